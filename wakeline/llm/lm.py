"""Language-model scoring: a trigram model of the learning rows in sharded Elias-Fano tries, asked by every text.

Texts are words (A-Z lower-cased) and one end token. They are cut into blocks of about BLOCK tokens, coded by the block's own
distinct words and staged, so every later step sees the same blocks. Three exchanges follow, each of a row for a block and bucket
with packed, pre-aggregated keys:

1. words by hash: counts and numbers of all words; counts give the base score exactly;
2. for words of more than HOT occurrences only: counts of the pairs that they are in, by hash;
3. distinct trigrams by middle word. A hot middle word's trigrams are dealt over a square grid by the words at both sides, with the
   counts that step 2 told, so no word, pair or context lands in one task; trigrams around unknown words are dealt by the sides.

The task of a bucket builds its trie (see trie.py) from the learning rows' counts and answers every block's trigrams with a
quantised log10 probability; blocks add up the answers of each text. Probabilities are Dirichlet-smoothed: trigrams by bigrams,
bigrams by words, words by one count for each, as the base score. A word that no learning row holds has count 0. Sums of quantised
values are sums of integers, so scores don't depend on partitions. N-grams are neither capped nor pruned: the model grows with
the corpus. Words, pairs and numbers are told apart by 64-bit hashes.

Null and empty texts are the end token alone. Rows without id are never learned from and count as held out. Repeated rows are
documents of their own. A model without learning rows gives every token probability 1. Columns but the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import staged, table
from wakeline.llm.shingles import mixed, words
from wakeline.llm.trie import CODES, Trie, code

FOLDS, HELD_FOLD = 7, 2
#: Tokens of a block, about so many token occurrences of a bucket of trigrams, and bytes of text for each bucket of words.
BLOCK, BUCKET, WORD_BYTES = 1 << 21, 1 << 19, 16 << 20
#: Trigrams that a trie is asked for at once.
ASKED = 1 << 17
#: A middle word with more occurrences than this is dealt over several buckets.
HOT = 1 << 22
#: Strengths of the lower orders: words behind bigrams, bigrams behind trigrams. Chosen on one seventh of the learning rows of sf0.1.
PRIORS = (3000.0, 3.0)
END, BEGIN_KEY = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
BEGIN, UNKNOWN, FIRST = 0, 1, 2
U64 = np.uint64


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays, byte by byte plane, compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *planes]))


def expanded(body: bytes, *kinds: str) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    at, out = 8 * len(kinds), []
    for n, kind in zip(data[:at].view(np.int64).tolist(), kinds, strict=True):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def _record(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(names.values())], list(names))


_BLOCK = {"block": pa.int64(), "ids": pa.list_(pa.int64()), "learn": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int32()), "tokens": pa.binary(), "begin": pa.int32(), "hashes": pa.binary(), "counts": pa.binary()}
BLOCK_ROW = "block long, ids array<long>, learn array<boolean>, lengths array<int>, tokens binary, begin int, hashes binary, counts binary"


def blocks(docs: DataFrame, learn: Column, text: str, id_col: str) -> DataFrame:
    """Staged: a row for some documents with their tokens as places in the block's sorted word hashes, and these hashes with their
    counts in the learning rows. The begin mark has a hash, too; its count is that of learning texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, bool, np.ndarray]] = []
        size = 0

        def row() -> pa.RecordBatch:
            lengths = np.array([len(h) for _, _, h in held], np.int32)
            learned = np.array([f for _, f, _ in held], bool)
            keys, place = np.unique(np.concatenate([*[h for _, _, h in held], [BEGIN_KEY]]), return_inverse=True)
            counts = np.bincount(place[:-1][np.repeat(learned, lengths)], minlength=len(keys))
            counts[place[-1]] = learned.sum()
            return _record(_BLOCK, [(number, [i for i, _, _ in held], learned, lengths, squeezed(place[:-1].astype(np.uint32)), int(place[-1]), keys.tobytes(), squeezed(counts.astype(np.uint32)))])

        for batch in batches:
            ids, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, flag, text_ in zip(ids, flags, batch.column(2), strict=True):
                _, h = words(np.frombuffer((text_.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8))
                held.append((i, flag, np.append(h, END)))
                size += len(h) + 1
                if size >= BLOCK:
                    yield row()
                    held, size, number = [], 0, number + 1
        if held:
            yield row()

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).cast("string").alias("text"))
    return staged(named.mapInArrow(cut, BLOCK_ROW), "blocks")


_REPLY = {"block": pa.int64(), "bucket": pa.int32(), "body": pa.binary(), "n": pa.int64(), "v": pa.int64(), "most": pa.int64()}
REPLY_ROW = "block long, bucket int, body binary, n long, v long, most long"


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows (block, bucket, body) sorted by bucket: each bucket with its (block, body) rows."""
    at, rows = None, []
    for batch in batches:
        for block, bucket, body in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            if bucket != at and rows:
                yield at, rows
                rows = []
            at = bucket
            rows.append((block, body))
    if rows:
        yield at, rows


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    return rows.select("block", "bucket", "body").repartition(n, "bucket").sortWithinPartitions("bucket")


def counted(keys: DataFrame, bits: int) -> DataFrame:
    """keys: block, hashes (sorted, packed), counts. Staged: for each block and bucket of hashes their numbers in the bucket (-1 where
    no learning row holds them) and whole counts, in the block's order; and a row without block for each bucket with its sum of
    counts, its number of counted hashes and the largest count."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, n = np.frombuffer(hashes, U64), expanded(counts, "u4")[0]
                cuts = [0, *np.searchsorted(h, np.arange(1, 1 << bits, dtype=U64) << U64(64 - bits)), len(h)] if bits else [0, len(h)]
                rows = [(block, b, h[cuts[b] : cuts[b + 1]].tobytes() + n[cuts[b] : cuts[b + 1]].tobytes()) for b in range(1 << bits) if cuts[b] < cuts[b + 1]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["block", "bucket", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _buckets(batches):
            sizes = [len(body) // 12 for _, body in rows]
            h = np.concatenate([np.frombuffer(body, U64, k) for (_, body), k in zip(rows, sizes, strict=True)])
            n = np.concatenate([np.frombuffer(body, np.uint32, k, 8 * k) for (_, body), k in zip(rows, sizes, strict=True)])
            keys, place = np.unique(h, return_inverse=True)
            total = np.bincount(place, weights=n).astype(np.int64)
            known = (total > 0) & (keys != BEGIN_KEY)
            number = np.where(known, np.cumsum(known) - 1, -1)
            cuts = np.cumsum([0, *sizes])
            some = [(block, bucket, squeezed(number[place[a:b]], total[place[a:b]]), None, None, None) for (block, _), a, b in zip(rows, cuts[:-1], cuts[1:], strict=True)]
            yield _record(_REPLY, [*some, (None, bucket, None, int(total[known].sum()), int(known.sum()), int(total.max(initial=0)))])

    return staged(_dealt(keys.mapInArrow(pack, "block long, bucket int, body binary"), 1 << bits).mapInArrow(add, REPLY_ROW), "counted")


def _joined(own: DataFrame, replies: dict[str, DataFrame]) -> DataFrame:
    """The rows of the blocks with each table of replies as an array of (bucket, body)."""
    for name, rows in replies.items():
        told = rows.where(F.col("block").isNotNull()).groupBy("block").agg(F.collect_list(F.struct("bucket", "body")).alias(name))
        own = own.join(told, "block", "left")
    return own


class _Block:
    """A block with the numbers and counts of its words."""

    def __init__(self, row: dict, bits: int) -> None:
        self.block, self.ids, self.learn = row["block"], row["ids"], np.array(row["learn"], bool)
        self.lengths = np.array(row["lengths"], np.int64)
        self.tokens = expanded(row["tokens"], "u4")[0].view(np.int32)
        parts = [(r["bucket"], *expanded(r["body"], "i8", "i8")) for r in sorted(row["words"], key=lambda r: r["bucket"])]
        self.count = np.concatenate([p[2] for p in parts])
        rank = np.concatenate([p[1] for p in parts])
        bucket = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        self.word = np.where(rank >= 0, FIRST + (rank << bits) + bucket, UNKNOWN)
        self.begin = row["begin"]
        self.word[self.begin] = BEGIN

    def trigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct trigrams as places of their words, in a fixed order; the one of each token; and counts in the learning rows."""
        starts = np.cumsum(self.lengths) - self.lengths
        begin = np.array([self.begin], np.int32)
        before = np.concatenate([begin, self.tokens[:-1]])
        before[starts] = self.begin
        first = np.concatenate([begin, before[:-1]])
        first[starts] = self.begin
        if len(self.word) < 1 << 21:
            keys = before.astype(np.int64)
            for part in (self.tokens, first):
                keys <<= 21
                keys |= part
            keys, one = np.unique(keys, return_inverse=True)
            a, b, c = ((keys >> shift & 0x1FFFFF).astype(np.int32) for shift in (0, 42, 21))
        else:
            order = np.lexsort((first, self.tokens, before))
            a, b, c = first[order], before[order], self.tokens[order]
            fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
            one = np.empty(len(order), np.int64)
            one[order] = np.cumsum(fresh) - 1
            a, b, c = a[fresh], b[fresh], c[fresh]
        learned = np.bincount(one[np.repeat(self.learn, self.lengths)], minlength=len(a)).astype(np.uint32)
        return a, b, c, one, learned


def _pair_key(side: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mixed(mixed(x.astype(U64) * U64(2) + U64(side)) + y.astype(U64))


def _pairs(own: _Block, split: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted hashes of the pairs around hot middle words, their counts in the learning rows, and for both kinds of pairs, (w1, w2)
    and (w2, w3), the place of each distinct trigram's pair, -1 where the word isn't hot."""
    a, b, c, _, learned = own.trigrams()
    hot = np.flatnonzero(own.count[b] > split)
    keys = np.concatenate([_pair_key(0, own.word[b[hot]], own.word[a[hot]]), _pair_key(1, own.word[b[hot]], own.word[c[hot]])])
    known, place = np.unique(keys, return_inverse=True)
    counts = np.bincount(place, weights=np.tile(learned[hot], 2), minlength=len(known)).astype(np.uint32)
    both = []
    for part in (place[: len(hot)], place[len(hot) :]):
        at = np.full(len(a), -1)
        at[hot] = part
        both.append(at)
    return known, counts, both


def _bucket_of(own: _Block, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: int, split: int) -> np.ndarray:
    """By middle word; hot ones by a grid of both sides, unknown ones by the sides."""
    to = lambda word, part: (mixed(mixed(word.astype(U64)) + part) % U64(n)).astype(np.int32)
    out = to(own.word, np.zeros(len(own.word), U64))[b]
    apart = np.flatnonzero(((own.count > split) | (own.word == UNKNOWN))[b])
    w1, w3 = (own.word[x[apart]].astype(U64) for x in (a, c))
    grid = np.ceil(np.sqrt(np.maximum(own.count[b[apart]], 1) / split)).astype(U64)
    part = np.where(own.word[b[apart]] == UNKNOWN, mixed(w1 * U64(3) + mixed(w3)), (mixed(w1) % grid) * grid + mixed(w3 + U64(7)) % grid)
    out[apart] = to(own.word[b[apart]], part)
    return out


class Model:
    """What the steps share: the blocks, the replies, and the sums N (tokens) and V (words) of the learning rows."""

    def __init__(self, docs: DataFrame, learn: Column, text: str = "text", id_col: str = "doc_id", priors: tuple[float, float] = PRIORS, split: int = HOT) -> None:
        self.priors, self.split = priors, split
        self.blocks = blocks(docs, learn, text, id_col)
        size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0
        self.bits = max(0, size // WORD_BYTES).bit_length()
        self.words = counted(self.blocks.select("block", "hashes", "counts"), self.bits)
        all_ = self.words.where("block is null").agg(F.sum("n"), F.sum("v"), F.max("most")).first()
        self.tokens, self.known, most = (x or 0 for x in all_)
        seen = self.blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
        self.n_buckets = max(1, -(-seen // BUCKET))
        self.replies = {"words": self.words}
        if most > split:
            self.replies["pairs"] = counted(self._hot(), self.bits)

    def _of_blocks(self, told: Callable[[_Block, dict], pa.RecordBatch | None], schema: str, more: dict[str, DataFrame] | None = None) -> DataFrame:
        """told(block, row) for every block with the replies so far and `more`."""
        bits = self.bits

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    if (out := told(_Block(row, bits), row)) is not None:
                        yield out

        return _joined(self.blocks.select("block", "ids", "learn", "lengths", "tokens", "begin"), self.replies | (more or {})).mapInArrow(each, schema)

    def _hot(self) -> DataFrame:
        split = self.split

        def told(own: _Block, _: dict) -> pa.RecordBatch:
            keys, counts, _ = _pairs(own, split)
            return _record({"block": pa.int64(), "hashes": pa.binary(), "counts": pa.binary()}, [(own.block, keys.tobytes(), squeezed(counts))] if len(keys) else [])

        return self._of_blocks(told, "block long, hashes binary, counts binary")

    def asked(self) -> DataFrame:
        """block, bucket, body: the distinct trigrams of every block, with their counts in the learning rows."""
        n, split, total, known = self.n_buckets, self.split, self.tokens, self.known

        def told(own: _Block, row: dict) -> pa.RecordBatch:
            a, b, c, _, learned = own.trigrams()
            to = _bucket_of(own, a, b, c, n, split)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(n + 1))
            p1 = code((own.count + 1) / (total + known + 1))
            counts = []
            if row.get("pairs"):
                _, _, places = _pairs(own, split)
                sums = np.concatenate([expanded(r["body"], "i8", "i8")[1] for r in sorted(row["pairs"], key=lambda r: r["bucket"])])
                counts = [np.where(places[0] >= 0, own.count[b], 0), *[np.where(p >= 0, sums[np.maximum(p, 0)], 0) for p in places]]
            rows = []
            for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[bucket] : cuts[bucket + 1]]
                rows.append((own.block, bucket, _asking(own, a[at], b[at], c[at], p1, learned[at], [x[at] for x in counts])))
            return _record({"block": pa.int64(), "bucket": pa.int32(), "body": pa.binary()}, rows)

        return self._of_blocks(told, "block long, bucket int, body binary")

    def _by_bucket(self, told: Callable[[int, _Asked, bytes], Iterator[tuple]], names: dict[str, pa.DataType], schema: str) -> DataFrame:
        priors = self.priors

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, rows in _buckets(batches):
                asked = _Asked(rows)
                yield _record(names, list(told(bucket, asked, asked.trie(priors))))

        return _dealt(self.asked(), self.n_buckets).mapInArrow(each, schema)

    def levels(self) -> DataFrame:
        """bucket, trie: the model itself, one buffer of compact levels for each bucket (see Trie)."""
        return self._by_bucket(lambda bucket, _, trie: iter([(bucket, trie)]), {"bucket": pa.int32(), "trie": pa.binary()}, "bucket int, trie binary")

    def answers(self) -> DataFrame:
        """block, bucket, body: the codes of the block's trigrams in the order in which it asked."""
        told = lambda bucket, asked, trie: ((block, bucket, body) for block, body in asked.answers(Trie(trie)))
        return self._by_bucket(told, {"block": pa.int64(), "bucket": pa.int32(), "body": pa.binary()}, "block long, bucket int, body binary")

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
        answers = staged(self.answers(), "answers")
        n, split, total, known = self.n_buckets, self.split, self.tokens, self.known

        def told(own: _Block, row: dict) -> pa.RecordBatch | None:
            a, b, c, one, _ = own.trigrams()
            order = np.argsort(_bucket_of(own, a, b, c, n, split), kind="stable")
            codes = np.empty(len(a), np.int64)
            codes[order] = np.concatenate([expanded(r["body"], "u2")[0] for r in sorted(row["codes"], key=lambda r: r["bucket"])])
            starts = np.cumsum(own.lengths) - own.lengths
            count = own.count[own.tokens]
            base = np.add.reduceat(np.log10(count + 1.0), starts) - own.lengths * np.log10(total + known + 1.0)
            score = np.add.reduceat(codes[one], starts) / -float(CODES)
            return pa.record_batch([pa.array(own.ids, pa.int64()), pa.array(~own.learn), pa.array(own.lengths), pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)), pa.array(np.full(len(starts), total, np.int64)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return self._of_blocks(told, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", {"codes": answers})


def _asking(own: _Block, a: np.ndarray, b: np.ndarray, c: np.ndarray, p1: np.ndarray, learned: np.ndarray, counts: list[np.ndarray]) -> bytes:
    """A block's trigrams for a bucket: the words at the sides by their places in a list of numbers and codes, the middle ones, which
    come in runs, by run. The first byte says whether hot words' counts come along."""
    sides = own.word[np.concatenate([c, a])]
    numbers, first, place = np.unique(sides, return_index=True, return_inverse=True)
    known = p1[np.concatenate([c, a])[first]]
    turn = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    runs = np.diff(np.append(turn, len(b)))
    return bytes([bool(counts)]) + squeezed(np.diff(numbers, prepend=0), known, place[: len(c)].astype(np.uint32), place[len(c) :].astype(np.uint32), own.word[b[turn]], runs.astype(np.uint32), learned.astype(np.uint32), *counts)


class _Asked:
    """The trigrams that all blocks ask a bucket for, each once, with their counts in the learning rows of all blocks."""

    def __init__(self, rows: list[tuple[int, bytes]]) -> None:
        self.blocks, parts, told = [b for b, _ in rows], [], []
        for _, body in rows:
            steps, known, third, first, middle, runs, learned, *counts = expanded(body[1:], "i8", "u2", "u4", "u4", "i8", "u4", "u4", *["i8"] * (3 if body[0] else 0))
            numbers = np.cumsum(steps)
            parts.append((numbers[first], np.repeat(middle, runs), numbers[third], known[third], learned))
            told.append(np.array(counts) if counts else None)
        self.sizes = [len(p[0]) for p in parts]
        w1, w2, w3, p1, n = (np.concatenate([p[i] for p in parts]) for i in range(5))
        order = np.lexsort((w1, w3, w2))
        w1, w2, w3 = w1[order], w2[order], w3[order]
        fresh = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (w3[1:] != w3[:-1])])
        at = np.flatnonzero(fresh)
        self.one = np.empty(len(order), np.int64)
        self.one[order] = np.cumsum(fresh) - 1
        self.words, self.p1, self.n = (w1[at], w2[at], w3[at]), p1[order[at]].astype(np.int64), np.add.reduceat(n[order].astype(np.int64), at)
        self.told = None
        if any(t is not None for t in told):
            self.told = np.concatenate([np.zeros((3, k), np.int64) if t is None else t for t, k in zip(told, self.sizes, strict=True)], axis=1)[:, order[at]]

    def trie(self, priors: tuple[float, float]) -> bytes:
        """The levels of the learning rows' trigrams, and of the hot words' pairs that are counted elsewhere."""
        at = np.flatnonzero((self.n > 0) if self.told is None else (self.n > 0) | (self.told.max(axis=0) > 0))
        return Trie.built(*(w[at] for w in self.words), self.n[at], self.p1[at], priors, None if self.told is None else self.told[:, at])

    def answers(self, trie: Trie) -> Iterator[tuple[int, bytes]]:
        parts = [slice(i, i + ASKED) for i in range(0, len(self.p1), ASKED)]
        codes = np.concatenate([trie.codes(*(w[p] for w in self.words), self.p1[p]) for p in parts])[self.one]
        cuts = np.cumsum([0, *self.sizes])
        for block, lo, hi in zip(self.blocks, cuts[:-1], cuts[1:], strict=True):
            yield block, squeezed(codes[lo:hi])


def score(docs: DataFrame, learn: Column, text: str = "text", id_col: str = "doc_id", priors: tuple[float, float] = PRIORS, split: int = HOT) -> DataFrame:
    """The scores of all rows by a model of the rows for which `learn` is true."""
    return Model(docs, learn, text, id_col, priors, split).scores()


def op13_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_FOLD)
