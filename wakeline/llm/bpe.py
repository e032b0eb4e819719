"""Byte-level BPE: a recursive DuckDB query in every partition merges all new words of a batch at once.

A word (a match of the splitting pattern) starts as one row a byte: its position and token. In each round the rows look up the
rank of their pair with the next row in the merge table, and each word's leftmost pair of least rank is contracted, until no
word has a pair. Decoding joins the ids with the vocabulary and concatenates the bytes in order.

Words are cut first wherever no token of the vocabulary that stands in the word reaches across: no merge can cross there, so the
parts merge alone, are short and repeat more than words do. Words and parts met before are looked up in tables that a Python
worker keeps; their size is bounded and they change no result. A full table becomes the older of two generations and what is met
again moves to the younger one, so common words are never merged anew, however many rare ones pass. Parts over LONG bytes (runs such as one repeated letter) contract
all their pairs of least rank in one round; that is the same unless a new pair ranks lower than the round that made it, which
the query notices: such parts go one pair a round.

Null texts are empty: no ids, and the hashes of the empty string. Every document gives one row, whatever ids repeat or are null.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import table

#: Parts that one query merges: its rows are what a worker holds beside its tables.
WORDS_AT_ONCE = 10_000
LONG = 64
#: Words and parts of a generation; a worker keeps two of each. Bytes of words that are cut at once.
KEPT_WORDS, KEPT_PARTS = 350_000, 200_000
CUT_BYTES = 1 << 18

# A state row: word, position, token, next token (-1 at the end), round, and the rank and position that the round contracted.
_ONE = """
with recursive s(w, pos, tok, nt, it, best) as (
  select w, pos, tok, nt, 0, 0::bigint from start
  union all
  select w, pos, case when pos = spot then merged else tok end,
         case when pos = spot then after when next_pos = spot then merged else nt end, it, best
  from (select *, (best & 1099511627775)::int spot, (best >> 40)::int merged from (
          select w, pos, tok, nt, it + 1 it, lag(pos) over o before, lead(nt) over o after, lead(pos) over o next_pos,
                 min((rank::bigint << 40) | pos) over (partition by w order by pos
                   rows between unbounded preceding and unbounded following) best
          from s left join merges m on s.tok::bigint * 65536 + s.nt = m.pair
          window o as (partition by w order by pos)))
  where best is not null and (before is null or before <> spot)
),
"""
_ALL = """
with recursive s(w, pos, tok, nt, it, best) as (
  select w, pos, tok, nt, 0, -1::bigint from start
  union all
  select w, pos, case when hit then least_rank else tok end,
         case when hit then case when after_hit then least_rank else after end when next_hit then least_rank else nt end,
         it, case when least_rank < best or best = -2 then -2 else least_rank end
  from (select *, lag(hit) over o before_hit, lead(hit) over o next_hit, lead(hit, 2) over o after_hit, lead(nt) over o after from (
          select *, coalesce(rank = least_rank and row_number() over (partition by w, run, rank = least_rank order by pos) % 2 = 1, false) hit from (
            select *, seq - sum((rank is not null and rank = least_rank)::int) over (partition by w order by pos) run from (
              select w, pos, tok, nt, it + 1 it, best, m.rank::bigint as rank, row_number() over (partition by w order by pos) seq,
                     min(m.rank::bigint) over (partition by w) least_rank
              from s left join merges m on s.tok::bigint * 65536 + s.nt = m.pair)))
        window o as (partition by w order by pos))
  where least_rank is not null and not coalesce(before_hit, false)
),
"""
_TAIL = """
last as (select w, max(it) it from s group by w)
select s.w, string_agg(s.tok::varchar, ',' order by s.pos) ids,
       string_agg(v.hexed, '' order by s.pos) decoded, min(s.best) = -2 doubtful
from s join last on s.w = last.w and s.it = last.it join vocabulary v on v.id = s.tok group by s.w
"""


class Coder:
    """The merge table in a DuckDB of this process, and the words met so far with their ids."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pairs = [(ranks[t[:i]] * 65536 + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.find = regex.compile(pattern).findall
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        # What a query frees goes back at once: the worker stands beside others for hours.
        freed = {f"allocator_{name}flush_threshold": "1MB" for name in ("", "bulk_deallocation_")}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "350MB", "preserve_insertion_order": False} | freed)
        for name, data in (("merges", {"pair": [p for p, _ in pairs], "rank": pa.array([r for _, r in pairs], pa.int32())}), ("vocabulary", {"id": pa.array(list(ranks.values()), pa.int32()), "hexed": [t.hex() for t in ranks]})):
            self.db.register("given", pa.table(data))
            self.db.execute(f"create table {name} as select * from given")
        #: Ids of words and parts, joined by commas: the younger generation and the older one.
        self.met: dict[str, str] = {}
        self.met_before: dict[str, str] = {}
        self.seen: dict[bytes, str] = {}
        self.seen_before: dict[bytes, str] = {}
        #: What parts decode to if it is not the part itself, and the words that hold such parts.
        self.odd: dict[bytes, bytes] = {}
        self.odd_words: dict[str, bytes] = {}
        self._trie(ranks)

    def _trie(self, ranks: dict[bytes, int]) -> None:
        """What tokens of two bytes or more start with, as nodes: single bytes are nodes 0 to 255, a step is node * 256 + byte."""
        begun = {t[:i] for t in ranks for i in range(2, len(t) + 1)}
        node = {bytes([i]): i for i in range(256)} | {t: i for i, t in enumerate(sorted(begun, key=len), 256)}
        steps = np.array([node[t[:-1]] * 256 + t[-1] for t in begun], np.int64)
        to, token = np.array([node[t] for t in begun], np.int64), np.array([t in ranks for t in begun])
        order = np.argsort(steps)
        self.steps, self.to, self.token = steps[order], to[order], token[order]

    def _bounds(self, data: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where parts start in bytes whose words end at `end`, told for each byte."""
        reach = np.arange(1, len(data) + 1)
        at, node, size = np.arange(len(data)), data.astype(np.int64), 1
        while len(at):
            more = at + size < end[at]
            at = at[more]
            step = node[more] * 256 + data[at + size]
            found = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            hit = self.steps[found] == step
            at, found, size = at[hit], found[hit], size + 1
            node, token = self.to[found], self.token[found]
            reach[at[token]] = at[token] + size
        far = np.maximum.accumulate(reach)
        return np.append(0, np.flatnonzero(far[:-1] <= np.arange(1, len(data))) + 1)

    def cut(self, words: list[bytes]) -> list[list[bytes]]:
        """Each word, none empty, cut where no token in it reaches across. What is cut at once holds CUT_BYTES, or one longer word."""
        out: list[list[bytes]] = []
        ends = np.cumsum([len(w) for w in words])
        first = 0
        while first < len(words):
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + CUT_BYTES, "right")))
            joined, own = b"".join(words[first:last]), ends[first:last] - before
            cuts = self._bounds(np.frombuffer(joined, np.uint8), np.repeat(own, np.diff(own, prepend=0)))
            pieces = [joined[a:b] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(joined)], strict=True)]
            places = [0, *np.searchsorted(cuts, own).tolist()]
            out += [pieces[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
            first = last
        return out

    def parts(self, word: bytes) -> list[bytes]:
        return self.cut([word])[0]

    def _merged(self, words: list[bytes], rounds: str) -> list[tuple]:
        size = np.array([len(w) for w in words])
        ends = np.cumsum(size)
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        nxt = np.append(tok[1:], -1)
        nxt[ends - 1] = -1
        pos = np.arange(len(tok)) - np.repeat(ends - size, size)
        self.db.register("start", pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), size), "pos": pos.astype(np.int32), "tok": tok, "nt": nxt.astype(np.int32)}))
        return self.db.execute(rounds + _TAIL).fetchall()

    def merged(self, parts: list[bytes]) -> dict[bytes, str]:
        """Of each part, none empty and none twice, its ids."""
        out = {}
        for some, rounds in (([p for p in parts if len(p) <= LONG], _ONE), ([p for p in parts if len(p) > LONG], _ALL)):
            for at in range(0, len(some), WORDS_AT_ONCE):
                coded = some[at : at + WORDS_AT_ONCE]
                for w, ids, decoded, doubtful in self._merged(coded, rounds):
                    if doubtful:
                        ((_, ids, decoded, _),) = self._merged([coded[w]], _ONE)
                    out[coded[w]] = ids
                    if (back := bytes.fromhex(decoded)) != coded[w]:
                        self.odd[coded[w]] = back
        return out

    def learn(self, new: list[str]) -> list[str]:
        """Adds words, new and not empty, to the younger generation and returns those over LONG bytes, which must not stay, so that
        the tables hold few bytes."""
        coded = [w.encode() for w in new]
        cut = self.cut(coded)
        distinct = {p for parts in cut for p in parts}
        need = distinct.difference(self.seen)
        if len(self.seen) + len(need) > KEPT_PARTS:
            self.seen_before, self.seen, need = self.seen, {}, distinct
        again = {p: x for p in need if (x := self.seen_before.get(p)) is not None}
        self.seen |= again
        long = self.merged(sorted(need.difference(again)))
        self.seen |= long
        for w, parts in zip(new, cut, strict=True):
            self.met[w] = self.seen[parts[0]] if len(parts) == 1 else ",".join([self.seen[p] for p in parts])
            if self.odd and any(p in self.odd for p in parts):
                self.odd_words[w] = b"".join([self.odd.get(p, p) for p in parts])
        for p in [p for p in long if len(p) > LONG]:
            del self.seen[p]
        return [w for w, c in zip(new, coded, strict=True) if len(c) > LONG]

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """Of each text the number of ids, the ids joined by commas, and the bytes that the ids decode to."""
        for at in range(0, len(texts), 512):
            split = [self.find(t) for t in texts[at : at + 512]]
            distinct = set().union(*split)
            new = distinct.difference(self.met)
            if len(self.met) + len(new) > KEPT_WORDS:
                self.met_before, self.met, new = self.met, {}, distinct
            again = {w: x for w in new if (x := self.met_before.get(w)) is not None}
            self.met |= again
            long = self.learn(sorted(new.difference(again)))
            for words in split:
                ids = ",".join(map(self.met.__getitem__, words))
                whole = not self.odd_words or self.odd_words.keys().isdisjoint(words)
                back = "".join(words).encode() if whole else b"".join([self.odd_words.get(w) or w.encode() for w in words])
                yield ids.count(",") + 1 if ids else 0, ids, back
            for w in long:
                del self.met[w]


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", id_col: str = "doc_id", hashed: bool = False, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) and decoded (binary); hashed: the SHA-256 of both instead.

    keep: a Python worker keeps its tables from one partition to the next; else it frees them for the stages that follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids, back = [], [], []
            for count, joined, data in own.encode(texts):
                n.append(count)
                ids.append(hashlib.sha256(joined.encode()).hexdigest() if hashed else np.fromstring(joined, np.int32, sep=",") if joined else np.empty(0, np.int32))
                back.append(hashlib.sha256(data).hexdigest() if hashed else data)
            kinds = (pa.string(), pa.string()) if hashed else (pa.list_(pa.int32()), pa.binary())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, kinds[0]), pa.array(back, kinds[1])], ["doc_id", "n_tokens", *names])
        if not keep:
            coder.cache_clear()

    names = ("ids_sha256", "decoded_sha256") if hashed else ("ids", "decoded")
    kinds = "ids_sha256 string, decoded_sha256 string" if hashed else "ids array<int>, decoded binary"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the public multilingual rank file, which every executor has installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), *vocabulary(), hashed=True)
