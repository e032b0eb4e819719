"""Exact substring removal: every byte that a LENGTH-byte string covers which also starts in a document with a smaller id.

1. Every LENGTH-byte window has an anchor, the GRAM-byte string of least hash in it; equal windows have equal anchors. One
   pass finds the anchors that different texts share. Copies of a whole text need no search: all but the smallest id go.
2. The windows of each shared anchor travel as one segment of bytes to the task of that anchor. There a suffix array of all
   segments is sorted deep-shallow: multikey quicksort by words of eight bytes to SHALLOW bytes, then blind tries, which branch
   only on words in which their suffixes differ, order the groups that still agree. Equal windows end side by side.
3. Anchors of very many documents would gather in one task. Their segments are reduced to distinct ones first, whose windows
   are spread by their own bytes and joined back.

Null texts are empty. Texts under LENGTH bytes lose nothing. Rows with null ids neither lose nor remove anything. Rows that
repeat an id are no reason for each other's removal; each is judged with its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import staged, table
from wakeline.llm.shingles import _BYTE, mixed, powers

LENGTH = 50
GRAM = 20
SHALLOW = 16
#: Groups of up to this many suffixes are sorted plainly, as quicksort does with its small parts.
SMALL = 2048
PIECE = 1 << 19
FLUSH_BYTES = 6 << 20
BUCKET_BYTES = 24 << 20
#: An anchor with more documents than this, in one flush or in all, is hot.
HOT_FLUSH, HOT = 512, 20_000
_ORDER = np.random.default_rng(7).permutation(_BYTE) | np.uint64(1)
_POS_BITS = 20


def _anchored(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first and last window start, anchor's place and hash. ends: where texts end in data."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, np.empty(0, np.uint64)
    up, down = powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_ORDER[data] * up, dtype=np.uint64)])
    h = mixed((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])
    m = ((h >> np.uint64(_POS_BITS)) << np.uint64(_POS_BITS)) | np.arange(len(h), dtype=np.uint64)
    span, wide = LENGTH - GRAM + 1, 1
    while wide * 2 <= span:
        m = np.minimum(m[:-wide], m[wide:])
        wide *= 2
    m = np.minimum(m[: len(m) - (span - wide)], m[span - wide :])
    place = (m & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
    fits = np.ones(len(place), bool)  # a window must not pass the end of its text
    for e in ends[:-1]:
        fits[max(0, e - LENGTH + 1) : e] = False
    starts = np.flatnonzero(fits)
    if not len(starts):
        return none, none, none, np.empty(0, np.uint64)
    new = np.concatenate([[True], (np.diff(place[starts]) != 0) | (np.diff(starts) != 1)])
    lo = starts[new]
    hi = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    return lo, hi, place[lo], h[place[lo]]


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts: index of the text, first and last window start, anchor's place (all in the text), anchor's hash.

    Long texts are cut into pieces that overlap by LENGTH - 1 bytes, so every window is in just one of them.
    """
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def done() -> tuple[np.ndarray, ...]:
        firsts = np.cumsum([0] + [len(p) for _, _, p in group])
        lo, hi, place, h = _anchored(np.frombuffer(b"".join(p for _, _, p in group), np.uint8), firsts[1:])
        of = np.searchsorted(firsts, lo, side="right") - 1
        shift = np.array([at for _, at, _ in group])[of] - firsts[of] if len(lo) else lo
        return np.array([i for i, _, _ in group])[of] if len(lo) else lo, lo + shift, hi + shift, place + shift, h

    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), PIECE - LENGTH + 1):
            piece = t[at : at + PIECE]
            if len(piece) < LENGTH:
                continue
            if size + len(piece) > PIECE:
                yield done()
                group, size = [], 0
            group.append((i, at, piece))
            size += len(piece)
    if group:
        yield done()


def _asked(docs: DataFrame, bits: int) -> DataFrame:
    """Packed anchors of every flush: one row for each bucket with, by document, 32 more bits of each hash and its place (in byte
    planes), and the number of each document's anchors; `direct` rows hold places already known to be shared, and hot.

    Anchors are least hashes, so most are small: buckets go by the bits of the hash mixed once more.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, int] = {}
        texts: dict[bytes, bytes] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = list(texts)
            name = int.from_bytes(hashlib.sha256(b"".join(keys)).digest()[:8], "big", signed=True)
            own = np.array([ids[k] for k in keys], np.int64)
            cls = np.frombuffer(b"".join(k[:8] for k in keys), ">i8").astype(np.int64)
            parts = list(runs([texts[k] for k in keys]))
            d = np.concatenate([np.empty(0, np.int64), *(p[0] for p in parts)]).astype(np.int64)
            place = np.concatenate([np.empty(0, np.int64), *(p[3] for p in parts)])
            h = np.concatenate([np.empty(0, np.uint64), *(p[4] for p in parts)])
            order = np.argsort(h, kind="stable")
            d, place, h = d[order], place[order], h[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
            count = np.diff(np.append(first, len(h)))
            hot = np.repeat(count > HOT_FLUSH, count) & (np.repeat(np.minimum.reduceat(d, first), count) != np.repeat(np.maximum.reduceat(d, first), count)) if len(h) else np.empty(0, bool)
            witness = np.zeros(len(h), bool)
            witness[first] = True
            rows: list[tuple] = []
            keep = ~hot | witness  # a hot anchor sends one witness to its bucket
            even = mixed(h)
            bucket = (even >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            for direct, mask in ((False, keep), (True, hot)):
                if not mask.any():
                    continue
                b = bucket[mask] if not direct else d[mask] % (1 << bits)
                turn = np.lexsort((place[mask], d[mask], b))
                cuts = np.flatnonzero(np.append(True, np.diff(b[turn]) != 0))
                short = ((even[mask][turn] << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                dd, pp, ww = d[mask][turn], place[mask][turn], hot[mask][turn]
                for a, z in zip(cuts, np.append(cuts[1:], len(turn)), strict=True):
                    named, each = np.unique(dd[a:z], return_counts=True)
                    planes = pp[a:z].astype(np.uint32).view(np.uint8).reshape(-1, 4).T
                    rows.append((name, int(b[turn[a]]), direct, b"" if direct else short[a:z].tobytes(), each.astype(np.uint32).tobytes(), planes.tobytes(), np.packbits(ww[a:z]).tobytes(), own[named].tobytes(), cls[named].tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 6]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["flush", "bucket", "direct", "h", "d", "p", "w", "ids", "cls"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                coded = text.encode("utf-8", "surrogatepass")
                key = hashlib.sha256(coded).digest()
                if key not in texts:
                    texts[key] = coded
                    size += len(coded)
                ids[key] = min(doc_id, ids.get(key, doc_id))
                if size >= FLUSH_BYTES:
                    yield flush()
                    ids, texts, size = {}, {}, 0
        if texts:
            yield flush()

    return docs.mapInArrow(pack, "flush long, bucket int, direct boolean, h binary, d binary, p binary, w binary, ids binary, cls binary")


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Where rows sorted by keys start a new combination of them."""
    return np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))) if len(keys[0]) else np.empty(0, np.int64)


def _shared(asked: DataFrame) -> DataFrame:
    """doc_id, cls, hot, p: the places in each document of anchors that another text has, too.

    A bucket answers each flush in one packed row; the answers to a flush are then put together by document.
    """

    def shared(given: pa.Table) -> pa.Table:
        h, row, ids, cls, p, w = [], [], [], [], [], []
        ready: list[tuple[np.ndarray, ...]] = []
        flush = given.column("flush").to_pylist()
        for i, r in enumerate(given.to_pylist()):
            each = np.frombuffer(r["d"], np.uint32)
            place = np.ascontiguousarray(np.frombuffer(r["p"], np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0]
            own, kind = np.repeat(np.frombuffer(r["ids"], np.int64), each), np.repeat(np.frombuffer(r["cls"], np.int64), each)
            source = np.full(len(place), i)
            if r["direct"]:
                ready.append((source, own, kind, np.ones(len(place), bool), place))
                continue
            h.append(np.frombuffer(r["h"], np.uint32))
            for held, new in ((row, source), (ids, own), (cls, kind), (p, place)):
                held.append(new)
            w.append(np.unpackbits(np.frombuffer(r["w"], np.uint8), count=len(place)).astype(bool))
        if h:
            h, row, ids, cls, p, w = (np.concatenate(x) for x in (h, row, ids, cls, p, w))
            order = np.argsort(h, kind="stable")
            h, row, ids, cls, p, w = h[order], row[order], ids[order], cls[order], p[order], w[order]
            first = _cuts(h)
            count = np.diff(np.append(first, len(h)))
            hot = np.logical_or.reduceat(w, first) | (count > HOT)
            many = (np.minimum.reduceat(cls, first) != np.maximum.reduceat(cls, first)) | hot
            keep = np.repeat(many, count)
            ready.append((row[keep], ids[keep], cls[keep], np.repeat(hot, count)[keep], p[keep]))
        out: list[tuple] = []
        if ready:
            row, ids, cls, hot, p = (np.concatenate(x) for x in zip(*ready, strict=True))
            order = np.lexsort((p, hot, cls, ids, row))
            row, ids, cls, hot, p = row[order], ids[order], cls[order], hot[order], p[order]
            entry = _cuts(row, ids, cls, hot)
            each = np.diff(np.append(entry, len(row))).astype(np.uint32)
            at = _cuts(row[entry])
            for a, z in zip(at, [*at[1:], len(entry)], strict=True):
                e = entry[a:z]
                out.append((flush[row[e[0]]], ids[e].tobytes(), cls[e].tobytes(), hot[e].tobytes(), each[a:z].tobytes(), p[e[0] : entry[z] if z < len(entry) else len(p)].tobytes()))
        kinds = (pa.int64(), *[pa.binary()] * 5)
        return pa.table({n: pa.array([x[i] for x in out], k) for i, (n, k) in enumerate(zip(("flush", "ids", "cls", "hot", "d", "p"), kinds, strict=True))})

    def by_document(given: pa.Table) -> pa.Table:
        ids, cls, hot, p = [], [], [], []
        for r in given.to_pylist():
            each = np.frombuffer(r["d"], np.uint32)
            for held, name, kind in ((ids, "ids", np.int64), (cls, "cls", np.int64), (hot, "hot", np.bool_)):
                held.append(np.repeat(np.frombuffer(r[name], kind), each))
            p.append(np.frombuffer(r["p"], np.uint32))
        ids, cls, hot, p = (np.concatenate(x) for x in (ids, cls, hot, p))
        order = np.lexsort((p, hot, cls, ids))
        ids, cls, hot, p = ids[order], cls[order], hot[order], p[order]
        at = _cuts(ids, cls, hot)
        places = [p[a:z].tobytes() for a, z in zip(at, [*at[1:], len(p)], strict=True)]
        return pa.table({"doc_id": ids[at], "cls": cls[at], "hot": hot[at], "p": pa.array(places, pa.binary())})

    answers = asked.groupBy("bucket").applyInArrow(shared, "flush long, ids binary, cls binary, hot binary, d binary, p binary")
    return answers.groupBy("flush").applyInArrow(by_document, "doc_id long, cls long, hot boolean, p binary")


def _segments(texts: DataFrame, places: DataFrame) -> DataFrame:
    """h, seg, doc_id, cls, lo: the bytes that the windows of a shared anchor cover, and where they start."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            coded = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            asked = [np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in p])) for p in batch.column(3).to_pylist()]
            for d, lo, hi, place, h in runs(coded):
                some = np.zeros(len(d), bool)
                for i in np.unique(d):
                    own = slice(*np.searchsorted(d, (i, i + 1)))
                    some[own] = np.isin(place[own], asked[i])
                d, lo, hi, h = d[some], lo[some], hi[some], h[some]
                seg = [coded[i][a : z + LENGTH] for i, a, z in zip(d.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(seg, pa.binary()), pa.array(ids[d]), pa.array(cls[d]), pa.array(lo, pa.int32())], ["h", "seg", "doc_id", "cls", "lo"])

    return texts.join(places, ["doc_id", "cls"]).select("doc_id", "cls", "text", "p").mapInArrow(cut, "h long, seg binary, doc_id long, cls long, lo int")


def _quicksorted(a: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey quicksort to SHALLOW bytes, a character being the word a[start + depth] of eight bytes.

    Each group has a median of three as pivot and splits into less, equal and greater; the equal part goes on with its next word.
    All groups split in one pass, which numpy does at once. Groups of up to SMALL rows are left to plain sorting. Returns the
    starts, whether each opens a new group, and the depth from which its group is not yet in order.
    """
    order, opens, sorted_to = starts.copy(), np.zeros(len(starts), bool), np.full(len(starts), SHALLOW)
    opens[:1] = True
    rows, size, depth = np.arange(len(order)), np.array([len(order)]), np.zeros(1, np.int64)
    while True:
        large = size > SMALL
        stays = np.repeat(large, size)
        sorted_to[rows[~stays]] = np.repeat(depth, size)[~stays]
        rows, size, depth = rows[stays], size[large], depth[large]
        if not len(size):
            return order, opens, sorted_to
        first, held = np.cumsum(size) - size, order[rows]
        word = a[held + np.repeat(depth, size)]
        pivot = np.repeat(np.sort(np.stack([word[first], word[first + size // 2], word[first + size - 1]]), axis=0)[1], size)
        sides = [word < pivot, word == pivot, word > pivot]
        parts = np.stack([np.add.reduceat(side, first, dtype=np.int64) for side in sides])
        begins = first + np.cumsum(parts, axis=0) - parts
        to = np.empty(len(rows), np.int64)
        for side, n, at in zip(sides, parts, begins, strict=True):
            to[side] = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
        order[rows[to]] = held
        parts, begins, deeper = parts.T.ravel(), begins.T.ravel(), np.stack([depth, depth + 8, depth], axis=1).ravel()
        opens[rows[begins[parts > 0]]] = True
        go = (parts > 1) & (deeper < SHALLOW)
        rows, size, depth = rows[np.repeat(go, parts)], parts[go], deeper[go]


def equal_windows(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts in suffix order, and for each whether it opens a new group of equal LENGTH-byte windows."""
    a = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for shift, step in ((8, 1), (16, 2), (32, 4)):
        a = (a[:-step] << np.uint64(shift)) | a[step:]
    order, opens, sorted_to = _quicksorted(a, starts)
    for depth in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        group = np.cumsum(opens) - 1
        rows = np.flatnonzero((np.bincount(group)[group] > 1) & (sorted_to <= depth)) if len(order) else order
        if not len(rows):
            continue
        word = a[order[rows] + depth]
        if depth >= SHALLOW:  # deep: a blind trie's node passes over a word on which all its suffixes agree
            cuts = np.flatnonzero(np.append(True, np.diff(group[rows]) != 0))
            differ = np.minimum.reduceat(word, cuts) != np.maximum.reduceat(word, cuts)
            branch = np.repeat(differ, np.diff(np.append(cuts, len(rows))))
            rows, word = rows[branch], word[branch]
            if not len(rows):
                continue
        turn = np.lexsort((word, group[rows]))
        order[rows] = order[rows][turn]
        word = word[turn]
        opens[rows[1:]] |= (np.diff(word) != 0) & (np.diff(rows) == 1)
    return order, opens


def _marked(segments: list[bytes], doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the segments of one task: their numbers and the byte runs in them that a smaller document's window covers."""
    number: dict[bytes, int] = {}
    kind = np.array([number.setdefault(s, len(number)) for s in segments], np.int64)
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, doc)
    size = np.array([len(s) for s in number])
    firsts = np.cumsum(size) - size
    data = np.frombuffer(b"".join(number), np.uint8)
    n = size - LENGTH + 1
    owner = np.repeat(np.arange(len(n)), n)
    ahead = np.cumsum(n) - n
    starts = firsts[owner] + np.arange(len(owner)) - ahead[owner]
    order, opens = equal_windows(data, starts)
    at = np.full(len(data), -1)
    at[starts] = np.arange(len(starts))
    where = at[order]
    cuts = np.flatnonzero(opens)
    best = np.empty(len(starts), np.int64)
    best[where] = np.repeat(np.minimum.reduceat(least[owner[where]], cuts), np.diff(np.append(cuts, len(where))))
    # Back to each occurrence: its windows that start in a smaller document, joined into runs.
    reps = n[kind]
    occ = np.repeat(np.arange(len(kind)), reps)
    w = np.arange(len(occ)) - np.repeat(np.cumsum(reps) - reps, reps)
    gone = np.flatnonzero(best[ahead[kind[occ]] + w] < doc[occ])
    if not len(gone):
        return occ[:0], lo[:0], lo[:0]
    new = np.append(True, (np.diff(occ[gone]) != 0) | (np.diff(w[gone]) != 1))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(gone) - 1)
    a, z = gone[new], gone[last]
    return occ[a], lo[occ[a]] + w[a], lo[occ[z]] + w[z] + LENGTH


SORT_BYTES = 6 << 20


def _cold_runs(segments: DataFrame, parts: int) -> DataFrame:
    """Runs found by sorting. An anchor's segments are in one task, next to each other; a task sorts a few MB at a time."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, int, int]] = []
        size = 0

        def sorted_out(rows: list[tuple[int, bytes, int, int, int]]) -> pa.RecordBatch:
            doc, cls, lo = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4))
            of, start, end = _marked([r[1] for r in rows], doc, lo)
            return pa.record_batch([pa.array(doc[of]), pa.array(cls[of]), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["doc_id", "cls", "start", "end"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SORT_BYTES and row[0] != held[-1][0]:
                    yield sorted_out(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        if held:
            yield sorted_out(held)

    return segments.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(mark, "doc_id long, cls long, start int, end int")


def _hot_runs(segments: DataFrame) -> DataFrame:
    """The same runs for hot anchors: distinct segments, their windows by content, and a join back to the occurrences."""
    own = segments.withColumn("sid", F.struct(F.xxhash64("seg"), F.xxhash64(F.lit(1), "seg")))
    windows = own.groupBy("sid", "seg").agg(F.min("doc_id").alias("least"))
    windows = windows.select("sid", "least", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("seg") - (LENGTH - 1)), lambda i: F.substring(F.col("seg"), i, F.lit(LENGTH)))).alias("w", "bytes"))
    best = windows.groupBy("bytes").agg(F.min("least").alias("best"))
    found = windows.join(best, "bytes").groupBy("sid").agg(F.collect_list(F.struct("w", "best")).alias("found"))
    hit = own.select("sid", "doc_id", "cls", "lo").join(found, "sid").withColumn("w", F.array_sort(F.transform(F.filter("found", lambda x: x["best"] < F.col("doc_id")), lambda x: x["w"])))
    # Windows follow each other in a run: it opens where the one before is not marked and closes where the next one is not.
    opens = F.filter("w", lambda w: ~F.array_contains("w", w - 1))
    closes = F.filter("w", lambda w: ~F.array_contains("w", w + 1))
    return hit.select("doc_id", "cls", "lo", F.explode(F.arrays_zip(opens.alias("a"), closes.alias("z"))).alias("x")).select("doc_id", "cls", (F.col("lo") + F.col("x.a")).alias("start"), (F.col("lo") + F.col("x.z") + LENGTH).alias("end"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with keep_bytes the bytes that stay."""
    # A needless alias would keep Spark from seeing that the uses of one exchange are the same.
    own_id = F.col("doc_id") if (id_col, dict(docs.dtypes)[id_col]) == ("doc_id", "bigint") else F.col(id_col).cast("long").alias("doc_id")
    rows = docs.select(own_id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(0, int(total // BUCKET_BYTES).bit_length())
    named = rows.where("doc_id is not null").where(F.octet_length("text") >= LENGTH)
    places = staged(_shared(_asked(named, bits)), "places")
    sha = F.unhex(F.sha2(F.col("text"), 256))
    cls = F.conv(F.hex(F.substring("sha", 1, 8)), 16, -10).cast("long")
    keyed = named.select("doc_id", sha.alias("sha"))
    sums = staged(keyed.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "copies")
    firsts = sums.select(F.col("least").alias("doc_id"), cls.alias("cls"))
    asked = places.groupBy("doc_id", "cls", "hot").agg(F.collect_list("p").alias("p")).join(firsts, ["doc_id", "cls"], "left_semi")
    # The texts are dealt by id and content once; both uses below read that one exchange.
    texts = rows.withColumn("sha", sha).select("doc_id", cls.alias("cls"), "text").where("doc_id is not null and cls is not null").repartition("doc_id", "cls")
    found = _cold_runs(_segments(texts, asked.where("not hot")), max(1, int(total // (8 << 20))))
    if not places.where("hot").isEmpty():
        found = found.unionByName(_hot_runs(staged(_segments(texts, asked.where("hot")), "hot")))
    copies = keyed.join(sums.where("n > 1").select("sha", "least"), "sha").where("doc_id > least").select("doc_id", cls.alias("cls"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "least")
    told = found.withColumn("least", F.lit(None).cast("long")).unionByName(copies)
    spans = told.groupBy("doc_id", "cls").agg(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end"))).alias("spans"), F.min("least").alias("least"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans, least = (c.to_pylist() for c in batch.columns)
            out = []
            for doc_id, t, own, first in zip(ids, texts, spans, least, strict=True):
                data = t.encode("utf-8", "surrogatepass")
                gone = []
                if first is not None and doc_id is not None and first < doc_id:
                    gone = [(0, len(data))]
                else:
                    for a, z in sorted((s["start"], s["end"]) for s in own or ()):
                        if gone and a <= gone[-1][1]:
                            gone[-1] = (gone[-1][0], max(z, gone[-1][1]))
                        else:
                            gone.append((a, z))
                at, kept = 0, []
                for a, z in gone:
                    kept.append(data[at:a])
                    at = z
                stay = b"".join([*kept, data[at:]])
                out.append((doc_id, len(data), len(data) - len(stay), len(gone), hashlib.sha256(stay).hexdigest(), stay if keep_bytes else None))
            kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary())
            yield pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in RESULT.split(", ")])

    joined = texts.join(spans, ["doc_id", "cls"], "left").select("doc_id", "text", "spans", "least")
    bare = rows.where("doc_id is null").select("doc_id", "text", *[F.lit(None).cast(joined.schema[c].dataType).alias(c) for c in ("spans", "least")])
    out = joined.unionByName(bare).mapInArrow(judge, RESULT)
    return out if keep_bytes else out.drop("kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)


#: Long texts are cut into pieces of 1000 windows first, so no window is sought in a whole text.
OP9_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
pieces as (select doc_id, k, substr(x, 2000 * k + 1, 2098) y from (select doc_id, x, unnest(range((length(x) // 2 - 50) // 1000 + 1)) k from d where length(x) >= 100)),
w as (select doc_id, 1000 * k + i p, md5_number(substr(y, 2 * i + 1, 100)) h from (select doc_id, k, y, unnest(range(length(y) // 2 - 49)) i from pieces)),
f as (select h, min(doc_id) least from w group by h having count(*) > 1),
gone as (select w.doc_id, w.p from w join f on w.h = f.h and f.least < w.doc_id),
runs as (select doc_id, p, sum(opens) over (partition by doc_id order by p) run
         from (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end opens from gone)),
spans as (select doc_id, min(p) a, max(p) + 50 z from runs group by doc_id, run),
gaps as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) since from spans),
cut as (select g.doc_id, count(*) n, sum(z - a) lost, max(z) last, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' order by a) kept
        from gaps g join d on g.doc_id = d.doc_id group by g.doc_id)
select d.doc_id, (length(x) // 2)::bigint n_bytes, coalesce(lost, 0)::bigint n_removed, coalesce(n, 0)::bigint n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) kept_sha256
from d left join cut on d.doc_id = cut.doc_id
"""
