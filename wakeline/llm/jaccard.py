"""Similarity join of shingle sets by token-combination prefixes.

Equal sets form one class. All sets order their tokens alike: by how many documents hold them (in powers of two, rare ones
first), then by hash. Two sets of Jaccard similarity t or more share a token among the first |x| - ceil(t|x|) + 1 of each, and
two among one more. So the join looks only at these extended prefixes. Rare tokens are indexed singly, frequent ones by pairs;
sets with too many frequent tokens for pairs meet the whole lists of theirs. A place p in the order bounds what two sets can
share from there on, so each posting has a largest size of partner. Candidates are verified on the whole sets.

Only components are asked for, so lists don't expand into all pairs. First each list's members are verified against a pivot,
the member in which the list's token comes earliest; what they link is contracted. In a list whose members are still in more
than one component, only the members outside of its largest component meet the others, by size and place. A parity bitmap whose
distance bounds the sets' difference from below drops most of these before the sets are built. None of the tests loses a link.

Null, blank and empty texts have an empty set and link with nothing. Rows with null ids link with nothing and are their own,
null, component. Of rows that repeat an id each has the component of its own text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.llm.common import dropped, looked_up, staged, table
from wakeline.llm.graph import components
from wakeline.llm.shingles import mixed, sets

#: Tokens in more documents than this are ordered by their counts; at most FREQUENT_MOST are told to the executors (5 MB). The
#: others count as rare: an order that is alike for all sets, so no link depends on the bound.
FREQUENT = 7
FREQUENT_MOST = 1 << 19
#: Tokens are counted by their first KEPT_BITS bits, in buckets of the tokens of about BUCKET_BYTES of text each.
KEPT_BITS = 48
FLUSH_TOKENS = 1 << 21
BUCKET_BYTES = 12 << 20
LEVEL_BITS = 11
#: Tokens in whose lists at most so many members ask count as rare, so a list costs its length; the others are indexed by pairs
#: in sets with up to PAIRED_TOKENS of them.
ASKING = 32
PAIRED_TOKENS = 40
BITMAP = 8
#: Members of a list that one pivot takes, and that meet in one task.
PIVOT_MEMBERS, TASK_MEMBERS = 1024, 4096
#: Pairs whose sets are held at once, and buckets of texts that are told to all executors (a set of at most so many numbers).
PAIRS_AT_ONCE, ASKED_BUCKETS = 128, 1 << 22
SETS = "doc_id long, copy long, n_shingles long, key binary, prefix array<long>, rare int, bitmap array<long>"


def _texts(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("copy"), F.col(text).cast("string").alias("text"))


def _packed(arrays: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Truncated hashes, sorted, some millions at a time: a row for each bucket, which is the first `bits` bits."""

    def row(held: list[np.ndarray]) -> pa.RecordBatch:
        t = np.sort(np.concatenate(held))
        cuts = np.searchsorted(t, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(KEPT_BITS - bits))
        some = np.flatnonzero(np.diff(cuts))
        high, low = (t >> np.uint64(32)).astype(np.uint16), t.astype(np.uint32)
        bodies = [high[cuts[i] : cuts[i + 1]].tobytes() + low[cuts[i] : cuts[i + 1]].tobytes() for i in some]
        return pa.record_batch([pa.array(some, pa.int32()), pa.array(bodies, pa.binary())], ["bucket", "body"])

    held, size = [], 0
    for t in arrays:
        held.append(t)
        size += len(t)
        if size >= FLUSH_TOKENS:
            yield row(held)
            held, size = [], 0
    if size:
        yield row(held)


def _unpacked(body: bytes) -> np.ndarray:
    n = len(body) // 6
    return (np.frombuffer(body, np.uint16, n).astype(np.uint64) << np.uint64(32)) | np.frombuffer(body, np.uint32, n, 2 * n)


def _bucketed(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """bucket, body: the truncated tokens of all documents. Beyond LEVEL_BITS the buckets are split in a second exchange, so the
    rows stay in proportion to the text."""
    first = min(bits, LEVEL_BITS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed((s >> np.uint64(64 - KEPT_BITS) for batch in batches for s in sets(batch.column(0).to_pylist(), n)), first)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed((_unpacked(body) for batch in batches for body in batch.column(1).to_pylist()), bits)

    rows = docs.select("text").mapInArrow(pack, "bucket int, body binary")
    return rows if bits == first else rows.repartition(1 << first, "bucket").mapInArrow(split, "bucket int, body binary")


def frequent_tokens(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted truncated hashes of the frequent tokens and the binary logarithms of their counts over all documents; the bound
    rises until FREQUENT_MOST hold them all. Tokens that truncation joins share a rank, for all sets alike."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(0, int(total // BUCKET_BYTES)).bit_length()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None

        def told() -> pa.RecordBatch:
            t = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
            cuts = np.append(np.flatnonzero(np.append(True, t[1:] != t[:-1])), len(t)) if len(t) else np.zeros(1, np.int64)
            count = np.diff(cuts)
            often = count > FREQUENT
            rank = np.floor(np.log2(count[often])).astype(np.int8)
            return pa.record_batch([pa.array(t[cuts[:-1][often]].view(np.int64)), pa.array(rank)], ["token", "rank"])

        for batch in batches:
            for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != at:
                    yield told()
                    held, at = [], bucket
                held.append(_unpacked(body))
        yield told()

    dealt = _bucketed(docs, n, bits).repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
    counts = staged(dealt.mapInArrow(counted, "token long, rank byte"), "frequent")
    by_rank = sorted(((r[0], r[1]) for r in counts.groupBy("rank").count().collect()), reverse=True)
    least, held = 0, 0
    for rank, some in by_rank:
        held += some
        if held > FREQUENT_MOST:
            least = rank + 1
            break
    told = counts.where(F.col("rank") >= least).toArrow()
    dropped(counts)
    hashes, ranks = told.column("token").to_numpy().astype(np.uint64), told.column("rank").to_numpy().astype(np.uint8)
    order = np.argsort(hashes)
    return hashes[order], ranks[order]


def _signed(docs: DataFrame, n: int, num: int, den: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Of every document: size of its set, a 128-bit key of the set, its extended prefix, of which the first `rare` tokens are not
    frequent, and its parity bitmap."""
    known, ranks = frequent

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, key, prefix, rare, bitmap = [], [], [], [], []
            for s in sets(batch.column(2).to_pylist(), n):
                size.append(len(s))
                key.append(np.array([mixed(s).sum(dtype=np.uint64), mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)]).tobytes() if len(s) else None)
                # A smaller set can't be t-similar to another set: one token more or less is too much.
                if len(s) and len(s) * (den - num) >= num:
                    rank = np.zeros(len(s), np.uint8)
                    if len(known):
                        short = s >> np.uint64(64 - KEPT_BITS)
                        at = np.minimum(np.searchsorted(known, short), len(known) - 1)
                        rank = np.where(known[at] == short, ranks[at], 0)
                    rare.append(int((rank == 0).sum()))
                    prefix.append(s[np.argsort(rank, kind="stable")][: len(s) - -(-num * len(s) // den) + 2].view(np.int64))
                    bit = (mixed(s) >> np.uint64(64 - 9)).astype(np.int64)
                    bitmap.append(np.packbits(np.bincount(bit, minlength=64 * BITMAP) % 2 == 1).view(np.int64))
                else:
                    prefix.append(None)
                    rare.append(None)
                    bitmap.append(None)
            longs = pa.list_(pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(prefix, longs), pa.array(rare, pa.int32()), pa.array(bitmap, longs)], ["doc_id", "copy", "n_shingles", "key", "prefix", "rare", "bitmap"])

    return docs.mapInArrow(sign, SETS)


def _can_link(num: int, den: int, a: str = "", b: str = "o_") -> Column:
    """What two linked sets fulfil: sizes that allow it, and bitmaps no further apart than the sets may be."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}bitmap")[i].bitwiseXOR(F.col(f"{b}bitmap")[i])) for i in range(BITMAP)])
    # inter >= num/(den+num) (na+nb), so the difference na+nb-2 inter <= (na+nb)(den-num)/(den+num)
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (apart * (den + num) <= (na + nb) * (den - num))


def _filtered(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs a, b of classes whose sizes and bitmaps allow a link."""
    left = classes.select(F.col("node").alias("a"), "n", "bitmap")
    right = classes.select(F.col("node").alias("b"), F.col("n").alias("o_n"), F.col("bitmap").alias("o_bitmap"))
    return pairs.distinct().join(right, "b").join(left, "a").where(_can_link(num, den)).select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs a, b whose whole sets are similar, staged. Sets are built again from the texts of the classes asked for, of both
    ends where they meet: texts are shuffled compressed, hashes would not compress."""
    pairs = staged(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = staged(classes.join(nodes, "node", "left_semi").select("node", "doc_id", "copy"), "asked")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PAIRS_AT_ONCE):
                a, b, ta, tb = (c.to_pylist() for c in batch.slice(at, PAIRS_AT_ONCE).columns)
                texts = dict(zip(a, ta, strict=True)) | dict(zip(b, tb, strict=True))
                whole = dict(zip(texts, sets(list(texts.values()), n), strict=True))
                inter = [len(np.intersect1d(whole[x], whole[y], assume_unique=True)) for x, y in zip(a, b, strict=True)]
                alike = [i * den >= (len(whole[x]) + len(whole[y]) - i) * num for x, y, i in zip(a, b, inter, strict=True)]
                yield pa.record_batch([pa.array([x for x, is_ in zip(c, alike, strict=True) if is_], pa.int64()) for c in (a, b)], ["a", "b"])

    # Few texts are asked for. What surely isn't goes before the join, by a number of buckets that doesn't grow with the input.
    bucket = lambda c: F.pmod(F.col(c), F.lit(ASKED_BUCKETS)).cast("int")
    some = docs.join(F.broadcast(asked.select(bucket("copy").alias("bucket")).distinct()), bucket("copy") == F.col("bucket"), "left_semi")
    texts = staged(some.join(asked, ["doc_id", "copy"]).select("node", "text"), "texts")
    # b first: it is seldom hot; then rows are large and Spark splits what is left of a hot a.
    found = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    links = staged(found.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long").distinct(), "links")
    dropped(pairs, asked, texts)
    return links


def _lists(classes: DataFrame) -> DataFrame:
    """k, node, n, p: the prefix tokens that two classes or more hold, and their places. Of tokens that the same classes hold,
    which say the same about them, the two that come first stay (two, as pairs of tokens must stay, too); `twin` marks the second."""
    postings = classes.where("prefix is not null").select("node", "n", "rare", F.posexplode("prefix").alias("p", "k"))
    # Equal members give equal facts; the sets of one class never give two tokens equal facts by chance.
    facts = {"length": F.count("*"), "mark": F.bit_xor(F.xxhash64("node")), "first": F.min("node"), "place": F.min("p")}
    # Lists of rare tokens are short, so one exchange by token serves facts and rows. Those of frequent ones may be hot.
    own = Window.partitionBy("k")
    seldom = postings.where("p < rare").select("k", "node", "n", "p", *[f.over(own).alias(name) for name, f in facts.items()]).where("length > 1")
    often = postings.where("p >= rare").select("k", "node", "n", "p")
    about = often.groupBy("k").agg(*[f.alias(name) for name, f in facts.items()]).where("length > 1")
    about = about.unionByName(seldom.select(*about.columns).dropDuplicates(["k"]))
    order = Window.partitionBy("length", "first", "mark").orderBy("place", "k")
    kept = about.withColumn("_n", F.row_number().over(order)).where("_n <= 2").select("k", "length", (F.col("_n") == 2).alias("twin"))
    short = seldom.drop("length", "mark", "first", "place").join(kept, "k")
    return short.unionByName(looked_up(often, kept, ["k"], F.col("node"), 8).where("length is not null"))


def _star_pairs(lists: DataFrame) -> DataFrame:
    """Each member of a list with a pivot a; a long list has several, each with the first of them."""
    parts = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.col("length") / PIVOT_MEMBERS)))).cast("long")
    rows = lists.where("not twin").withColumn("part", F.pmod(F.xxhash64("node"), parts))
    pivots = rows.groupBy("k", "part").agg(F.min(F.struct("p", "node")).alias("pivot"))
    top = pivots.groupBy("k").agg(F.min("pivot").alias("top"))
    own = rows.join(pivots, ["k", "part"]).select(F.col("pivot.node").alias("a"), F.col("node").alias("b"))
    over = pivots.join(top, "k").select(F.col("top.node").alias("a"), F.col("pivot.node").alias("b"))
    return own.unionByName(over).where("a <> b")


def _outside(lists: DataFrame) -> DataFrame:
    """The rows of lists whose members are in two components or more, and whether a member is outside of the largest."""
    sizes = lists.groupBy("k", "root").agg(F.count("*").alias("c"))
    open_ = sizes.groupBy("k").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.count("*").alias("parts"), F.sum("c").alias("size"), (F.sum("c") - F.max("c")).alias("asking")).where("parts > 1")
    return looked_up(lists, open_.select("k", "major", "size", "asking"), ["k"], F.col("node"), 8).where("major is not null").withColumn("asks", F.col("root") != F.col("major"))


def _band(size: Column, num: int, den: int) -> Column:
    return F.floor(F.log(size.cast("double")) / (math.log(den / num) / 2) + 1e-9)


def _bounded(rows: DataFrame, num: int, den: int) -> DataFrame:
    """The rows with the least and largest size (cap) of a partner that meets a set of size n at its place p.

    Two sets meet at their first or second shared token, for pairs of tokens p is the place of the second. From place p on a set
    of n tokens shares n - p at most, and one token before. That bounds the partner's size.
    """
    cap = F.least(F.floor(F.col("n") * den / num), F.floor((F.col("n") - F.col("p") + 1) * (num + den) / num) - F.col("n"))
    least = F.ceil(F.col("n") * num / den)
    return rows.withColumn("cap", cap).withColumn("least", least).where("cap >= least")


def _partnered(rows: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of lists without those that no partner of their list can meet, by what is known of each band of sizes.

    A member of the largest component has partners among those that ask, the others among all. Both of two sets that meet stay,
    at each shared token up to the one where they meet, as caps fall with the place.
    """
    rows = _bounded(rows, num, den)
    sizes = rows.groupBy("k", "asks", _band(F.col("n"), num, den).alias("band")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("cap").alias("reach"))
    bands = sizes.groupBy("k").agg(F.collect_list(F.struct("asks", "low", "high", "reach")).alias("bands"))

    def meets(b: Column) -> Column:
        return (b["asks"] | F.col("asks")) & (b["low"] <= F.col("cap")) & (b["high"] >= F.col("least")) & (b["low"] * num <= F.col("n") * den) & (b["reach"] >= F.col("n"))

    return looked_up(rows, bands, ["k"], F.col("node"), 8).where(F.exists("bands", meets)).drop("bands", "cap", "least")


def _met(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs a, b of one list and of two components of which one asks, sizes and places permitting. Partners are met in bands of
    size; members of very long lists are spread over tasks."""
    band = lambda c: _band(c, num, den)
    rows = _bounded(rows, num, den)
    spread = F.ceil(F.col("size") / TASK_MEMBERS)
    left = rows.where("asks").withColumn("task", F.pmod(F.xxhash64("node"), spread)).withColumn("band", F.explode(F.sequence(band(F.col("least")), band(F.col("cap")))))
    right = rows.select("k", band(F.col("n")).alias("band"), F.explode(F.sequence(F.lit(0).cast("long"), spread - 1)).alias("task"), *[F.col(c).alias(f"o_{c}") for c in ("node", "n", "root", "cap", "least", "asks")])
    once = ~F.col("o_asks") | (F.col("o_n") < F.col("n")) | ((F.col("o_n") == F.col("n")) & (F.col("o_node") < F.col("node")))
    met = left.join(right, ["k", "band", "task"]).where((F.col("root") != F.col("o_root")) & once & F.col("o_n").between(F.col("least"), F.col("cap")) & F.col("n").between(F.col("o_least"), F.col("o_cap")))
    return met.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"))


def _open_pairs(lists: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that share a rare token, two frequent ones, or one of a set with many frequent ones."""
    known = lists.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = staged(_outside(known), "open")
    short, long = rows.where((F.col("asking") <= ASKING) & ~F.col("twin")), staged(_partnered(rows.where(F.col("asking") > ASKING), num, den), "partnered")
    many = long.groupBy("node").agg(F.count("*").alias("tokens"))
    marked = long.join(many, "node")
    few = marked.where(F.col("tokens") <= PAIRED_TOKENS).groupBy("node", "n", "root").agg(F.array_sort(F.collect_list(F.struct("p", "k"))).alias("own"))
    own = F.col("own")
    two = F.flatten(F.transform(own, lambda x, i: F.transform(F.slice(own, i + 2, PAIRED_TOKENS), lambda y: F.struct(y["p"].alias("p"), F.xxhash64(x["k"], y["k"]).alias("k")))))
    pairs = staged(few.select("node", "n", "root", F.explode(two).alias("x")).select("x.k", "node", "n", "x.p", "root"), "paired")
    # Sets with more frequent tokens than that ask in the whole lists of theirs.
    whole = marked.withColumn("asks", F.col("tokens") > PAIRED_TOKENS)
    found = _met(short, num, den).unionByName(_met(_outside(pairs), num, den)).unionByName(_met(whole, num, den))
    out = staged(found.distinct(), "met")
    dropped(rows, long, pairs)
    return out


def grouped(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, copy, n_shingles, group, least of every row of _texts: group numbers a component (null for empty sets and null
    ids) and least is its smallest doc_id. Staged."""
    frequent = frequent_tokens(docs, n)
    rows = staged(_signed(docs, n, num, den, frequent), "sets")
    # A class is one text or texts with equal sets; its node is a number of its own, whatever ids repeat.
    first = F.min(F.struct("doc_id", "copy")).alias("first")
    own = rows.where("key is not null and doc_id is not null").groupBy("key").agg(first, F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"), F.first("rare").alias("rare"), F.first("bitmap").alias("bitmap"))
    classes = staged(own.select("key", "first.*", "n", "prefix", "rare", "bitmap", F.monotonically_increasing_id().alias("node")), "classes")
    members = staged(rows.select("doc_id", "copy", "n_shingles", "key"), "members")
    dropped(rows)
    lists = staged(_lists(classes), "lists")
    links = _verified(_filtered(_star_pairs(lists), classes, num, den), classes, docs, n, num, den)
    roots = components(links)
    met = _open_pairs(lists, roots, num, den)
    dropped(links, lists)
    more = _verified(_filtered(met, classes, num, den), classes, docs, n, num, den)
    ends = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    dropped(met, more, roots)
    owner = classes.select("key", "doc_id", "node").join(ends, "node", "left").select("key", "doc_id", F.coalesce("root", "node").alias("group"))
    least = owner.groupBy("group").agg(F.min("doc_id").alias("least"))
    owner = looked_up(owner, least, ["group"], F.col("key"), 8).select("key", "group", "least")
    found = looked_up(members, owner, ["key"], F.coalesce("doc_id", F.lit(0)))
    alone = F.col("doc_id").isNull() | F.col("key").isNull()
    out = staged(found.select("doc_id", "copy", "n_shingles", *[F.when(~alone, F.col(c)).alias(c) for c in ("group", "least")]), "groups")
    dropped(members, classes, ends)
    return out


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link where inter * den >= union * num."""
    found = grouped(_texts(docs, text, id_col), n, num, den)
    return found.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


OP10_SQL = """
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                                           else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) s from d),
sized as (select doc_id, len(s)::bigint n, s from sets),
one as (select doc_id, n, unnest(s) t from sized),
common as (select a.doc_id a, b.doc_id b from one a join one b on a.t = b.t and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
           group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links as (select a, b from common union all select b, a from common),
reached(a, b) as (select doc_id, doc_id from sized union select r.a, l.b from reached r join links l on r.b = l.a)
select sized.doc_id, n n_shingles, min(b) component_id from sized join reached on a = sized.doc_id group by sized.doc_id, n
"""


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id, of those the one whose text has the smallest hash.

    An id that repeats with other texts is a document for each of them: each text belongs to its own group and only members of
    one group go. Rows that repeat id and text are one document. Rows without id stay, and so do null, empty and blank texts.
    Columns of any name pass through.
    """
    found = grouped(_texts(docs, "text", "doc_id"), 5, 80, 100).where("doc_id is not null")
    first = found.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "copy")).alias("first")).select("first.*")
    kept = first.unionByName(found.where("group is null").select("doc_id", "copy").distinct())
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("copy").alias("kept_copy"))
    own = docs.where("doc_id is not null")
    same = (own["doc_id"] == kept["kept_id"]) & (F.xxhash64(own["text"]) == kept["kept_copy"])
    return own.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
