"""Benchmark decontamination by template windows; DataFrame functions only.

Numbers, names and units become typed placeholders, so a question whose figures or names were changed keeps its template. A
capitalised word, wherever it stands, is met both as a name and as the plain word, on either side; so is an item's first word.

Windows of WINDOW template words are joined by hash. Those with fewer than MIN_WORDS plain words say nothing and do not count.
A matched window covers its words. A place of the item in a document is one shift between their words, with all shifts up to
(1 - COVERAGE) of the item's words around it, as words left out or put in move what follows. A document holds an item if

- at some place at least COVERAGE of the words that the item's windows reach are covered, or
- at one shift PASSAGE words in a row are covered,

and the slots covered there are consistent: each value of the item always stands against one and the same value. A capitalised
word that the item also holds in lower case is no name there. Items that no window can tell (short ones, or of few plain words)
are held by documents in which all their words and values stand in a row: their template alone is met anywhere.

Null texts and texts without words match nothing. Repeated documents match each for itself; repeated item ids count once, with
their smallest text. Rows with null ids take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import staged, table

WINDOW = 5
COVERAGE = 0.8
MIN_WORDS = 3
#: Words in a row that make a passage.
PASSAGE = 13
#: Windows of the benchmark that are broadcast; with more, Spark's ordinary join takes over.
BROADCAST_WINDOWS = 400_000
#: Candidate documents whose ids are broadcast to fetch their words; with more, Spark's ordinary join takes over.
BROADCAST_IDS = 500_000
NUMBER, NAME, UNIT = "0", "ℕ", "ℚ"
#: Stands before a word that may be a name. Of one byte, so that plain texts stay plain.
MARK = "\x01"
# Units that may follow a number.
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|miles|mile|ft|feet|inches|l|ml|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|dollars|dollar|euros|euro|cents|percent"
#: Possessive: what follows a number is never one of its own characters.
_NUMBER = r"\p{N}++(?:[.,]\p{N}++)*+"
_TOKEN = r"(\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+)"


def template(text: Column) -> Column:
    """The words of a text, MARK before capitalised ones, typed placeholders in the place of numbers and units."""
    t = F.lower(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(" ")), r"\p{Lu}(?<![\p{L}\p{M}]\p{Lu})(?=\p{Ll})", MARK + "$0"))
    t = F.regexp_replace(t, rf"{_NUMBER}\s*+(?:{UNITS})(?!\p{{L}})", f" {NUMBER} {UNIT}")
    t = F.regexp_replace(t, _NUMBER, f" {NUMBER} ")
    t = F.split(t, rf"[^\p{{L}}\p{{M}}\p{{N}}{MARK}]+")
    return F.array_remove(t, "")  # what stands before the first word and after the last one


def words(text: Column) -> Column:
    """The same words as they stand in the text."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))


def _forms(w: Column) -> Column:
    """Every reading of a window's words, a marked one as the plain word or as a name; readings of too many names are left out."""
    none = F.array(F.array().cast("array<string>"))
    put = lambda acc, word: F.transform(acc, lambda a: F.concat(a, F.array(word)))
    every = F.aggregate(w, none, lambda acc, x: F.when(x.startswith(MARK), F.concat(put(acc, F.substring(x, 2, 1_000_000)), put(acc, F.lit(NAME)))).otherwise(put(acc, x)))
    return F.filter(every, lambda a: F.size(F.filter(a, lambda x: x == NAME)) <= WINDOW - MIN_WORDS)


def _starts(size: Column) -> Column:
    return F.when(size >= WINDOW, F.sequence(F.lit(1), size - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))


def _item_windows(items: DataFrame) -> DataFrame:
    """item_id, item_at, h of every reading of every window that says something. No other can be met, so documents need no test."""
    plain = lambda w: F.size(F.array_except(w, F.array(F.lit(NUMBER), F.lit(NAME), F.lit(UNIT)))) >= MIN_WORDS
    at = items.select("item_id", "t", F.explode(_starts(F.size("t"))).alias("item_at"))
    read = at.select("item_id", "item_at", F.explode(_forms(F.slice("t", F.col("item_at"), WINDOW))).alias("w"))
    return read.where(plain(F.col("w"))).select("item_id", "item_at", _xor(_placed([_told(F.col("w")[i]) for i in range(WINDOW)])).alias("h")).distinct()


def _told(word: Column) -> Column:
    """The hash of a word without its MARK; the last bit says whether it bears one."""
    marked = word.startswith(MARK)
    h = F.xxhash64(F.when(marked, F.substring(word, 2, 1_000_000)).otherwise(word))
    return F.when(marked, h.bitwiseOR(F.lit(1))).otherwise(h.bitwiseAND(F.lit(-2)))


def _placed(hashes: list[Column]) -> list[Column]:
    """The hash of each word of a window, turned by its place. That of the window is their exclusive or, so a reading changes it
    by one difference for each name."""
    turned = lambda x, n: F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n)) if n else x
    return [turned(x.bitwiseAND(F.lit(-2)), 13 * i) for i, x in enumerate(hashes)]


def _xor(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x.bitwiseXOR(y), columns)


def _doc_windows(docs: DataFrame) -> DataFrame:
    """doc_id, copy, doc_at, h of every reading of every window of t. Only windows with a marked word have more than one.

    Words are hashed once each, before they are laid side by side in windows.
    """
    told = docs.where(F.size("t") >= WINDOW).select("doc_id", "copy", F.transform("t", _told).alias("u"))
    shifted = F.arrays_zip(*[F.slice("u", i + 1, F.size("u")).alias(f"u{i}") for i in range(WINDOW)])
    rows = told.select("doc_id", "copy", F.posexplode(shifted).alias("at", "u")).select("doc_id", "copy", (F.col("at") + 1).alias("doc_at"), "u.*").where(f"u{WINDOW - 1} is not null")
    each = [F.col(f"u{i}") for i in range(WINDOW)]
    plain, names = _placed(each), _placed([_told(F.lit(NAME))] * WINDOW)
    rows = rows.select("doc_id", "copy", "doc_at", _xor(plain).alias("h"), *[F.when(u.bitwiseAND(F.lit(1)) == 1, x.bitwiseXOR(n)).alias(f"d{i}") for i, (u, x, n) in enumerate(zip(each, plain, names, strict=True))])
    d = [F.col(f"d{i}") for i in range(WINDOW)]
    count = sum((x.isNotNull().cast("int") for x in d), F.lit(0))
    every = _xor([F.coalesce(x, F.lit(0).cast("long")) for x in d])
    rows = rows.select("*", count.alias("count"), every.alias("every"), F.coalesce(*d).alias("first"))
    count, every, first, none = F.col("count"), F.col("every"), F.col("first"), F.lit(0).cast("long")
    many = F.array(none, *d, *[d[i].bitwiseXOR(d[j]) for i in range(WINDOW) for j in range(i)])
    changes = F.when(count == 0, F.array(none)).when(count == 1, F.array(none, every)).when(count == 2, F.array(none, every, first, every.bitwiseXOR(first))).otherwise(many)
    read = rows.select("doc_id", "copy", "doc_at", "h", F.explode(changes).alias("change"))
    return read.where("change is not null").select("doc_id", "copy", "doc_at", F.col("h").bitwiseXOR(F.col("change")).alias("h"))


def _items(benchmark: DataFrame, id_col: str, text: str) -> DataFrame:
    """item_id, its template t, its words v in lower case; the first word is always marked."""
    own = benchmark.select(F.col(id_col).alias("item_id"), F.col(text).alias("item_text")).where("item_id is not null and item_text is not null")
    own = own.groupBy("item_id").agg(F.min("item_text").alias("item_text"))
    t = template(F.col("item_text"))
    head = F.get("t", F.lit(0))
    first = F.when(head.isin(NUMBER, UNIT) | head.startswith(MARK), head).otherwise(F.concat(F.lit(MARK), head))
    v = F.transform(words(F.col("item_text")), lambda w: F.lower(w))
    return own.select("item_id", t.alias("t"), v.alias("v")).withColumn("t", F.concat(F.array(first), F.slice("t", 2, F.size("t")))).where(F.size("v") > 0)


def _documents(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """A repeated id is a document for each of its texts."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text")).where("doc_id is not null and text is not null")


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, matched and words (covered words, and those that windows reach), coverage of every pair that the rules above find."""
    found = _found(docs, benchmark, text, id_col, item_col, item_text)
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("words").alias("words"), F.max("coverage").alias("coverage"))


def _found(docs: DataFrame, benchmark: DataFrame, text: str, id_col: str, item_col: str, item_text: str) -> DataFrame:
    """The same by text: doc_id, copy (the text's hash), item_id, matched, words, coverage."""
    items, rows = _items(benchmark, item_col, item_text), _documents(docs, text, id_col)
    windows = _item_windows(items)
    reach = F.array_distinct(F.flatten(F.transform(F.collect_set("item_at"), lambda i: F.sequence(i, i + (WINDOW - 1)))))
    told = windows.groupBy("item_id").agg(F.size(reach).alias("words")).join(items, "item_id")
    known = F.broadcast(windows) if windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS else windows
    met = _doc_windows(rows.select("doc_id", "copy", template(F.col("text")).alias("t"))).join(known, "h")
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set("item_at"), lambda i: F.sequence(i, i + (WINDOW - 1))))))
    places = met.groupBy("doc_id", "copy", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(covered.alias("at"))
    pairs = places.groupBy("doc_id", "copy", "item_id").agg(F.array_sort(F.collect_list(F.struct("shift", "at"))).alias("places")).join(told, "item_id")
    found = _consistent(_candidates(pairs), rows)
    untold = items.join(windows.select("item_id").distinct(), "item_id", "left_anti")
    return found if untold.isEmpty() else found.unionByName(_verbatim(rows, untold))


def _candidates(pairs: DataFrame) -> DataFrame:
    """A row for each place that covers enough: held, the item's covered words and the shift of each."""
    places = F.transform("places", lambda x, k: F.struct(x["shift"].alias("shift"), x["at"].alias("at"), (k + 1).alias("number")))
    drift = F.greatest(F.lit(1), F.floor((1 - COVERAGE) * F.size("v") + 1e-9).cast("int"))
    pairs = pairs.withColumn("places", places)
    places = F.col("places")
    enough = F.size(F.array_distinct(F.flatten(F.transform(places, lambda x: x["at"]))))
    pairs = pairs.where((enough >= COVERAGE * F.col("words")) | (enough >= PASSAGE)).withColumn("drift", drift)
    held = lambda at, shift: F.transform(at, lambda i: F.struct(i.alias("at"), shift.alias("shift")))

    def around(x: Column) -> Column:
        """The words of the place itself first, then what the places around it add, the nearest first."""
        some = F.slice(places, F.greatest(x["number"] - F.col("drift"), F.lit(1)), 2 * F.col("drift") + 1)
        near = F.array_sort(F.transform(F.filter(some, lambda y: F.abs(y["shift"] - x["shift"]) <= F.col("drift")), lambda y: F.struct(F.abs(y["shift"] - x["shift"]).alias("far"), y["shift"].alias("shift"), y["at"].alias("at"))))
        every = F.array_distinct(F.flatten(F.transform(near, lambda y: y["at"])))
        return F.transform(every, lambda i: F.struct(i.alias("at"), F.filter(near, lambda y: F.array_contains(y["at"], i))[0]["shift"].alias("shift")))

    def runs(x: Column) -> Column:
        first = F.filter(x["at"], lambda i: ~F.array_contains(x["at"], i - 1))
        last = F.filter(x["at"], lambda i: ~F.array_contains(x["at"], i + 1))
        long = F.filter(F.arrays_zip(first.alias("a"), last.alias("z")), lambda r: r["z"] - r["a"] + 1 >= PASSAGE)
        return F.transform(long, lambda r: held(F.sequence(r["a"], r["z"]), x["shift"]))

    whole = lambda c: F.filter(F.array(c), lambda w: F.size(w) >= COVERAGE * F.col("words"))
    # Places differ in their shift, so only what one place gives can repeat.
    of_place = F.transform(places, lambda x: F.array_distinct(F.concat(whole(held(x["at"], x["shift"])), whole(around(x)), runs(x))))
    return pairs.select("doc_id", "copy", "item_id", "t", "v", "words", F.explode(F.flatten(of_place)).alias("held"))


def _consistent(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Drops places at which a value of the item stands against two values of the document.

    A row for each slot meets the document's word at its place, so a text of many places is read once and not once a place.
    """
    kind = lambda i: F.col("t")[i - 1]
    slot = lambda i: kind(i).isin(NUMBER, UNIT) | (kind(i).startswith(MARK) & ~F.array_contains("t", F.col("v")[i - 1]))
    value = lambda i: F.struct(F.when(kind(i).startswith(MARK), F.lit(NAME)).otherwise(kind(i)).alias("kind"), F.col("v")[i - 1].alias("own"))
    slots = F.transform(F.filter("held", lambda c: slot(c["at"])), lambda c: F.struct((c["at"] + c["shift"] - 1).alias("at"), value(c["at"]).alias("value")))
    asked = staged(found.select("doc_id", "copy", "item_id", F.monotonically_increasing_id().alias("place"), F.size("held").alias("matched"), "words", slots.alias("slots")), "places")
    ids = asked.where(F.size("slots") > 0).select("doc_id", "copy").distinct()
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    texts = rows.join(ids, ["doc_id", "copy"], "left_semi").dropDuplicates(["doc_id", "copy"])
    told = texts.select("doc_id", "copy", F.posexplode(words(F.col("text"))).alias("at", "other")).select("doc_id", "copy", "at", F.lower("other").alias("other"))
    each = asked.select("doc_id", "copy", "place", F.explode("slots").alias("slot")).select("doc_id", "copy", "place", "slot.*")
    against = each.join(told, ["doc_id", "copy", "at"], "left").groupBy("place").agg(F.size(F.collect_set(F.struct("value", "other"))).alias("others"), F.size(F.collect_set("value")).alias("values"))
    bad = against.where("others > values").select("place")
    return asked.join(bad, "place", "left_anti").select("doc_id", "copy", "item_id", "matched", "words", (F.col("matched") / F.col("words")).alias("coverage"))


def _verbatim(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of a document and an item that no window tells, all of whose words stand in the document in a row.

    One pass hashes the runs of every length that such an item begins with; a text that holds some is read once more for each item.
    """
    items = items.select("item_id", "v", F.xxhash64(F.slice("v", 1, WINDOW)).alias("h"), F.least(F.size("v"), F.lit(WINDOW)).alias("length"))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())
    n = F.size("v").alias("words")
    lower = rows.select("doc_id", "copy", F.transform(words(F.col("text")), lambda w: F.lower(w)).alias("d"))
    asked = lower.select("doc_id", "copy", "d", F.explode(F.array(*[F.lit(length) for length in lengths])).alias("length")).where(F.size("d") >= F.col("length"))
    hashes = F.transform(F.sequence(F.lit(1), F.size("d") - F.col("length") + 1), lambda i: F.xxhash64(F.slice("d", i, F.col("length"))))
    met = asked.select("doc_id", "copy", "length", F.posexplode(hashes).alias("at", "h"))
    pairs = met.join(items, ["h", "length"]).groupBy("doc_id", "copy", "item_id").agg(F.collect_set(F.col("at") + 1).alias("starts"))
    read = pairs.join(items.select("item_id", "v"), "item_id").join(lower.dropDuplicates(["doc_id", "copy"]), ["doc_id", "copy"])
    return read.where(F.exists("starts", lambda i: F.slice("d", i, F.size("v")) == F.col("v"))).select("doc_id", "copy", "item_id", n.alias("matched"), n, F.lit(1.0).alias("coverage"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Of rows that repeat an id those go whose own text holds one. Null and empty texts
    and rows without id stay, and columns of any name pass through."""
    found = _found(docs, table(spark, sf_dir, "benchmark"), "text", "doc_id", "item_id", "text")
    leaks = found.select(F.col("doc_id").alias("leak_id"), F.col("copy").alias("leak_copy")).distinct()
    same = (docs["doc_id"] == leaks["leak_id"]) & (F.xxhash64(docs["text"]) == leaks["leak_copy"])
    return docs.join(leaks, same, "left_anti")
