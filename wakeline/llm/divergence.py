"""Source divergence audit: which sources of a language use its terms most unlike each other, and by which terms.

Terms are counted natively, once for each (lang, source, term), with partial sums before the exchange. A term's sparse vector is
the list of its counts by source. Terms with one vector say the same about every pair of sources, so vectors are grouped, every
pair of sources that a vector names is evaluated once, and its value is multiplied by the number of the vector's terms. What
sources miss is told by two sums instead of rows: terms that only one of two sources has, by its distinct counts, and terms that
neither has. Ranks of terms come from the original terms, the best 50 of each partition before the exchange.

All values are integers: a term's smoothed share is 1 + floor(10^9 (count + 5) / (N + 5 V)), in decimals of 38 digits. Null text,
lang and source count as ''. A text without terms still makes its (lang, source) group occur; a language without kept terms has
pairs of value 0. Ties of values are ordered by the item's UTF-8 bytes. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.llm.common import dropped, staged, table

#: Runs of ASCII letters and of whatever is not ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCUMENTS, RANKS, UNIT, PRIOR = 30, 50, 1_000_000_000, 5


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (count + PRIOR) / (total + PRIOR terms)), exactly; both sides are positive wherever a term is kept."""
    up = (count + PRIOR).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", up, (total + terms * PRIOR).cast("decimal(20,0)"))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it). A text's terms are sorted, so the first of equal ones
    is the one that counts the document."""
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    own = docs.select("lang", "source", F.sort_array(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("w"))
    marked = F.transform("w", lambda x, i: F.struct(x.alias("term"), F.when((i > 0) & (F.get("w", i - 1) == x), 0).otherwise(1).alias("first")))
    return own.select("lang", "source", F.explode(marked).alias("x")).groupBy("lang", "source", "x.term").agg(F.count("*").alias("n"), F.sum("x.first").alias("docs"))


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: for every group all other sources of its language, and its terms
    over the language's share up to `ranks`."""
    named = docs.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    counts = staged(term_counts(named), "terms")
    # A document has one source, so the documents of a language that hold a term are the sum over its sources.
    vector = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector")
    kept = staged(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), vector).where(F.col("docs") >= least_documents).select("lang", "term", "total", "vector"), "kept")
    dropped(counts)
    distinct = kept.groupBy("lang", "vector").agg(F.count("*").alias("m"))
    entries = distinct.select("lang", "m", F.explode("vector").alias("e")).select("lang", "m", "e.source", "e.n")
    # Of a (lang, source) group: terms with a count and the sum of counts; of a language: its terms and their sum.
    sums = entries.groupBy("lang", "source", "n").agg(F.sum("m").alias("m"))
    own = sums.groupBy("lang", "source").agg(F.sum(F.col("m") * F.col("n")).alias("size"), F.sum("m").alias("held"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("V"), F.sum("total").alias("NL"))
    groups = named.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["size", "held", "V", "NL"])
    groups = staged(groups.withColumn("zero", F.when(F.col("V") > 0, share(F.lit(0), F.col("size"), F.col("V"))).otherwise(0)), "groups")
    held = F.col("V") > 0

    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("o_zero"), F.col("held").alias("o_held"))
    met = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    neither = met.select("lang", "source", "item", ((F.col("V") - F.col("held") - F.col("o_held")) * F.abs(F.col("zero") - F.col("o_zero"))).alias("value"))
    # As if no other source had a source's terms: once for each of its distinct counts.
    hist = sums.join(groups.where(held).select("lang", "source", "size", "V"), ["lang", "source"]).select("lang", "source", "m", share(F.col("n"), F.col("size"), F.col("V")).alias("p"))
    alone = hist.join(other, "lang").where(F.col("source") != F.col("item")).select("lang", "source", "item", (F.col("m") * F.abs(F.col("p") - F.col("o_zero"))).alias("value"))
    alone = alone.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Where both have it, what the sums above told is taken back.
    priced = distinct.withColumn("id", F.monotonically_increasing_id()).select("lang", "id", "m", F.explode("vector").alias("e"))
    priced = priced.select("lang", "id", "m", "e.source", "e.n").join(groups.select("lang", "source", "size", "V", "zero"), ["lang", "source"])
    priced = priced.select("lang", "id", "m", F.struct("source", share(F.col("n"), F.col("size"), F.col("V")).alias("p"), "zero").alias("e"))
    lists = priced.groupBy("lang", "id").agg(F.first("m").alias("m"), F.sort_array(F.collect_list("e")).alias("es")).where(F.size("es") > 1)
    two = lists.select("lang", "m", "es", F.posexplode("es").alias("i", "a")).select("lang", "m", "a", F.explode(F.slice("es", F.col("i") + 2, F.size("es"))).alias("b"))
    gap = lambda x, y: F.abs(F.col(f"a.{x}") - F.col(f"b.{y}"))
    both = two.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), (F.col("m") * (gap("p", "p") - gap("p", "zero") - gap("zero", "p") + gap("zero", "zero"))).alias("value"))
    both = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # A pair's value is the same in both directions.
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    shared = alone.unionByName(both).select("lang", ways.alias("x"), "value").select("lang", "x.source", "x.item", "value")
    parts = neither.unionByName(shared)
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    terms = kept.select("lang", "term", "total", F.explode("vector").alias("e")).select("lang", "term", "total", "e.source", "e.n")
    terms = terms.join(groups.select("lang", "source", "size", "V", "NL"), ["lang", "source"])
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (share(F.col("n"), F.col("size"), F.col("V")) - share(F.col("total"), F.col("NL"), F.col("V"))).alias("value")).where("value > 0")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    every = pairs.withColumn("rank", F.row_number().over(order))
    return every.unionByName(top).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
with d as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') w, row_number() over () r from documents),
g as (select distinct lang, source from d),
t as (select lang, source, r, unnest(w) term from d),
kept as (select lang, term, count(*) total from t group by lang, term having count(distinct r) >= {LEAST_DOCUMENTS}),
v as (select lang, count(*) v, sum(total)::hugeint nl from kept group by lang),
c as (select g.lang, g.source, kept.term, kept.total, coalesce(n, 0) n from g join kept using (lang)
  left join (select lang, source, term, count(*) n from t group by all) x on x.lang = g.lang and x.source = g.source and x.term = kept.term),
s as (select lang, source, sum(n)::hugeint gn from c group by lang, source),
p as (select c.lang, c.source, c.term, c.n, 1 + ({UNIT}::hugeint * (n + {PRIOR})) // (gn + {PRIOR} * v) p, 1 + ({UNIT}::hugeint * (total + {PRIOR})) // (nl + {PRIOR} * v) q
  from c join s using (lang, source) join v using (lang)),
f as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' part, term item, (p - q)::bigint as value from p where n > 0 and p > q)
select * from (select *, (row_number() over (partition by lang, source order by value desc, encode(item)))::int rank from pairs)
union all select * from (select *, (row_number() over (partition by lang, source order by value desc, encode(item)))::int rank from terms) where rank <= {RANKS}
"""
