"""Filter interaction audit: what every filter removes at every place of every order, from one SQL CUBE.

Five filters give a document five failure flags. Documents are counted by part and flags first, so that the CUBE over
the flags and the part expands counts and never documents. A row of the CUBE that keeps the flags of a subset and has
them all false tells how many documents survive that subset. A step of an order goes from one subset to the same with
one filter more: pairs of subsets meet in joins on part and subset, and the 120 orders only name the pairs.

Identical texts are told by their SHA-256, counted before they meet their rows, and a text that very many rows hold is
dealt over groups by that count. Only the tables of pairs and orders, 80 and 600 rows whatever the input, are broadcast.

Edge cases: a null text is an empty one, which has no words; it fails A, and E if another document is empty; a null part
is the empty string, together with empty ones. A null id is larger than all others and is no smaller id itself. Rows of
equal id are documents of their own that never make each other fail E. A label that is repeated counts as soon as one of
its rows is 1; labels of a null id count for none. A very long text is judged whole, in the row it stands in. An empty
table gives an empty result; only the named columns are read, whatever other columns are called.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.llm.store import col, hot_join, written

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
ALL = (1 << len(FILTERS)) - 1
COUNTS = ("n", "good", "toxic")


def flags(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides: all but E."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals * F.lit(100) > F.length(text) * F.lit(2),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part and the flags A to E of every document."""
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "part", F.sha2("text", 256).alias("digest"), F.xxhash64(F.col("id").cast("string"), "part").alias("spread"), *[c.alias(k) for k, c in flags(F.col("text")).items()])
    rows = written(rows, "audit-flags")
    held = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    again = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))
    return hot_join(rows, held, ["digest"], "spread", "rows", "audit-texts").select("id", "part", *"ABCD", again.alias("E"))


def counted(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents, good ones and toxic ones by part and flags."""
    ones = {k: F.max((col(c) == 1).cast("int")) for k, c in (("good", "quality"), ("toxic", "toxic"))}
    marked = labels.filter(col(id_col).isNotNull()).groupBy(col(id_col).alias("labelled")).agg(*[F.coalesce(c, F.lit(0)).alias(k) for k, c in ones.items()])
    rows = failed.join(marked, F.col("id") == F.col("labelled"), "left")
    return rows.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in COUNTS[1:]])


def survivors(counts: DataFrame) -> DataFrame:
    """part, subset (a bit for each filter) and how many pass all filters of it, zeros included."""
    cubed = counts.cube("part", *FILTERS).agg(*[F.sum(k).alias(k) for k in COUNTS], F.grouping("part").alias("every"), *[F.grouping(f).alias(f"out_{f}") for f in FILTERS])
    passed, subset = F.col("every") == 0, F.lit(0)
    for i, f in enumerate(FILTERS):
        passed = passed & ((F.col(f"out_{f}") == 1) | ~F.col(f))
        subset = subset + F.when(F.col(f"out_{f}") == 0, 1 << i).otherwise(0)
    found = cubed.filter(passed).select("part", subset.alias("subset"), *COUNTS)
    grid = counts.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(ALL))))
    return grid.join(found, ["part", "subset"], "left").na.fill(0, list(COUNTS))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark, n = docs.sparkSession, len(FILTERS)
    passing = written(survivors(written(counted(failures(docs, id_col, text_col, part_col), labels, id_col), "audit-counts")), "audit-survivors")
    # the share of all orders in which a filter follows just these others
    pairs = [(s, s | 1 << i, f, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()), s == 0, s | 1 << i == ALL) for s in range(ALL + 1) for i, f in enumerate(FILTERS) if not s >> i & 1]
    pairs = spark.createDataFrame(pairs, "subset int, after int, filter string, orders long, first boolean, last boolean")
    before = passing.join(F.broadcast(pairs), "subset")
    after = passing.select("part", F.col("subset").alias("after"), *[F.col(k).alias(f"{k}_after") for k in COUNTS])
    steps = before.join(after, ["part", "after"]).select("part", "subset", "filter", "orders", "first", "last", F.col("n_after").alias("kept"), *[(F.col(k) - F.col(f"{k}_after")).alias(f"{k}_lost") for k in COUNTS])
    # of a filter alone: what it removes as the first, as the last, and over all orders
    alone = steps.groupBy("part", "filter").agg(F.sum(F.when(F.col("first"), F.col("n_lost"))).alias("fails"), F.sum(F.when(F.col("last"), F.col("n_lost"))).alias("unique_fails"), F.sum(F.col("orders") * F.col("n_lost")).alias("shapley"))
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    places = [("".join(p), k + 1, p[k], sum(bit[f] for f in p[:k])) for p in permutations(FILTERS) for k in range(n)]
    places = spark.createDataFrame(places, "filter_order string, step int, filter string, subset int")
    out = steps.join(alone, ["part", "filter"]).join(F.broadcast(places), ["subset", "filter"])
    return out.select("part", "filter_order", "step", "filter", "kept", F.col("n_lost").alias("removed"), (F.col("fails") - F.col("n_lost")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
