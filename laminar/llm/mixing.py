"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word target from its weight. Whole epochs come first: a target of
2.4 times the source's size takes every document twice; the remaining 0.4 is a
weighted sample without replacement. Its keys are -ln(u) / w, u from a hash of the
document's id and w the document's quality weight; documents are taken in key order
until their prefix sum of words meets the budget.

The prefix sum is two-level, so that a source of any size is spread over all tasks:
words are summed by source and key bin, bins are summed up within a source, and only
the rows of the one bin in which the budget ends are sorted. The result of planning
is one row per source; documents are then decided row by row against it, without
moving their texts.

Contract: null texts have size 0; a null source is a source of its own and the last
one. Documents of size 0 are never taken. Rows with equal id and source share one
key and are decided together. Quality weights that are null or not positive count as
`LEAST_WEIGHT`. Extra columns are ignored by `mix` and kept by `resample`, whatever their names. An empty table gives an empty table. Weights
and `cap` have to be positive, else a ValueError is raised; a cap too large to matter is no cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, numbered

#: Documents' lowest quality weight.
LEAST_WEIGHT = 0.1
#: Key bins: so many to an octave, from 2^LOW to 2^HIGH. Keys of any one weight put at most 0.37 * ln 2 / PER_OCTAVE
#: of their rows into a bin, whatever the weight is.
PER_OCTAVE, LOW, HIGH = 256, -40, 24
BINS = PER_OCTAVE * (HIGH - LOW)


def words_in(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def quality_weight(text_col: str) -> Column:
    """1 for clean prose, less the more symbols a text has."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    marks = F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    return F.greatest(F.lit(LEAST_WEIGHT), 1 - 10.0 * marks / F.greatest(F.length(t), F.lit(1)))


def source_key(source_col: str) -> Column:
    """Sorts by code point, null last."""
    return F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))


def sample_key(id_col: str, weight: Column, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 11)
    u = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
    w = F.when(weight > 0, weight).otherwise(F.lit(LEAST_WEIGHT))
    return -F.log(u) / w


def prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None, seed: int) -> dict[str, Column]:
    key = sample_key(id_col, quality_weight(text_col) if weight is None else weight, seed)
    return {"__source": source_key(source_col), "__id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "__size": words_in(text_col), "__key": key}


def key_bin() -> Column:
    return F.greatest(F.lit(0), F.least(F.floor((F.log2("__key") - LOW) * PER_OCTAVE), F.lit(BINS - 1))).cast("int")


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(__source, source_size, target): shares of all words by weight, at most `cap` times a source's size.

    What a capped source leaves is shared again by weight. The level (words per unit
    of weight) only rises, so each round needs two sums over the sources.
    """
    if not weights or min(weights) <= 0 or not cap > 0:
        raise ValueError("weights and cap have to be positive")
    place = F.row_number().over(W.orderBy("__source")) - 1  # one row per source
    by_place = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    table = materialise(sources.select("__source", "source_size", by_place.alias("w")), "sources")
    level, capped = 0.0, -1
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while True:
        over = cap * F.col("source_size") < level * F.col("w")
        got = table.agg(F.sum(F.when(over, cap * F.col("source_size")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w"))), F.count(F.when(over, 1))).first()
        if got[2] == capped or not got[1]:
            break
        capped = got[2]
        level = (total - got[0]) / got[1]
    return table.select("__source", "source_size", F.least(level * F.col("w"), cap * F.col("source_size")).alias("target"))


def plan(sized: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """One row per source: size, target, epochs, the bin in which the sample ends and the last (key, id) taken there."""
    bins = sized.groupBy("__source", key_bin().alias("bin")).agg(F.sum("__size").alias("words"))
    bins = materialise(bins, "bins")
    goal = targets(bins.groupBy("__source").agg(F.sum("words").alias("source_size")), weights, cap)
    epochs = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) + 1e-9)
    goal = materialise(goal.withColumn("epochs", epochs).withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))), "targets")
    upto = W.partitionBy("__source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    ends = bins.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).join(goal, "__source")
    ends = ends.filter((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("words") > F.col("budget")))
    edge = materialise(ends.select("__source", "bin", "before", "budget"), "edge")
    inside = sized.withColumn("bin", key_bin()).join(edge, ["__source", "bin"])
    order = W.partitionBy("__source").orderBy("__key", "__id").rowsBetween(W.unboundedPreceding, -1)
    taken = inside.withColumn("ahead", F.col("before") + F.coalesce(F.sum("__size").over(order), F.lit(0)))
    taken = taken.filter(F.col("ahead") + F.col("__size") / 2 <= F.col("budget"))
    last = taken.groupBy("__source").agg(F.max(F.struct("__key", "__id")).alias("cut"))
    return materialise(goal.join(edge.select("__source", F.col("bin").alias("edge")), "__source", "left").join(last, "__source", "left"), "plan")


def decided(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """rows with their source's plan and __times, how often the mix takes them. Spark broadcasts the plan if its size is small."""
    joined = rows.join(planned, "__source", "left")
    at = F.struct("__key", "__id")
    # No edge: the budget is all of the source, or nothing of it.
    sampled = F.when(F.col("edge").isNull(), F.col("budget") > 0).when(key_bin() < F.col("edge"), True).when((key_bin() == F.col("edge")) & F.col("cut").isNotNull(), at <= F.col("cut")).otherwise(False)
    return joined.withColumn("__times", F.when(F.col("__size") > 0, F.col("epochs") + F.when(sampled, 1).otherwise(0)).otherwise(0).cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, weight: Column | None = None, seed: int = 42) -> DataFrame:
    """id, size, source_size, target and taken (words, repeats counted) of every row."""
    cols = prepared(docs, id_col, text_col, source_col, weight, seed)
    sized = materialise(docs.select(id_col, *[c.alias(n) for n, c in cols.items()]), "sizes")
    out = decided(sized, plan(sized, weights, cap))
    return out.select(id_col, F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__times")).alias("taken"))


def resample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, weight: Column | None = None, seed: int = 42) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken."""
    kept = docs if weight is None else docs.select("*", weight.alias("__weight"))
    rows, name = numbered(kept)
    cols = prepared(rows, name[id_col], name[text_col], name[source_col], None if weight is None else F.col(rows.columns[-1]), seed)
    sized = materialise(rows.select(*[c.alias(n) for n, c in cols.items()]), "sizes")
    out = decided(rows.withColumns(cols), plan(sized, weights, cap))
    out = out.filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return out.select(*rows.columns[: len(docs.columns)]).toDF(*docs.columns)
