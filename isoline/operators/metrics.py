"""Agreement of partitions, precision and recall, average precision, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pairs(n: Column) -> Column:
    return F.sum(n * (n - 1) / 2).cast("bigint")


def agreement(items: DataFrame, keys: tuple[str, ...], first: str, second: str) -> DataFrame:
    """Pairwise agreement of two partitions of the same items, per keys, from counts instead of pairs.

    n_pair, agree, first_only (together in the first partition only), second_only, pct. Groups of one item have no
    pair and a pct of 0.
    """
    cells = items.groupBy(*keys, first, second).agg(F.count("*").alias("n"))
    both = cells.groupBy(*keys).agg(_pairs(F.col("n")).alias("both"), F.sum("n").alias("total"))
    a = cells.groupBy(*keys, first).agg(F.sum("n").alias("n")).groupBy(*keys).agg(_pairs(F.col("n")).alias("same_first"))
    b = cells.groupBy(*keys, second).agg(F.sum("n").alias("n")).groupBy(*keys).agg(_pairs(F.col("n")).alias("same_second"))
    out = both.join(a, list(keys)).join(b, list(keys)).withColumn("n_pair", (F.col("total") * (F.col("total") - 1) / 2).cast("bigint"))
    agree = F.col("n_pair") - F.col("same_first") - F.col("same_second") + 2 * F.col("both")
    pct = F.when(F.col("n_pair") > 0, 100.0 * agree / F.nullif("n_pair", F.lit(0))).otherwise(0.0)
    return out.select(*keys, F.col("total").alias("n_items"), "n_pair", agree.alias("agree"), (F.col("same_first") - F.col("both")).alias("first_only"), (F.col("same_second") - F.col("both")).alias("second_only"), pct.alias("pct"))


def precision_recall(rows: DataFrame, truth: str, found: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of a boolean truth and a boolean finding; a ratio of nothing is 0."""
    t, f = F.col(truth), F.col(found)
    n = rows.groupBy(*keys).agg(F.count_if(t & f).alias("tp"), F.count_if(~t & f).alias("fp"), F.count_if(t & ~f).alias("fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)

    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def boundary_edges(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected edges in one canonical form."""
    return edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo is not null and lo <> hi").distinct()


def average_precision(hits: DataFrame, cls: str, score: str, order: str, tp: str, gt: DataFrame, buckets: int = 64) -> DataFrame:
    """Per class: ap with the precision envelope, recall and number of truths.

    hits: one row per prediction with a score and whether it is a true positive; gt: (class, n_gt). Cumulative counts
    are taken in two levels, so that a class with most of the predictions is not ranked in one task: scores are cut
    at sampled quantiles, buckets are counted, and windows run within buckets.
    """
    cuts = hits.groupBy(cls).agg(F.percentile_approx(score, [k / buckets for k in range(1, buckets)], 1000).alias("_cuts"))
    rows = hits.join(cuts, cls).withColumn("_b", F.size(F.filter("_cuts", lambda c: c > F.col(score))))
    inside = Window.partitionBy(cls, "_b").orderBy(F.desc(score), order).rowsBetween(Window.unboundedPreceding, 0)
    one = F.when(F.col(tp), 1).otherwise(0)
    rows = rows.withColumn("_tp", F.sum(one).over(inside)).withColumn("_n", F.count("*").over(inside))
    sums = rows.groupBy(cls, "_b").agg(F.max("_tp").alias("t"), F.max("_n").alias("c"))
    before = Window.partitionBy(cls).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(cls, "_b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("_tp0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_n0"))
    rows = rows.join(sums, [cls, "_b"]).join(gt, cls).where("n_gt > 0")
    rows = rows.withColumn("_precision", (F.col("_tp") + F.col("_tp0")) / (F.col("_n") + F.col("_n0")))
    after = Window.partitionBy(cls, "_b").orderBy(F.col("_n")).rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_best", F.max("_precision").over(after))
    tops = rows.groupBy(cls, "_b").agg(F.max("_precision").alias("p"))
    later = Window.partitionBy(cls).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    tops = tops.select(cls, "_b", F.max("p").over(later).alias("_later"))
    rows = rows.join(tops, [cls, "_b"]).withColumn("_best", F.greatest("_best", F.coalesce("_later", F.lit(0.0))))
    got = rows.where(F.col(tp)).groupBy(cls).agg(F.sum("_best").alias("s"), F.count("*").alias("n_tp"))
    out = gt.join(got, cls, "left")
    ratio = lambda c: F.when(F.col("n_gt") > 0, F.coalesce(F.col(c), F.lit(0)) / F.nullif("n_gt", F.lit(0))).otherwise(0.0)
    return out.select(cls, ratio("s").alias("ap50"), ratio("n_tp").alias("recall"), "n_gt")


def dominant_vote(votes: DataFrame, keys: tuple[str, ...], value: str, order: str) -> DataFrame:
    """The most frequent value per keys; of equally frequent ones the first seen, then the largest."""
    n = votes.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"), value)).alias(value), F.max("n").alias("n_votes"))


def match_stems(sources: DataFrame, stems: DataFrame, gram: int = 8) -> DataFrame:
    """The stem of each source that starts with or contains the source's key; the closest length, then the first.

    Keys of `gram` characters and more meet stems on the key's first gram, which the stem must hold somewhere; shorter
    keys on all of theirs. Candidates are then checked whole.
    """
    n = F.least(F.length("key"), F.lit(gram))
    src = sources.where("key <> ''").withColumn("_n", n).withColumn("_g", F.substring("key", 1, gram))
    sizes = src.select("_n").distinct()
    parts = stems.select("stem").distinct().join(sizes, F.length("stem") >= F.col("_n")).withColumn("_g", F.explode(F.expr("array_distinct(transform(sequence(1, length(stem) - _n + 1), i -> substring(stem, i, _n)))")))
    near = src.join(parts, ["_n", "_g"]).where(F.contains("stem", "key"))
    best = near.groupBy("key").agg(F.min_by("stem", F.struct(F.abs(F.length("stem") - F.length("key")), "stem")).alias("stem"))
    return sources.join(best, "key", "left").select(*sources.columns, "stem")


def id_sets(found: DataFrame, expected: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """(keys, n_found, n_expected, n_correct, recall, precision) of sets of ids, in percent; a ratio of nothing is 0."""
    f, e = found.select(*keys, value).distinct(), expected.select(*keys, value).distinct()
    both = f.withColumn("_f", F.lit(1)).join(e.withColumn("_e", F.lit(1)), [*keys, value], "full")
    n = both.groupBy(*keys).agg(F.count("_f").alias("n_found"), F.count("_e").alias("n_expected"), F.count_if(F.col("_f").isNotNull() & F.col("_e").isNotNull()).alias("n_correct"))
    ratio = lambda of: F.when(F.col(of) > 0, 100.0 * F.col("n_correct") / F.nullif(of, F.lit(0))).otherwise(0.0)
    return n.select(*keys, "n_found", "n_expected", "n_correct", ratio("n_expected").alias("recall"), ratio("n_found").alias("precision"))
