"""Exact percentiles and dense indexes for groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITS = 128


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "q") -> DataFrame:
    """Linear-interpolation percentiles per group as an array column ``name``, plus ``n``.

    Equal to ``percentile``, but no group is ever gathered: equal values are
    counted first, a mergeable sketch picks cut points per group, counts per
    slice give the rank offsets, and only the slices that hold a wanted rank are
    ordered.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    cut_probs = F.array(*[F.lit(i / SPLITS) for i in range(1, SPLITS)])
    cuts = counted.groupBy(*keys).agg(F.percentile_approx("_v", cut_probs, 10000).alias("_cuts"))
    sliced = counted.join(cuts, keys).withColumn(
        "_slice", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    ).drop("_cuts")
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    sizes = sliced.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_size"))
    sizes = sizes.withColumn("_before", F.sum("_size").over(by_slice) - F.col("_size")).withColumn(
        "n", F.sum("_size").over(Window.partitionBy(*keys))
    )
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    ranks = sizes.withColumn("_w", wanted).withColumn("_h", (F.col("n") - 1) * F.col("_w.p"))
    low, high = F.floor("_h"), F.ceil("_h")
    ranks = ranks.withColumn("_rank", F.explode(F.array_distinct(F.array(low, high))))
    ranks = ranks.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_size")))
    slices = ranks.groupBy(*keys, "_slice", "_before", "n").agg(
        F.collect_set(F.struct(F.col("_w.i").alias("i"), "_rank", "_h")).alias("_want")
    )
    run = F.sum("_c").over(Window.partitionBy(*keys, "_slice").orderBy("_v"))
    hit = (
        sliced.join(slices, [*keys, "_slice"])
        .withColumn("_end", run + F.col("_before"))
        .withColumn("_t", F.explode("_want"))
        .filter((F.col("_t._rank") < F.col("_end")) & (F.col("_t._rank") >= F.col("_end") - F.col("_c")))
    )
    frac = F.col("_h") - F.floor("_h")
    points = (
        hit.groupBy(*keys, "n", F.col("_t.i").alias("_i"), F.col("_t._h").alias("_h"))
        .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .select(*keys, "n", "_i", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias("_q"))
    )
    return (
        points.groupBy(*keys, "n")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias(name))
        .select(*keys, name, "n")
    )
