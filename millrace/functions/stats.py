"""Statistics as Spark expressions and plans: normal tail, percentiles, rank tests, effect sizes, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The Abramowitz and Stegun 7.1.26 polynomial for the error function.
P = 0.3275911
COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + P * F.abs(x))
    series = F.lit(0.0)
    for a in reversed(COEFFICIENTS):
        series = (series + a) * t
    return F.signum(x) * (1.0 - series * F.exp(-x * x))


def normal_cdf(x: Column, compat: bool = False) -> Column:
    """The standard normal distribution. ``compat`` feeds |x| instead of |x| / sqrt(2) to the polynomial and is anti-conservative."""
    if not compat:
        return 0.5 * (1.0 + erf(x / F.sqrt(F.lit(2.0))))
    t = 1.0 / (1.0 + P * F.abs(x))
    series = F.lit(0.0)
    for a in reversed(COEFFICIENTS):
        series = (series + a) * t
    y = 1.0 - series * F.exp(-x * x / 2)
    return F.when(x < -8, 0.0).when(x > 8, 1.0).otherwise(0.5 * (1.0 + F.when(x < 0, -1.0).otherwise(1.0) * y))


def percentile_nearest(column: str, q: float) -> Column:
    """Nearest rank: the value at ceil(q n)."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{column}`)")


def percentile_rounded(column: str, q: float) -> Column:
    """The value at index round((n - 1) q) of the sorted group; for report-sized groups."""
    values = F.sort_array(F.collect_list(column))
    return F.get(values, F.round((F.size(values) - 1) * F.lit(q)).cast("int"))


def wilcoxon(pairs: DataFrame, keys: list[str], x: str, y: str, compat: bool = False) -> DataFrame:
    """Two-sided signed-rank test per group: keys, n, statistic, p_value.

    Zero differences drop, tied ones share their average rank, and up to 20 pairs get a continuity correction.
    Groups with no difference have statistic 0 and p 1.
    """
    diff = F.col(x) - F.col(y)
    base = pairs.select(*keys, diff.alias("_d"))
    nonzero = base.filter("_d <> 0")
    size = F.abs("_d")
    order = W.partitionBy(*keys).orderBy(size)
    ties = W.partitionBy(*keys, size)
    ranked = nonzero.withColumn("_r", F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)
    plus, minus = F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0))
    sums = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.least(plus, minus).alias("statistic"))
    n = F.col("n").cast("double")
    mu, sigma = n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    z = (F.col("statistic") + F.when(n <= 20, 0.5).otherwise(0.0) - mu) / sigma
    tested = sums.withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * normal_cdf(-F.abs(z), compat))))
    return base.select(*keys).distinct().join(tested, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("statistic", F.lit(0.0)).alias("statistic"), F.coalesce("p_value", F.lit(1.0)).alias("p_value"))


def cohens_d(x: str, y: str) -> Column:
    """Difference of means over the pooled population deviation, floored at 1e-10. An aggregate."""
    n, m = F.count(x), F.count(y)
    pooled = F.sqrt((F.var_pop(x) * (n - 1) + F.var_pop(y) * (m - 1)) / F.greatest(n + m - 2, F.lit(1)))
    return (F.avg(x) - F.avg(y)) / F.greatest(pooled, F.lit(1e-10))


def effect_class(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def bootstrap(df: DataFrame, keys: list[str], value: str, draws: int = 1000, level: float = 0.95, seed: int = 1) -> DataFrame:
    """Percentile interval of the mean per group: keys, mean, lo, hi. Seeded, so runs repeat.

    Every draw picks n values by hashed positions: rows are exploded to draws and slots and joined back by
    position, so no group is collected. The slots are ``draws`` times the rows, which Spark's size estimate does not
    see, so they are spread over tasks and the join is a merge join: neither side is broadcast.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(value)) - 1)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("mean"))
    slots = sizes.select(*keys, "_n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_b")).repartition(tasks, *keys, "_b")
    slots = slots.select(*keys, "_n", "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_s"))
    picked = slots.select(*keys, "_b", F.pmod(F.xxhash64(*keys, "_b", "_s", F.lit(seed)), F.col("_n")).cast("int").alias("_i"))
    means = picked.join(numbered.hint("merge"), [*keys, "_i"]).groupBy(*keys, "_b").agg(F.avg(value).alias("_m"))
    edge = (1 - level) / 2
    # the two ends of ``draws`` means; draws is a parameter, so the list is bounded
    ends = means.groupBy(*keys).agg(F.sort_array(F.collect_list("_m")).alias("_l"))
    ends = ends.select(*keys, F.get("_l", F.floor(F.lit(edge) * draws).cast("int")).alias("lo"), F.get("_l", F.least(F.floor(F.lit(1 - edge) * draws), F.lit(draws - 1)).cast("int")).alias("hi"))
    return sizes.join(ends, keys).select(*keys, "mean", "lo", "hi")
