"""Paired experiments between two arms: comparisons, efficiency ratios, tests, hypotheses, run orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.hashing import mulberry32
from millrace.functions.stats import bootstrap, cohens_d, effect_class, wilcoxon

NEW, OLD = "tool", "traditional"
METRICS = ("correctness", "tokens", "steps")
CELL = ["corpus", "task_id", "model"]
ALPHA, HARD, SUCCESS = 0.05, 3, 0.8


def flat(trials: DataFrame) -> DataFrame:
    """Trials with tokens as their total and the number of distinct tools."""
    total = F.col("tokens.total") if "struct" in dict(trials.dtypes)["tokens"] else F.col("tokens")
    out = trials.withColumn("tokens", total.cast("double")).withColumn("steps", F.col("steps").cast("double"))
    return out.withColumn("unique_tools", F.size(F.array_distinct(F.transform("tool_calls", lambda t: t["name"])))) if "tool_calls" in trials.columns else out


def groups(trials: DataFrame) -> DataFrame:
    """Per corpus, task, model and arm: trials, success rate, means of the metrics, efficiency index."""
    index = F.col("correctness") * F.log1p(1.0 / F.greatest("tokens", F.lit(1.0))) * F.col("success").cast("int")
    return flat(trials).groupBy(*CELL, "arm").agg(
        F.count(F.lit(1)).alias("trials"), F.avg(F.col("success").cast("int")).alias("tsr"), F.avg("correctness").alias("mcs"), F.avg("tokens").alias("mean_tokens"), F.avg("steps").alias("mean_steps"), F.avg(index).alias("aei")
    )


def adjusted(grouped: DataFrame, tasks: DataFrame) -> DataFrame:
    """groups() with difficulty (0 where unknown) and dae, the index over difficulty (0 at difficulty 0)."""
    joined = grouped.join(tasks.select("task_id", "difficulty"), "task_id", "left").withColumn("difficulty", F.coalesce("difficulty", F.lit(0)))
    return joined.withColumn("dae", F.when(F.col("difficulty") == 0, 0.0).otherwise(F.col("aei") / F.col("difficulty")))


def pairs(trials: DataFrame, new: str = NEW, old: str = OLD) -> DataFrame:
    """(cell, metric, new, old): trials of both arms paired by the rank of their repetition, one row per metric."""
    ranked = flat(trials).withColumn("_n", F.row_number().over(W.partitionBy(*CELL, "arm").orderBy("repetition")))
    a, b = (ranked.filter(F.col("arm") == x).select(*CELL, "_n", *(F.col(m).alias(f"{m}_{s}") for m in METRICS)) for x, s in ((new, "a"), (old, "b")))
    both = a.join(b, [*CELL, "_n"])
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").cast("double").alias("new"), F.col(f"{m}_b").cast("double").alias("old")) for m in METRICS))
    return both.select(*CELL, F.explode(cells).alias("m")).select(*CELL, "m.*")


def compare(trials: DataFrame, new: str = NEW, old: str = OLD, compat: bool = False) -> DataFrame:
    """Per cell and metric: means, deviations, signed-rank test, effect size, and significance after Bonferroni."""
    keys = [*CELL, "metric"]
    p = pairs(trials, new, old)
    effects = p.groupBy(*keys).agg(F.avg("new").alias("mean_new"), F.avg("old").alias("mean_old"), F.stddev_pop("new").alias("std_new"), F.stddev_pop("old").alias("std_old"), F.when(F.count(F.lit(1)) > 1, cohens_d("new", "old")).otherwise(0.0).alias("effect_size"))
    tested = effects.join(wilcoxon(p, keys, "new", "old", compat), keys)
    n = tested.agg(F.count(F.lit(1)).alias("comparisons"))
    out = tested.join(F.broadcast(n), how="cross").withColumn("alpha", F.lit(ALPHA) / F.col("comparisons"))
    return out.withColumn("significant", F.col("p_value") < F.col("alpha")).withColumn("magnitude", effect_class(F.col("effect_size"))).drop("comparisons")


def intervals(trials: DataFrame, arm: str, draws: int = 1000, seed: int = 1) -> DataFrame:
    """Bootstrap intervals of each cell's and metric's mean for one arm."""
    p = pairs(trials).select(*CELL, "metric", F.col("new" if arm == NEW else "old").alias("value"))
    return bootstrap(p, [*CELL, "metric"], "value", draws, seed=seed)


def ratios(trials: DataFrame, by: list[str] = ("corpus",), new: str = NEW, old: str = OLD) -> DataFrame:
    """by, ter and ser: mean tokens and steps of the old arm over the new one's; infinite where the latter is 0."""
    mean = lambda m, arm: F.avg(F.when(F.col("arm") == arm, F.col(m)))
    means = flat(trials).groupBy(*by).agg(*(mean(m, a).alias(f"_{m}_{s}") for m in ("tokens", "steps") for a, s in ((new, "new"), (old, "old"))))
    ratio = lambda m: F.when(F.col(f"_{m}_new") == 0, float("inf")).otherwise(F.col(f"_{m}_old") / F.when(F.col(f"_{m}_new") != 0, F.col(f"_{m}_new")))
    return means.filter("_tokens_new IS NOT NULL AND _tokens_old IS NOT NULL").select(*by, ratio("tokens").alias("ter"), ratio("steps").alias("ser"))


def hypotheses(trials: DataFrame, tasks: DataFrame, compared: DataFrame | None = None, new: str = NEW, old: str = OLD) -> DataFrame:
    """(hypothesis, supported, effect) of H1 tokens, H2 steps on hard tasks, H3 hard over easy, H4 variance."""
    results = compare(trials, new, old) if compared is None else compared
    level = results.join(tasks.select("task_id", "difficulty"), "task_id", "left").withColumn("hard", F.coalesce("difficulty", F.lit(0)) >= HARD)
    sure = lambda m: results.filter((F.col("metric") == m) & F.col("significant"))
    finite = F.col("ter") != float("inf")
    h1 = ratios(trials, ["corpus"], new, old).join(sure("tokens").select("corpus").distinct().withColumn("_s", F.lit(True)), "corpus", "left")
    h1 = h1.agg((F.count(F.when((F.col("ter") > 1) & F.col("_s"), 1)) >= 2).alias("supported"), F.coalesce(F.avg(F.when(finite, F.col("ter"))), F.lit(0.0)).alias("effect"))
    h2 = level.filter("metric = 'steps' AND hard").join(ratios(trials, CELL, new, old).select(*CELL, "ser"), CELL, "left")
    h2 = h2.agg(((F.countDistinct("task_id") > 0) & (F.count(F.when((F.col("ser") > 1) & F.col("significant"), 1)) >= F.countDistinct("task_id") * 0.5)).alias("supported"), F.coalesce(F.avg("effect_size"), F.lit(0.0)).alias("effect"))
    gain = lambda c: F.coalesce(F.avg(F.when(c, F.col("mean_new") - F.col("mean_old"))), F.lit(0.0))
    h3 = level.filter("metric = 'correctness'").agg((gain(F.col("hard")) - gain(~F.col("hard"))).alias("effect")).select((F.col("effect") > 0).alias("supported"), "effect")
    var = lambda arm: F.var_pop(F.when(F.col("arm") == arm, F.col("correctness")))
    n = lambda arm: F.count(F.when(F.col("arm") == arm, 1))
    h4 = trials.agg(var(new).alias("a"), var(old).alias("b"), (F.least(n(new), n(old)) >= 2).alias("ok"))
    h4 = h4.select((F.col("ok") & (F.col("a") < F.col("b"))).alias("supported"), F.when(F.col("ok") & (F.col("b") > 0), F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).otherwise(0.0).alias("effect"))
    named = [df.select(F.lit(f"H{i}").alias("hypothesis"), F.coalesce("supported", F.lit(False)).alias("supported"), F.col("effect").cast("double").alias("effect")) for i, df in enumerate((h1, h2, h3, h4), 1)]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


def task_efficiency(compared: DataFrame) -> DataFrame:
    """Per task: mean effect and p-value, and whether any comparison is significant."""
    return compared.groupBy("task_id").agg(F.avg("effect_size").alias("mean_effect"), F.avg("p_value").alias("mean_p"), F.bool_or("significant").alias("any_significant"))


def summary(verdicts: DataFrame) -> DataFrame:
    """hypothesis by corpus: verdicts (corpus, hypothesis, supported) pivoted."""
    return verdicts.groupBy("hypothesis").pivot("corpus").agg(F.first(F.when(F.col("supported"), "supported").otherwise("not supported")))


def rubric_score(scores: DataFrame, rubric: DataFrame, by: list[str]) -> DataFrame:
    """Weighted mean of (criterion, score) rows under (criterion, weight); missing scores are 0; four decimals."""
    cells = scores.select(*by).distinct().join(F.broadcast(rubric), how="cross")
    joined = cells.join(scores, [*by, "criterion"], "left")
    return joined.groupBy(*by).agg(F.round(F.sum(F.coalesce("score", F.lit(0.0)) * F.col("weight")) / F.sum("weight"), 4).alias("score"))


def judged_success(column: str = "score"):
    return F.col(column) >= SUCCESS


def design(spark: SparkSession, models: list[str], repetitions: int, tasks: list[str], arms: tuple[str, str] = (NEW, OLD)) -> DataFrame:
    """The trial matrix model x repetition x arm x task; odd repetitions begin with the new arm."""
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, models))).alias("model"))
    reps = one.select("model", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition"))
    forward, back = F.array(*map(F.lit, arms)), F.array(*map(F.lit, reversed(arms)))
    with_arms = reps.select("model", "repetition", F.posexplode(F.when(F.col("repetition") % 2 == 1, forward).otherwise(back)).alias("arm_order", "arm"))
    return with_arms.select("*", F.explode(F.array(*map(F.lit, tasks))).alias("task_id"))


def task_order(tasks: list[tuple[str, int]], corpus: str, repetition: int, model: str = "", arm: str = "") -> list[str]:
    """Task ids shuffled within the tiers easy (to 2), medium (3) and hard (from 4), seeded by the cell."""
    seed = 0
    for c in f"{corpus}:{repetition}:{model}:{arm}":
        seed = (seed * 31 + ord(c)) & 0xFFFFFFFF
    draw, out = mulberry32(seed), []
    for tier in ((lambda d: d <= 2), (lambda d: d == 3), (lambda d: d >= 4)):
        ids = [t for t, d in tasks if tier(d)]
        for i in range(len(ids) - 1, 0, -1):
            j = int(draw() * (i + 1))
            ids[i], ids[j] = ids[j], ids[i]
        out += ids
    return out
