"""Regression gates: metrics against a baseline with tolerances, and the verdict on a new backend."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.records import load_baseline, metric_rows

# Tolerances of each metric. Absolute ones are two-sided, relative ones limit growth.
ABSOLUTE = {m: 0.01 for m in ("recall_at_5", "recall_at_10", "ndcg_at_10", "mrr", "symbol_recall_at_5", "symbol_recall_at_10", "symbol_precision_at_5")}
RELATIVE = {"indexing_secs": 0.5, "peak_rss_bytes": 0.2, "disk_size_bytes": 0.2, "query_p95_ms": 1.0}
PASSED, FAILED, REGRESSED, TOO_SLOW = 0, 1, 2, 75


def tolerances(spark: SparkSession) -> DataFrame:
    rows = [(k, "absolute", v) for k, v in ABSOLUTE.items()] + [(k, "relative", v) for k, v in RELATIVE.items()]
    return spark.createDataFrame(rows, "name string, tol_kind string, tol double")


def compare(current: DataFrame, baseline: DataFrame, tolerance: DataFrame) -> DataFrame:
    """name, current, baseline, delta, status of every metric on either side.

    A metric that misses on one side, or is not finite, regresses. A baseline of 0 with a relative tolerance asks
    for equality. Limits themselves regress. A metric without a tolerance has absolute 0.01.
    """
    both = current.select("name", F.col("value").alias("current")).join(baseline.select("name", F.col("value").alias("baseline")), "name", "full_outer")
    both = both.join(F.broadcast(tolerance), "name", "left").withColumn("delta", F.col("current") - F.col("baseline"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    within = F.when(F.coalesce("tol_kind", F.lit("absolute")) == "absolute", F.abs("delta") < F.coalesce("tol", F.lit(0.01))).when(F.col("baseline") == 0, F.col("delta") == 0).otherwise(F.col("delta") < F.col("baseline") * F.col("tol"))
    ok = finite("current") & finite("baseline") & finite("delta") & within
    return both.select("name", "current", "baseline", "delta", F.when(ok, "pass").otherwise("regress").alias("status"))


def slim_to_full(metrics: dict[str, float]) -> dict[str, float]:
    """Metrics of one family with the other family's at zero."""
    return {**dict.fromkeys(ABSOLUTE, 0.0), **metrics}


def migration_reasons(reports: DataFrame) -> DataFrame:
    """One row per candidate: verdict ('migrate' or 'stay') and the reasons to stay.

    Input pairs have struct columns ``incumbent`` and ``candidate`` of store reports.
    """
    i, c = (lambda n: F.col(f"incumbent.{n}")), (lambda n: F.col(f"candidate.{n}"))
    one = lambda x: F.round(x, 1).cast("string")
    grew = lambda n, label: F.when(c(n) > i(n) * 1.2, F.concat(F.lit(f"{label} > 1.2x: incumbent="), i(n).cast("string"), F.lit(", candidate="), c(n).cast("string")))
    slow = lambda side, get: F.when(~get("slo_passed"), F.concat(F.lit(f"{side} SLO failed: indexing "), one(get("indexing_secs")), F.lit("s exceeded "), get("slo_limit_secs").cast("string"), F.lit("s")))
    reasons = F.array_compact(
        F.array(
            F.when(c("indexing_secs") > i("indexing_secs") / 1.5, F.concat(F.lit("Indexing not 1.5x faster: incumbent="), one(i("indexing_secs")), F.lit("s, candidate="), one(c("indexing_secs")), F.lit("s"))),
            grew("peak_rss_bytes", "Peak RSS"),
            grew("disk_size_bytes", "Disk size"),
            F.when(i("query_p95_ms") > 0, grew("query_p95_ms", "Query p95")),
            slow("Candidate", c),
            slow("Incumbent", i),
        )
    )
    return reports.withColumn("reasons", reasons).withColumn("verdict", F.when(F.size("reasons") == 0, "migrate").otherwise("stay"))


def exit_code(compared: DataFrame, slo_passed: bool = True) -> int:
    """0 pass, 2 regression, 75 where the time limit is missed; errors are 1."""
    if not slo_passed:
        return TOO_SLOW
    return REGRESSED if compared.filter("status = 'regress'").limit(1).count() else PASSED


def run(spark: SparkSession, current: dict[str, float], baseline_path: str, delta_path: str | None = None) -> int:
    """Compare metrics with a baseline file; writes the deltas as JSON beside it and returns the exit code."""
    try:
        found = load_baseline(baseline_path)
    except ValueError:
        return FAILED
    names = [k for k in found.get("metrics", {}) if k in ABSOLUTE or k in RELATIVE]
    full = slim_to_full if any(k in ABSOLUTE for k in names) else dict
    compared = compare(metric_rows(spark, full(current)), metric_rows(spark, full({k: found["metrics"][k] for k in names})), tolerances(spark))
    rows = [r.asDict() for r in compared.orderBy("name").collect()]
    Path(delta_path or f"{baseline_path}.delta.json").write_text(json.dumps(rows, indent=1))
    return exit_code(compared)
