"""Benchmark grid, micro-aggregates by grouping sets, eligibility census."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions.ident import stable_id
from factlens.functions.ratios import rounded
from factlens.operators.score import f1

PROFILES = ("lookahead", "unit_drift", "duplicate", "revision_overwrite")
SEVERITIES = ("low", "medium", "high")


def seed_class(seed: int) -> str:
    """development 0-9, validation 100-109, reserved 1000-1009."""
    for name, low in (("development", 0), ("validation", 100), ("reserved", 1000)):
        if low <= seed <= low + 9:
            return name
    raise ValueError(f"seed {seed} belongs to no class")


def expand(spark: SparkSession, profiles=PROFILES, severities=SEVERITIES, seeds=range(10), authorized: bool = False) -> DataFrame:
    """The case matrix: every profile, severity and seed, and a clean control for each seed."""
    classes = {s: seed_class(s) for s in seeds}
    if "reserved" in classes.values() and not authorized:
        raise PermissionError("reserved seeds need authorization")
    rows = [(p, v, s, classes[s], "fault") for p, v, s in product(sorted(profiles), severities, sorted(seeds))] + [("none", "none", s, classes[s], "clean_control") for s in sorted(seeds)]
    cases = spark.createDataFrame(rows, "fault_profile string, severity string, seed int, seed_class string, kind string")
    return cases.select(stable_id("case", F.col("fault_profile"), F.col("severity"), F.col("seed").cast("string")).alias("case_id"), "*")


COUNTERS = ("findings", "faults", "true_positives", "false_positives", "eligible")


def controls(spark: SparkSession, profiles=PROFILES, severity: str = "medium", seed: int = 0) -> DataFrame:
    """A clean control for every profile: nothing is injected, and its denominator is what faults of the severity could take."""
    rows = [(p, severity, seed, seed_class(seed), "clean_control") for p in sorted(profiles)]
    cases = spark.createDataFrame(rows, "fault_profile string, severity string, seed int, seed_class string, kind string")
    return cases.select(stable_id("control", F.col("fault_profile"), F.col("severity"), F.col("seed").cast("string")).alias("case_id"), "*")


def aggregate(results: DataFrame, dims: tuple[str, ...] = ("fault_profile", "severity", "seed_class", "seed"), nulls: str = "strict") -> DataFrame:
    """Overall and by each dimension, in one pass of grouping sets: sums of counters, then ratios.

    nulls: "lenient" has precision 1 for succeeded groups without findings and faults, and F1 0 where precision and recall are 0;
    "strict" has null for both.
    """
    dims_ = list(dims)
    sums = results.groupingSets([[], *[[d] for d in dims_]], *dims_).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.count_if(F.col("status") == "ok").alias("succeeded"), F.count("*").alias("cases"), F.grouping_id(*dims_).alias("gid"))
    # A set bit of gid says that the dimension is summed over; the first dimension has the highest bit.
    n = len(dims_)
    which = F.when(F.col("gid") == (1 << n) - 1, F.lit("overall"))
    value = F.when(F.col("gid") == (1 << n) - 1, F.lit("all"))
    for i, d in enumerate(dims_):
        mine = (1 << n) - 1 - (1 << (n - 1 - i))
        which, value = which.when(F.col("gid") == mine, F.lit(d)), value.when(F.col("gid") == mine, F.col(d).cast("string"))
    p, r = rounded(F.col("true_positives"), F.col("findings")), rounded(F.col("true_positives"), F.col("faults"))
    if nulls == "lenient":
        p = F.when((F.col("findings") == 0) & (F.col("faults") == 0) & (F.col("succeeded") > 0), F.lit(1.0)).otherwise(p)
    out = sums.withColumns({"dimension": which, "member": value, "precision": p, "recall": r})
    score = f1(F.col("precision"), F.col("recall"))
    if nulls == "strict":
        score = F.when(F.col("precision") + F.col("recall") == 0, None).otherwise(score)
    return out.withColumns({"f1": score, "false_positive_rate": rounded(F.col("false_positives"), F.col("eligible"))}).select("dimension", "member", "cases", "succeeded", *COUNTERS, "precision", "recall", "f1", "false_positive_rate")


LEAST_UNIT, LEAST_TOTAL = 8, 24


def census(counts: DataFrame, units: DataFrame, families: tuple[str, ...] = PROFILES) -> DataFrame:
    """(partition, family): total, best unit (by count, then id), supporting units, status; cells without a row count zero.

    `units` (partition, unit) is a driver-side registry, so its product with the few families is small.
    """
    cells = units.withColumn("family", F.explode(F.array(*map(F.lit, families))))
    full = cells.join(counts, ["partition", "unit", "family"], "left").withColumn("eligible", F.coalesce("eligible", F.lit(0)))
    out = full.groupBy("partition", "family").agg(F.sum("eligible").alias("total"), F.max_by(F.struct("unit", "eligible"), F.struct(F.col("eligible"), F.col("unit"))).alias("best"), F.count_if(F.col("eligible") > 0).alias("supporting"))
    ok = (F.col("best.eligible") >= LEAST_UNIT) & (F.col("total") >= LEAST_TOTAL)
    return out.select("partition", "family", "total", F.col("best.unit").alias("best_unit"), F.col("best.eligible").alias("best_eligible"), "supporting", F.when(ok, "eligible").otherwise("ineligible").alias("status"))


def diversity_profile(facts: DataFrame) -> DataFrame:
    """Exact counts and extremes that describe a unit of facts."""
    lag = F.datediff("filed_on", "period_end")
    return facts.agg(
        F.count("*").alias("records"), *[F.count_distinct(c).alias(f"distinct_{c}") for c in ("entity_id", "concept", "unit", "period_end", "form", "source_name")],
        F.min(lag).cast("long").alias("least_lag"), F.max(lag).cast("long").alias("most_lag"), F.count_if(F.col("value") < 0).alias("negative"), F.count_if(F.col("value") == 0).alias("zero"),
        F.min("period_end").alias("first_period_end"), F.max("period_end").alias("last_period_end"),
    )


def run_cases(spark: SparkSession, cases: list, run_one) -> DataFrame:
    """Status rows of cases run one by one; a failing case does not stop the others and shows its error class only."""
    rows = []
    for case in cases:
        try:
            rows.append((case, "ok", None, run_one(case)))
        except Exception as e:  # noqa: BLE001
            rows.append((case, "failed", type(e).__name__, None))
    return spark.createDataFrame(rows, "case_id string, status string, error string, result string")


def incomplete(cases: DataFrame, statuses: DataFrame) -> DataFrame:
    """(case_id, status) of the cases that have no status, or one other than `ok`."""
    return cases.join(statuses.select("case_id", "status"), "case_id", "left").filter("status IS NULL OR status != 'ok'").select("case_id", F.coalesce("status", F.lit("incomplete")).alias("status"))
