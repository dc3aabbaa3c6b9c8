"""Audit policy: rules over audit input and findings, exceptions, roll-up and disposition."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions.ident import stable_id
from factlens.operators.detect import run_detectors
from factlens.operators.series import reporting_gaps

RESULT = ("rule_id", "rule_kind", "affected", "entity_id", "concept_namespace", "concept", "unit", "action", "detail")


@dataclass(frozen=True)
class Scope:
    concept_namespace: str
    concept: str
    entity_id: str | None = None
    unit: str | None = None

    def column(self) -> Column:
        own = {k: v for k, v in vars(self).items() if v is not None}
        return reduce(Column.__and__, [F.col(k) == v for k, v in own.items()])


@dataclass(frozen=True)
class ConceptUnit:
    rule_id: str
    scope: Scope
    accepted: tuple[str, ...]
    action: str = "blocking"


LAGS = {"filing": ("filed_on", "period_end"), "publication": ("available_on", "filed_on"), "availability": ("available_on", "period_end")}


@dataclass(frozen=True)
class PublicationLag:
    rule_id: str
    scope: Scope
    basis: str
    least: int
    most: int
    action: str = "warning"


@dataclass(frozen=True)
class ReportingFrequency:
    rule_id: str
    scope: Scope
    most_days: int
    action: str = "warning"


@dataclass(frozen=True)
class DetectorRule:
    rule_id: str
    detector: str
    enabled: bool = True
    action: str = "blocking"
    reason: str | None = None
    #: The least severity that gives a result.
    least: str = "low"
    #: The ratio from which unit drift is a finding; no other detector has one.
    threshold: int | None = None

    def __post_init__(self):
        if self.threshold is not None and (self.detector != "unit_drift" or self.threshold < 2):
            raise ValueError(f"rule {self.rule_id}: a threshold of two or more belongs to unit drift alone")
        if not self.enabled and not self.reason:
            raise ValueError(f"rule {self.rule_id}: a disabled detector needs a reason")
        if self.least not in SEVERITIES:
            raise ValueError(f"rule {self.rule_id}: unknown severity {self.least}")


SEVERITIES = ("low", "medium", "high")


class PolicyError(ValueError):
    """A policy cannot be applied to these data; nothing is reported."""


def _results(hits: DataFrame, rule, kind: str, affected: Column, detail: Column) -> DataFrame:
    return hits.select(F.lit(rule.rule_id).alias("rule_id"), F.lit(kind).alias("rule_kind"), affected.alias("affected"), "entity_id", "concept_namespace", "concept", "unit", F.lit(rule.action).alias("action"), detail.alias("detail"))


def concept_unit(audit: DataFrame, rule: ConceptUnit) -> DataFrame:
    return _results(audit.filter(rule.scope.column() & ~F.col("unit").isin(*rule.accepted)), rule, "concept_unit", F.col("record_id"), F.col("unit"))


#: Key of the metadata of `available_on` that says where it is from, and the value of a day that nobody stated.
AVAILABILITY, ASSUMED = "availability", "assumed"


def require_evidence(audit: DataFrame, rules: list) -> None:
    """Raises if a lag rule looks at `available_on` and the mapping did not say where it is from.

    The mapping writes its origin into the column's metadata, which selections and written tables keep. A column without it is a
    fact's own, so it is evidence.
    """
    for r in rules:
        if isinstance(r, PublicationLag) and "available_on" in LAGS[r.basis] and audit.schema["available_on"].metadata.get(AVAILABILITY) == ASSUMED:
            raise PolicyError(f"rule {r.rule_id}: {r.basis} needs to know when the data were available")


def publication_lag(audit: DataFrame, rule: PublicationLag) -> DataFrame:
    require_evidence(audit, [rule])
    end, start = LAGS[rule.basis]
    lag = F.datediff(end, start)
    return _results(audit.filter(rule.scope.column() & ~lag.between(rule.least, rule.most)), rule, "publication_lag", F.col("record_id"), lag.cast("string"))


def reporting_frequency(audit: DataFrame, rule: ReportingFrequency) -> DataFrame:
    return _results(reporting_gaps(audit.filter(rule.scope.column()), rule.most_days), rule, "reporting_frequency", F.concat_ws("|", "affected"), F.col("gap_days").cast("string"))


def run_detector_rules(audit: DataFrame, as_of: date | str, rules: list[DetectorRule]) -> DataFrame:
    """Findings of the detectors whose rule is enabled, unit drift from its rule's threshold on."""
    _one_each(rules)
    parts = []
    for r in rules:
        if r.enabled:
            more = {} if r.threshold is None else {"unit_drift": {"threshold": r.threshold}}
            parts.append(run_detectors(audit, as_of, (r.detector,), options=more))
    return reduce(DataFrame.unionByName, parts) if parts else run_detectors(audit.limit(0), as_of)


def _one_each(rules: list[DetectorRule]) -> None:
    names = [r.detector for r in rules]
    if again := sorted({n for n in names if names.count(n) > 1}):
        raise PolicyError(f"several rules for {again}")


def detector_results(findings: DataFrame, audit: DataFrame, rules: list[DetectorRule]) -> DataFrame:
    """One result for each finding of an enabled rule, of at least the rule's severity.

    A detector has one rule at most. Every record of a finding must be in `audit`, else the plan raises. A scope column is null
    where a finding's records differ in it, so that an exception for it does not fit.
    """
    _one_each(rules)
    on = [r for r in rules if r.enabled]
    grave = lambda r: F.col("severity").isin(*SEVERITIES[SEVERITIES.index(r.least) :])
    case = F.coalesce(F.lit(None).cast("struct<rule_id: string, action: string>"), *[F.when((F.col("detector") == r.detector) & grave(r), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.action).alias("action"))) for r in on])
    ruled = findings.withColumn("r", case).filter("r IS NOT NULL").select("finding_id", "r", "affected", "severity")
    columns = ("entity_id", "concept_namespace", "concept", "unit")
    known = audit.select("record_id", *columns, F.lit(True).alias("known"))
    each = ruled.withColumn("record_id", F.explode(F.split("affected", r"\|"))).join(known, "record_id", "left")
    same = [F.when(F.min(c) == F.max(c), F.min(c)).alias(c) for c in columns]
    whole = each.groupBy("finding_id", "r", "affected", "severity").agg(*same, F.min(F.when(F.col("known").isNull(), F.col("record_id"))).alias("unknown"))
    rule = F.when(F.col("unknown").isNull(), F.col("r.rule_id")).otherwise(F.raise_error(F.concat(F.lit("a finding names a record that is not audited: "), "unknown")).cast("string"))
    return whole.select(rule.alias("rule_id"), F.lit("detector").alias("rule_kind"), "affected", *columns, "r.action", F.col("severity").alias("detail"))


SCOPE = ("record_id", "entity_id", "concept_namespace", "concept", "unit")


class AmbiguousException(ValueError):
    """Two exceptions of equal specificity fit one result."""


def exceptions_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Exceptions as a table; a scope field that is left out fits everything, a dataset_name too."""
    schema = ", ".join(f"{c} string" for c in ("exception_id", "rule_id", *(f"x_{c}" for c in SCOPE), "effect", "override", "reason", "dataset_name"))
    return spark.createDataFrame([tuple(r.get(c.split()[0].removeprefix("x_") if c.startswith("x_") else c.split()[0]) for c in schema.split(", ")) for r in rows], schema)


def _key(rule: Column, pattern: int, values: list[Column]) -> Column:
    """What a result and an exception of a pattern share: the rule, the pattern and the values of the pattern's fields."""
    return F.array(rule, F.lit(str(pattern)), *[v for i, v in enumerate(values) if pattern >> i & 1])


def resolve_exceptions(results: DataFrame, exceptions: DataFrame, dataset_name: str | None = None, strict: bool = True) -> DataFrame:
    """Each result with its most specific exception: effective_action (null: waived), exception_id, ambiguous.

    An exception's pattern says which scope fields it sets. A result asks, for every pattern in use (32 at most), for exceptions of
    its rule with its own values of these fields: an equality join on one key, however many exceptions a rule has. Exceptions are
    configuration and broadcast, so results of one rule, which share keys, do not meet in one task, and only patterns that name a
    record shuffle them. A record fits a result that it is one of. Where two exceptions of the most fields fit, the plan raises, or says
    `ambiguous` if not `strict` (the action is then that of the smaller exception_id). With `dataset_name`, exceptions for other
    datasets are left out.
    """
    r = results.withColumn("result_id", stable_id("res", F.col("rule_id"), F.col("affected")))
    if "dataset_name" in exceptions.columns:
        exceptions = exceptions.filter(F.col("dataset_name").isNull() | (F.lit(dataset_name).isNotNull() & (F.col("dataset_name") == F.lit(dataset_name))))
    pattern = reduce(Column.__add__, [F.when(F.col(f"x_{c}").isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(SCOPE)])
    used = sorted(x.pattern for x in exceptions.select(pattern.alias("pattern")).distinct().collect())  # of 32 at most
    given = exceptions.withColumn("pattern", pattern)
    fields = [F.col(f"x_{c}") for c in SCOPE]
    x = F.struct("exception_id", "effect", "override").alias("x")
    own = [F.lit(None), *[F.col(c) for c in SCOPE[1:]]]
    size = lambda p: F.lit(bin(p).count("1")).alias("specificity")
    keyed = lambda p: given.filter(F.col("pattern") == p).select(_key(F.col("rule_id"), p, fields).alias("key"), size(p), x).distinct()
    # A null among a result's values fits no exception that sets the field.
    whole = lambda key: ~F.exists(key, lambda v: v.isNull())
    best = lambda: F.struct("specificity", "x", "n")  # noqa: E731  of a pattern: the smallest exception and how many there are
    out, hits = r, []
    for p in (p for p in used if not p & 1):
        each = keyed(p).groupBy("key", "specificity").agg(F.min("x").alias("x"), F.count("*").alias("n")).select("key", best().alias(f"_hit{p}"))
        key = _key(F.col("rule_id"), p, own)
        out = out.withColumn("key", F.when(whole(key), key)).join(F.broadcast(each), "key", "left").drop("key")
        hits.append(F.col(f"_hit{p}"))
    if by_record := [p for p in used if p & 1]:
        keys = F.flatten(F.array(*[F.transform(F.split("affected", r"\|"), lambda i: _key(F.col("rule_id"), p, [i, *own[1:]])) for p in by_record]))
        asked = r.select("result_id", F.explode(F.array_distinct(F.filter(keys, whole))).alias("key"))
        found = asked.join(F.broadcast(reduce(DataFrame.unionByName, map(keyed, by_record))), "key").distinct()
        found = found.groupBy("result_id", "specificity").agg(F.min("x").alias("x"), F.count("*").alias("n")).groupBy("result_id").agg(F.max_by(best(), F.col("specificity")).alias("_hit"))
        out = out.join(found, "result_id", "left")
        hits.append(F.col("_hit"))
    kind = "struct<specificity: int, x: struct<exception_id: string, effect: string, override: string>, n: bigint>"
    all_hits = F.array_compact(F.array(*hits)) if hits else F.array().cast(f"array<{kind}>")
    out = out.withColumn("_all", all_hits).withColumn("_most", F.array_max(F.transform("_all", lambda h: h.specificity)))
    out = out.withColumn("_best", F.filter("_all", lambda h: h.specificity == F.col("_most")))
    out = out.withColumn("x", F.array_min(F.transform("_best", lambda h: h.x))).withColumn("ambiguous", F.aggregate("_best", F.lit(0).cast("long"), lambda n, h: n + h.n) > 1)
    action = F.when(F.col("x").isNull(), F.col("action")).when(F.col("x.effect") == "override_action", F.col("x.override"))
    if strict:
        action = F.when(F.col("ambiguous"), F.raise_error(F.concat(F.lit("several exceptions fit equally: rule "), "rule_id", F.lit(", "), "affected")).cast("string")).otherwise(action)
    return out.select("result_id", *RESULT, action.alias("effective_action"), F.col("x.exception_id").alias("exception_id"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def require_clear(resolved: DataFrame) -> DataFrame:
    """`resolved` itself; raises where two exceptions of equal specificity fit a result."""
    if (first := resolved.filter("ambiguous").select("rule_id", "affected").first()) is not None:
        raise AmbiguousException(f"rule {first.rule_id}: several exceptions fit {first.affected} equally")
    return resolved


def insufficient_periods(audit: DataFrame, rule: ReportingFrequency) -> DataFrame:
    """Series in a frequency rule's scope with fewer than two period ends: no gap can be told, so they are not evaluated."""
    key = ("entity_id", "concept_namespace", "concept", "unit", "dimensions", "period_type")
    few = audit.filter(rule.scope.column()).groupBy(*key).agg(F.count_distinct("period_end").alias("periods")).filter("periods < 2")
    return few.select(F.lit(rule.rule_id).alias("rule_id"), *key[:4], "periods", F.lit("insufficient_distinct_periods").alias("reason"))


def evaluated(audit: DataFrame, rules: list) -> DataFrame:
    """(rule_id, matching, groups): the records that each rule looks at, in one pass; groups: a frequency rule's series of two period ends or more."""
    scoped = [r for r in rules if not isinstance(r, DetectorRule)]
    whole = [r.rule_id for r in rules if isinstance(r, DetectorRule)]
    fits = F.array_compact(F.array(*[F.when(r.scope.column(), F.lit(r.rule_id)) for r in scoped], *map(F.lit, whole)))
    n = audit.select(F.explode(fits).alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("matching"))
    frequent = [r for r in scoped if isinstance(r, ReportingFrequency)]
    key = ("entity_id", "concept_namespace", "concept", "unit", "dimensions", "period_type")
    each = F.array_compact(F.array(*[F.when(r.scope.column(), F.lit(r.rule_id)) for r in frequent])) if frequent else F.array().cast("array<string>")
    ends = audit.select(F.explode(each).alias("rule_id"), *key, "period_end").groupBy("rule_id", *key).agg(F.count_distinct("period_end").alias("ends"))
    groups = ends.filter("ends >= 2").groupBy("rule_id").agg(F.count("*").alias("groups"))
    return n.join(groups, "rule_id", "left")


def roll_up(spark: SparkSession, rules: list, results: DataFrame, evaluated: DataFrame) -> DataFrame:
    """A row for every rule, also without results: status, reason and counts. `evaluated`: (rule_id, matching), and groups where there are frequency rules.

    A disabled rule gives its own reason. A frequency rule is evaluated if a series has two period ends, any other if a record matches.
    """
    kind = lambda r: "reporting_frequency" if isinstance(r, ReportingFrequency) else ""
    own = spark.createDataFrame([(r.rule_id, r.action, getattr(r, "enabled", True), getattr(r, "reason", None), kind(r), isinstance(r, DetectorRule)) for r in rules], "rule_id string, action string, enabled boolean, disabled_reason string, kind string, whole boolean")
    n = results.groupBy("rule_id").agg(F.count("*").alias("results"), F.count_if(F.col("effective_action").isNull()).alias("waived"))
    if "groups" not in evaluated.columns:
        evaluated = evaluated.withColumn("groups", F.lit(None).cast("long"))
        own = own.withColumn("kind", F.lit(""))
    out = F.broadcast(own).join(evaluated, "rule_id", "left").join(n, "rule_id", "left")
    frequent, some = F.col("kind") == "reporting_frequency", F.coalesce("matching", F.lit(0)) > 0
    ran = F.col("whole") | F.when(frequent, F.coalesce("groups", F.lit(0)) > 0).otherwise(some)
    status = F.when(~F.col("enabled"), "disabled").when(ran, "evaluated").otherwise("not_evaluated")
    reason = F.when(status == "disabled", F.col("disabled_reason")).when(status == "not_evaluated", F.when(frequent, "insufficient_distinct_periods").otherwise("no_matching_records"))
    looked = F.when(F.col("enabled"), F.coalesce("matching", F.lit(0))).otherwise(0)
    return out.select("rule_id", "action", status.alias("status"), reason.alias("reason"), looked.alias("matching"), F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("waived", F.lit(0)).alias("waived"))


def disposition(results: DataFrame) -> DataFrame:
    """Counts by effective action and the audit's disposition: the gravest action, else passed."""
    a = F.col("effective_action")
    n = results.agg(F.count_if(a == "blocking").alias("blocking"), F.count_if(a == "warning").alias("warning"), F.count_if(a == "informational").alias("informational"), F.count_if(a.isNull()).alias("waived"))
    return n.withColumn("disposition", F.when(F.col("blocking") > 0, "blocking").when(F.col("warning") > 0, "warning").when(F.col("informational") > 0, "informational").otherwise("passed"))
