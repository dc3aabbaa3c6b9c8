"""Registered queries of the audit engine and the same results in SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions.ident import canonical_decimal, canonical_json, content_hash
from factlens.operators import detect, execution, impact, inject, manifest, pit, policy, replay, review, score, series
from factlens.plans import benchmark
from factlens.sources import companyfacts, generate, mapping, sinks, testdata

AS_OF = "1999-01-01"
SEED = 3
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return testdata.facts_orders(spark, d)


def _audit(spark: SparkSession, d: str) -> DataFrame:
    return pit.sanitize(_facts(spark, d))


FACTS = "WITH " + testdata.FACTS_SQL
LINEAGES = "WITH " + testdata.LINEAGES_SQL
SEEN = f"available_on <= DATE '{AS_OF}'"
FINGERPRINT_SQL = "entity_id, concept_namespace, concept, value, unit, period_type, period_end, filed_on, available_on, accession_number, source_name, source_locator"
SEVERITY_SQL = "CASE WHEN filed_on - available_on >= 30 THEN 'high' WHEN filed_on - available_on >= 14 THEN 'medium' ELSE 'low' END"
LOOK_SQL = f"SELECT record_id, entity_id, CAST(filed_on - available_on AS BIGINT) AS leaked_days, {SEVERITY_SQL} AS severity, 'proven_by_contract' AS confidence FROM facts WHERE available_on = period_end AND available_on < filed_on AND {SEEN}"


@query(FACTS + LOOK_SQL)
def detect_lookahead(spark, d):
    return detect.lookahead(_audit(spark, d), AS_OF)


@query(FACTS + f"SELECT record_id, entity_id, value, period_end FROM facts WHERE {SEEN}")
def asof_visible(spark, d):
    return _facts(spark, d).filter(pit.visible(AS_OF)).select("record_id", "entity_id", "value", "period_end")


@query(FACTS + f"SELECT entity_id, count(*) FILTER (WHERE {SEEN}) AS visible, count(*) AS records FROM facts GROUP BY entity_id")
def asof_count_by_entity(spark, d):
    return _facts(spark, d).groupBy("entity_id").agg(F.count_if(pit.visible(AS_OF)).alias("visible"), F.count("*").alias("records"))


@query(LINEAGES + f"SELECT lineage_id, seq, record_id, value FROM (SELECT *, row_number() OVER (PARTITION BY lineage_id ORDER BY seq DESC) AS r FROM lineages WHERE {SEEN}) WHERE r = 1")
def pit_latest_revision(spark, d):
    return pit.snapshot(testdata.lineages_lineitem(spark, d), AS_OF).select("lineage_id", "seq", "record_id", "value")


@query(LINEAGES + """, l AS (SELECT *, lag(seq) OVER w AS ps, lag(available_on) OVER w AS pa, lag(filed_on) OVER w AS pf, lag(entity_id || '|' || period_end) OVER w AS pk, entity_id || '|' || period_end AS key
  FROM (SELECT * REPLACE (CASE WHEN seq = 3 THEN 2 ELSE seq END AS seq, CASE WHEN seq = 5 THEN available_on - INTERVAL 4000 DAY ELSE available_on END AS available_on) FROM lineages) WINDOW w AS (PARTITION BY lineage_id ORDER BY seq, record_id))
  SELECT lineage_id, violation, count(*) AS members FROM (SELECT lineage_id, unnest([CASE WHEN seq = ps THEN 'duplicate_sequence' END, CASE WHEN key != pk THEN 'mixed_economic_key' END, CASE WHEN available_on < pa THEN 'available_on_decreases' END, CASE WHEN filed_on < pf THEN 'filed_on_decreases' END]) AS violation FROM l) WHERE violation IS NOT NULL GROUP BY ALL""")
def pit_lineage_violations(spark, d):
    """Lineages whose third member repeats the second's number and whose fifth is dated back."""
    rows = pit.with_lineage(testdata.lineages_lineitem(spark, d))
    seq = F.when(F.col("seq") == 3, 2).otherwise(F.col("seq"))
    broken = rows.withColumns({"available_on": F.when(F.col("seq") == 5, F.date_sub("available_on", 4000)).otherwise(F.col("available_on")), "source_row_key": F.concat("lineage_id", F.lit("#r"), seq)})
    return pit.lineage_violations(broken.drop("lineage_id", "seq"))


@query("WITH " + testdata.FACTS_SQL + "," + testdata.LINEAGES_SQL + f"SELECT 'orders' AS concept_namespace, count(*) AS records, sum(value) AS total FROM facts WHERE {SEEN} UNION ALL SELECT 'lineitem', count(*), sum(value) FROM (SELECT *, row_number() OVER (PARTITION BY lineage_id ORDER BY seq DESC) AS r FROM lineages WHERE {SEEN}) WHERE r = 1")
def snapshot_union_independent(spark, d):
    both = _facts(spark, d).unionByName(testdata.lineages_lineitem(spark, d))
    return pit.snapshot(both, AS_OF).groupBy("concept_namespace").agg(F.count("*").alias("records"), F.sum("value").alias("total"))


@query(FACTS + "SELECT record_id, entity_id, concept, value, unit, form, accession_number FROM facts")
def sanitize_projection(spark, d):
    return _audit(spark, d).select("record_id", "entity_id", "concept", "value", "unit", "form", "accession_number")


@query(FACTS + f"SELECT severity, count(*) AS findings FROM ({LOOK_SQL}) GROUP BY severity")
def lookahead_severity_histogram(spark, d):
    return detect_lookahead(spark, d).groupBy("severity").agg(F.count("*").alias("findings"))


OVER_SQL = f"SELECT record_id, entity_id, accession_number, filed_on, available_on, 'high' AS severity, 'proven_by_contract' AS confidence FROM facts WHERE {SEEN} AND filed_on > DATE '{AS_OF}'"


@query(FACTS + OVER_SQL)
def detect_revision_overwrite(spark, d):
    return detect.revision_overwrite(_audit(spark, d), AS_OF)


DUP_SQL = f"SELECT entity_id, array_to_string(list_sort(list(record_id)), '|') AS affected, count(*) AS members, 'medium' AS severity FROM facts WHERE {SEEN} GROUP BY {FINGERPRINT_SQL} HAVING count(*) >= 2"


@query(FACTS + DUP_SQL)
def detect_exact_duplicates(spark, d):
    return detect.exact_duplicates(_audit(spark, d), AS_OF).select("entity_id", "affected", "members", "severity")


SERIES_SQL = f"""series AS (SELECT * FROM (SELECT *, count(*) OVER k AS series_size, max(n) OVER k AS most FROM (SELECT *, count(*) OVER (PARTITION BY entity_id, period_end) AS n FROM facts WHERE {SEEN}) WINDOW k AS (PARTITION BY entity_id)) WHERE series_size >= 3 AND most = 1),
near AS (SELECT * FROM (SELECT *, last_value(CASE WHEN value <> 0 THEN value END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(CASE WHEN value <> 0 THEN value END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n2
  FROM series WINDOW w AS (PARTITION BY entity_id ORDER BY period_end, record_id)) WHERE value <> 0 AND (p IS NOT NULL OR n2 IS NOT NULL))"""


@query(FACTS + "," + SERIES_SQL + " SELECT record_id, entity_id, series_size FROM series")
def comparable_series(spark, d):
    return series.comparable_series(_audit(spark, d), AS_OF).select("record_id", "entity_id", "series_size")


@query(FACTS + "," + SERIES_SQL + " SELECT record_id, value, p AS previous_value, n2 AS next_value FROM near")
def nearest_nonzero_neighbors(spark, d):
    return series.nearest_nonzero(series.comparable_series(_audit(spark, d), AS_OF)).select("record_id", "value", "previous_value", "next_value")


DRIFT_SQL = SERIES_SQL + """,
gated AS (SELECT record_id, entity_id, value, p, n2 FROM near WHERE (p IS NULL OR greatest(abs(value), abs(p)) >= 50 * least(abs(value), abs(p))) AND (n2 IS NULL OR greatest(abs(value), abs(n2)) >= 50 * least(abs(value), abs(n2)))),
tries AS (SELECT g.*, f, o, CASE WHEN o = 0 THEN CAST(abs(value) AS HUGEINT_D) ELSE CAST(abs(value) AS HUGEINT_D) * f END AS l, CASE WHEN o = 0 THEN CAST(abs(p) AS HUGEINT_D) * f ELSE CAST(abs(p) AS HUGEINT_D) END AS a, CASE WHEN o = 0 THEN CAST(abs(n2) AS HUGEINT_D) * f ELSE CAST(abs(n2) AS HUGEINT_D) END AS b
  FROM gated g, (VALUES (100), (1000), (1000000)) fs(f), (VALUES (0), (1)) os(o)),
valid AS (SELECT *, coalesce(CAST(greatest(l, a) AS DOUBLE) / CAST(least(l, a) AS DOUBLE), 0) AS ra, coalesce(CAST(greatest(l, b) AS DOUBLE) / CAST(least(l, b) AS DOUBLE), 0) AS rb FROM tries WHERE (a IS NULL OR greatest(l, a) < 50 * least(l, a)) AND (b IS NULL OR greatest(l, b) < 50 * least(l, b))),
drift AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY greatest(ra, rb), ra + rb, f, o) AS r FROM valid)
""".replace("HUGEINT_D", "DECIMAL(37,6)")


@query(FACTS + "," + DRIFT_SQL.replace("CASE WHEN value <> 0 THEN value END", "CASE WHEN value <> 0 THEN value END") + "SELECT record_id, entity_id, CAST(f AS BIGINT) AS factor, CASE o WHEN 0 THEN 'divide' ELSE 'multiply' END AS operation, CASE f WHEN 100 THEN 'low' WHEN 1000 THEN 'medium' ELSE 'high' END AS severity, CASE WHEN p IS NOT NULL AND n2 IS NOT NULL THEN 'strong' ELSE 'suspicious' END AS confidence FROM drift WHERE r = 1")
def detect_unit_drift(spark, d):
    return detect.unit_drift(_audit(spark, d), AS_OF)


@query(FACTS + "," + DRIFT_SQL + f"SELECT detector, severity, count(*) AS findings FROM (SELECT 'lookahead' AS detector, severity FROM ({LOOK_SQL}) UNION ALL SELECT 'revision_overwrite', severity FROM ({OVER_SQL}) UNION ALL SELECT 'duplicate', severity FROM ({DUP_SQL}) UNION ALL SELECT 'unit_drift', CASE f WHEN 100 THEN 'low' WHEN 1000 THEN 'medium' ELSE 'high' END FROM drift WHERE r = 1) GROUP BY ALL")
def detect_all_report(spark, d):
    return detect.run_detectors(_audit(spark, d), AS_OF).groupBy("detector", "severity").agg(F.count("*").alias("findings"))


def _pairs_sql(percent: int) -> str:
    return LINEAGES + f""", p AS (SELECT *, lead(seq) OVER w AS s2, lead(value) OVER w AS v2, lead(available_on) OVER w AS a2, lead(record_id) OVER w AS r2 FROM lineages WINDOW w AS (PARTITION BY lineage_id ORDER BY seq))
SELECT lineage_id, record_id, r2 AS later_id, value, v2 AS later_value FROM p WHERE {SEEN} AND a2 > DATE '{AS_OF}' AND s2 = seq + 1 AND a2 > available_on AND value <> 0 AND v2 <> value AND abs(v2 - value) * 100 >= abs(value) * {percent}"""


def _revision_pairs(level: int):
    def run(spark, d):
        rows = series.adjacent_revisions(testdata.lineages_lineitem(spark, d), AS_OF, inject.MINIMUM_SIZE[level])
        return rows.select("lineage_id", "record_id", F.col("later.record_id").alias("later_id"), "value", F.col("later.value").alias("later_value"))

    return run


for _i, _name in enumerate(("low", "medium", "high")):
    QUERIES[f"revision_pairs_{_name}"] = _revision_pairs(_i)
    ORACLE[f"revision_pairs_{_name}"] = _pairs_sql(inject.MINIMUM_SIZE[_i])


@query(FACTS + ", g AS (SELECT entity_id, concept_namespace, concept, unit, period_type, period_end, list(record_id) AS ids FROM facts GROUP BY ALL), l AS (SELECT *, lag(period_end) OVER w AS before, lag(ids) OVER w AS b FROM g WINDOW w AS (PARTITION BY entity_id ORDER BY period_end)) SELECT entity_id, before AS previous_period_end, period_end, CAST(period_end - before AS BIGINT) AS gap_days, array_to_string(list_sort(list_concat(b, ids)), '|') AS affected FROM l WHERE period_end - before > 365")
def policy_reporting_gap(spark, d):
    gaps = series.reporting_gaps(_audit(spark, d), 365)
    return gaps.select("entity_id", "previous_period_end", "period_end", F.col("gap_days").cast("long").alias("gap_days"), F.concat_ws("|", "affected").alias("affected"))


def _digest_sql(family: str) -> str:
    return f"""sha256('{{"eligibility_unit_id":"' || record_id || '","namespace":"{family}","seed":{SEED}}}')"""


def _pick_sql(source: str, family: str, fraction: str, columns: str = "record_id") -> str:
    n = f"(SELECT least(count(*), {inject.MOST}, greatest(1, ceil(count(*) * CAST({fraction} AS DECIMAL(9,4))))) FROM {source})"
    return f"SELECT * EXCLUDE (r), r - 1 AS target_rank FROM (SELECT {columns}, row_number() OVER (ORDER BY {_digest_sql(family)}, record_id) AS r FROM {source}) WHERE r <= {n}"


ELIGIBLE_LOOK = f"elig AS (SELECT * FROM facts WHERE available_on = filed_on AND period_end <= DATE '{AS_OF}' AND available_on > DATE '{AS_OF}' AND filed_on - period_end >= 7)"
ELIGIBLE_DUP = f"elig AS (SELECT facts.* FROM facts JOIN (SELECT any_value(record_id) AS record_id FROM facts WHERE {SEEN} GROUP BY {FINGERPRINT_SQL} HAVING count(*) = 1) USING (record_id))"
ELIGIBLE_DRIFT = SERIES_SQL + ", elig AS (SELECT * FROM series WHERE value <> 0)"


@query(FACTS + "," + ELIGIBLE_LOOK + _pick_sql("elig", "lookahead", "0.05"))
def select_targets_lookahead(spark, d):
    return series.select_targets(inject.eligible_lookahead(_facts(spark, d), AS_OF, "low"), "record_id", "lookahead", SEED, "0.05", inject.MOST).select("record_id", "target_rank")


@query(FACTS + "," + ELIGIBLE_DRIFT + _pick_sql("elig", "unit_drift", "0.05"))
def select_targets_unit_drift(spark, d):
    return series.select_targets(inject.eligible_unit_drift(_facts(spark, d), AS_OF), "record_id", "unit_drift", SEED, "0.05", inject.MOST).select("record_id", "target_rank")


@query(FACTS + "," + ELIGIBLE_DUP + _pick_sql("elig", "duplicate", "0.05"))
def select_targets_duplicate(spark, d):
    return series.select_targets(inject.eligible_duplicate(_facts(spark, d), AS_OF), "record_id", "duplicate", SEED, "0.05", inject.MOST).select("record_id", "target_rank")


def _id_sql(family: str) -> str:
    return f"'rec_' || left(sha256('{family}|{SEED}|' || record_id), 16)"


def _clean(spark, d) -> DataFrame:
    return _facts(spark, d)


@query(FACTS + "," + ELIGIBLE_LOOK + f", m AS ({_pick_sql('elig', 'lookahead', '0.02')}) SELECT CASE WHEN m.record_id IS NULL THEN f.record_id ELSE {_id_sql('lookahead').replace('record_id', 'f.record_id')} END AS record_id, CASE WHEN m.record_id IS NULL THEN f.available_on ELSE f.period_end END AS available_on, f.value FROM facts f LEFT JOIN m ON f.record_id = m.record_id")
def inject_lookahead(spark, d):
    return inject.inject_lookahead(_clean(spark, d), AS_OF, "low", SEED)[0].select("record_id", "available_on", "value")


@query(FACTS + "," + ELIGIBLE_DRIFT + f", m AS ({_pick_sql('elig', 'unit_drift', '0.05')}) SELECT CASE WHEN m.record_id IS NULL THEN f.record_id ELSE {_id_sql('unit_drift').replace('record_id', 'f.record_id')} END AS record_id, CAST(CASE WHEN m.record_id IS NULL THEN f.value ELSE f.value * 1000 END AS DECIMAL(28,6)) AS value FROM facts f LEFT JOIN m ON f.record_id = m.record_id")
def inject_unit_drift(spark, d):
    return inject.inject_unit_drift(_clean(spark, d), AS_OF, "medium", SEED)[0].select("record_id", "value")


@query(FACTS + "," + ELIGIBLE_DUP + f", m AS ({_pick_sql('elig', 'duplicate', '0.05', 'record_id, entity_id, value')}) SELECT record_id, entity_id, value FROM facts UNION ALL SELECT {_id_sql('duplicate')}, entity_id, value FROM m")
def inject_duplicate(spark, d):
    return inject.inject_duplicate(_clean(spark, d), AS_OF, "medium", SEED)[0].select("record_id", "entity_id", "value")


@query("WITH pairs AS (" + _pairs_sql(5).replace("SELECT lineage_id, record_id, r2 AS later_id", "SELECT a2, lineage_id, record_id, r2 AS later_id") + f"), {testdata.LINEAGES_SQL}, m AS (SELECT * FROM pairs JOIN ({_pick_sql('pairs', 'revision_overwrite', '0.05')}) t USING (record_id)), snap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lineage_id ORDER BY seq DESC) AS r FROM lineages WHERE {SEEN}) WHERE r = 1) SELECT CASE WHEN m.record_id IS NULL THEN s.record_id ELSE {_id_sql('revision_overwrite').replace('record_id', 's.record_id')} END AS record_id, coalesce(m.later_value, s.value) AS value, coalesce(m.a2, s.filed_on) AS filed_on, s.available_on FROM snap s LEFT JOIN m ON s.record_id = m.record_id")
def inject_revision(spark, d):
    history = testdata.lineages_lineitem(spark, d)
    snap = pit.snapshot(history, AS_OF).drop("lineage_id", "seq")
    return inject.inject_revision_overwrite(snap, history, AS_OF, "medium", SEED)[0].select("record_id", "value", "filed_on", "available_on")


@query(FACTS + f", elig AS (SELECT * FROM facts WHERE {SEEN}), m AS ({_pick_sql('elig', 'missing', '0.10')}) SELECT record_id, value FROM facts ANTI JOIN m USING (record_id)")
def inject_missing(spark, d):
    return inject.inject_missing(_clean(spark, d), AS_OF, "random", "low", SEED)[0].select("record_id", "value")


def _inject_missing(mechanism: str):
    def run(spark, d):
        clean = _clean(spark, d)
        kept, manifest = inject.inject_missing(clean, AS_OF, mechanism, "low", SEED, 1_000_000, bound_whole=False)
        return kept.select("record_id", "value")

    return run


def _missing_sql(mechanism: str) -> str:
    seen = f"seen AS (SELECT * FROM facts WHERE {SEEN})"
    if mechanism == "periodic_gap":
        order = "PARTITION BY entity_id, concept_namespace, concept, unit, period_type ORDER BY period_end"
        pool = f"pool AS (SELECT * EXCLUDE (a, b) FROM (SELECT *, row_number() OVER ({order}, record_id) AS a, row_number() OVER ({order} DESC, record_id DESC) AS b FROM seen) WHERE a > 1 AND b > 1)"
    else:
        keys = {"entity_dependent": ("entity_id",), "survivorship": ("entity_id",), "concept_dependent": ("concept_namespace", "concept"), "source_outage": ("source_name", "source_locator")}[mechanism]
        cols = ", ".join(keys)
        digest = " || '|' || ".join((f"'{SEED}'", *keys))
        pool = f"one AS (SELECT DISTINCT {cols}, sha256({digest}) AS h FROM seen ORDER BY h, {cols} LIMIT 1), pool AS (SELECT seen.* FROM seen SEMI JOIN one USING ({cols}))"
    gone = "SELECT record_id FROM pool" if mechanism in ("survivorship", "source_outage") else _pick_sql("pool", "missing", "0.10").replace(str(inject.MOST), "1000000")
    return FACTS + f", {seen}, {pool}, m AS ({gone}) SELECT record_id, value FROM facts ANTI JOIN m USING (record_id)"


for _m in ("periodic_gap", "entity_dependent", "concept_dependent", "survivorship", "source_outage"):
    QUERIES[f"inject_missing_{_m}"] = _inject_missing(_m)
    ORACLE[f"inject_missing_{_m}"] = _missing_sql(_m)


def _injected(family: str, spark, d):
    if family == "revision_overwrite":
        history = testdata.lineages_lineitem(spark, d)
        clean = pit.snapshot(history, AS_OF).drop("lineage_id", "seq")
        return clean, *inject.inject_revision_overwrite(clean, history, AS_OF, "medium", SEED)
    clean = _clean(spark, d)
    if family == "lookahead":
        return clean, *inject.inject_lookahead(clean, AS_OF, "low", SEED)
    if family == "unit_drift":
        return clean, *inject.inject_unit_drift(clean, AS_OF, "medium", SEED)
    if family == "duplicate":
        return clean, *inject.inject_duplicate(clean, AS_OF, "medium", SEED)
    return clean, *inject.inject_missing(clean, AS_OF, "periodic_gap", "medium", SEED)


def _replay_residual(family: str):
    def run(spark, d):
        clean, corrupted, manifest = _injected(family, spark, d)
        return replay.residual(clean, replay.replay(family, corrupted, manifest))

    return run


for _f in ("lookahead", "unit_drift", "duplicate", "revision_overwrite", "missing"):
    QUERIES[f"replay_{_f}_residual"] = _replay_residual(_f)
    ORACLE[f"replay_{_f}_residual"] = "SELECT CAST(0 AS BIGINT) AS only_clean, CAST(0 AS BIGINT) AS only_repaired"

RATIO_SQL = "round(CAST({a} AS DOUBLE) / nullif({b}, 0), 9)"


def _score_sql(head: str, eligible: str, targets: str, findings: str, hits: str, minus: bool) -> str:
    rate = RATIO_SQL.format(a="false_positives", b="eligible - targets" if minus else "eligible")
    return head + f""", n AS (SELECT (SELECT count(*) FROM {findings}) AS findings, (SELECT count(*) FROM {hits}) AS true_positives, (SELECT count(*) FROM {targets}) AS targets, (SELECT count(*) FROM {eligible}) AS eligible),
q AS (SELECT *, findings - true_positives AS false_positives, targets - true_positives AS missed, {RATIO_SQL.format(a='true_positives', b='findings')} AS precision, {RATIO_SQL.format(a='true_positives', b='targets')} AS recall FROM n)
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE round(2 * precision * recall / (precision + recall), 9) END AS f1, {rate} AS false_positive_rate FROM q"""


LATE = "2003-01-01"


@query(_score_sql(FACTS + f",{ELIGIBLE_LOOK}, m AS ({_pick_sql('elig', 'lookahead', '0.02')}), f2 AS (SELECT f.entity_id, CASE WHEN m.record_id IS NULL THEN f.record_id ELSE 'x' || f.record_id END AS record_id, f.period_end, f.filed_on, CASE WHEN m.record_id IS NULL THEN f.available_on ELSE f.period_end END AS available_on FROM facts f LEFT JOIN m USING (record_id)), fd AS (SELECT * FROM f2 WHERE available_on = period_end AND available_on < filed_on AND {SEEN}), hit AS (SELECT * FROM fd WHERE record_id LIKE 'x%')", "elig", "m", "fd", "hit", True))
def score_lookahead(spark, d):
    clean, corrupted, manifest = _injected("lookahead", spark, d)
    found = detect.lookahead(pit.sanitize(corrupted), AS_OF)
    eligible = inject.eligible_lookahead(clean, AS_OF, "low").count()
    return score.metrics(score.matches(found, manifest, "record_id", "injected_record_id", {"leaked_days": "leaked_days"}), manifest.count(), eligible, "lookahead")


@query(_score_sql(FACTS + f",{ELIGIBLE_DUP}, m AS ({_pick_sql('elig', 'duplicate', '0.05')}), f2 AS (SELECT * FROM facts UNION ALL SELECT facts.* REPLACE ('x' || record_id AS record_id) FROM facts SEMI JOIN m USING (record_id)), fd AS (SELECT count(*) AS c, count(*) FILTER (WHERE record_id LIKE 'x%') AS x FROM f2 WHERE {SEEN} GROUP BY {FINGERPRINT_SQL} HAVING count(*) >= 2), hit AS (SELECT * FROM fd WHERE c = 2 AND x = 1)", "elig", "m", "fd", "hit", False))
def score_duplicate(spark, d):
    clean, corrupted, manifest = _injected("duplicate", spark, d)
    found = detect.exact_duplicates(pit.sanitize(corrupted), AS_OF)
    return score.metrics(score.matches(found, manifest, "affected", "affected", {}), manifest.count(), inject.eligible_duplicate(clean, AS_OF).count(), "duplicate")


#: The drift detector over injected facts f2 instead of facts.
DRIFT2_SQL = reduce(lambda q, n: re.sub(rf"\b{n}\b", f"{n}_2", q), ("series", "near", "gated", "tries", "valid", "drift"), DRIFT_SQL).replace("FROM facts", "FROM f2")


@query(_score_sql(FACTS + f",{ELIGIBLE_DRIFT}, m AS ({_pick_sql('elig', 'unit_drift', '0.05')}), f2 AS (SELECT f.* REPLACE (CASE WHEN m.record_id IS NULL THEN f.record_id ELSE 'x' || f.record_id END AS record_id, CAST(CASE WHEN m.record_id IS NULL THEN f.value ELSE f.value * 1000 END AS DECIMAL(28,6)) AS value) FROM facts f LEFT JOIN m ON f.record_id = m.record_id), {DRIFT2_SQL}, fd AS (SELECT record_id, f FROM drift_2 WHERE r = 1), hit AS (SELECT * FROM fd WHERE record_id LIKE 'x%' AND f = 1000)", "elig", "m", "fd", "hit", False))
def score_unit_drift(spark, d):
    clean, corrupted, manifest = _injected("unit_drift", spark, d)
    found = detect.unit_drift(pit.sanitize(corrupted), AS_OF)
    return score.metrics(score.matches(found, manifest, "record_id", "injected_record_id", {"factor": "factor"}), manifest.count(), inject.eligible_unit_drift(clean, AS_OF).count(), "unit_drift")


PAIRS5_SQL = _pairs_sql(5).replace("SELECT lineage_id, record_id, r2 AS later_id", "SELECT a2, lineage_id, record_id, r2 AS later_id")


@query(_score_sql("WITH pairs AS (" + PAIRS5_SQL + f"), {testdata.LINEAGES_SQL}, m AS ({_pick_sql('pairs', 'revision_overwrite', '0.05')}), snap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lineage_id ORDER BY seq DESC) AS r FROM lineages WHERE {SEEN}) WHERE r = 1), fd AS (SELECT s.record_id, m.record_id AS fault FROM snap s LEFT JOIN m USING (record_id) LEFT JOIN pairs p ON p.record_id = m.record_id WHERE coalesce(p.a2, s.filed_on) > DATE '{AS_OF}'), hit AS (SELECT * FROM fd WHERE fault IS NOT NULL)", "pairs", "m", "fd", "hit", False))
def score_revision_overwrite(spark, d):
    history, path = testdata.lineages_lineitem(spark, d), f"{sinks.work_folder(spark)}/eligible"
    pairs = inject.eligible_revision_overwrite(history, AS_OF, "medium")
    pairs.write.parquet(path)  # they are counted and chosen from
    eligible = spark.read.schema(pairs.schema).parquet(path)
    corrupted, manifest = inject.inject_revision_overwrite(pit.snapshot(history, AS_OF).drop("lineage_id", "seq"), history, AS_OF, "medium", SEED, eligible=eligible)
    found = detect.revision_overwrite(pit.sanitize(corrupted), AS_OF)
    return score.metrics(score.matches(found, manifest, "record_id", "injected_record_id", {}), manifest.count(), eligible.count(), "revision_overwrite")


@query(FACTS + "," + ELIGIBLE_DUP + f", n AS (SELECT count(*) AS false_positives FROM ({DUP_SQL})) SELECT false_positives, (SELECT count(*) FROM elig) AS eligible, CASE WHEN false_positives > 0 THEN CAST(0 AS DOUBLE) END AS precision, CAST(NULL AS DOUBLE) AS recall, {RATIO_SQL.format(a='false_positives', b='(SELECT count(*) FROM elig)')} AS false_positive_rate FROM n")
def score_clean_control(spark, d):
    facts = _facts(spark, d)
    return score.clean_control(detect.exact_duplicates(pit.sanitize(facts), AS_OF), inject.eligible_duplicate(facts, AS_OF).count())


def _findings_sql(table: str, clean_id: str) -> str:
    faults = "count(*) FILTER (WHERE record_id LIKE 'x%')"
    return f"""SELECT 'lookahead' AS detector, record_id AS affected, {clean_id} AS clean_affected, {SEVERITY_SQL} AS severity, CAST(record_id LIKE 'x%' AS BIGINT) AS faults FROM {table} WHERE available_on = period_end AND available_on < filed_on AND {SEEN}
UNION ALL SELECT 'revision_overwrite', record_id, {clean_id}, 'high', CAST(record_id LIKE 'x%' AS BIGINT) FROM {table} WHERE {SEEN} AND filed_on > DATE '{AS_OF}'
UNION ALL SELECT 'duplicate', array_to_string(list_sort(list(record_id)), '|'), array_to_string(list_sort(list({clean_id})), '|'), 'medium', {faults} FROM {table} WHERE {SEEN} GROUP BY {FINGERPRINT_SQL} HAVING count(*) >= 2"""


@query(FACTS + f",{ELIGIBLE_LOOK}, m AS ({_pick_sql('elig', 'lookahead', '0.02')}), f2 AS (SELECT f.* REPLACE (CASE WHEN m.record_id IS NULL THEN f.record_id ELSE 'x' || f.record_id END AS record_id, CASE WHEN m.record_id IS NULL THEN f.available_on ELSE f.period_end END AS available_on), f.record_id AS clean_id FROM facts f LEFT JOIN m ON f.record_id = m.record_id), found AS ({_findings_sql('f2', 'clean_id')}), background AS ({_findings_sql('facts', 'record_id')}) SELECT detector, CASE WHEN detector = 'lookahead' AND faults = 1 THEN 'primary_matched' WHEN EXISTS (SELECT 1 FROM background b WHERE b.detector = found.detector AND b.clean_affected = found.clean_affected AND b.severity = found.severity) THEN 'independent_background' WHEN detector <> 'lookahead' AND faults = 1 THEN 'secondary_corroborating' ELSE 'unmatched' END AS interpretation, count(*) AS findings FROM found GROUP BY ALL")
def interpret_findings(spark, d):
    clean, corrupted, manifest = _injected("lookahead", spark, d)
    names = ("lookahead", "revision_overwrite", "duplicate")
    found, background = detect.run_detectors(pit.sanitize(corrupted), AS_OF, names), detect.run_detectors(pit.sanitize(clean), AS_OF, names)
    out = score.interpret(found, manifest, background, "lookahead")
    return out.groupBy("detector", "interpretation").agg(F.count("*").alias("findings"))


def _states(family: str, spark, d) -> DataFrame:
    clean, corrupted, manifest = _injected(family, spark, d)
    return impact.states(clean=clean, corrupted=corrupted, repaired=replay.replay(family, corrupted, manifest))


IMPACT_SQL = "SELECT CAST(c AS DECIMAL(38,6)) AS clean, CAST(x AS DECIMAL(38,6)) AS corrupted, CAST(c AS DECIMAL(38,6)) AS repaired, CAST(x - c AS DECIMAL(38,6)) AS delta, round(CAST(x - c AS DOUBLE) / abs(CAST(c AS DOUBLE)), 9) AS relative, x <> c AS changed, true AS exact_restoration FROM n"


@query(FACTS + f",{ELIGIBLE_LOOK}, m AS ({_pick_sql('elig', 'lookahead', '0.02')}), n AS (SELECT count(*) FILTER (WHERE {SEEN}) AS c, count(*) FILTER (WHERE {SEEN}) + (SELECT count(*) FROM m) AS x FROM facts) " + IMPACT_SQL)
def impact_availability(spark, d):
    return impact.impact(impact.availability_count(_states("lookahead", spark, d), AS_OF))


@query(FACTS + f",{ELIGIBLE_DRIFT}, m AS ({_pick_sql('elig', 'unit_drift', '0.05', 'record_id, value')}), n AS (SELECT sum(value) AS c, sum(value) + 999 * (SELECT sum(value) FROM m) AS x FROM facts) " + IMPACT_SQL)
def impact_aggregate(spark, d):
    return impact.impact(impact.aggregate_value(_states("unit_drift", spark, d)))


@query(FACTS + f",{ELIGIBLE_DUP}, m AS ({_pick_sql('elig', 'duplicate', '0.05')}), n AS (SELECT count(*) AS c, count(*) + (SELECT count(*) FROM m) AS x FROM facts) " + IMPACT_SQL)
def impact_record_count(spark, d):
    return impact.impact(impact.record_count(_states("duplicate", spark, d)))


@query(FACTS + ", s AS (SELECT entity_id, sum(value) FILTER (WHERE period_end BETWEEN DATE '1995-01-01' AND DATE '1995-12-31') AS a, sum(value) FILTER (WHERE period_end BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') AS b FROM facts GROUP BY entity_id), g AS (SELECT entity_id, round(CAST(b - a AS DOUBLE) / abs(CAST(a AS DOUBLE)), 9) AS growth FROM s WHERE a <> 0 AND b IS NOT NULL) SELECT entity_id, growth, row_number() OVER (ORDER BY growth DESC, entity_id) AS rank FROM g QUALIFY rank <= 100")
def impact_growth(spark, d):
    return impact.growth_ranking(_facts(spark, d), ("1995-01-01", "1995-12-31"), ("1996-01-01", "1996-12-31"), top=100)


DAYS = ("1995-03-31", "1996-06-30", "1997-09-30", "1998-12-15")
EXPECT_SQL = f"expect AS (SELECT 'C' || c_custkey AS entity_id, CAST(d AS DATE) AS period_end, CAST(CAST(d AS DATE) + 60 AS DATE) AS expected_by, 'exp-' || c_custkey || '-' || d AS expected_observation_id FROM customer, (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in DAYS)}) t(d))"


@query(FACTS + f",{EXPECT_SQL}, seen AS (SELECT * FROM facts WHERE {SEEN}), absent AS (SELECT * FROM expect WHERE expected_by <= DATE '{AS_OF}' AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.entity_id = expect.entity_id AND seen.period_end = expect.period_end)) SELECT expected_observation_id, a.entity_id, a.period_end, max(s.period_end) FILTER (WHERE s.period_end < a.period_end) AS previous_end, min(s.period_end) FILTER (WHERE s.period_end > a.period_end) AS next_end, 'low' AS severity FROM absent a LEFT JOIN seen s ON a.entity_id = s.entity_id GROUP BY ALL")
def missing_detect(spark, d):
    expected = generate.customer_expectations(spark, d, DAYS)
    return detect.missing_observations(_audit(spark, d), expected, AS_OF).drop("confidence")


@query(FACTS + f",{EXPECT_SQL} SELECT s.period_end, count(*) AS observed, sum(value) AS total FROM facts s JOIN expect e ON s.entity_id = e.entity_id AND s.period_end = e.period_end WHERE {SEEN} AND expected_by <= DATE '{AS_OF}' GROUP BY s.period_end")
def missing_support_asof(spark, d):
    expected = generate.customer_expectations(spark, d, DAYS).filter(F.col("expected_by") <= F.lit(AS_OF).cast("date"))
    seen = _audit(spark, d).filter(pit.visible(AS_OF)).join(expected.select("entity_id", "period_end"), ["entity_id", "period_end"])
    return seen.groupBy("period_end").agg(F.count("*").alias("observed"), F.sum("value").alias("total"))


@query(FACTS + f",{EXPECT_SQL}, o AS (SELECT value FROM facts s JOIN expect e ON s.entity_id = e.entity_id AND s.period_end = e.period_end WHERE {SEEN} AND expected_by <= DATE '{AS_OF}'), n AS (SELECT CAST(CAST(sum(value) AS DOUBLE) / count(*) AS DECIMAL(38,6)) AS figure FROM o) SELECT 'clean' AS state, figure FROM n")
def impact_cohort_mean(spark, d):
    return impact.cohort_mean(generate.customer_expectations(spark, d, DAYS), impact.states(clean=_facts(spark, d)), AS_OF, "count")


SCOPE = policy.Scope("orders", "TotalPrice")
UNITS = policy.ConceptUnit("unit-1", SCOPE, ("EUR",), "blocking")
LAG = policy.PublicationLag("lag-1", SCOPE, "availability", 7, 40, "warning")
GAP = policy.ReportingFrequency("gap-1", SCOPE, 365, "informational")
LAG_SQL = "SELECT 'lag-1' AS rule_id, record_id AS affected, entity_id, CAST(available_on - period_end AS VARCHAR) AS detail, 'warning' AS action FROM facts WHERE NOT (available_on - period_end BETWEEN 7 AND 40)"


@query(FACTS + "SELECT 'unit-1' AS rule_id, record_id AS affected, unit AS detail FROM facts WHERE unit NOT IN ('EUR')")
def policy_concept_unit(spark, d):
    return policy.concept_unit(_audit(spark, d), UNITS).select("rule_id", "affected", "detail")


@query(FACTS + LAG_SQL)
def policy_publication_lag(spark, d):
    return policy.publication_lag(_audit(spark, d), LAG).select("rule_id", "affected", "entity_id", "detail", "action")


EXCEPTIONS = [
    {"exception_id": "x1", "rule_id": "lag-1", "concept": "TotalPrice", "effect": "override_action", "override": "informational", "reason": "known calendar"},
    {"exception_id": "x2", "rule_id": "lag-1", "concept": "TotalPrice", "entity_id": "C7", "effect": "waive", "reason": "agreed"},
]
RESOLVED_SQL = f"r AS (SELECT affected, CASE WHEN entity_id = 'C7' THEN NULL ELSE 'informational' END AS effective_action, CASE WHEN entity_id = 'C7' THEN 'x2' ELSE 'x1' END AS exception_id, false AS ambiguous FROM ({LAG_SQL}))"


def _resolved(spark, d) -> DataFrame:
    return policy.resolve_exceptions(policy.publication_lag(_audit(spark, d), LAG), policy.exceptions_table(spark, EXCEPTIONS))


@query(FACTS + "," + RESOLVED_SQL + " SELECT * FROM r")
def policy_exceptions(spark, d):
    return _resolved(spark, d).select("affected", "effective_action", "exception_id", "ambiguous")


@query(FACTS + "," + RESOLVED_SQL + " SELECT CAST(0 AS BIGINT) AS blocking, CAST(0 AS BIGINT) AS warning, count(*) FILTER (WHERE effective_action = 'informational') AS informational, count(*) FILTER (WHERE effective_action IS NULL) AS waived, 'informational' AS disposition FROM r")
def policy_disposition(spark, d):
    return policy.disposition(_resolved(spark, d))


@query(FACTS + "," + RESOLVED_SQL + " SELECT 'lag-1' AS rule_id, 'evaluated' AS status, (SELECT count(*) FROM facts) AS matching, count(*) AS results, count(*) FILTER (WHERE effective_action IS NULL) AS waived FROM r UNION ALL SELECT 'none-1', 'not_evaluated', 0, 0, 0")
def policy_roll_up(spark, d):
    other = policy.PublicationLag("none-1", policy.Scope("orders", "Nothing"), "filing", 0, 1)
    audit = _audit(spark, d)
    n = audit.filter(SCOPE.column()).agg(F.lit("lag-1").alias("rule_id"), F.count("*").alias("matching"))
    return policy.roll_up(spark, [LAG, other], _resolved(spark, d), n).select("rule_id", "status", "matching", "results", "waived")


RESULTS_SQL = "res AS (SELECT o_orderpriority AS fault_profile, o_orderstatus AS severity, CASE o_orderkey % 2 WHEN 0 THEN 'development' ELSE 'validation' END AS seed_class, CAST(o_orderkey % 10 AS INTEGER) AS seed, o_orderkey % 7 AS findings, o_orderkey % 5 AS faults, least(o_orderkey % 7, o_orderkey % 5) AS true_positives, o_orderkey % 7 - least(o_orderkey % 7, o_orderkey % 5) AS false_positives, o_orderkey % 50 AS eligible, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'ok' END AS status FROM orders)"


def _case_results(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    tp = F.least(k % 7, k % 5)
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("fault_profile"), F.col("o_orderstatus").alias("severity"), F.when(k % 2 == 0, "development").otherwise("validation").alias("seed_class"), (k % 10).cast("int").alias("seed"), (k % 7).alias("findings"), (k % 5).alias("faults"), tp.alias("true_positives"), (k % 7 - tp).alias("false_positives"), (k % 50).alias("eligible"), F.when(k % 11 == 0, "failed").otherwise("ok").alias("status"))


def _aggregate_sql(dims: tuple[str, ...], lenient: bool) -> str:
    parts = " UNION ALL ".join(f"SELECT '{n}' AS dimension, {e} AS member, * FROM res" for n, e in (("overall", "'all'"), *((x, f"CAST({x} AS VARCHAR)") for x in dims)))
    p = RATIO_SQL.format(a="sum(true_positives)", b="sum(findings)")
    if lenient:
        p = f"CASE WHEN sum(findings) = 0 AND sum(faults) = 0 AND count(*) FILTER (WHERE status = 'ok') > 0 THEN 1.0 ELSE {p} END"
    zero = "0.0" if lenient else "NULL"
    return f"WITH {RESULTS_SQL}, a AS (SELECT dimension, member, count(*) AS cases, count(*) FILTER (WHERE status = 'ok') AS succeeded, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in benchmark.COUNTERS)}, {p} AS precision, {RATIO_SQL.format(a='sum(true_positives)', b='sum(faults)')} AS recall, {RATIO_SQL.format(a='sum(false_positives)', b='sum(eligible)')} AS false_positive_rate FROM ({parts}) GROUP BY dimension, member) SELECT *, CASE WHEN precision + recall = 0 THEN {zero} ELSE round(2 * precision * recall / (precision + recall), 9) END AS f1 FROM a"


@query(_aggregate_sql(("fault_profile", "severity", "seed_class", "seed"), True))
def aggregate_grouping_sets(spark, d):
    return benchmark.aggregate(_case_results(spark, d), nulls="lenient")


@query(_aggregate_sql(("fault_profile", "severity"), False))
def aggregate_v2(spark, d):
    return benchmark.aggregate(_case_results(spark, d), ("fault_profile", "severity"))


@query("WITH units AS (SELECT DISTINCT 'p' || (n_regionkey % 3) AS partition, 'u' || n_nationkey AS unit FROM nation), fam AS (SELECT unnest(['duplicate','lookahead']) AS family), cnt AS (SELECT 'p' || (n_regionkey % 3) AS partition, 'u' || n_nationkey AS unit, 'duplicate' AS family, count(*) AS eligible FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 GROUP BY ALL UNION ALL SELECT 'p' || (n_regionkey % 3), 'u' || n_nationkey, 'lookahead', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 GROUP BY ALL), c AS (SELECT u.partition, u.unit, family, coalesce(eligible, 0) AS eligible FROM units u CROSS JOIN fam LEFT JOIN cnt USING (partition, unit, family)), r AS (SELECT *, row_number() OVER (PARTITION BY partition, family ORDER BY eligible DESC, unit DESC) AS k FROM c) SELECT partition, family, CAST(sum(eligible) AS BIGINT) AS total, max(unit) FILTER (WHERE k = 1) AS best_unit, max(eligible) FILTER (WHERE k = 1) AS best_eligible, count(*) FILTER (WHERE eligible > 0) AS supporting, CASE WHEN max(eligible) >= 8 AND sum(eligible) >= 24 THEN 'eligible' ELSE 'ineligible' END AS status FROM r GROUP BY partition, family")
def eligibility_census(spark, d):
    nation, customer = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "customer"))
    part, unit = F.concat(F.lit("p"), F.col("n_regionkey") % 3).alias("partition"), F.concat(F.lit("u"), F.col("n_nationkey")).alias("unit")
    family = F.when(F.col("c_acctbal") > 5000, "duplicate").when(F.col("c_acctbal") < 0, "lookahead").alias("family")
    by_nation = customer.groupBy("c_nationkey", family).count().filter("family IS NOT NULL")
    counts = by_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(part, unit, "family", F.col("count").alias("eligible"))
    return benchmark.census(counts, nation.select(part, unit).distinct(), ("duplicate", "lookahead"))


@query(FACTS + "SELECT count(*) AS records, count(DISTINCT entity_id) AS distinct_entity_id, count(DISTINCT concept) AS distinct_concept, count(DISTINCT unit) AS distinct_unit, count(DISTINCT period_end) AS distinct_period_end, count(DISTINCT form) AS distinct_form, count(DISTINCT source_name) AS distinct_source_name, CAST(min(filed_on - period_end) AS BIGINT) AS least_lag, CAST(max(filed_on - period_end) AS BIGINT) AS most_lag, count(*) FILTER (WHERE value < 0) AS negative, count(*) FILTER (WHERE value = 0) AS zero, min(period_end) AS first_period_end, max(period_end) AS last_period_end FROM facts")
def diversity_profile(spark, d):
    return benchmark.diversity_profile(_facts(spark, d))


@query(FACTS + f", a AS (SELECT record_id, 'low' AS s FROM facts WHERE available_on = period_end AND available_on < filed_on AND available_on <= DATE '1997-01-01'), b AS (SELECT record_id FROM facts WHERE available_on = period_end AND available_on < filed_on AND {SEEN}) SELECT CASE WHEN a.record_id IS NULL THEN 'added' WHEN b.record_id IS NULL THEN 'removed' ELSE 'unchanged' END AS change, count(*) AS findings FROM a FULL JOIN b ON a.record_id = b.record_id GROUP BY change")
def rerun_diff(spark, d):
    audit = _audit(spark, d)
    runs = [detect.run_detectors(audit, day, ("lookahead",)) for day in ("1997-01-01", AS_OF)]
    return review.rerun_diff(*runs).groupBy("change").agg(F.count("*").alias("findings"))


def _adjudicated(spark, d):
    found = detect.run_detectors(_audit(spark, d), AS_OF, ("lookahead", "revision_overwrite"))
    bit = F.conv(F.substring("finding_id", 6, 1), 16, 10).cast("int")
    return found, found.filter(bit < 12).select("finding_id", F.when(bit % 2 == 0, "confirmed").otherwise("rejected").alias("disposition"), (bit * 10).cast("long").alias("review_seconds"))


FOUND_SQL = f"found AS (SELECT 'find_' || left(sha256('lookahead|' || record_id), 16) AS finding_id, 'lookahead' AS detector FROM ({LOOK_SQL}) UNION ALL SELECT 'find_' || left(sha256('revision_overwrite|' || record_id), 16), 'revision_overwrite' FROM ({OVER_SQL})), adj AS (SELECT *, strpos('0123456789abcdef', substr(finding_id, 6, 1)) - 1 AS bit FROM found)"


@query(FACTS + f",{FOUND_SQL} SELECT count(*) FILTER (WHERE bit >= 12) AS unreviewed, CAST(0 AS BIGINT) AS unknown FROM adj")
def adjudication_coverage(spark, d):
    return review.adjudication_coverage(*_adjudicated(spark, d))


@query(FACTS + f",{FOUND_SQL} SELECT detector, count(*) AS findings, count(*) FILTER (WHERE bit < 12 AND bit % 2 = 0) AS confirmed, count(*) FILTER (WHERE bit < 12 AND bit % 2 = 1) AS rejected, count(*) FILTER (WHERE bit >= 12) AS unreviewed, CAST(coalesce(sum(bit * 10) FILTER (WHERE bit < 12), 0) AS BIGINT) AS review_seconds FROM adj GROUP BY detector")
def pilot_report(spark, d):
    return review.pilot_report(*_adjudicated(spark, d))


@query(FACTS + """, c AS (SELECT record_id, value FROM facts), t AS (SELECT record_id, regexp_replace(regexp_replace(CAST(value AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS text FROM c) SELECT record_id, text, sha256('{"record_id":"' || record_id || '","value":"' || text || '"}') AS hash FROM t""")
def identity_hashes(spark, d):
    rows = _facts(spark, d).withColumn("text", canonical_decimal(F.col("value")))
    return rows.select("record_id", "text", content_hash(canonical_json(record_id=F.col("record_id"), value=F.col("text"))).alias("hash"))


@query("WITH e AS (SELECT DISTINCT 'C' || o_custkey AS entity_id FROM orders) SELECT entity_id, (row_number() OVER (ORDER BY sha256(entity_id)) - 1) % 7 AS partition FROM e")
def entity_partition_rank(spark, d):
    return series.entity_partitions(_audit(spark, d), 7)


@query("""WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey % 13 = 0 THEN 'n/a' WHEN c_custkey % 17 = 0 THEN '1e5' ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS amount, CASE WHEN c_custkey % 19 = 0 THEN '1995-02-30' ELSE '1995-03-31' END AS pe FROM customer)
SELECT CASE WHEN k::INT % 13 = 0 OR k::INT % 17 = 0 THEN 'normalization.invalid_decimal' WHEN k::INT % 19 = 0 THEN 'normalization.invalid_date' ELSE 'ok' END AS outcome, count(*) AS rows FROM r GROUP BY outcome""")
def mapping_diagnostics(spark, d):
    good, bad = mapping.normalize(_external(spark, d), CUSTOMER_MAPPING)
    return bad.groupBy(F.col("error_code").alias("outcome")).agg(F.count("*").alias("rows")).unionByName(good.agg(F.lit("ok").alias("outcome"), F.count("*").alias("rows")).filter("rows > 0"))


@query("SELECT 'N' || c_custkey AS entity_id, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(28,6)) AS value, DATE '1995-03-31' AS period_end, DATE '1995-05-01' AS filed_on, DATE '1995-05-01' AS available_on FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 19 <> 0")
def mapping_normalize(spark, d):
    return mapping.normalize(_external(spark, d), CUSTOMER_MAPPING)[0].select("entity_id", "value", "period_end", "filed_on", "available_on")


CUSTOMER_MAPPING = mapping.Mapping(
    columns={"entity_id": "entity", "value": "amount", "period_end": "period_end", "filed_on": "filed", "source_row_key": "row"},
    constants={"concept_namespace": "customer", "concept": "AccountBalance", "unit": "USD", "period_type": "instant", "source_name": "customer", "source_locator": "testdata/customer"},
    null_tokens=("", "n/a"),
)


def _external(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    amount = F.when(k % 13 == 0, "n/a").when(k % 17 == 0, "1e5").otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    return spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("N"), k).alias("entity"), amount.alias("amount"), F.when(k % 19 == 0, "1995-02-30").otherwise("1995-03-31").alias("period_end"), F.lit("1995-05-01").alias("filed"), F.concat(F.lit("c-"), k).alias("row"))


@query("WITH e AS (SELECT user_id, event_type, CAST(ts AS DATE) AS d, CASE WHEN event_id % 5 = 0 THEN '8-K' ELSE '10-Q' END AS form FROM events) SELECT CASE WHEN event_type NOT IN ('click', 'view') THEN 'concept_not_allowed' WHEN form <> '10-Q' THEN 'form_not_allowed' ELSE 'accepted' END AS reason, count(*) AS entries FROM e GROUP BY reason")
def json_flatten_exclusions(spark, d):
    entry = F.struct(F.lit(None).cast("string").alias("start"), F.date_format(F.col("ts").cast("date"), "yyyy-MM-dd").alias("end"), F.lit("1.50").alias("val"), F.concat(F.lit("a-"), "event_id").alias("accn"), F.when(F.col("event_id") % 5 == 0, "8-K").otherwise("10-Q").alias("form"), F.date_format(F.date_add(F.col("ts").cast("date"), 3), "yyyy-MM-dd").alias("filed"))
    doc = F.struct(F.col("user_id").alias("cik"), F.lit("x").alias("entityName"), F.create_map(F.lit("gaap"), F.create_map(F.col("event_type"), F.struct(F.create_map(F.lit("USD"), F.array(entry)).alias("units")))).alias("facts"))
    raw = spark.read.parquet(f"{d}/events.parquet").select(F.to_json(doc).alias("json"))
    rules = companyfacts.Rules(taxonomies=("gaap",), concepts=("click", "view"), units=("USD",), forms=("10-Q",), filed=("2000-01-01", "2100-01-01"))
    return companyfacts.flatten(raw, rules).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("entries"))


@query("WITH g AS (SELECT c_custkey AS issuer, p FROM customer, range(20) u(p)) SELECT 'E' || issuer AS entity_id, CAST(DATE '2000-03-31' + CAST(91 * p AS INTEGER) AS DATE) AS period_end, CAST(DATE '2000-03-31' + CAST(91 * p + 30 AS INTEGER) AS DATE) AS filed_on, CAST(DATE '2000-03-31' + CAST(91 * p + 32 AS INTEGER) AS DATE) AS available_on, CAST(1000 + 10 * p + issuer AS DECIMAL(28,6)) AS value FROM g")
def corpus_generate(spark, d):
    """The performance corpus with an entity for each customer."""
    customers = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("i"))
    return generate.performance_facts(customers).select("entity_id", "period_end", "filed_on", "available_on", "value")


@query(FACTS + f", found AS ({_findings_sql('facts', 'record_id')}) SELECT CASE detector WHEN 'lookahead' THEN 'r1' ELSE 'r2' END AS rule_id, CASE detector WHEN 'lookahead' THEN 'blocking' ELSE 'warning' END AS action, severity AS detail, count(*) AS results FROM found WHERE (detector = 'lookahead' AND severity IN ('medium', 'high')) OR detector = 'duplicate' GROUP BY ALL")
def policy_detector_rules(spark, d):
    """Look-ahead from medium severity on blocks, duplicates warn, overwrites are switched off with a reason."""
    audit = _audit(spark, d)
    rules = [policy.DetectorRule("r1", "lookahead", least="medium"), policy.DetectorRule("r2", "duplicate", action="warning"), policy.DetectorRule("r3", "revision_overwrite", enabled=False, reason="source restates filing days")]
    found = detect.run_detectors(audit, AS_OF, ("lookahead", "duplicate", "revision_overwrite"))
    return policy.detector_results(found, audit, rules).groupBy("rule_id", "action", "detail").agg(F.count("*").alias("results"))


@query(FACTS + "SELECT 'freq' AS rule_id, entity_id, concept_namespace, concept, unit, count(DISTINCT period_end) AS periods, 'insufficient_distinct_periods' AS reason FROM facts GROUP BY entity_id, concept_namespace, concept, unit, period_type HAVING count(DISTINCT period_end) < 2")
def policy_insufficient_periods(spark, d):
    return policy.insufficient_periods(_audit(spark, d), policy.ReportingFrequency("freq", SCOPE, 365))


PARTITIONS = 16
RERUN = ("lookahead", "duplicate", "revision_overwrite")


def _rerun(changed: int | None):
    def run(spark, d):
        root, audit = sinks.work_folder(spark), _audit(spark, d)
        execution.run_partitioned(spark, audit, AS_OF, root, PARTITIONS, RERUN)
        if changed is not None:
            moved = execution.partition_of(PARTITIONS) == changed
            audit = audit.withColumn("value", F.when(moved, F.col("value") + 1).otherwise(F.col("value")).cast("decimal(28,6)"))
        return execution.run_partitioned(spark, audit, AS_OF, root, PARTITIONS, RERUN)[0]

    return run


def _rerun_sql(changed: int | None) -> str:
    part = f"('0x' || left(sha256(entity_id), 8))::BIGINT % {PARTITIONS}"
    status = "'reused'" if changed is None else f"CASE WHEN partition = {changed} THEN 'audited' ELSE 'reused' END"
    return FACTS + f", found AS ({_findings_sql('facts', 'record_id')}), p AS (SELECT record_id, CAST({part} AS INTEGER) AS partition FROM facts), n AS (SELECT partition, count(*) AS findings FROM found JOIN p ON p.record_id = split_part(affected, '|', 1) GROUP BY partition) SELECT partition, count(*) AS records, coalesce(any_value(findings), 0) AS findings, {status} AS status FROM p LEFT JOIN n USING (partition) GROUP BY partition"


for _name, _changed in (("audit_rerun_unchanged", None), ("audit_rerun_one_changed", 3)):
    QUERIES[_name], ORACLE[_name] = _rerun(_changed), _rerun_sql(_changed)


def _revalidate(family: str):
    """A stored manifest with changed, absent and foreign entries, picked by the first digit of the id, modulo 5, against facts, severity and seed."""
    severity, more = ("low", {}) if family == "lookahead" else ("medium", {"mechanism": "periodic_gap"} if family == "missing" else {})

    def run(spark, d):
        facts = _clean(spark, d)
        if family == "revision_overwrite":
            more["history"] = testdata.lineages_lineitem(spark, d)
        m = manifest.derive(family, facts, AS_OF, severity, SEED, **more)
        key = "record_id" if family == "missing" else "original_record_id"
        digit = F.conv(F.substring(key, 5, 1), 16, 10).cast("int") % 5
        changes = {"target_rank": F.when(digit == 2, F.col("target_rank") + 1).otherwise(F.col("target_rank")), key: F.when(digit == 3, F.concat(F.lit("x"), key)).otherwise(F.col(key))}
        if family != "missing":
            changes["injected_record_id"] = F.when(digit == 1, F.lit("rec_0")).otherwise(F.col("injected_record_id"))
        path = f"{sinks.work_folder(spark)}/manifest"
        m.filter(digit != 0).withColumns(changes).write.parquet(path)
        stored = spark.read.schema(m.schema).parquet(path)
        return manifest.revalidate_from_facts(stored, family, facts, AS_OF, severity, SEED, key, 16, **more).groupBy("problem").agg(F.count("*").alias("entries"))

    return run


PERIODIC_SQL = f"seen AS (SELECT * FROM facts WHERE {SEEN}), elig AS (SELECT * EXCLUDE (a, b) FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, concept_namespace, concept, unit, period_type ORDER BY period_end, record_id) AS a, row_number() OVER (PARTITION BY entity_id, concept_namespace, concept, unit, period_type ORDER BY period_end DESC, record_id DESC) AS b FROM seen) WHERE a > 1 AND b > 1)"


def _revalidate_sql(head: str, source: str, family: str, fraction: str) -> str:
    changed = "" if family == "missing" else " WHEN 1 THEN ['changed:injected_record_id']"
    cases = f"CASE (strpos('0123456789abcdef', substr(record_id, 5, 1)) - 1) % 5 WHEN 0 THEN ['left_out']{changed} WHEN 2 THEN ['changed:target_rank'] WHEN 3 THEN ['left_out', 'not_selected'] ELSE [] END"
    return head + f", m AS ({_pick_sql(source, family, fraction)}), u AS (SELECT unnest({cases}) AS problem FROM m) SELECT problem, count(*) AS entries FROM u GROUP BY problem"


for _f, _head, _source, _fraction in (
    ("lookahead", f"{FACTS},{ELIGIBLE_LOOK}", "elig", "0.02"), ("unit_drift", f"{FACTS},{ELIGIBLE_DRIFT}", "elig", "0.05"), ("duplicate", f"{FACTS},{ELIGIBLE_DUP}", "elig", "0.05"),
    ("revision_overwrite", f"WITH pairs AS ({PAIRS5_SQL})", "pairs", "0.05"), ("missing", f"{FACTS},{PERIODIC_SQL}", "elig", "0.25"),
):
    QUERIES[f"manifest_revalidate_{_f}"], ORACLE[f"manifest_revalidate_{_f}"] = _revalidate(_f), _revalidate_sql(_head, _source, _f, _fraction)


YEARS = impact.GrowthContext("orders", "TotalPrice", "USD", "instant", (None, "1995-12-31"), (None, "1996-12-31"))
FROZEN, RESEARCH = "1995-12-31", "1997-06-30"


@query(FACTS + f", y AS (SELECT entity_id, value, make_date(year(period_end), 12, 31) AS period_end, available_on FROM facts), v AS (SELECT * FROM y WHERE available_on <= DATE '{FROZEN}' UNION ALL SELECT * FROM y WHERE available_on <= DATE '{RESEARCH}' AND period_end = DATE '1996-12-31'), s AS (SELECT entity_id, sum(value) FILTER (WHERE period_end = DATE '1995-12-31') AS a, sum(value) FILTER (WHERE period_end = DATE '1996-12-31') AS b FROM v GROUP BY entity_id), g AS (SELECT entity_id, round(CAST(b - a AS DOUBLE) / abs(CAST(a AS DOUBLE)), 9) AS growth FROM s WHERE a <> 0 AND b IS NOT NULL) SELECT entity_id, growth, row_number() OVER (ORDER BY growth DESC, entity_id) AS rank FROM g QUALIFY rank <= 100")
def impact_frozen_vintage(spark, d):
    """Growth of yearly facts: 1995 as the last day of that year knew it, 1996 as June 1997 did."""
    yearly = _facts(spark, d).withColumn("period_end", F.make_date(F.year("period_end"), F.lit(12), F.lit(31)))
    frozen = impact.frozen_vintage(pit.snapshot(yearly, FROZEN), FROZEN, yearly, RESEARCH, YEARS)
    return impact.growth_ranking(frozen.filter(YEARS.fits()), ("1995-12-31", "1995-12-31"), ("1996-12-31", "1996-12-31"), top=100)


#: Rows that a mechanism removes, as common table expressions ending in m_<mechanism>.
def _removed_sql(mechanism: str) -> str:
    whole = _missing_sql(mechanism) if mechanism != "random" else FACTS + f", seen AS (SELECT * FROM facts WHERE {SEEN}), m AS ({_pick_sql('seen', 'missing', '0.10').replace(str(inject.MOST), '1000000')})"
    return f"(WITH {whole.removeprefix(FACTS).lstrip(', ').split(' SELECT record_id, value FROM facts ANTI')[0]} SELECT '{mechanism}' AS mechanism, record_id FROM m)"


KEY_SQL = "entity_id, concept_namespace, concept, unit, period_type, period_end, source_name, source_locator"
MECHANISMS = ("random", "periodic_gap", "entity_dependent", "concept_dependent", "survivorship", "source_outage")


@query(FACTS + f", gone AS ({' UNION ALL '.join(_removed_sql(m) for m in MECHANISMS)}), visible AS (SELECT record_id, hash({KEY_SQL}) AS h, period_end FROM facts WHERE {SEEN}), c AS (SELECT mechanism, v.record_id, g.record_id IS NOT NULL AS lost, count(*) OVER (PARTITION BY mechanism, h, period_end) = count(g.record_id) OVER (PARTITION BY mechanism, h, period_end) AS bare FROM visible v CROSS JOIN (SELECT DISTINCT mechanism FROM gone) LEFT JOIN gone g USING (mechanism, record_id)) SELECT mechanism, count(*) FILTER (WHERE bare) AS findings, count(*) FILTER (WHERE lost) AS targets, count(*) FILTER (WHERE lost AND bare) AS true_positives, count(*) FILTER (WHERE bare AND NOT lost) AS false_positives, count(*) FILTER (WHERE lost AND NOT bare) AS missed, {RATIO_SQL.format(a='count(*) FILTER (WHERE lost AND bare)', b='count(*) FILTER (WHERE bare)')} AS precision, {RATIO_SQL.format(a='count(*) FILTER (WHERE lost AND bare)', b='count(*) FILTER (WHERE lost)')} AS recall FROM c GROUP BY mechanism")
def score_missing(spark, d):
    """All six mechanisms over the whole table; a copy that stays behind hides a removed row, which is then missed."""
    return score.missing_evaluation(_facts(spark, d), AS_OF, MECHANISMS, "low", SEED, 1_000_000, bound_whole=False)


# These modules register more queries when they are imported.
from factlens.plans import queries_audit, queries_grid  # noqa: E402, F401
