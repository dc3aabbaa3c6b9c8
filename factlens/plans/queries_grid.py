"""Queries over whole grids of benchmark cases and over total orders, with their SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.operators import dispatch, impact, inject, pit, ranks, review
from factlens.plans import benchmark
from factlens.plans.queries import AS_OF, DRIFT_SQL, DUP_SQL, ELIGIBLE_DRIFT, ELIGIBLE_DUP, LOOK_SQL, OVER_SQL, RESULTS_SQL, SEED, SEEN, SERIES_SQL, _aggregate_sql, _pick_sql, query
from factlens.sources import testdata

#: Two seeds of each open class; with four families and three severities 48 cases with a fault, and four controls.
SEEDS = (0, 1, 100, 101)


def grid(spark) -> DataFrame:
    return benchmark.expand(spark, seeds=SEEDS).filter("kind = 'fault'").unionByName(benchmark.controls(spark))


def _dispatched(spark, d) -> dispatch.Dispatched:
    return dispatch.dispatch(spark, grid(spark), testdata.facts_orders(spark, d), testdata.lineages_lineitem(spark, d), AS_OF)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: The detectors over the facts of all cases: their ids carry the case, which keeps the cases apart.
_NAMES = ("series", "near", "gated", "tries", "valid", "drift")
CASE_DRIFT = reduce(lambda q, n: re.sub(rf"\b{n}\b", f"{n}_c", q), _NAMES, DRIFT_SQL).replace("FROM facts", "FROM cf")
_FRACTIONS = [(f, s, inject.FRACTIONS[f][i], inject.MINIMUM_LAG[i], inject.MINIMUM_SIZE[i], inject.SCALE[i]) for f in dispatch.FAMILIES for i, s in enumerate(inject.SEVERITIES)]
GRID_SQL = (
    "WITH " + testdata.FACTS_SQL + "," + testdata.LINEAGES_SQL + f""",
levels(profile, severity, fraction, lag, size, factor) AS (VALUES {_values(_FRACTIONS)}),
cases AS (SELECT 'case_' || left(sha256(profile || '|' || severity || '|' || seed), 16) AS case_id, profile, severity, seed, CASE WHEN seed < 100 THEN 'development' ELSE 'validation' END AS seed_class, 'fault' AS kind FROM levels, (VALUES {_values((s,) for s in SEEDS)}) s(seed)
  UNION ALL SELECT 'control_' || left(sha256(profile || '|medium|0'), 16), profile, 'medium', 0, 'development', 'clean_control' FROM levels WHERE severity = 'medium'),
snap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lineage_id ORDER BY seq DESC) AS r FROM lineages WHERE {SEEN}) WHERE r = 1),
cl AS (SELECT 'facts' AS dataset, record_id, entity_id, concept_namespace, concept, value, unit, period_type, period_end, filed_on, available_on, accession_number, source_name, source_locator FROM facts
  UNION ALL SELECT 'history', record_id, entity_id, 'lineitem', 'ExtendedPrice', value, 'USD', 'instant', period_end, filed_on, available_on, 'A-' || lineage_id || '#r' || seq, 'lineitem', 'testdata/lineitem' FROM snap),
p AS (SELECT *, lead(seq) OVER w AS s2, lead(value) OVER w AS v2, lead(available_on) OVER w AS a2 FROM lineages WINDOW w AS (PARTITION BY lineage_id ORDER BY seq)),
pairs AS (SELECT record_id, value, v2, a2, 'A-' || lineage_id || '#r' || s2 AS acc2 FROM p WHERE {SEEN} AND a2 > DATE '{AS_OF}' AND s2 = seq + 1 AND a2 > available_on AND value <> 0 AND v2 <> value),
{SERIES_SQL}, {ELIGIBLE_DUP},
pool AS (SELECT profile, severity, record_id FROM levels, facts WHERE profile = 'lookahead' AND available_on = filed_on AND period_end <= DATE '{AS_OF}' AND available_on > DATE '{AS_OF}' AND filed_on - period_end >= lag
  UNION ALL SELECT profile, severity, record_id FROM levels, series WHERE profile = 'unit_drift' AND value <> 0
  UNION ALL SELECT profile, severity, record_id FROM levels, elig WHERE profile = 'duplicate'
  UNION ALL SELECT profile, severity, record_id FROM levels, pairs WHERE profile = 'revision_overwrite' AND abs(v2 - value) * 100 >= abs(value) * size),
counts AS (SELECT profile, severity, count(*) AS eligible FROM pool GROUP BY ALL),
sized AS (SELECT c.*, coalesce(eligible, 0) AS eligible, factor, CASE WHEN kind = 'fault' AND eligible > 0 THEN least(eligible, {inject.MOST}, greatest(1, ceil(eligible * CAST(fraction AS DECIMAL(9,4))))) ELSE 0 END AS wanted FROM cases c JOIN levels USING (profile, severity) LEFT JOIN counts USING (profile, severity)),
tg AS (SELECT case_id, record_id, 'rec_' || left(sha256(profile || '|' || seed || '|' || record_id), 16) AS new_id FROM (SELECT s.*, record_id, row_number() OVER (PARTITION BY case_id ORDER BY sha256('{{"eligibility_unit_id":"' || record_id || '","namespace":"' || s.profile || '","seed":' || seed || '}}'), record_id) AS r FROM sized s JOIN pool USING (profile, severity)) WHERE r <= wanted),
marked AS (SELECT s.case_id, s.profile, s.factor, cl.*, t.new_id, q.v2, q.a2, q.acc2 FROM sized s JOIN cl ON cl.dataset = CASE WHEN s.profile = 'revision_overwrite' THEN 'history' ELSE 'facts' END LEFT JOIN tg t ON t.case_id = s.case_id AND t.record_id = cl.record_id LEFT JOIN pairs q ON t.record_id = q.record_id AND s.profile = 'revision_overwrite'),
plain AS (SELECT * FROM (SELECT case_id, profile, coalesce(new_id, record_id) AS rid, entity_id AS eid, concept_namespace, concept, unit, period_type, period_end, source_name, source_locator,
    CAST(CASE WHEN new_id IS NULL THEN value WHEN profile = 'unit_drift' THEN value * factor WHEN profile = 'revision_overwrite' THEN v2 ELSE value END AS DECIMAL(28,6)) AS value,
    CASE WHEN new_id IS NOT NULL AND profile = 'revision_overwrite' THEN a2 ELSE filed_on END AS filed_on, CASE WHEN new_id IS NOT NULL AND profile = 'lookahead' THEN period_end ELSE available_on END AS available_on,
    CASE WHEN new_id IS NOT NULL AND profile = 'revision_overwrite' THEN acc2 ELSE accession_number END AS accession_number FROM marked)
  UNION ALL SELECT case_id, profile, record_id, entity_id, concept_namespace, concept, unit, period_type, period_end, source_name, source_locator, value, filed_on, available_on, accession_number FROM marked WHERE new_id IS NOT NULL AND profile = 'duplicate'),
cf AS (SELECT case_id || '~' || rid AS record_id, case_id || '~' || eid AS entity_id, * EXCLUDE (case_id, profile, rid, eid) FROM plain),
{CASE_DRIFT},
fd AS (SELECT 'lookahead' AS detector, record_id AS affected, entity_id, severity FROM ({LOOK_SQL.replace("FROM facts", "FROM cf")})
  UNION ALL SELECT 'revision_overwrite', record_id, entity_id, severity FROM ({OVER_SQL.replace("FROM facts", "FROM cf")})
  UNION ALL SELECT 'duplicate', affected, entity_id, severity FROM ({DUP_SQL.replace("FROM facts", "FROM cf")})
  UNION ALL SELECT 'unit_drift', record_id, entity_id, CASE f WHEN 100 THEN 'low' WHEN 1000 THEN 'medium' ELSE 'high' END FROM drift_c WHERE r = 1),
fc AS (SELECT split_part(entity_id, '~', 1) AS case_id, detector, severity, replace(affected, split_part(entity_id, '~', 1) || '~', '') AS affected FROM fd),
expected AS (SELECT tg.case_id, c.profile AS detector, CASE WHEN c.profile = 'duplicate' THEN least(record_id, new_id) || '|' || greatest(record_id, new_id) ELSE new_id END AS affected, CASE WHEN c.profile = 'unit_drift' THEN c.severity END AS sev FROM tg JOIN cases c USING (case_id)),
tp AS (SELECT case_id, count(*) AS n FROM fc JOIN expected e USING (case_id, detector, affected) WHERE sev IS NULL OR sev = severity GROUP BY case_id),
fig AS (SELECT m.case_id, m.seen <> x.seen AS seen, m.total <> x.total AS total, m.records <> x.records AS records FROM (SELECT case_id, count(*) FILTER (WHERE {SEEN}) AS seen, sum(value) AS total, count(*) AS records FROM marked GROUP BY case_id) m JOIN (SELECT case_id, count(*) FILTER (WHERE {SEEN}) AS seen, sum(value) AS total, count(*) AS records FROM plain GROUP BY case_id) x USING (case_id)),
res AS (SELECT s.case_id, s.profile AS fault_profile, s.severity, CAST(s.seed AS INTEGER) AS seed, s.seed_class, s.kind, CASE WHEN s.kind = 'fault' AND s.wanted = 0 THEN 'no_target' ELSE 'ok' END AS status, coalesce(f.n, 0) AS findings, coalesce(t.n, 0) AS faults, coalesce(tp.n, 0) AS true_positives,
  coalesce(f.n, 0) - coalesce(tp.n, 0) AS false_positives, s.eligible - CASE WHEN s.profile = 'lookahead' THEN coalesce(t.n, 0) ELSE 0 END AS eligible,
  CASE WHEN t.n IS NOT NULL THEN CASE s.profile WHEN 'lookahead' THEN seen WHEN 'duplicate' THEN records ELSE total END END AS changed, CASE WHEN t.n IS NOT NULL THEN true END AS restored
  FROM sized s LEFT JOIN (SELECT case_id, count(*) AS n FROM fc GROUP BY ALL) f USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS n FROM tg GROUP BY ALL) t USING (case_id) LEFT JOIN tp USING (case_id) LEFT JOIN fig USING (case_id))
"""
)


@query(GRID_SQL + "SELECT * FROM res")
def benchmark_grid(spark, d):
    """Every case of the grid, injected, audited, scored and repaired in one plan."""
    return _dispatched(spark, d).results


@query(GRID_SQL + "SELECT t.case_id, t.record_id, c.profile AS fault_profile FROM tg t JOIN cases c USING (case_id)")
def benchmark_targets(spark, d):
    """The rows that each case of the grid corrupts."""
    return _dispatched(spark, d).manifest.select("case_id", "record_id", "fault_profile")


@query(GRID_SQL + "SELECT case_id, detector, severity, count(*) AS findings FROM fc GROUP BY ALL")
def benchmark_findings(spark, d):
    """What all detectors find in each case, counted by severity."""
    return _dispatched(spark, d).findings.groupBy("case_id", "detector", "severity").agg(F.count("*").alias("findings"))


GRID_DIMS = ("fault_profile", "severity", "seed_class")


@query(GRID_SQL + _aggregate_sql(GRID_DIMS, True).removeprefix("WITH " + RESULTS_SQL))
def benchmark_aggregate(spark, d):
    """The grid's counters summed over all cases and by family, severity and class of seeds."""
    return benchmark.aggregate(_dispatched(spark, d).results, GRID_DIMS, "lenient")


YEAR = "SELECT entity_id, sum(value) FILTER (WHERE period_end BETWEEN DATE '1995-01-01' AND DATE '1995-12-31') AS a, sum(value) FILTER (WHERE period_end BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') AS b FROM facts GROUP BY entity_id"


@query("WITH " + testdata.FACTS_SQL + f", s AS ({YEAR}), g AS (SELECT entity_id, round(CAST(b - a AS DOUBLE) / abs(CAST(a AS DOUBLE)), 9) AS growth FROM s WHERE a <> 0 AND b IS NOT NULL) SELECT entity_id, growth, row_number() OVER (ORDER BY growth DESC, entity_id) AS rank FROM g")
def impact_growth_all(spark, d):
    """Every entity's place by growth, ranked range by range."""
    return impact.growth_ranking(testdata.facts_orders(spark, d), ("1995-01-01", "1995-12-31"), ("1996-01-01", "1996-12-31"))


@query("WITH " + testdata.FACTS_SQL + " SELECT record_id, row_number() OVER (ORDER BY entity_id, concept, period_end, filed_on, record_id) - 1 AS place FROM facts")
def canonical_order(spark, d):
    """Every fact's place in the canonical order of a sorted sink."""
    return ranks.total_rank(testdata.facts_orders(spark, d), ["entity_id", "concept", "period_end", "filed_on", "record_id"], "place").select("record_id", "place")


@query(GRID_SQL + "SELECT case_id, CASE WHEN fault_profile = 'duplicate' THEN 'incomplete' ELSE status END AS status FROM res WHERE fault_profile = 'duplicate' OR status <> 'ok'")
def benchmark_incomplete(spark, d):
    """Cases of the grid that are still to be run, where those of one family have not been."""
    return benchmark.incomplete(grid(spark), _dispatched(spark, d).results.filter("fault_profile != 'duplicate'"))


_YEARS = "sum(value) FILTER (WHERE period_end BETWEEN DATE '1995-01-01' AND DATE '1995-12-31') AS a, sum(value) FILTER (WHERE period_end BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') AS b"
_RANKS = "SELECT entity_id, row_number() OVER (ORDER BY round(CAST(b - a AS DOUBLE) / abs(CAST(a AS DOUBLE)), 9) DESC, entity_id) AS rank FROM (SELECT entity_id, {years} FROM {table} GROUP BY entity_id) WHERE a <> 0 AND b IS NOT NULL"


@query("WITH " + testdata.FACTS_SQL + f", {ELIGIBLE_DRIFT}, m AS ({_pick_sql('elig', 'unit_drift', '0.05')}), f2 AS (SELECT f.entity_id, f.period_end, CAST(CASE WHEN m.record_id IS NULL THEN f.value ELSE f.value * 1000 END AS DECIMAL(28,6)) AS value FROM facts f LEFT JOIN m USING (record_id)), r1 AS ({_RANKS.format(years=_YEARS, table='facts')}), r2 AS ({_RANKS.format(years=_YEARS, table='f2')}) SELECT entity_id, r1.rank AS clean_rank, r2.rank AS other_rank FROM r1 FULL JOIN r2 USING (entity_id) WHERE r1.rank IS DISTINCT FROM r2.rank")
def impact_ranking_change(spark, d):
    """Entities whose place by growth is another one once values have drifted."""
    clean = testdata.facts_orders(spark, d)
    drifted = inject.inject_unit_drift(clean, AS_OF, "medium", SEED)[0]
    years = ("1995-01-01", "1995-12-31"), ("1996-01-01", "1996-12-31")
    return impact.ranking_change(impact.growth_ranking(clean, *years), impact.growth_ranking(drifted, *years))


@query("WITH " + testdata.LINEAGES_SQL + f", snap AS (SELECT *, row_number() OVER (PARTITION BY lineage_id ORDER BY seq DESC) AS r FROM lineages WHERE {SEEN}) SELECT record_id FROM snap WHERE r = 1 AND lineage_id LIKE '%-3'")
def snapshot_inconsistent(spark, d):
    """Rows of a stored snapshot that are not those of the one built from history: values of third line items were changed."""
    built = pit.snapshot(testdata.lineages_lineitem(spark, d), AS_OF)
    stored = built.withColumn("value", F.when(F.col("lineage_id").endswith("-3"), F.col("value") + 1).otherwise(F.col("value")).cast("decimal(28,6)"))
    return impact.inconsistent(stored.drop("lineage_id", "seq"), built.drop("lineage_id", "seq"))


@query("WITH " + testdata.FACTS_SQL + " SELECT entity_id, count(DISTINCT form) AS partitions FROM facts GROUP BY entity_id HAVING count(DISTINCT form) > 1")
def entity_overlap(spark, d):
    """Entities that lie in more than one partition, where forms are taken as partitions."""
    return review.disjoint_violations(pit.sanitize(testdata.facts_orders(spark, d)), "form")
