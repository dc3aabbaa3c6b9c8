"""The engine's public names."""

from factlens.operators.attempts import finalize, run_attempt
from factlens.operators.detect import DETECTORS, missing_observations, run_detectors
from factlens.operators.dispatch import dispatch
from factlens.operators.execution import run_partitioned
from factlens.operators.freeze import freeze, freeze_status, run_class
from factlens.operators.impact import GrowthContext, frozen_vintage, impact, states
from factlens.operators.inject import inject_duplicate, inject_lookahead, inject_missing, inject_revision_overwrite, inject_unit_drift
from factlens.operators.manifest import require_clean, require_valid, revalidate, revalidate_from_facts
from factlens.operators.pit import assert_lineages, lineage_violations, sanitize, snapshot
from factlens.operators.policy import resolve_exceptions, roll_up
from factlens.operators.ranks import total_rank, write_sorted
from factlens.operators.replay import replay, residual
from factlens.operators.review import carried_adjudications, evidence, evidence_diff
from factlens.operators.score import clean_control, interpret, matches, metrics, missing_evaluation
from factlens.plans.benchmark import aggregate, census, expand
from factlens.plans.report import Policy, audit_report
from factlens.sources.artifacts import read_sealed, seal
from factlens.sources.mapping import Mapping, load, normalize, profiled, read_arrow, read_csv, read_parquet

__all__ = [
    "DETECTORS", "GrowthContext", "Mapping", "Policy", "aggregate", "assert_lineages", "audit_report", "carried_adjudications", "census", "clean_control", "dispatch", "evidence", "evidence_diff", "expand", "finalize", "freeze",
    "freeze_status", "frozen_vintage", "impact", "inject_duplicate", "inject_lookahead", "inject_missing", "inject_revision_overwrite", "inject_unit_drift", "interpret", "lineage_violations", "load", "matches", "metrics",
    "missing_evaluation", "missing_observations", "normalize", "profiled", "read_arrow", "read_csv", "read_parquet", "read_sealed", "replay", "require_clean", "require_valid", "residual", "resolve_exceptions", "revalidate",
    "revalidate_from_facts", "roll_up", "run_attempt", "run_class", "run_detectors", "run_partitioned", "sanitize", "seal", "snapshot", "states", "total_rank", "write_sorted",
]
