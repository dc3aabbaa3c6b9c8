"""Revalidation: a stored manifest against one derived anew from the clean facts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.functions.ident import digest_of_rows, row_digest
from factlens.operators import inject, pit
from factlens.schema import fact_errors

#: Ranks of one leaf of a manifest's digest.
LEAF = 1024


class ManifestConflict(ValueError):
    """A manifest does not say what its seed, severity and facts imply."""


def revalidate(stored: DataFrame, derived: DataFrame, key: str = "original_record_id") -> DataFrame:
    """(key, problem) of every entry that differs: `not_selected`, `left_out`, `repeated`, or `changed:` and the first differing column.

    `derived` is the manifest that the injector gives for the same facts, seed and severity: its ranks, ids and values are all
    computed again. Equal manifests give no row; a null key is `not_selected`. Both sides shuffle once, on the key.
    """
    if set(stored.columns) != set(derived.columns):
        raise ManifestConflict(f"columns differ: {sorted(set(stored.columns) ^ set(derived.columns))}")
    body = [c for c in derived.columns if c != key]
    pack = lambda df, side: df.groupBy(F.col(key)).agg(F.count("*").alias(f"{side}_n"), F.first(F.struct(*body)).alias(side))
    both = pack(stored, "stored").join(pack(derived, "derived"), key, "full_outer")
    same = lambda c: F.col(f"stored.{c}").eqNullSafe(F.col(f"derived.{c}"))
    problem: Column = F.coalesce(
        F.when(F.col("derived_n").isNull(), F.lit("not_selected")), F.when(F.col("stored_n").isNull(), F.lit("left_out")), F.when(F.col("stored_n") > 1, F.lit("repeated")), *[F.when(~same(c), F.lit(f"changed:{c}")) for c in body]
    )
    return both.select(key, problem.alias("problem")).filter("problem IS NOT NULL")


def require_valid(stored: DataFrame, derived: DataFrame, key: str = "original_record_id") -> DataFrame:
    """`stored` itself; raises on the first entry that differs."""
    if (bad := revalidate(stored, derived, key).first()) is not None:
        raise ManifestConflict(f"{bad[0]}: {bad.problem}")
    return stored


class UnfitFacts(ValueError):
    """Facts that nothing may be injected into."""


def require_clean(facts: DataFrame) -> None:
    """Raises unless every fact keeps the rules of its schema, ids are unique and revision histories do not contradict themselves."""
    if (bad := fact_errors(facts).first()) is not None:
        raise UnfitFacts(f"{bad.record_id}: {bad.error}")
    if (twice := facts.groupBy("record_id").count().filter("count > 1").first()) is not None:
        raise UnfitFacts(f"{twice.record_id}: repeated record_id")
    pit.assert_lineages(facts)


def derive(family: str, facts: DataFrame, as_of: date | str, severity: str, seed: int, history: DataFrame | None = None, mechanism: str = "random", most: int = inject.MOST) -> DataFrame:
    """The manifest that the family's injector gives for these facts, or, for revision overwrites, for the snapshot of `history`."""
    if family == "revision_overwrite":
        snap = pit.snapshot(history, as_of).drop("lineage_id", "seq")
        return inject.inject_revision_overwrite(snap, history, as_of, severity, seed, most)[1]
    if family == "missing":
        return inject.inject_missing(facts, as_of, mechanism, severity, seed, most)[1]
    return {"lookahead": inject.inject_lookahead, "unit_drift": inject.inject_unit_drift, "duplicate": inject.inject_duplicate}[family](facts, as_of, severity, seed, most)[1]


def leaves(manifest: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(leaf, digest): a digest of the entries of every `leaf` ranks. Entries without a rank are dealt to leaves by their content."""
    h = row_digest(manifest.columns)
    place = F.coalesce(F.floor(F.col("target_rank") / leaf), -1 - F.pmod(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long"), F.lit(256)))
    return manifest.withColumn("_h", h).groupBy(place.cast("long").alias("leaf")).agg(digest_of_rows(F.col("_h")).alias("digest"))


def root_digest(manifest: DataFrame, leaf: int = LEAF) -> str:
    """What a sealed manifest is known by: the digest of its leaves."""
    return leaves(manifest, leaf).agg(digest_of_rows(row_digest(["leaf", "digest"])).alias("d")).first().d


def revalidate_from_facts(stored: DataFrame, family: str, facts: DataFrame, as_of: date | str, severity: str, seed: int, key: str = "original_record_id", leaf: int = LEAF, **more) -> DataFrame:
    """(key, problem) as revalidate has them, of a stored manifest against what the facts, the severity and the seed imply.

    Digests of leaves say which ranges of ranks differ; only entries of those are compared with each other. A manifest that is what it
    should be has equal leaves, and none of its entries is compared.
    """
    derived = derive(family, facts, as_of, severity, seed, **more)
    if set(stored.columns) != set(derived.columns):
        raise ManifestConflict(f"columns differ: {sorted(set(stored.columns) ^ set(derived.columns))}")
    a, b = leaves(stored.select(*derived.columns), leaf), leaves(derived, leaf)
    differ = a.withColumnRenamed("digest", "a").join(b.withColumnRenamed("digest", "b"), "leaf", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("leaf")
    mine = lambda df: df.withColumn("leaf", F.coalesce(F.floor(F.col("target_rank") / leaf), F.lit(-1)).cast("long"))
    # An entry without a rank is in some leaf below zero: they are all compared if any of those differs.
    wanted = differ.select(F.greatest("leaf", F.lit(-1)).alias("leaf")).distinct()
    part = lambda df: mine(df).join(wanted, "leaf", "left_semi").drop("leaf")
    return revalidate(part(stored.select(*derived.columns)), part(derived), key)
