"""Comparable series, neighbours, revision pairs, fingerprints, gaps, deterministic selection."""

from __future__ import annotations

from datetime import date
from decimal import ROUND_CEILING, Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlens.functions.ratios import relative_size_at_least
from factlens.operators.pit import visible, with_lineage
from factlens.operators.ranks import DIGITS, total_rank
from factlens.schema import FINGERPRINT
from factlens.sources.sinks import work_folder

SERIES_KEY = ("entity_id", "concept_namespace", "concept", "unit", "dimensions", "period_type", "period_length_days")


def period_length() -> Column:
    return F.datediff("period_end", "period_start") + 1


def series_key(scope: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The columns of a series in the order in which rows are compared: the entity first, as it tells most of them apart."""
    return (SERIES_KEY[0], *scope, *SERIES_KEY[1:])


def comparable_series(audit: DataFrame, as_of: date | str, least: int = 3, scope: tuple[str, ...] = ()) -> DataFrame:
    """Visible rows of series of at least `least` rows; a series with a repeated coordinate goes as a whole.

    One shuffle on the series key serves both windows and, after it, the neighbours. `scope`: columns that keep series apart, as case ids do.
    """
    rows = audit.filter(visible(as_of)).withColumns({"period_length_days": period_length(), "coordinate": F.struct("period_end", F.coalesce("period_start", "period_end").alias("start"))})
    by_key = Window.partitionBy(*series_key(scope))
    by_place = by_key.orderBy("coordinate")
    # rank and row_number part where a coordinate repeats. The longest order comes first: the others, and the neighbours', are satisfied by it.
    numbered = rows.withColumn("number", F.row_number().over(by_key.orderBy("coordinate", "record_id")))
    marked = numbered.withColumn("repeat", F.col("number") != F.rank().over(by_place))
    kept = marked.withColumns({"series_size": F.count("*").over(by_key), "bad": F.max("repeat").over(by_key)})
    return kept.filter((F.col("series_size") >= least) & ~F.col("bad")).drop("number", "repeat", "bad")


def nearest_nonzero(series: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """previous_value, next_value: the nearest values other than zero on both sides; rows of value zero or without a neighbour go."""
    w = Window.partitionBy(*series_key(scope)).orderBy("coordinate", "record_id")
    value = F.when(F.col("value") != 0, F.col("value"))
    near = series.withColumns({
        "previous_value": F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "next_value": F.first(value, True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
    return near.filter("value != 0 AND (previous_value IS NOT NULL OR next_value IS NOT NULL)")


def duplicate_groups(audit: DataFrame, as_of: date | str, scope: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """Groups of at least `least` visible rows of equal fingerprint: record_ids sorted, members.

    Rows are dealt and sorted by a hash of the fingerprint. Where groups of one row are not asked for, rows that are alone with their hash,
    which are most of them, go before any fingerprint is compared.
    """
    own = (*scope, *FINGERPRINT)
    rows = audit.filter(visible(as_of)).select("record_id", *own, F.xxhash64(*own).alias("_hash"))
    if least > 1:
        rows = rows.withColumn("_equal", F.count("*").over(Window.partitionBy("_hash"))).filter(F.col("_equal") >= least)
    groups = rows.groupBy("_hash", *own)
    groups = groups.agg(F.array_sort(F.collect_list("record_id")).alias("record_ids"), F.count("*").alias("members")).drop("_hash")
    return groups.filter(F.col("members") >= least) if least > 1 else groups


def adjacent_revisions(facts: DataFrame, as_of: date | str, percent: int) -> DataFrame:
    """The last visible revision of each lineage with the next one, where a later state could overwrite an earlier one."""
    cut = F.lit(str(as_of)).cast("date")
    w = Window.partitionBy("lineage_id").orderBy("seq", "record_id")
    cols = ("record_id", "seq", "value", "available_on", "filed_on", "accession_number", "source_row_key", "form", "source_name", "source_locator")
    pairs = with_lineage(facts).filter("lineage_id IS NOT NULL").withColumn("later", F.lead(F.struct(*cols)).over(w)).filter("later IS NOT NULL")
    last_seen = (F.col("available_on") <= cut) & (F.col("later.available_on") > cut)
    ok = (
        last_seen
        & (F.col("later.seq") == F.col("seq") + 1)
        & (F.col("available_on") == F.col("filed_on"))
        & (F.col("later.available_on") == F.col("later.filed_on"))
        & (F.col("later.filed_on") > F.col("filed_on"))
        & (F.col("accession_number") != F.col("later.accession_number"))
        & (F.col("source_row_key") != F.col("later.source_row_key"))
        & (F.col("value") != 0)
        & (F.col("value") != F.col("later.value"))
        & relative_size_at_least(F.col("value"), F.col("later.value"), percent)
    )
    return pairs.filter(ok)


def reporting_gaps(audit: DataFrame, most_days: int) -> DataFrame:
    """Consecutive period ends of a concept further apart than `most_days`, with the rows at both ends."""
    key = ("entity_id", "concept_namespace", "concept", "unit", "dimensions", "period_type")
    ends = audit.groupBy(*key, "period_end").agg(F.collect_list("record_id").alias("ids"))
    w = Window.partitionBy(*key).orderBy("period_end")
    pairs = ends.withColumns({"previous_period_end": F.lag("period_end").over(w), "before": F.lag("ids").over(w)})
    gap = F.datediff("period_end", "previous_period_end")
    return pairs.withColumn("gap_days", gap).filter(F.col("gap_days") > most_days).withColumn("affected", F.array_sort(F.concat("before", "ids"))).drop("ids", "before")


def target_count(eligible: int, fraction: str, most: int) -> int:
    """min(eligible, most, max(1, ceiling(eligible * fraction)))."""
    return min(eligible, most, max(1, int((eligible * Decimal(fraction)).to_integral_value(ROUND_CEILING))))


def selection_digest(namespace: str, seed: int, unit: Column) -> Column:
    return F.sha2(F.concat(F.lit('{"eligibility_unit_id":"'), unit, F.lit(f'","namespace":"{namespace}","seed":{seed}}}')), 256)


class NoEligibleTarget(ValueError):
    """Nothing can be corrupted."""


def select_targets(eligible: DataFrame, unit: str, namespace: str, seed: int, fraction: str, most: int) -> DataFrame:
    """The first rows by selection digest, then by unit, with target_rank from 0; raises without an eligible row.

    One job over the eligible rows counts them and writes those of the least digests: twice the wanted fraction of all there can be, as
    digests are spread evenly. Only if these are too few, as may be in a small table, a second job writes all. Their histogram by the
    first digits says in which bucket the targets end and at which rank each bucket begins; the buckets are ranked apart, so no task
    takes more than a bucket, however many are wanted. Whatever uses the targets reads the written rows.
    """
    spark, seen, root = eligible.sparkSession, Observation(), work_folder(eligible.sparkSession)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    bucket = F.substring("digest", 1, DIGITS)
    sizes = lambda df: sorted(tuple(r) for r in df.groupBy(bucket).count().collect())  # noqa: E731  16 ** DIGITS rows at most
    rows = eligible.withColumn("digest", selection_digest(namespace, seed, F.col(unit)))
    share = 2 * Decimal(fraction)
    counted = rows.observe(seen, F.count("*").alias("eligible"))
    near = stored(counted.filter(F.substring("digest", 1, 8) < f"{int(share * 16**8):08x}") if share < 1 else counted, "near")
    # An empty table is not even read, so nothing is observed then.
    many = seen.get.get("eligible", 0)
    if not many:
        raise NoEligibleTarget(f"{namespace}: no eligible row")
    n, found = target_count(many, fraction, most), sizes(near)
    if sum(size for _, size in found) < n:
        near = stored(rows, "all")
        found = sizes(near)
    starts, before = [], 0
    for name, size in found:
        if before >= n:
            break
        starts.append((name, before))
        before += size
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy("digest", unit)) - 1
    placed = near.withColumn("_bucket", bucket).join(F.broadcast(spark.createDataFrame(starts, "_bucket string, _before long")), "_bucket")
    ranked = placed.withColumn("target_rank", F.col("_before") + local).filter(F.col("target_rank") < n).drop("_bucket", "_before")
    return stored(ranked, "targets")


def entity_partitions(audit: DataFrame, partitions: int) -> DataFrame:
    """(entity_id, partition): round robin by the rank of the entity's SHA-256, ranked range by range."""
    ids = audit.select("entity_id").distinct().withColumn("h", F.sha2("entity_id", 256))
    return total_rank(ids, ["h", "entity_id"]).select("entity_id", (F.col("rank") % partitions).cast("long").alias("partition"))
