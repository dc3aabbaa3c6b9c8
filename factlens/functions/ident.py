"""Canonical text and stable identifiers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_decimal(c: Column) -> Column:
    """Shortest plain text of a decimal: no trailing zeros, no point without digits, no minus zero."""
    text = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.regexp_replace(text, r"^-0$", "0")


def canonical_json(**fields: Column) -> Column:
    """Compact JSON of the fields, keys sorted, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def content_hash(json: Column) -> Column:
    return F.sha2(json, 256)


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """prefix_ and 16 hex digits of the SHA-256 of the parts, joined by |."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256), 1, 16))


def snapshot_digest(df: DataFrame, columns: list[str], buckets: int = 256) -> DataFrame:
    """One row with the digest of all rows, whatever their order: row hashes per bucket, then the buckets' hashes."""
    rows = df.select(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    sums = rows.withColumn("b", F.pmod(F.xxhash64("h"), F.lit(buckets))).groupBy("b").agg(*[F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)], F.count("*").alias("n"))
    each = F.concat_ws(":", "b", "n", *[f"s{i}" for i in range(8)])
    return sums.agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(each))), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's named columns, nulls kept, whatever their order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def digest_of_rows(digest: Column) -> Column:
    """One text that stands for a multiset of row digests, in any order and in one aggregation: their number and the sums of their 64-bit quarters."""
    words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)]
    # Longs are summed by 16 bits, so no row makes a decimal and no sum ends before 2 ** 47 rows.
    pieces = [F.sum(p) for w in words for p in (F.shiftright(w, 16), w.bitwiseAND(0xFFFF))]
    exact = [p.cast("decimal(38,0)") for p in pieces]
    quarters = [reduce(lambda high, low: high * F.lit(1 << 16) + low, exact[4 * i : 4 * i + 4]).cast("decimal(38,0)").cast("string") for i in range(4)]
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), *quarters), 256)
