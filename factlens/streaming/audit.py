"""Streaming forms of the stateless detectors and of duplicate detection, for facts that arrive over time.

An extension. Look-ahead gives the batch detector's findings; duplicates are those that arrive within one window of the event time, so groups
that are spread further apart are the batch detector's to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.operators import detect
from factlens.schema import FINGERPRINT


def lookahead_stream(audit: DataFrame, as_of: str) -> DataFrame:
    """Stateless: each fact is judged as it arrives."""
    return detect.lookahead(audit, as_of)


def duplicates_stream(audit: DataFrame, event_time: str, late: str = "1 day") -> DataFrame:
    """Windows of one day of arrivals; a group's state goes when the watermark has passed its window."""
    return audit.withWatermark(event_time, late).groupBy(F.window(event_time, "1 day"), *FINGERPRINT).agg(F.array_sort(F.collect_list("record_id")).alias("record_ids"), F.count("*").alias("members")).filter("members >= 2")
