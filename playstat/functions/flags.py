"""Scalar flag and bucket expressions (all JVM-side Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: thresholds and labels of the analyses
LISTEN_PLUS_MIN_PCT = 50          # ratio >= 50  -> listen-through
REWIND_MIN_PCT = 100              # ratio > 100  -> rewound / replayed
LENGTH_BUCKETS_4 = [(120, "0-2min"), (240, "2-4min"), (420, "4-7min")]
LENGTH_BUCKET_4_LAST = "7+min"
LENGTH_BUCKETS_6 = [(90, "<1.5m"), (150, "1.5-2.5m"), (210, "2.5-3.5m"),
                    (270, "3.5-4.5m"), (360, "4.5-6m")]
LENGTH_BUCKET_6_LAST = "6m+"
THIRDS = ("beginning", "middle", "end")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def listen_plus(ratio="played_ratio_pct") -> Column:
    """1 when the play reached half the track (NULL ratio -> 0)."""
    return F.when(_c(ratio) >= LISTEN_PLUS_MIN_PCT, 1).otherwise(0)


def rewind_flag(ratio="played_ratio_pct") -> Column:
    """1 when more than the whole track was played (NULL ratio -> 0)."""
    return F.when(_c(ratio) > REWIND_MIN_PCT, 1).otherwise(0)


def _buckets(x: Column, edges, last: str) -> Column:
    out = None
    for edge, label in edges:
        out = F.when(x < edge, label) if out is None else out.when(x < edge, label)
    return out.otherwise(last)


def length_bucket4(length="track_length_seconds") -> Column:
    """Left-closed 4-way length bucket; NULL length falls in the last bucket."""
    return _buckets(_c(length), LENGTH_BUCKETS_4, LENGTH_BUCKET_4_LAST)


def length_bucket6(length="track_length_seconds") -> Column:
    return _buckets(_c(length), LENGTH_BUCKETS_6, LENGTH_BUCKET_6_LAST)


def position_third(pos="pos_in_session", length="session_len") -> Column:
    rel = _c(pos).cast("double") / _c(length)
    return (F.when(rel < F.lit(1.0) / 3, THIRDS[0])
             .when(rel < F.lit(2.0) / 3, THIRDS[1]).otherwise(THIRDS[2]))


def event_flag(value: str, col="event_type") -> Column:
    return F.when(_c(col) == value, 1).otherwise(0)


def quartile_from_cuts(x, q1, q2, q3) -> Column:
    """1..4 from three cut-points (right-closed)."""
    x = _c(x)
    return (F.when(x <= _c(q1), 1).when(x <= _c(q2), 2).when(x <= _c(q3), 3).otherwise(4))
