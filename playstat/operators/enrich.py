"""Clock reconstruction and listen enrichment (listen flag, length bucket)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playstat.functions.flags import length_bucket4, listen_plus
from playstat.operators.prefix import running_sum
from playstat.sources.schemas import Bundle

CLOCK_UNIT_SEC = 5          # fixed value: ``timestamp`` counts 5-second units


def reconstruct_time(df: DataFrame, order_cols, clock: str = "cumsum", delta_col: str = "timestamp",
                     unit: int = CLOCK_UNIT_SEC, part: str = "uid", chunk_col: str | None = None,
                     out: str = "abs_time_sec") -> DataFrame:
    """``abs_time_sec`` = unit x running sum of per-user deltas in ``order_cols`` order.

    ``clock="absolute"`` is for tables whose ``timestamp`` already is a time:
    then no window is needed. Passing ``order_cols=("timestamp",)`` reproduces
    the original (order by the delta itself) behaviour."""
    if clock == "absolute":
        return df.withColumn(out, F.col(delta_col) * unit)
    r = running_sum(df, part, order_cols, F.col(delta_col), out, chunk_col)
    return r.withColumn(out, F.col(out) * unit)


def with_flags(listens: DataFrame) -> DataFrame:
    """listen_plus and length_bucket only (no clock: cheaper when time is unused)."""
    return (listens.withColumn("listen_plus", listen_plus())
                   .withColumn("length_bucket", length_bucket4()))


def enrich_listens(b: Bundle, clock: bool = True) -> DataFrame:
    """Listens with abs_time_sec (unless ``clock=False``), listen_plus, length_bucket.

    The chunked clock ends in a join Catalyst cannot prune, so callers that
    never read abs_time_sec pass ``clock=False``."""
    lst = (reconstruct_time(b.table("listens"), b.order("listens"), b.clock, chunk_col=b.chunk_for("listens"))
           if clock else b.listens)
    return with_flags(lst)


def clocked(b: Bundle, table: str) -> DataFrame:
    return reconstruct_time(b.table(table), b.order(table), b.clock, chunk_col=b.chunk_for(table))


def clocked_together(b: Bundle, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """Two event tables on one clock: with per-user deltas, the running sum goes over
    the events of both, or their times could not be compared."""
    if b.clock == "absolute":
        return clocked(b, first), clocked(b, second)
    one, two = getattr(b, first), getattr(b, second)
    both = one.withColumn("__second", F.lit(0)).unionByName(two.withColumn("__second", F.lit(1)),
                                                            allowMissingColumns=True)
    merged = b.with_(listens=both)             # ties are broken by all columns, the kind among them
    timed = reconstruct_time(merged.table("listens"), merged.order("listens"), b.clock,
                             chunk_col=merged.chunk_for("listens"))
    return (timed.filter(F.col("__second") == 0).select(*one.columns, "abs_time_sec"),
            timed.filter(F.col("__second") == 1).select(*two.columns, "abs_time_sec"))
