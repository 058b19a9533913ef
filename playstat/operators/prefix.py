"""Running sums and lags per key, and global prefix sums over an ordered key.

Per-key sequences (``running_sum``, ``lag_value``) take an optional
``chunk_col``: a coarse column that is monotone in the order within a key (for
example the event day). With it, the work runs on (key, chunk) groups and a
small per-chunk offset table is stitched back with an equi-join, so one very
active key is spread over as many tasks as it has chunks instead of one.

``global_prefix`` computes, for a frame with a unique ordered key, the sum of a
weight over all smaller keys without a single-partition window: rows are cut into
ranges by the key, each range is scanned on its own and the totals of earlier
ranges are broadcast.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playstat.session import cut_lineage

UNB = Window.unboundedPreceding


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def running_sums(df: DataFrame, part: Sequence[str] | str, order: Sequence[str], sums: dict,
                 chunk_col: str | None = None) -> DataFrame:
    """Several running sums in one pass: ``sums`` maps out -> (value, inclusive).
    ``inclusive=False`` sums strictly earlier rows."""
    part, order = _cols(part), _cols(order)
    specs = {o: (F.col(v) if isinstance(v, str) else v, inc) for o, (v, inc) in sums.items()}
    if chunk_col is None:
        for o, (v, inc) in specs.items():
            w = Window.partitionBy(*part).orderBy(*order).rowsBetween(UNB, 0 if inc else -1)
            df = df.withColumn(o, F.coalesce(F.sum(v).over(w), F.lit(0)))
        return df
    keys = part + [chunk_col]
    for o, (v, _) in specs.items():
        df = df.withColumn(f"__{o}_v", v)
    local = df
    for o, (_, inc) in specs.items():
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(UNB, 0 if inc else -1)
        local = local.withColumn(o, F.coalesce(F.sum(f"__{o}_v").over(w), F.lit(0)))
    # chunk totals from a column-pruned, map-side-combined aggregate of the input;
    # one row per (key, chunk), so the offset scan per key is small
    tot = df.groupBy(*keys).agg(*[F.sum(f"__{o}_v").alias(f"__{o}_t") for o in specs])
    wk = Window.partitionBy(*part).orderBy(chunk_col).rowsBetween(UNB, -1)
    for o in specs:
        tot = tot.withColumn(f"__{o}_off", F.coalesce(F.sum(f"__{o}_t").over(wk), F.lit(0)))
    tot = tot.drop(*[f"__{o}_t" for o in specs])
    out = local.join(tot, keys, "inner")
    for o in specs:
        out = out.withColumn(o, F.col(o) + F.col(f"__{o}_off"))
    return out.drop(*[f"__{o}_{x}" for o in specs for x in ("v", "off")])


def running_sum(df: DataFrame, part: Sequence[str] | str, order: Sequence[str], value: Column | str,
                out: str, chunk_col: str | None = None, inclusive: bool = True) -> DataFrame:
    """``out`` = sum of ``value`` over rows of the same ``part`` up to this row
    (``inclusive=False``: strictly before it).

    With ``chunk_col`` each (part, chunk) is scanned on its own and the totals
    of earlier chunks are added from a small per-chunk table."""
    return running_sums(df, part, order, {out: (value, inclusive)}, chunk_col)


def lag_value(df: DataFrame, part: Sequence[str] | str, order: Sequence[str], col: str, out: str,
              chunk_col: str | None = None) -> DataFrame:
    """``out`` = ``col`` of the previous row of the same ``part`` (NULL on the first)."""
    part, order = _cols(part), _cols(order)
    if chunk_col is None:
        return df.withColumn(out, F.lag(col).over(Window.partitionBy(*part).orderBy(*order)))
    keys = part + [chunk_col]
    prev = f"__{out}_prev"
    local = df.withColumn(out, F.lag(col).over(Window.partitionBy(*keys).orderBy(*order)))
    last = (df.groupBy(*keys)
            .agg(F.max_by(col, F.struct(*order)).alias("__last"))
            .withColumn(prev, F.lag("__last").over(Window.partitionBy(*part).orderBy(chunk_col)))
            .drop("__last"))
    return (local.join(last, keys, "inner")
            .withColumn(out, F.coalesce(F.col(out), F.col(prev))).drop(prev))


def row_index(df: DataFrame, part, order, out: str = "idx", chunk_col: str | None = None) -> DataFrame:
    """0-based position of the row within its ``part`` in ``order``."""
    return running_sum(df, part, order, F.lit(1), out, chunk_col, inclusive=False)


RANGE_ROWS = 200_000          # rows of a range; the number of ranges follows the row count


def global_prefix(df: DataFrame, key: str, weight: str, out: str = "cum_before",
                  part: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """``out`` = sum of ``weight`` over rows with a smaller ``key`` (within ``part``).

    ``key`` must be unique within ``part``. The rows are cut into ranges of
    (part, key) of about ``range_rows`` rows and written once; each range is scanned
    on its own, and the totals of earlier ranges, one small row per range and part,
    are broadcast to it. Runs a count and a write while the query is built."""
    part = list(part)
    ranges = max(1, -(-df.count() // range_rows))
    cut = cut_lineage(df.repartitionByRange(ranges, *part, key).withColumn("__range", F.spark_partition_id()))
    keys = part + ["__range"]
    if ranges == 1:
        w = Window.partitionBy(*keys).orderBy(key).rowsBetween(UNB, -1)
        return cut.withColumn(out, F.coalesce(F.sum(weight).over(w), F.lit(0))).drop("__range")
    totals = cut.groupBy(*keys).agg(F.sum(weight).alias("__total"))
    # at most (ranges + parts) rows
    earlier = Window.partitionBy(*part).orderBy("__range").rowsBetween(UNB, -1)
    offsets = totals.withColumn("__off", F.coalesce(F.sum("__total").over(earlier), F.lit(0))).drop("__total")
    inside = Window.partitionBy(*keys).orderBy(key).rowsBetween(UNB, -1)
    return (cut.join(F.broadcast(offsets), keys)
            .withColumn(out, F.col("__off") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
            .drop("__off", "__range"))
