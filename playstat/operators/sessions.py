"""Sessionisation of an event stream and per-session position / share.

Only the session boundary scan is a per-user window (via ``prefix``); session
length, start and recommended share are per-session aggregates joined back, so
a very long session is aggregated map-side instead of buffered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playstat.functions.flags import event_flag, position_third
from playstat.operators.prefix import lag_value, row_index, running_sums
from playstat.operators.skew import join_maybe_salted
from playstat.sources.schemas import HOT_KEY_ROWS

# fixed values: defaults of the session analysis
SESSION_GAP_SEC = 30 * 60
MIN_SESSION_LEN = 6
DOMINATED_SHARE = 0.5


def sessionize(df: DataFrame, order_cols, gap_sec: int = SESSION_GAP_SEC, time_col: str = "abs_time_sec",
               part: str = "uid", chunk_col: str | None = None, with_index: bool = False) -> DataFrame:
    """``session_id`` (0-based per user): a gap strictly above ``gap_sec`` opens a
    session. ``with_index`` also adds ``__idx`` (0-based row index per user) in
    the same pass."""
    d = lag_value(df, part, order_cols, time_col, "__prev", chunk_col)
    d = d.withColumn("__new", F.when(
        F.coalesce(F.col(time_col) - F.col("__prev"), F.lit(0)) > gap_sec, 1).otherwise(0))
    sums = {"session_id": (F.col("__new"), True)}
    if with_index:
        sums["__idx"] = (F.lit(1), False)
    return running_sums(d, part, order_cols, sums, chunk_col).drop("__prev", "__new")


def session_positions(sess: DataFrame, order_cols, min_len: int = MIN_SESSION_LEN, part: str = "uid",
                      chunk_col: str | None = None, dislike_value: str = "dislike",
                      hot_session_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Adds pos_in_session, session_len, pos_third, is_dislike, rec_share and
    rec_dominated; keeps sessions with at least ``min_len`` events and at least
    one listen (non-NULL is_organic).

    Per-session statistics are an aggregate joined back. When users are chunked
    (some user is hot, so a session may be too), sessions longer than
    ``hot_session_rows`` are salted in that join."""
    d = sess if "__idx" in sess.columns else row_index(sess, part, order_cols, "__idx", chunk_col)
    keys = [part, "session_id"]
    stats = (d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("session_len"),
        F.min("__idx").alias("__start"),
        F.avg(F.when(F.col("is_organic").isNotNull(),
                     F.when(F.col("is_organic") == 0, 1).otherwise(0))).alias("rec_share"))
        .filter((F.col("session_len") >= min_len) & F.col("rec_share").isNotNull()))
    joined = join_maybe_salted(d, stats, keys, "inner", chunk_col is not None, hot_session_rows)
    return (joined
            .withColumn("pos_in_session", F.col("__idx") - F.col("__start"))
            .withColumn("pos_third", position_third())
            .withColumn("is_dislike", event_flag(dislike_value))
            .withColumn("rec_dominated", F.col("rec_share") > DOMINATED_SHARE)
            .drop("__idx", "__start"))
