"""Pair roll-ups, presence-flag joins, after-event matching, top users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playstat.operators.skew import join_maybe_salted
from playstat.sources.schemas import HOT_KEY_ROWS

PAIR = ["uid", "item_id"]
TOP_FRACTION = 0.01         # fixed value: share of users treated as "top"


def pair_agg(listens: DataFrame, order_cols) -> DataFrame:
    """One row per (uid, item_id): the organic flag of the last listen (by the
    total order), listen count, max listen flag and max ratio."""
    return listens.groupBy(*PAIR).agg(
        F.max_by("is_organic", F.struct(*order_cols)).alias("is_organic"),
        F.count(F.lit(1)).alias("n_listens"),
        F.max("listen_plus").alias("listen_plus"),
        F.max("played_ratio_pct").alias("played_ratio"))


def flag_join(left: DataFrame, events: DataFrame, flag: str, keys=PAIR) -> DataFrame:
    """Left-join a 0/1 presence flag of ``events`` on ``keys``. The flag side is
    de-duplicated (an aggregate, so map-side combined) before the join."""
    flags = events.select(*keys).distinct().withColumn(flag, F.lit(1))
    return (left.join(flags, list(keys), "left")
            .withColumn(flag, F.coalesce(F.col(flag), F.lit(0))))


CANCEL_CHUNK_SEC = 86_400     # one scan per (pair, day); later days via a small table


def cancel_match(dis: DataFrame, und: DataFrame, fix_min_time: bool = True,
                 chunk_sec: int | None = CANCEL_CHUNK_SEC) -> DataFrame:
    """Per dislike (uid, item_id, abs_time_sec, is_organic): ``cancelled`` = 1 if
    an undislike of the same pair comes strictly later; ``time_to_cancel`` =
    first such undislike time minus the dislike time.

    Both kinds are unioned and scanned per pair in reverse time order with a
    running minimum, so no (dislike, undislike) pairs are materialised. With
    ``chunk_sec`` the scan runs per (pair, time chunk) and the first undislike
    of any later chunk comes from a per-chunk aggregate joined back, so one hot
    pair is spread over its chunks. ``fix_min_time=False`` reproduces the
    original time, the minimum over *all* undislikes of the pair (which can be
    negative)."""
    d = dis.select(*PAIR, "abs_time_sec", "is_organic", F.lit(0).alias("kind"))
    u = und.select(*PAIR, "abs_time_sec", F.lit(None).cast("int").alias("is_organic"),
                   F.lit(1).alias("kind"))
    both = d.unionByName(u)
    und_t = F.when(F.col("kind") == 1, F.col("abs_time_sec"))
    keys = list(PAIR)
    if chunk_sec:
        both = both.withColumn("__chunk", F.floor(F.col("abs_time_sec") / chunk_sec).cast("bigint"))
        keys = keys + ["__chunk"]
    # (time desc, dislike before undislike): rows before a dislike are strictly later
    w = Window.partitionBy(*keys).orderBy(F.desc("abs_time_sec"), F.asc("kind")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    nxt = both.withColumn("next_und", F.min(und_t).over(w)).filter(F.col("kind") == 0)
    if chunk_sec:
        # first undislike in any strictly later chunk: one row per (pair, chunk)
        per = both.groupBy(*keys).agg(F.min(und_t).alias("__m"))
        later = per.withColumn("__later_und", F.min("__m").over(
            Window.partitionBy(*PAIR).orderBy(F.desc("__chunk"))
            .rowsBetween(Window.unboundedPreceding, -1))).drop("__m")
        nxt = (nxt.join(later, keys, "inner")
               .withColumn("next_und", F.least("next_und", "__later_und")).drop("__later_und"))
    g = nxt.groupBy(*PAIR, "abs_time_sec", "is_organic").agg(F.min("next_und").alias("next_und"))
    g = g.withColumn("cancelled", F.col("next_und").isNotNull().cast("int"))
    if fix_min_time:
        t = F.col("next_und")
    else:
        first_any = und.groupBy(*PAIR).agg(F.min("abs_time_sec").alias("any_und"))
        g = g.join(first_any, PAIR, "left")
        t = F.when(F.col("cancelled") == 1, F.col("any_und"))
    return (g.withColumn("time_to_cancel", t - F.col("abs_time_sec"))
             .select(*PAIR, "abs_time_sec", "is_organic", "cancelled", "time_to_cancel"))


def top_fraction_users(per_user: DataFrame, count_col: str = "cnt", fraction: float = TOP_FRACTION,
                       part: str = "uid") -> DataFrame:
    """The first int(n_users * fraction) + 1 users by (count desc, uid asc).

    A histogram of counts finds the cut-off count (one row per distinct count);
    only users tied at the cut-off are ranked, by uid, with a range-bucketed
    prefix count instead of a global window."""
    from playstat.operators.prefix import global_prefix
    from playstat.session import cut_lineage
    per_user = cut_lineage(per_user)          # one row per user, read three times
    hist = per_user.groupBy(count_col).agg(F.count(F.lit(1)).alias("users"))
    n_users = hist.agg(F.sum("users").alias("__users"))                       # one row
    hist = hist.withColumn("__down", -F.col(count_col))
    cut = (global_prefix(hist, "__down", "users", "above").crossJoin(F.broadcast(n_users))
           .withColumn("k", (F.floor(F.col("__users") * fraction) + 1).cast("bigint"))
           .filter((F.col("above") < F.col("k")) & (F.col("above") + F.col("users") >= F.col("k")))
           .select(F.col(count_col).alias("__cut"), (F.col("k") - F.col("above")).alias("__need")))
    c = per_user.crossJoin(F.broadcast(cut))            # one row
    above = c.filter(F.col(count_col) > F.col("__cut")).drop("__cut", "__need")
    tied = (c.filter(F.col(count_col) == F.col("__cut")).withColumn("__one", F.lit(1)))
    tied = (global_prefix(tied, part, "__one", "__before")
            .filter(F.col("__before") < F.col("__need")).drop("__cut", "__need", "__one", "__before"))
    return above.unionByName(tied)


def exclude_users(df: DataFrame, users: DataFrame, part: str = "uid", hot: bool = False,
                  hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Rows whose user is not in ``users`` (NULL users dropped too, as NOT IN does)."""
    return join_maybe_salted(df.filter(F.col(part).isNotNull()), users.select(part), part, "left_anti", hot, hot_rows)
