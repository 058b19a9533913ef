"""Named queries: one function ``Context -> DataFrame`` per operator or
analysis (``CTX_QUERIES``). ``REGISTRY`` binds them to the adapter views of the
given tables as ``(spark, sf_dir) -> DataFrame``; ``oracle.py`` spells the
same queries for DuckDB. On real interaction data use
``Context.from_folder(spark, path)`` and call the functions directly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playstat.functions.flags import length_bucket6, quartile_from_cuts, rewind_flag
from playstat.operators import interactions as I
from playstat.operators import ranks as R
from playstat.operators import sequences as Q
from playstat.operators import sessions as S
from playstat.operators import tests as TS
from playstat.operators.enrich import clocked, clocked_together, enrich_listens, reconstruct_time, with_flags
from playstat.operators.models import add_zscores, zscore_stats
from playstat.operators.prefix import global_prefix, row_index
from playstat.operators.sampling import hash_sample, quantile_sketch, sample_to_target, sample_to_target_by_group
from playstat.operators.skew import join_maybe_salted
from playstat.plans.context import Context, testdata_context  # noqa: F401
from playstat.session import cut_lineage, written
from playstat.sources.adapters import events_bundle, lineitem_bundle

# fixed values: parameters of the registered sampling queries
SAMPLE_SEED = 42
SAMPLE_FRACTION = 0.5
SAMPLE_TARGET = 500
QUARTILE_PROBS = (0.25, 0.5, 0.75)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round DOUBLE columns (the oracle rounds the same way)."""
    return df.select([F.round(F.col(f.name), digits).alias(f.name)
                      if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                      for f in df.schema.fields])


# ---------------------------------------------------------------- shared views

def L(ctx):
    return ctx.volume


def E(ctx):
    return ctx.behaviour


LISTEN_COLUMNS = ("uid", "is_organic", "played_ratio_pct", "track_length_seconds")


def l_listens(ctx):
    """The volume bundle with the columns that the listen-only analyses read. Analyses that
    share their frames write listens that come from joins once, instead of joining for each
    of their passes."""
    b = L(ctx)
    lst = b.listens.select(*LISTEN_COLUMNS)
    return b.with_(listens=ctx.shared("listens", lambda: lst, lambda df: written(df, "listens"))
                   if b.listens_joined else lst)


def l_enriched(ctx, clock=False):
    b = L(ctx)
    return b, enrich_listens(b, clock)


def e_enriched(ctx, clock=False):
    b = E(ctx)
    return b, enrich_listens(b, clock)


def e_pairs(ctx):
    b, lst = e_enriched(ctx)
    return b, ctx.shared("pairs", lambda: I.pair_agg(lst, b.order("listens")))


# ---------------------------------------------------------------- A: sources

def table_profile(ctx):
    b = E(ctx)
    parts = [getattr(b, t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("row_count"),
                               F.count_distinct("uid").alias("distinct_uid"))
             for t in ("listens", "likes", "dislikes", "undislikes", "multi_event")]
    return reduce(DataFrame.unionByName, parts)


def needed_embeddings(ctx):
    b = E(ctx)
    items = b.listens.select("item_id").distinct()
    e = b.embeddings.join(items, "item_id", "left_semi")
    return rounded(e.select("item_id", F.size("normalized_embed").alias("dims"),
                            F.sqrt(F.aggregate("normalized_embed", F.lit(0.0),
                                                lambda a, x: a + x.cast("double") * x)).alias("norm")))


# ---------------------------------------------------------------- B/D: enrich + groups

def reconstruct_time_q(ctx):
    b = L(ctx)
    r = reconstruct_time(b.table("listens"), b.order("listens"), b.clock, chunk_col=b.chunk_for("listens"))
    return r.select("uid", "item_id", "l_orderkey", "l_linenumber", "l_suppkey", "abs_time_sec")


def enrich_listens_q(ctx):
    _, lst = l_enriched(ctx, clock=True)
    return lst.select("uid", "item_id", "l_orderkey", "l_linenumber", "l_suppkey", "is_organic",
                      "abs_time_sec", "listen_plus", "length_bucket")


def listen_plus_by_group(ctx):
    _, lst = l_enriched(ctx)
    base = lst.filter(F.col("played_ratio_pct").isNotNull())
    g = base.groupBy("is_organic").agg(
        F.count(F.lit(1)).alias("total"), F.sum("listen_plus").alias("lp_count"),
        F.avg("listen_plus").alias("lp_rate"), F.avg("played_ratio_pct").alias("mean_ratio"))
    med = R.exact_median(base, "played_ratio_pct", ["is_organic"], "median_ratio")
    return rounded(g.join(med, "is_organic").orderBy("is_organic"))


def listen_plus_by_bucket(ctx):
    _, lst = l_enriched(ctx)
    return rounded(lst.filter(F.col("played_ratio_pct").isNotNull())
                   .groupBy("length_bucket", "is_organic")
                   .agg(F.avg("listen_plus").alias("lp_rate"), F.count(F.lit(1)).alias("n"))).orderBy("length_bucket", "is_organic")


def listen_plus_by_len6(ctx):
    _, lst = l_enriched(ctx)
    return rounded(lst.filter(F.col("played_ratio_pct").isNotNull()
                              & F.col("track_length_seconds").isNotNull())
                   .withColumn("len_bucket", length_bucket6())
                   .groupBy("len_bucket", "is_organic")
                   .agg(F.avg("listen_plus").alias("lp_rate"), F.count(F.lit(1)).alias("n"))).orderBy("len_bucket", "is_organic")


def _l_rewind(ctx):
    return l_listens(ctx).listens.withColumn("rewind", rewind_flag())


def rewind_rate_by_group(ctx):
    lst = _l_rewind(ctx)
    return rounded(lst.groupBy("is_organic").agg(
        F.count(F.lit(1)).alias("total"), F.sum("rewind").alias("rewind_count"),
        F.avg("rewind").alias("rewind_rate"))).orderBy("is_organic")


def top_fraction_users(ctx):
    lst = _l_rewind(ctx)
    per_user = lst.filter(F.col("rewind") == 1).groupBy("uid").agg(F.count(F.lit(1)).alias("cnt"))
    return I.top_fraction_users(per_user, "cnt")


def rewind_rate_excl_top(ctx):
    """The top users and the rate of the others both come from one count per user and group:
    no user is hot in it, and the listens are read and shuffled once."""
    counts = cut_lineage(_l_rewind(ctx).groupBy("uid", "is_organic").agg(
        F.count(F.lit(1)).alias("listens"), F.sum("rewind").alias("rewinds")))
    per_user = counts.filter(F.col("rewinds") > 0).groupBy("uid").agg(F.sum("rewinds").alias("cnt"))
    rest = I.exclude_users(counts, I.top_fraction_users(per_user, "cnt"))
    return rounded(rest.groupBy("is_organic").agg(
        F.sum("listens").alias("total"),
        (F.sum("rewinds") / F.sum("listens")).alias("rewind_rate"))).orderBy("is_organic")


# ---------------------------------------------------------------- C/D: pairs and flags

def pair_agg(ctx):
    _, p = e_pairs(ctx)
    return rounded(p)


def flag_join(ctx):
    b, p = e_pairs(ctx)
    return I.flag_join(p, b.dislikes, "disliked").select("uid", "item_id", "is_organic", "disliked")


def _like_dislike(ctx):
    b, p = e_pairs(ctx)
    return I.flag_join(I.flag_join(p, b.likes, "liked"), b.dislikes, "disliked")


def like_dislike_rates(ctx):
    h = _like_dislike(ctx)
    return rounded(h.groupBy("is_organic").agg(F.count(F.lit(1)).alias("pairs"),
                                               F.avg("liked").alias("like_rate"),
                                               F.avg("disliked").alias("dislike_rate"))).orderBy("is_organic")


def asymmetry_ratio(ctx):
    h = _like_dislike(ctx)
    g = h.groupBy("is_organic").agg(F.avg("liked").alias("like_rate"),
                                    F.avg("disliked").alias("dislike_rate"))
    return rounded(g.withColumn("asymmetry_ratio", F.try_divide("dislike_rate", "like_rate"))).orderBy("is_organic")


def contingency_like(ctx):
    return TS.contingency(_like_dislike(ctx), "liked")


def contingency_dislike(ctx):
    return TS.contingency(_like_dislike(ctx), "disliked")


def contingency_rewind(ctx):
    return TS.contingency(_l_rewind(ctx), "rewind")


def _cancel(ctx):
    b = E(ctx)
    return I.cancel_match(*clocked_together(b, "dislikes", "undislikes"))


def contingency_cancel(ctx):
    return TS.contingency(_cancel(ctx), "cancelled")


def chi2_like(ctx):
    return rounded(TS.chi2_2x2(contingency_like(ctx)))


def chi2_dislike(ctx):
    return rounded(TS.chi2_2x2(contingency_dislike(ctx)))


def chi2_rewind(ctx):
    return rounded(TS.chi2_2x2(contingency_rewind(ctx)))


def chi2_cancel(ctx):
    return rounded(TS.chi2_2x2(contingency_cancel(ctx)))


def _rates_wide(h):
    return h.agg(F.avg(F.when(F.col("is_organic") == 0, F.col("liked"))).alias("like_rec"),
                 F.avg(F.when(F.col("is_organic") == 1, F.col("liked"))).alias("like_org"),
                 F.avg(F.when(F.col("is_organic") == 0, F.col("disliked"))).alias("dislike_rec"),
                 F.avg(F.when(F.col("is_organic") == 1, F.col("disliked"))).alias("dislike_org"))


def asymmetry_test_df(ctx):
    h = _like_dislike(ctx)
    cl = TS.chi2_2x2(TS.contingency(h, "liked")).select(F.col("p_value").alias("p_like"))
    cd = TS.chi2_2x2(TS.contingency(h, "disliked")).select(F.col("p_value").alias("p_dislike"))
    r = cl.crossJoin(cd).crossJoin(_rates_wide(h))                       # one-row frames
    return (r.withColumn("p_like_adj", TS.bonferroni("p_like", 2))
             .withColumn("p_dislike_adj", TS.bonferroni("p_dislike", 2))
             .withColumn("confirmed", F.coalesce(
                 (F.col("p_like_adj") < 0.05) & (F.col("p_dislike_adj") < 0.05)
                 & (F.col("like_rec") < F.col("like_org"))
                 & (F.col("dislike_rec") > F.col("dislike_org")), F.lit(False))))


def asymmetry_test(ctx):
    return rounded(asymmetry_test_df(ctx))


def cancel_match_q(ctx):
    return _cancel(ctx)


def time_to_cancel(ctx):
    c = _cancel(ctx).filter(F.col("cancelled") == 1)
    g = c.groupBy("is_organic").agg(F.count(F.lit(1)).alias("n_cancelled"),
                                    F.avg("time_to_cancel").alias("mean_time"))
    med = R.exact_median(c, "time_to_cancel", ["is_organic"], "median_time")
    return rounded(g.join(med, "is_organic").orderBy("is_organic"))


def cancellation_rate_by_group(ctx):
    return rounded(_cancel(ctx).groupBy("is_organic").agg(
        F.count(F.lit(1)).alias("dislikes"), F.sum("cancelled").alias("cancelled"),
        F.avg("cancelled").alias("cancel_rate")).orderBy("is_organic"))


def _cumsum_ctx(ctx):
    """The events view with per-user deltas (1 to 5 units) for dislikes and undislikes."""
    b = E(ctx)
    delta = F.col("event_id") % 5 + 1
    b = b.with_(clock="cumsum", dislikes=b.dislikes.withColumn("timestamp", delta),
                undislikes=b.undislikes.withColumn("timestamp", delta))
    return Context.from_bundle(ctx.spark, b, ctx.params)


def cancel_match_cumsum(ctx):
    return _cancel(_cumsum_ctx(ctx))


def contingency_cancel_cumsum(ctx):
    return contingency_cancel(_cumsum_ctx(ctx))


# ---------------------------------------------------------------- E: sessions

def _sessions(ctx, with_index=False):
    b = E(ctx)
    me = clocked(b, "multi_event")
    return b, S.sessionize(me, b.order("multi_event"), gap_sec=ctx.params.session_gap, chunk_col=b.chunk_for("multi_event"),
                           with_index=with_index)


def sessionize_q(ctx):
    _, s = _sessions(ctx)
    return s.select("uid", "event_id", "abs_time_sec", "session_id")


def _positions(ctx):
    b, s = _sessions(ctx, with_index=True)
    return S.session_positions(s, b.order("multi_event"), min_len=ctx.params.min_session_len,
                               chunk_col=b.chunk_for("multi_event"),
                               hot_session_rows=ctx.params.hot_session_rows)


def session_position(ctx):
    return _positions(ctx).select("uid", "event_id", "session_id", "pos_in_session",
                                       "session_len", "pos_third", "is_dislike")


def session_rec_share(ctx):
    p = _positions(ctx)
    return rounded(p.select("uid", "session_id", "session_len", "rec_share", "rec_dominated").distinct())


def dislike_by_third(ctx):
    p = _positions(ctx)
    return rounded(p.groupBy("rec_dominated", "pos_third").agg(
        F.avg("is_dislike").alias("p_dislike"), F.count(F.lit(1)).alias("n"),
        F.stddev_samp("is_dislike").alias("sd_dislike")).orderBy("rec_dominated", "pos_third"))


def session_fatigue_df(ctx):
    p = _positions(ctx).filter(F.col("rec_dominated") & F.col("pos_third").isin("beginning", "end"))
    end, beg = F.col("pos_third") == "end", F.col("pos_third") == "beginning"
    w = p.agg(F.avg(F.when(end, F.col("is_dislike"))).alias("p_end"),
              F.count_if(end).alias("n_end"),
              F.avg(F.when(beg, F.col("is_dislike"))).alias("p_begin"),
              F.count_if(beg).alias("n_begin"))
    z, pv = TS.two_proportion_z(F.col("p_end"), F.col("n_end"), F.col("p_begin"), F.col("n_begin"))
    return w.withColumn("z", z).withColumn("p_value", pv)


def session_fatigue(ctx):
    return rounded(session_fatigue_df(ctx))


# ---------------------------------------------------------------- activity quartiles

def discrete_quantiles(values: DataFrame, col: str, probs=QUARTILE_PROBS, names=("q1", "q2", "q3")):
    """Exact lower quantiles (smallest value whose cumulative count reaches
    ceil(p n)), from the value histogram; one row."""
    h = cut_lineage(values.groupBy(col).agg(F.count(F.lit(1)).alias("__c")))
    h = global_prefix(h, col, "__c", "__before").withColumn("__cum", F.col("__before") + F.col("__c"))
    n = F.sum("__c")
    aggs = []
    for p, nm in zip(probs, names):
        aggs.append(F.min(F.when(F.col("__cum") >= F.col("__k_" + nm), F.col(col))).alias(nm))
    tot = h.agg(n.alias("__n"))
    h = h.crossJoin(F.broadcast(tot))                                    # one row
    for p, nm in zip(probs, names):
        h = h.withColumn("__k_" + nm, F.ceil(F.col("__n") * p))
    return h.agg(*aggs)


def _activity(ctx):
    b, lst = e_enriched(ctx)
    per_user = cut_lineage(lst.groupBy("uid").agg(F.count(F.lit(1)).alias("total_listens")))
    cuts = discrete_quantiles(per_user, "total_listens")
    q = (per_user.crossJoin(F.broadcast(cuts))                            # one row
         .withColumn("activity_quartile", quartile_from_cuts("total_listens", "q1", "q2", "q3")))
    return b, lst, cuts, q.select("uid", "total_listens", "activity_quartile")


def activity_cutpoints(ctx):
    return _activity(ctx)[2]


def activity_cutpoints_approx(ctx):
    lst = E(ctx).listens
    return quantile_sketch(lst.groupBy("uid").agg(F.count(F.lit(1)).alias("total_listens")), "total_listens",
                           QUARTILE_PROBS, ("q1", "q2", "q3"))


def activity_quartile(ctx):
    return _activity(ctx)[3]


def _rec_quartile(ctx):
    b, lst, _, q = _activity(ctx)
    return b, join_maybe_salted(lst.filter(F.col("is_organic") == 0), q.select("uid", "activity_quartile"),
                                "uid", "inner", b.key_is_hot("listens", "uid"), b.hot_key_rows)


def listen_plus_by_quartile(ctx):
    _, r = _rec_quartile(ctx)
    return rounded(r.groupBy("activity_quartile").agg(F.avg("listen_plus").alias("lp_rate"),
                                                      F.count(F.lit(1)).alias("n"))).orderBy("activity_quartile")


def like_rate_by_quartile(ctx):
    b, r = _rec_quartile(ctx)
    pairs = r.groupBy("uid", "item_id", "activity_quartile").agg(F.count(F.lit(1)).alias("n"))
    h = I.flag_join(pairs, b.likes, "liked")
    return rounded(h.groupBy("activity_quartile").agg(F.avg("liked").alias("like_rate"),
                                                      F.count(F.lit(1)).alias("pairs"))).orderBy("activity_quartile")


def trend_spearman(ctx):
    _, r = _rec_quartile(ctx)
    return rounded(R.spearman(r, "activity_quartile", "listen_plus"))


# ---------------------------------------------------------------- G: statistics

def zscore_stats_q(ctx):
    b = L(ctx)
    lst = b.listens.filter(F.col("played_ratio_pct").isNotNull() & F.col("track_length_seconds").isNotNull())
    return rounded(zscore_stats(lst, ["is_organic", "track_length_seconds"]))


def zscore_columns(ctx):
    b = L(ctx)
    lst = b.listens.filter(F.col("played_ratio_pct").isNotNull() & F.col("track_length_seconds").isNotNull())
    z = add_zscores(lst, ["is_organic", "track_length_seconds"])
    return rounded(z.groupBy("s_is_organic", "s_track_length_seconds").agg(F.count(F.lit(1)).alias("n")))


def avg_ranks_q(ctx):
    b = L(ctx)
    h = R.value_histogram(b.listens, "played_ratio_pct")
    return rounded(R.avg_ranks(h, "played_ratio_pct"))


def mann_whitney_less(ctx):
    b = L(ctx)
    return rounded(R.mann_whitney(b.listens, "played_ratio_pct", "is_organic", 0, 1))


def mann_whitney_two_sided(ctx):
    c = _cancel(ctx).filter(F.col("cancelled") == 1)
    m = R.mann_whitney(c, "time_to_cancel", "is_organic", 0, 1)
    return rounded(m.select("n1", "n2", "u1", "z", "p_two_sided"))


def _h4(ctx):
    b, p = e_pairs(ctx)
    return I.flag_join(p, b.likes, "liked").filter(F.col("played_ratio").isNotNull())


def spearman_by_group(ctx):
    return rounded(R.spearman(_h4(ctx), "played_ratio", "liked", part=["is_organic"]))


def fisher_z_df(ctx):
    s = R.spearman(_h4(ctx), "played_ratio", "liked", part=["is_organic"])
    w = s.agg(F.max(F.when(F.col("is_organic") == 0, F.col("rho"))).alias("rho_rec"),
              F.max(F.when(F.col("is_organic") == 1, F.col("rho"))).alias("rho_org"),
              F.max(F.when(F.col("is_organic") == 0, F.col("n"))).alias("n_rec"),
              F.max(F.when(F.col("is_organic") == 1, F.col("n"))).alias("n_org"))
    z, p = TS.fisher_z("rho_rec", "rho_org", "n_rec", "n_org")
    return w.withColumn("z", z).withColumn("p_value", p)


def fisher_z_q(ctx):
    return rounded(fisher_z_df(ctx))


# ---------------------------------------------------------------- F: sampling

def hash_sample_q(ctx):
    b = E(ctx)
    users = b.listens.select("uid").distinct()
    return hash_sample(users, "uid", SAMPLE_FRACTION, SAMPLE_SEED)


def sample_to_target_q(ctx):
    b = E(ctx)
    s = sample_to_target(b.listens, "event_id", SAMPLE_TARGET, SAMPLE_SEED)
    return s.select("event_id", "uid", "item_id")


def sample_to_target_by_group_q(ctx):
    s = sample_to_target_by_group(E(ctx).listens, "is_organic", "event_id", SAMPLE_TARGET, SAMPLE_SEED)
    return s.select("event_id", "uid", "item_id", "is_organic")


def _eligible(lst, p):
    g = lst.groupBy("uid").agg(F.count_if(F.col("is_organic") == 1).alias("organic_cnt"),
                               F.count_if(F.col("is_organic") == 0).alias("rec_cnt"))
    return g.filter((F.col("organic_cnt") >= p.eligible_min_organic) & (F.col("rec_cnt") >= p.eligible_min_rec))


def eligible_users(ctx):
    b = E(ctx)
    return _eligible(b.listens, ctx.params)


def sampled_user_history(ctx):
    b, lst = e_enriched(ctx, clock=True)
    users = hash_sample(_eligible(lst, ctx.params).select("uid"), "uid", SAMPLE_FRACTION, SAMPLE_SEED)
    return lst.join(users, "uid", "left_semi").select("uid", "event_id", "item_id", "abs_time_sec",
                                                      "is_organic", "listen_plus")


# ---------------------------------------------------------------- vectors and windows

def _history(ctx):
    b, _ = e_enriched(ctx)
    lst = with_flags(b.table("listens"))
    lst = join_maybe_salted(lst, _eligible(lst, ctx.params).select("uid"), "uid", "left_semi",
                            b.key_is_hot("listens", "uid"), b.hot_key_rows)
    return Q.history_similarity(lst, b.embeddings, b.order("listens"), k=ctx.params.history_len,
                                min_history=ctx.params.min_history, chunk_col=b.chunk_for("listens"),
                                hot_items=b.key_is_hot("listens", "item_id"), hot_rows=b.hot_key_rows)


def history_similarity(ctx):
    return rounded(_history(ctx).select("uid", "event_id", "n_org", "listen_plus", "cosine_sim"))


# ranks are taken on values rounded to 1e-9: sums of floats in another order
# must not break (or make) ties
RANK_DIGITS = 9


def history_spearman(ctx):
    h = _history(ctx).withColumn("cosine_sim", F.round("cosine_sim", RANK_DIGITS))
    return rounded(R.spearman(h, "cosine_sim", "listen_plus"))


def _win_rows(ctx):
    b = E(ctx)
    lst = with_flags(b.table("listens"))
    return b, Q.sliding_count_windows(lst, b.order("listens"), ctx.params.window_size, ctx.params.window_step,
                                       chunk_col=b.chunk_for("listens"))


def sliding_count_windows_q(ctx):
    _, w = _win_rows(ctx)
    return (w.groupBy("uid", "win").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))
             .filter(F.col("n") == ctx.params.window_size))


def window_entropy(ctx):
    _, w = _win_rows(ctx)
    return rounded(Q.window_stats(w, ctx.params.window_size))


def window_diversity_df(ctx):
    b = E(ctx)
    rows = row_index(b.table("listens"), "uid", b.order("listens"), "idx", b.chunk_for("listens"))
    return Q.window_diversity(rows, b.embeddings, ctx.params.window_size, ctx.params.window_step,
                              hot_items=b.key_is_hot("listens", "item_id"), hot_rows=b.hot_key_rows)


def window_cosine_diversity(ctx):
    return rounded(window_diversity_df(ctx))


def window_table(ctx) -> DataFrame:
    """Per full window: rec_share, entropy (rank-rounded) and rec_dom; one row per
    window (about rows/step), materialised because the tests read it repeatedly."""
    _, w = _win_rows(ctx)
    return cut_lineage(Q.window_stats(w, ctx.params.window_size)
                       .withColumn("rec_dom", (F.col("rec_share") > 0.5).cast("int"))
                       .withColumn("entropy", F.round("entropy", RANK_DIGITS)))


def diversity_test_df(ctx, st: DataFrame | None = None):
    st = st if st is not None else window_table(ctx)
    m = R.mann_whitney(st, "entropy", "rec_dom", 1, 0)
    means = st.agg(F.avg(F.when(F.col("rec_dom") == 1, F.col("entropy"))).alias("mean_rec"),
                   F.avg(F.when(F.col("rec_dom") == 0, F.col("entropy"))).alias("mean_org"))
    return m.select("n1", "n2", "u1", "z", "p_two_sided").crossJoin(means)   # one-row frames


def diversity_test(ctx):
    return rounded(diversity_test_df(ctx))


# ---------------------------------------------------------------- registry

CTX_QUERIES = {
    "table_profile": table_profile,
    "needed_embeddings": needed_embeddings,
    "reconstruct_time": reconstruct_time_q,
    "enrich_listens": enrich_listens_q,
    "listen_plus_by_group": listen_plus_by_group,
    "listen_plus_by_bucket": listen_plus_by_bucket,
    "listen_plus_by_len6": listen_plus_by_len6,
    "rewind_rate_by_group": rewind_rate_by_group,
    "top_fraction_users": top_fraction_users,
    "rewind_rate_excl_top": rewind_rate_excl_top,
    "pair_agg": pair_agg,
    "flag_join": flag_join,
    "like_dislike_rates": like_dislike_rates,
    "asymmetry_ratio": asymmetry_ratio,
    "contingency_like": contingency_like,
    "contingency_dislike": contingency_dislike,
    "contingency_rewind": contingency_rewind,
    "contingency_cancel": contingency_cancel,
    "chi2_like": chi2_like,
    "chi2_dislike": chi2_dislike,
    "chi2_rewind": chi2_rewind,
    "chi2_cancel": chi2_cancel,
    "asymmetry_test": asymmetry_test,
    "cancel_match": cancel_match_q,
    "cancel_match_cumsum": cancel_match_cumsum,
    "contingency_cancel_cumsum": contingency_cancel_cumsum,
    "cancellation_rate_by_group": cancellation_rate_by_group,
    "time_to_cancel": time_to_cancel,
    "sessionize": sessionize_q,
    "session_position": session_position,
    "session_rec_share": session_rec_share,
    "dislike_by_third": dislike_by_third,
    "session_fatigue": session_fatigue,
    "activity_cutpoints": activity_cutpoints,
    "activity_quartile": activity_quartile,
    "listen_plus_by_quartile": listen_plus_by_quartile,
    "like_rate_by_quartile": like_rate_by_quartile,
    "trend_spearman": trend_spearman,
    "zscore_stats": zscore_stats_q,
    "zscore_columns": zscore_columns,
    "avg_ranks": avg_ranks_q,
    "mann_whitney_less": mann_whitney_less,
    "mann_whitney_two_sided": mann_whitney_two_sided,
    "spearman_by_group": spearman_by_group,
    "fisher_z": fisher_z_q,
    "hash_sample": hash_sample_q,
    "sample_to_target": sample_to_target_q,
    "sample_to_target_by_group": sample_to_target_by_group_q,
    "activity_cutpoints_approx": activity_cutpoints_approx,
    "eligible_users": eligible_users,
    "sampled_user_history": sampled_user_history,
    "history_similarity": history_similarity,
    "history_spearman": history_spearman,
    "sliding_count_windows": sliding_count_windows_q,
    "window_entropy": window_entropy,
    "window_cosine_diversity": window_cosine_diversity,
    "diversity_test": diversity_test,
}


def on_testdata(f):
    """(spark, sf_dir) -> DataFrame over the adapter views of the given tables."""
    def run(spark, sf_dir):
        return f(testdata_context(spark, sf_dir))
    run.__name__ = f.__name__
    run.__doc__ = f.__doc__
    return run


REGISTRY = {k: on_testdata(f) for k, f in CTX_QUERIES.items()}
