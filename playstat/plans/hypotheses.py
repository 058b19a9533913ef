"""The eleven analyses (H1..H11) and their summary.

Each returns the typed long-form result frame (id, description, confirmed,
metric, value): one row per metric, computed from one-row Spark aggregates, so
only the final metric rows ever reach the driver. Verdict rules follow the
original analyses, with the documented fixes (rank-biserial orientation,
odds-ratio orientation, full data instead of driver samples).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playstat.operators import ranks as R
from playstat.operators import tests as TS
from playstat.operators.bootstrap import bootstrap_rate_diff
from playstat.operators.models import logit_interaction
from playstat.plans import queries as Q
from playstat.plans.context import TESTDATA_PARAMS, Context
from playstat.sources.schemas import RESULT_SCHEMA
from playstat.session import cut_lineage, ensure_checkpoint_dir
from playstat.sources.adapters import events_bundle

ALPHA = 0.05                # fixed value: significance level of every verdict

# fixed values: the questions, in order
DESCRIPTIONS = {
    "H1": "Listen-through is lower for recommended tracks",
    "H2": "P(dislike | listen) is higher for recommended tracks",
    "H3": "Dislikes of recommended tracks are cancelled more often",
    "H4": "The ratio-like correlation is weaker for recommended tracks",
    "H5": "Listen-through falls faster with track length for recommended tracks",
    "H6": "Rewinds (ratio > 100%) are more common for organic tracks",
    "H7": "P(dislike) rises towards the end of recommendation-dominated sessions",
    "H8": "Recommendations work better for more active users",
    "H9": "Recommendations similar to the organic history are listened through more",
    "H10": "Recommended tracks get fewer likes and more dislikes",
    "H11": "Recommendation-dominated windows are more diverse",
}


def result(wide: DataFrame, hid: str, confirmed: Column, metrics: list[str]) -> DataFrame:
    """Long-form result rows from a one-row frame of metric columns."""
    parts = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    return (wide.withColumn("__c", F.coalesce(confirmed, F.lit(False)))
            .select(F.lit(hid).alias("id"), F.lit(DESCRIPTIONS[hid]).alias("description"),
                    F.col("__c").alias("confirmed"),
                    F.expr(f"stack({len(metrics)}, {parts}) AS (metric, value)")))


def skipped(ctx, hid: str, reason: str) -> DataFrame:
    return ctx.spark.createDataFrame([(hid, DESCRIPTIONS[hid], False, reason, None)], RESULT_SCHEMA)


def _boot_counts(df: DataFrame, outcome: str) -> DataFrame:
    return df.agg(F.count_if(F.col("is_organic") == 0).alias("n1"),
                  F.sum(F.when(F.col("is_organic") == 0, F.col(outcome)).otherwise(0)).alias("k1"),
                  F.count_if(F.col("is_organic") == 1).alias("n2"),
                  F.sum(F.when(F.col("is_organic") == 1, F.col(outcome)).otherwise(0)).alias("k2"))


def h1_listen_plus(ctx):
    b = Q.l_listens(ctx)
    m = R.mann_whitney(b.listens, "played_ratio_pct", "is_organic", 0, 1)
    return result(m, "H1", (F.col("p_less") < ALPHA) & (F.col("r_rank_biserial") < 0),
                  ["n1", "n2", "u1", "z", "p_less", "r_rank_biserial"])


def h2_dislike_rate(ctx):
    b, p = Q.e_pairs(ctx)
    from playstat.operators.interactions import flag_join
    h = flag_join(p, b.dislikes, "disliked")
    chi = TS.chi2_2x2(TS.contingency(h, "disliked"))
    boot = bootstrap_rate_diff(_boot_counts(h, "disliked"), ctx.params.bootstrap_b, ctx.params.seed)
    w = chi.crossJoin(boot)                                                   # one-row frames
    return result(w, "H2", (F.col("p_value") < ALPHA) & (F.col("odds_ratio_rec_over_org") > 1)
                  & (F.col("ci_low") > 0),
                  ["chi2", "p_value", "odds_ratio_rec_over_org", "diff", "ci_low", "ci_high"])


def h3_cancellation(ctx):
    c = cut_lineage(Q._cancel(ctx))            # one row per dislike, read four times
    chi = TS.chi2_2x2(TS.contingency(c, "cancelled"))
    boot = bootstrap_rate_diff(_boot_counts(c, "cancelled"), ctx.params.bootstrap_b, ctx.params.seed)
    canc = c.filter(F.col("cancelled") == 1)
    mw = R.mann_whitney(canc, "time_to_cancel", "is_organic", 0, 1, tie_correction=False).select(
        F.col("p_two_sided").alias("time_p_value"))
    med = R.exact_median(canc, "time_to_cancel", ["is_organic"]).agg(
        F.max(F.when(F.col("is_organic") == 0, F.col("median"))).alias("median_time_rec"),
        F.max(F.when(F.col("is_organic") == 1, F.col("median"))).alias("median_time_org"))
    w = chi.crossJoin(boot).crossJoin(mw).crossJoin(med)                     # one-row frames
    return result(w, "H3", (F.col("p_value") < ALPHA) & (F.col("odds_ratio_rec_over_org") > 1),
                  ["chi2", "p_value", "odds_ratio_rec_over_org", "diff", "ci_low", "ci_high",
                   "time_p_value", "median_time_rec", "median_time_org"])


def h4_correlation(ctx):
    w = Q.fisher_z_df(ctx)
    return result(w, "H4", (F.col("p_value") < ALPHA) & (F.col("rho_rec") < F.col("rho_org")),
                  ["rho_rec", "rho_org", "n_rec", "n_org", "z", "p_value"])


def h5_length_interaction(ctx):
    b = Q.l_listens(ctx)
    from playstat.operators.enrich import enrich_listens
    lst = enrich_listens(b, clock=False).filter(F.col("played_ratio_pct").isNotNull()
                                   & F.col("track_length_seconds").isNotNull())
    fit = logit_interaction(lst)                 # four rows
    long = fit.select("name", F.expr("stack(3, 'coef', coef, 'wald_z', wald_z, 'p', p) AS (kind, value)"))
    conf = fit.agg(F.coalesce(F.max(F.when(F.col("name") == "interaction", F.col("coef") > 0)),
                              F.lit(False)).alias("confirmed"))
    return long.crossJoin(F.broadcast(conf)).select(
        F.lit("H5").alias("id"), F.lit(DESCRIPTIONS["H5"]).alias("description"), "confirmed",
        F.concat_ws("_", "kind", "name").alias("metric"), "value")


def h6_rewind(ctx):
    ctx = ctx.sharing()                        # the listens are read twice
    # organic/recommended odds ratio; no recommended rewinds at all -> +inf
    org_odds = F.col("org_pos").cast("double") * F.col("rec_neg")
    rec_odds = F.col("rec_pos").cast("double") * F.col("org_neg")
    chi = TS.chi2_2x2(Q.contingency_rewind(ctx)).withColumn(
        "or_org_over_rec", F.when(rec_odds > 0, org_odds / rec_odds)
                            .when(org_odds > 0, F.lit(float("inf"))))
    ex = Q.rewind_rate_excl_top(ctx).agg(
        F.max(F.when(F.col("is_organic") == 0, F.col("rewind_rate"))).alias("rate_rec_excl_top"),
        F.max(F.when(F.col("is_organic") == 1, F.col("rewind_rate"))).alias("rate_org_excl_top"))
    w = chi.crossJoin(ex)                                                     # one-row frames
    return result(w, "H6", (F.col("p_value") < ALPHA) & (F.col("or_org_over_rec") > 1),
                  ["chi2", "p_value", "or_org_over_rec", "rate_rec_excl_top", "rate_org_excl_top"])


def h7_session_fatigue(ctx):
    w = Q.session_fatigue_df(ctx)
    return result(w, "H7", (F.col("p_value") < ALPHA) & (F.col("p_end") > F.col("p_begin")),
                  ["p_end", "n_end", "p_begin", "n_begin", "z", "p_value"])


def _spearman_result(s: DataFrame, hid: str) -> DataFrame:
    s = R.with_t_pvalue(s)
    return result(s, hid, (F.col("p_value") < ALPHA) & (F.col("rho") > 0), ["n", "rho", "p_value"])


def h8_experience(ctx):
    _, r = Q._rec_quartile(ctx)
    return _spearman_result(R.spearman(r, "activity_quartile", "listen_plus"), "H8")


def h9_similarity(ctx):
    b = Q.E(ctx)
    if b.embeddings is None:                      # optional source absent
        return skipped(ctx, "H9", "SKIPPED: no embeddings")
    h = Q._history(ctx).withColumn("cosine_sim", F.round("cosine_sim", Q.RANK_DIGITS))
    return _spearman_result(R.spearman(h, "cosine_sim", "listen_plus"), "H9")


def h10_asymmetry(ctx):
    w = Q.asymmetry_test_df(ctx)
    return result(w, "H10", F.col("confirmed"),
                  ["p_like_adj", "p_dislike_adj", "like_rec", "like_org", "dislike_rec", "dislike_org"])


def h11_diversity(ctx):
    st = Q.window_table(ctx)
    t = Q.diversity_test_df(ctx, st)
    if Q.E(ctx).embeddings is None:               # optional source absent: entropy alone decides
        w = t.withColumn("diversity_p_value", F.lit(None).cast("double"))
        return _h11_result(w)
    div = (Q.window_diversity_df(ctx)
           .join(st.select("uid", "win", "rec_dom"), ["uid", "win"])
           .withColumn("diversity", F.round("diversity", Q.RANK_DIGITS)))
    dm = R.mann_whitney(div, "diversity", "rec_dom", 1, 0).select(
        F.col("p_two_sided").alias("diversity_p_value"))
    return _h11_result(t.crossJoin(dm))                                       # one-row frames


def _h11_result(w: DataFrame) -> DataFrame:
    return result(w, "H11", (F.col("p_two_sided") < ALPHA) & (F.col("mean_rec") > F.col("mean_org")),
                  ["n1", "n2", "mean_rec", "mean_org", "p_two_sided", "diversity_p_value"])


ALL = [h1_listen_plus, h2_dislike_rate, h3_cancellation, h4_correlation, h5_length_interaction,
       h6_rewind, h7_session_fatigue, h8_experience, h9_similarity, h10_asymmetry, h11_diversity]


CONCURRENT_ANALYSES = 4     # analyses submitted at once (Spark runs their jobs side by side)


def run_all(ctx, workers: int = CONCURRENT_ANALYSES) -> DataFrame:
    """All analyses; each small result is checkpointed (reliable, in the shared
    checkpoint dir) before the union, so the summary does not re-plan eleven
    pipelines at once. The analyses are independent, so a few are submitted
    concurrently from driver threads; the union keeps the H1..H11 order."""
    from concurrent.futures import ThreadPoolExecutor
    ctx = ctx.sharing()
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        parts = list(pool.map(lambda h: cut_lineage(h(ctx)), ALL))
    ctx.release()
    return reduce(DataFrame.unionByName, parts)


def hypothesis_summary(ctx) -> DataFrame:
    res = run_all(ctx)
    per = res.groupBy("id", "description").agg(F.max(F.col("confirmed").cast("int")).alias("confirmed"))
    tot = per.agg(F.lit("ALL").alias("id"), F.lit("confirmed / total").alias("description"),
                  F.sum("confirmed").alias("confirmed"), F.count(F.lit(1)).alias("total"))
    return per.withColumn("total", F.lit(1).cast("bigint")).withColumn(
        "confirmed", F.col("confirmed").cast("bigint")).unionByName(tot)


def logit_interaction_q(ctx) -> DataFrame:
    return h5_length_interaction(ctx).select("metric", "value")


def bootstrap_rate_diff_q(ctx) -> DataFrame:
    b, p = Q.e_pairs(ctx)
    from playstat.operators.interactions import flag_join
    return bootstrap_rate_diff(_boot_counts(flag_join(p, b.dislikes, "disliked"), "disliked"),
                               ctx.params.bootstrap_b, ctx.params.seed)


def folder_results(spark, sf_dir: str) -> DataFrame:
    """All analyses as ``plans/run.py`` runs them on a folder: the events views are written
    as domain tables (without embeddings), loaded, analysed, and the results written to and
    read back from the sink."""
    from playstat.plans.run import write_results
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/folder-{uuid.uuid4().hex}"
    b = events_bundle(spark, sf_dir, with_embeddings=False)
    for name in ("listens", "likes", "dislikes", "undislikes", "multi_event"):
        getattr(b, name).write.parquet(f"{base}/tables/{name}.parquet")
    ctx = Context.from_folder(spark, f"{base}/tables", TESTDATA_PARAMS, clock="absolute", order_cols=b.order_cols)
    write_results(run_all(ctx), f"{base}/results", ctx.params)
    return Q.rounded(spark.read.parquet(f"{base}/results"))


CTX_HYPOTHESES = {
    "h1_listen_plus": h1_listen_plus,
    "h2_dislike_rate": h2_dislike_rate,
    "h3_cancellation": h3_cancellation,
    "h4_correlation": h4_correlation,
    "h5_length_interaction": h5_length_interaction,
    "h6_rewind": h6_rewind,
    "h7_session_fatigue": h7_session_fatigue,
    "h8_experience": h8_experience,
    "h9_similarity": h9_similarity,
    "h10_asymmetry": h10_asymmetry,
    "h11_diversity": h11_diversity,
    "hypothesis_summary": hypothesis_summary,
    "logit_interaction": logit_interaction_q,
    "bootstrap_rate_diff": bootstrap_rate_diff_q,
}

HYPOTHESIS_QUERIES = {k: Q.on_testdata(lambda ctx, f=f: Q.rounded(f(ctx))) for k, f in CTX_HYPOTHESES.items()}
HYPOTHESIS_QUERIES["folder_results"] = folder_results
