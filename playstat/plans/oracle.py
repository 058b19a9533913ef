"""DuckDB spellings of the registered queries (the correctness oracle).

Written independently of the Spark plans, mostly in brute-force form (plain
windows, pair joins, row_number ranks). The adapter views are the CTEs below;
doubles are rounded to 6 places like ``queries.rounded``.
"""

from __future__ import annotations

L_ORDER = "l_shipdate, l_orderkey, l_linenumber, item_id, l_suppkey, l_extendedprice"
E_ORDER = "ts, event_id"

BASE = f"""
L AS (
  SELECT o.o_custkey AS uid, l.l_partkey AS item_id, CAST(l.l_linenumber AS BIGINT) AS "timestamp",
         CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END AS is_organic,
         CASE WHEN l.l_returnflag = 'A' AND l.l_linenumber = 7 THEN NULL ELSE l.l_quantity * 3 END AS played_ratio_pct,
         CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 6 THEN NULL ELSE CAST(p.p_size * 12 AS DOUBLE) END AS track_length_seconds,
         l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_extendedprice
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
LE AS (
  SELECT *, CAST(5 * SUM("timestamp") OVER (PARTITION BY uid ORDER BY {L_ORDER}
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS abs_time_sec,
         CASE WHEN played_ratio_pct >= 50 THEN 1 ELSE 0 END AS listen_plus,
         CASE WHEN track_length_seconds < 120 THEN '0-2min' WHEN track_length_seconds < 240 THEN '2-4min'
              WHEN track_length_seconds < 420 THEN '4-7min' ELSE '7+min' END AS length_bucket,
         CASE WHEN played_ratio_pct > 100 THEN 1 ELSE 0 END AS rewind
  FROM L),
EV AS (
  SELECT user_id AS uid, CAST(props->>'k' AS BIGINT) AS item_id, event_id, ts,
         epoch_us(ts) // 5000000 AS "timestamp", event_type AS raw_type, value
  FROM events),
ELIS AS (
  SELECT uid, item_id, "timestamp", ts, event_id, CAST(event_id % 2 AS INTEGER) AS is_organic,
         CASE WHEN event_id % 53 = 0 THEN NULL ELSE value END AS played_ratio_pct,
         CAST(30 + (item_id * 37) % 571 AS DOUBLE) AS track_length_seconds
  FROM EV WHERE raw_type IN ('view', 'click')),
ELE AS (
  SELECT *, "timestamp" * 5 AS abs_time_sec, CASE WHEN played_ratio_pct >= 50 THEN 1 ELSE 0 END AS listen_plus
  FROM ELIS),
ELIKE AS (SELECT uid, item_id, "timestamp" * 5 AS abs_time_sec FROM EV WHERE raw_type = 'purchase'),
EDIS AS (SELECT uid, item_id, "timestamp" * 5 AS abs_time_sec, CAST(event_id % 2 AS INTEGER) AS is_organic
         FROM EV WHERE raw_type = 'error'),
EUND AS (SELECT uid, item_id, "timestamp" * 5 AS abs_time_sec FROM EV WHERE raw_type = 'signup'),
EME AS (
  SELECT uid, item_id, ts, event_id, "timestamp" * 5 AS abs_time_sec,
         CASE WHEN raw_type IN ('view', 'click') THEN CAST(event_id % 2 AS INTEGER) END AS is_organic,
         CASE raw_type WHEN 'view' THEN 'listen' WHEN 'click' THEN 'listen' WHEN 'purchase' THEN 'like'
                       WHEN 'error' THEN 'dislike' WHEN 'signup' THEN 'undislike' END AS event_type
  FROM EV),
EMB AS (
  SELECT vec_id + 14 AS item_id, embedding AS normalized_embed
  FROM embeddings),
EPAIR AS (
  SELECT uid, item_id, arg_max(is_organic, (ts, event_id)) AS is_organic, count(*) AS n_listens,
         max(listen_plus) AS listen_plus, max(played_ratio_pct) AS played_ratio
  FROM ELE GROUP BY uid, item_id),
EFLAGS AS (
  SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM ELIKE k WHERE k.uid = p.uid AND k.item_id = p.item_id) THEN 1 ELSE 0 END AS liked,
              CASE WHEN EXISTS (SELECT 1 FROM EDIS k WHERE k.uid = p.uid AND k.item_id = p.item_id) THEN 1 ELSE 0 END AS disliked
  FROM EPAIR p),
ECANCEL AS (
  SELECT d.uid, d.item_id, d.abs_time_sec, d.is_organic,
         MAX(CASE WHEN u.abs_time_sec IS NOT NULL THEN 1 ELSE 0 END) AS cancelled,
         MIN(u.abs_time_sec) - d.abs_time_sec AS time_to_cancel
  FROM EDIS d LEFT JOIN EUND u ON d.uid = u.uid AND d.item_id = u.item_id AND u.abs_time_sec > d.abs_time_sec
  GROUP BY d.uid, d.item_id, d.abs_time_sec, d.is_organic)
"""


def erfc(z: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * abs({z})))"
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
         0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = f"{c[9]}"
    for a in reversed(c[1:9]):
        poly = f"({a} + {t} * {poly})"
    ans = f"({t} * exp(-abs({z}) * abs({z}) + ({c[0]}) + {t} * {poly}))"
    return f"(CASE WHEN {z} >= 0 THEN {ans} ELSE 2.0 - {ans} END)"


def p_two(z: str) -> str:
    return erfc(f"(abs({z}) / sqrt(2.0))")


def p_lower(z: str) -> str:
    return f"(0.5 * {erfc(f'(-({z}) / sqrt(2.0))')})"


def q(body: str, doubles=(), extra_ctes: str = "") -> str:
    """WITH <adapter views>[, extra] <body>, rounding the listed DOUBLE columns."""
    ctes = BASE + ("," + extra_ctes if extra_ctes else "")
    if doubles:
        rep = ", ".join(f"round({c}, 6) AS {c}" for c in doubles)
        return f"WITH {ctes}, __res AS ({body}) SELECT * REPLACE ({rep}) FROM __res"
    return f"WITH {ctes} {body}"


def contingency_sql(src: str, outcome: str) -> str:
    # DuckDB's count_if is HUGEINT: cast to BIGINT like Spark's count_if
    return (f"SELECT CAST(count_if(is_organic = 0 AND {outcome} = 0) AS BIGINT) AS rec_neg, "
            f"CAST(count_if(is_organic = 0 AND {outcome} = 1) AS BIGINT) AS rec_pos, "
            f"CAST(count_if(is_organic = 1 AND {outcome} = 0) AS BIGINT) AS org_neg, "
            f"CAST(count_if(is_organic = 1 AND {outcome} = 1) AS BIGINT) AS org_pos FROM {src}")


def chi2_sql(src: str, outcome: str) -> str:
    a, b, c, d = "CAST(rec_pos AS DOUBLE)", "CAST(rec_neg AS DOUBLE)", "CAST(org_pos AS DOUBLE)", "CAST(org_neg AS DOUBLE)"
    den = f"(({a}+{b})*({c}+{d})*({a}+{c})*({b}+{d}))"
    chi2 = f"(CASE WHEN {den} > 0 THEN ({a}+{b}+{c}+{d}) * ({a}*{d}-{b}*{c}) * ({a}*{d}-{b}*{c}) / {den} END)"
    return (f"SELECT *, {chi2} AS chi2, {erfc(f'sqrt({chi2} / 2.0)')} AS p_value, "
            f"CASE WHEN {b}*{c} > 0 THEN {a}*{d}/({b}*{c}) END AS odds_ratio_rec_over_org "
            f"FROM ({contingency_sql(src, outcome)})")


CHI2_DOUBLES = ("chi2", "p_value", "odds_ratio_rec_over_org")

ORACLE: dict[str, str] = {}

ORACLE["table_profile"] = q(" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count, count(DISTINCT uid) AS distinct_uid FROM {v}"
    for n, v in [("listens", "ELIS"), ("likes", "ELIKE"), ("dislikes", "EDIS"),
                 ("undislikes", "EUND"), ("multi_event", "EME")]))

ORACLE["needed_embeddings"] = q(
    "SELECT item_id, CAST(len(normalized_embed) AS INTEGER) AS dims, "
    "sqrt(list_sum(list_transform(normalized_embed, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm "
    "FROM EMB WHERE item_id IN (SELECT item_id FROM ELIS)", ["norm"])

ORACLE["reconstruct_time"] = q(
    "SELECT uid, item_id, l_orderkey, l_linenumber, l_suppkey, abs_time_sec FROM LE")

ORACLE["enrich_listens"] = q(
    "SELECT uid, item_id, l_orderkey, l_linenumber, l_suppkey, is_organic, abs_time_sec, listen_plus, "
    "length_bucket FROM LE")

ORACLE["listen_plus_by_group"] = q(
    "SELECT is_organic, count(*) AS total, CAST(sum(listen_plus) AS BIGINT) AS lp_count, "
    "avg(listen_plus) AS lp_rate, avg(played_ratio_pct) AS mean_ratio, "
    "quantile_cont(played_ratio_pct, 0.5) AS median_ratio FROM LE WHERE played_ratio_pct IS NOT NULL "
    "GROUP BY is_organic", ["lp_rate", "mean_ratio", "median_ratio"])

ORACLE["listen_plus_by_bucket"] = q(
    "SELECT length_bucket, is_organic, avg(listen_plus) AS lp_rate, count(*) AS n FROM LE "
    "WHERE played_ratio_pct IS NOT NULL GROUP BY length_bucket, is_organic", ["lp_rate"])

ORACLE["listen_plus_by_len6"] = q(
    "SELECT CASE WHEN track_length_seconds < 90 THEN '<1.5m' WHEN track_length_seconds < 150 THEN '1.5-2.5m' "
    "WHEN track_length_seconds < 210 THEN '2.5-3.5m' WHEN track_length_seconds < 270 THEN '3.5-4.5m' "
    "WHEN track_length_seconds < 360 THEN '4.5-6m' ELSE '6m+' END AS len_bucket, is_organic, "
    "avg(listen_plus) AS lp_rate, count(*) AS n FROM LE "
    "WHERE played_ratio_pct IS NOT NULL AND track_length_seconds IS NOT NULL GROUP BY 1, 2", ["lp_rate"])

ORACLE["rewind_rate_by_group"] = q(
    "SELECT is_organic, count(*) AS total, CAST(sum(rewind) AS BIGINT) AS rewind_count, "
    "avg(rewind) AS rewind_rate FROM LE GROUP BY is_organic", ["rewind_rate"])

TOP_USERS = ("TOPU AS (SELECT uid, cnt FROM (SELECT uid, cnt, row_number() OVER (ORDER BY cnt DESC, uid) AS rn, "
             "count(*) OVER () AS nu FROM (SELECT uid, count(*) AS cnt FROM LE WHERE rewind = 1 GROUP BY uid)) "
             "WHERE rn <= floor(nu * 0.01) + 1)")

ORACLE["top_fraction_users"] = q("SELECT uid, cnt FROM TOPU", extra_ctes=TOP_USERS)

ORACLE["rewind_rate_excl_top"] = q(
    "SELECT is_organic, count(*) AS total, avg(rewind) AS rewind_rate FROM LE "
    "WHERE uid NOT IN (SELECT uid FROM TOPU) GROUP BY is_organic", ["rewind_rate"], extra_ctes=TOP_USERS)

ORACLE["pair_agg"] = q("SELECT * FROM EPAIR", ["played_ratio"])

ORACLE["flag_join"] = q("SELECT uid, item_id, is_organic, disliked FROM EFLAGS")

ORACLE["like_dislike_rates"] = q(
    "SELECT is_organic, count(*) AS pairs, avg(liked) AS like_rate, avg(disliked) AS dislike_rate "
    "FROM EFLAGS GROUP BY is_organic", ["like_rate", "dislike_rate"])

ORACLE["asymmetry_ratio"] = q(
    "SELECT is_organic, avg(liked) AS like_rate, avg(disliked) AS dislike_rate, "
    "CASE WHEN avg(liked) <> 0 THEN avg(disliked) / avg(liked) END AS asymmetry_ratio "
    "FROM EFLAGS GROUP BY is_organic", ["like_rate", "dislike_rate", "asymmetry_ratio"])

ORACLE["contingency_like"] = q(contingency_sql("EFLAGS", "liked"))
ORACLE["contingency_dislike"] = q(contingency_sql("EFLAGS", "disliked"))
ORACLE["contingency_rewind"] = q(contingency_sql("LE", "rewind"))
ORACLE["contingency_cancel"] = q(contingency_sql("ECANCEL", "cancelled"))
ORACLE["chi2_like"] = q(chi2_sql("EFLAGS", "liked"), CHI2_DOUBLES)
ORACLE["chi2_dislike"] = q(chi2_sql("EFLAGS", "disliked"), CHI2_DOUBLES)
ORACLE["chi2_rewind"] = q(chi2_sql("LE", "rewind"), CHI2_DOUBLES)
ORACLE["chi2_cancel"] = q(chi2_sql("ECANCEL", "cancelled"), CHI2_DOUBLES)

ORACLE["asymmetry_test"] = q(
    "SELECT l.p_value AS p_like, d.p_value AS p_dislike, r.*, least(l.p_value * 2, 1.0) AS p_like_adj, "
    "least(d.p_value * 2, 1.0) AS p_dislike_adj, "
    "coalesce(least(l.p_value * 2, 1.0) < 0.05 AND least(d.p_value * 2, 1.0) < 0.05 AND r.like_rec < r.like_org "
    "AND r.dislike_rec > r.dislike_org, false) AS confirmed "
    f"FROM ({chi2_sql('EFLAGS', 'liked')}) l, ({chi2_sql('EFLAGS', 'disliked')}) d, "
    "(SELECT avg(liked) FILTER (WHERE is_organic = 0) AS like_rec, avg(liked) FILTER (WHERE is_organic = 1) AS like_org, "
    "avg(disliked) FILTER (WHERE is_organic = 0) AS dislike_rec, avg(disliked) FILTER (WHERE is_organic = 1) AS dislike_org "
    "FROM EFLAGS) r",
    ["p_like", "p_dislike", "like_rec", "like_org", "dislike_rec", "dislike_org", "p_like_adj", "p_dislike_adj"])

ORACLE["cancel_match"] = q("SELECT * FROM ECANCEL")

ORACLE["cancellation_rate_by_group"] = q(
    "SELECT is_organic, count(*) AS dislikes, CAST(sum(cancelled) AS BIGINT) AS cancelled, avg(cancelled) AS cancel_rate "
    "FROM ECANCEL GROUP BY is_organic", ["cancel_rate"])

# dislikes and undislikes on one clock of deltas
CUMSUM = f"""
CTIME AS (
  SELECT uid, item_id, raw_type, CAST(event_id % 2 AS INTEGER) AS is_organic,
         CAST(5 * SUM(event_id % 5 + 1) OVER (PARTITION BY uid ORDER BY {E_ORDER}
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS abs_time_sec
  FROM EV WHERE raw_type IN ('error', 'signup')),
CCANCEL AS (
  SELECT d.uid, d.item_id, d.abs_time_sec, d.is_organic,
         MAX(CASE WHEN u.abs_time_sec IS NOT NULL THEN 1 ELSE 0 END) AS cancelled,
         MIN(u.abs_time_sec) - d.abs_time_sec AS time_to_cancel
  FROM (SELECT * FROM CTIME WHERE raw_type = 'error') d LEFT JOIN (SELECT * FROM CTIME WHERE raw_type = 'signup') u
    ON d.uid = u.uid AND d.item_id = u.item_id AND u.abs_time_sec > d.abs_time_sec
  GROUP BY d.uid, d.item_id, d.abs_time_sec, d.is_organic)
"""
ORACLE["cancel_match_cumsum"] = q("SELECT * FROM CCANCEL", extra_ctes=CUMSUM)
ORACLE["contingency_cancel_cumsum"] = q(contingency_sql("CCANCEL", "cancelled"), extra_ctes=CUMSUM)

ORACLE["time_to_cancel"] = q(
    "SELECT is_organic, count(*) AS n_cancelled, quantile_cont(time_to_cancel, 0.5) AS median_time, "
    "avg(time_to_cancel) AS mean_time FROM ECANCEL WHERE cancelled = 1 GROUP BY is_organic",
    ["median_time", "mean_time"])


# ---------------------------------------------------------------- sessions (gap 86,400 s on events)

SESS = f"""
SES AS (
  SELECT *, CAST(SUM(new_s) OVER (PARTITION BY uid ORDER BY {E_ORDER}
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_id
  FROM (SELECT *, CASE WHEN coalesce(abs_time_sec - lag(abs_time_sec) OVER (PARTITION BY uid ORDER BY {E_ORDER}), 0)
                        > 86400 THEN 1 ELSE 0 END AS new_s FROM EME)),
POS AS (
  SELECT *, row_number() OVER (PARTITION BY uid, session_id ORDER BY {E_ORDER}) - 1 AS pos_in_session,
         count(*) OVER (PARTITION BY uid, session_id) AS session_len,
         avg(CASE WHEN is_organic IS NOT NULL THEN CASE WHEN is_organic = 0 THEN 1 ELSE 0 END END)
             OVER (PARTITION BY uid, session_id) AS rec_share
  FROM SES),
POS2 AS (
  SELECT *, CASE WHEN CAST(pos_in_session AS DOUBLE) / session_len < CAST(1 AS DOUBLE) / 3 THEN 'beginning'
                 WHEN CAST(pos_in_session AS DOUBLE) / session_len < CAST(2 AS DOUBLE) / 3 THEN 'middle'
                 ELSE 'end' END AS pos_third,
         CASE WHEN event_type = 'dislike' THEN 1 ELSE 0 END AS is_dislike, rec_share > 0.5 AS rec_dominated
  FROM POS WHERE session_len >= 6 AND rec_share IS NOT NULL)
"""

ORACLE["sessionize"] = q("SELECT uid, event_id, abs_time_sec, session_id FROM SES", extra_ctes=SESS)
ORACLE["session_position"] = q(
    "SELECT uid, event_id, session_id, pos_in_session, session_len, pos_third, is_dislike FROM POS2",
    extra_ctes=SESS)
ORACLE["session_rec_share"] = q(
    "SELECT DISTINCT uid, session_id, session_len, rec_share, rec_dominated FROM POS2", ["rec_share"],
    extra_ctes=SESS)
ORACLE["dislike_by_third"] = q(
    "SELECT rec_dominated, pos_third, avg(is_dislike) AS p_dislike, count(*) AS n, "
    "stddev_samp(is_dislike) AS sd_dislike FROM POS2 GROUP BY ALL",
    ["p_dislike", "sd_dislike"], extra_ctes=SESS)
_z = "(CASE WHEN se > 0 THEN (p_end - p_begin) / se END)"
ORACLE["session_fatigue"] = q(
    f"SELECT p_end, n_end, p_begin, n_begin, {_z} AS z, {p_two(_z)} AS p_value FROM ("
    "SELECT *, sqrt(pooled * (1 - pooled) * (1.0 / n_end + 1.0 / n_begin)) AS se FROM ("
    "SELECT *, (p_end * n_end + p_begin * n_begin) / (n_end + n_begin) AS pooled FROM ("
    "SELECT avg(is_dislike) FILTER (WHERE pos_third = 'end') AS p_end, "
    "CAST(count_if(pos_third = 'end') AS BIGINT) AS n_end, "
    "avg(is_dislike) FILTER (WHERE pos_third = 'beginning') AS p_begin, "
    "CAST(count_if(pos_third = 'beginning') AS BIGINT) AS n_begin "
    "FROM POS2 WHERE rec_dominated AND pos_third IN ('beginning', 'end'))))",
    ["p_end", "p_begin", "z", "p_value"], extra_ctes=SESS)

# ---------------------------------------------------------------- activity quartiles

ACT = """
UC AS (SELECT uid, count(*) AS total_listens FROM ELE GROUP BY uid),
CUTS AS (
  SELECT min(total_listens) FILTER (WHERE rn >= ceil(nu * 0.25)) AS q1,
         min(total_listens) FILTER (WHERE rn >= ceil(nu * 0.5)) AS q2,
         min(total_listens) FILTER (WHERE rn >= ceil(nu * 0.75)) AS q3
  FROM (SELECT total_listens, row_number() OVER (ORDER BY total_listens) AS rn, count(*) OVER () AS nu FROM UC)),
AQ AS (
  SELECT uid, total_listens, CASE WHEN total_listens <= q1 THEN 1 WHEN total_listens <= q2 THEN 2
                                  WHEN total_listens <= q3 THEN 3 ELSE 4 END AS activity_quartile
  FROM UC, CUTS),
RQ AS (SELECT l.*, a.activity_quartile FROM ELE l JOIN AQ a USING (uid) WHERE l.is_organic = 0)
"""

ORACLE["activity_cutpoints"] = q("SELECT * FROM CUTS", extra_ctes=ACT)
ORACLE["activity_quartile"] = q("SELECT * FROM AQ", extra_ctes=ACT)
ORACLE["listen_plus_by_quartile"] = q(
    "SELECT activity_quartile, avg(listen_plus) AS lp_rate, count(*) AS n FROM RQ GROUP BY 1", ["lp_rate"],
    extra_ctes=ACT)
ORACLE["like_rate_by_quartile"] = q(
    "SELECT activity_quartile, avg(CASE WHEN EXISTS (SELECT 1 FROM ELIKE k WHERE k.uid = p.uid "
    "AND k.item_id = p.item_id) THEN 1 ELSE 0 END) AS like_rate, count(*) AS pairs "
    "FROM (SELECT DISTINCT uid, item_id, activity_quartile FROM RQ) p GROUP BY 1", ["like_rate"],
    extra_ctes=ACT)


# ---------------------------------------------------------------- ranks

def avg_rank_sql(v: str, part: str = "") -> str:
    pb = f"PARTITION BY {part} " if part else ""
    pv = f"{part}, {v}" if part else v
    return (f"((rank() OVER ({pb}ORDER BY {v}) + rank() OVER ({pb}ORDER BY {v}) "
            f"+ count(*) OVER (PARTITION BY {pv}) - 1) / 2.0)")


def spearman_sql(src: str, x: str, y: str, part: str = "") -> str:
    sel = f"{part}, " if part else ""
    grp = f"GROUP BY {part}" if part else ""
    ranked = (f"SELECT {sel}{avg_rank_sql(x, part)} AS rx, {avg_rank_sql(y, part)} AS ry, "
              f"count(*) OVER ({'PARTITION BY ' + part if part else ''}) AS n "
              f"FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL")
    sums = (f"SELECT {sel}max(n) AS n, sum((rx - (n + 1) / 2.0) * (ry - (n + 1) / 2.0)) AS sxy, "
            f"sum((rx - (n + 1) / 2.0) * (rx - (n + 1) / 2.0)) AS sxx, "
            f"sum((ry - (n + 1) / 2.0) * (ry - (n + 1) / 2.0)) AS syy FROM ({ranked}) {grp}")
    rho = "CASE WHEN sxx > 0 AND syy > 0 THEN least(1.0, greatest(-1.0, sxy / sqrt(sxx * syy))) END"
    return (f"SELECT {sel}n, rho, CASE WHEN abs(rho) < 1.0 THEN rho * sqrt((n - 2.0) / (1.0 - rho * rho)) END AS t "
            f"FROM (SELECT *, CAST({rho} AS DOUBLE) AS rho FROM ({sums}))")


def t_two(t: str, n: str) -> str:
    """Two-sided Student-t tail with n - 2 degrees of freedom, by midpoint sums over the angle."""
    df = f"({n} - 2.0)"
    c = f"(2.0 * exp(lgamma(({df} + 1.0) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()))"
    lo = f"atan(abs({t}) / sqrt({df}))"
    w = f"((pi() / 2.0 - {lo}) / 400000.0)"
    return (f"(CASE WHEN {n} > 2 THEN least(1.0, {c} * {w} * (SELECT sum(pow(cos({lo} + {w} * (i + 0.5)), {df} - 1.0)) "
            f"FROM range(400000) r(i))) END)")


def spearman_p_sql(inner: str) -> str:
    return (f"SELECT n, rho, CASE WHEN abs(rho) = 1.0 THEN 0.0 WHEN t IS NOT NULL THEN {t_two('t', 'n')} END AS p_value "
            f"FROM ({inner})")


def mwu_sql(src: str, v: str, g: str, xv: int, yv: int, cols: str, ties: bool = True) -> str:
    base = f"SELECT {v} AS v, {g} AS g FROM {src} WHERE {v} IS NOT NULL AND {g} IN ({xv}, {yv})"
    ranked = f"SELECT g, {avg_rank_sql('v')} AS rk FROM ({base})"
    tie = f"SELECT sum(c * c * c - c) AS tie FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM ({base}) GROUP BY v)"
    s = (f"SELECT CAST(count_if(g = {xv}) AS DOUBLE) AS n1, CAST(count_if(g = {yv}) AS DOUBLE) AS n2, "
         f"sum(rk) FILTER (WHERE g = {xv}) AS r1 FROM ({ranked})")
    var = ("(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1))))" if ties
           else "(n1 * n2 / 12.0 * (n1 + n2 + 1))")
    z = "(CASE WHEN var > 0 THEN (u1 - n1 * n2 / 2.0) / sqrt(var) END)"
    inner = (f"SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u1, {var} AS var FROM ({s}) a, ({tie}) b")
    allc = {"n1": "CAST(n1 AS BIGINT) AS n1", "n2": "CAST(n2 AS BIGINT) AS n2", "u1": "u1", "z": f"{z} AS z",
            "p_less": f"{p_lower(z)} AS p_less", "p_two_sided": f"{p_two(z)} AS p_two_sided",
            "r_rank_biserial": "2.0 * u1 / (n1 * n2) - 1.0 AS r_rank_biserial"}
    return f"SELECT {', '.join(allc[c] for c in cols.split())} FROM ({inner})"


L_COMPLETE = "(SELECT * FROM L WHERE played_ratio_pct IS NOT NULL AND track_length_seconds IS NOT NULL)"
ORACLE["zscore_stats"] = q(
    "SELECT avg(is_organic) AS is_organic_mean, stddev_samp(is_organic) AS is_organic_std, "
    "avg(track_length_seconds) AS track_length_seconds_mean, stddev_samp(track_length_seconds) AS track_length_seconds_std "
    f"FROM {L_COMPLETE}",
    ["is_organic_mean", "is_organic_std", "track_length_seconds_mean", "track_length_seconds_std"])

ORACLE["zscore_columns"] = q(
    "SELECT (is_organic - mo) / so AS s_is_organic, (track_length_seconds - mt) / st AS s_track_length_seconds, "
    f"count(*) AS n FROM {L_COMPLETE}, (SELECT avg(is_organic) mo, stddev_samp(is_organic) so, "
    f"avg(track_length_seconds) mt, stddev_samp(track_length_seconds) st FROM {L_COMPLETE}) GROUP BY ALL",
    ["s_is_organic", "s_track_length_seconds"])

ORACLE["avg_ranks"] = q(
    "SELECT played_ratio_pct, n, CAST(sum(n) OVER (ORDER BY played_ratio_pct ROWS UNBOUNDED PRECEDING) AS DOUBLE) "
    "- n + (n + 1) / 2.0 AS avg_rank FROM (SELECT played_ratio_pct, count(*) AS n FROM L "
    "WHERE played_ratio_pct IS NOT NULL GROUP BY 1)", ["played_ratio_pct", "avg_rank"])

ORACLE["mann_whitney_less"] = q(
    mwu_sql("L", "played_ratio_pct", "is_organic", 0, 1, "n1 n2 u1 z p_less p_two_sided r_rank_biserial"),
    ["u1", "z", "p_less", "p_two_sided", "r_rank_biserial"])

ORACLE["mann_whitney_two_sided"] = q(
    mwu_sql("(SELECT * FROM ECANCEL WHERE cancelled = 1)", "time_to_cancel", "is_organic", 0, 1,
            "n1 n2 u1 z p_two_sided"), ["u1", "z", "p_two_sided"])

H4SRC = "(SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM ELIKE k WHERE k.uid = p.uid AND k.item_id = p.item_id) THEN 1 ELSE 0 END AS liked FROM EPAIR p WHERE played_ratio IS NOT NULL)"
ORACLE["spearman_by_group"] = q(spearman_sql(H4SRC, "played_ratio", "liked", "is_organic"), ["rho", "t"])
ORACLE["trend_spearman"] = q(spearman_sql("RQ", "activity_quartile", "listen_plus"), ["rho", "t"],
                             extra_ctes=ACT)

_clip = "(CASE WHEN {r} IS NOT NULL THEN least(0.9999, greatest(-0.9999, {r})) END)"
_fz = (f"((atanh({_clip.format(r='rho_rec')}) - atanh({_clip.format(r='rho_org')})) "
       "/ sqrt(1.0 / (n_rec - 3.0) + 1.0 / (n_org - 3.0)))")
ORACLE["fisher_z"] = q(
    f"SELECT *, {_fz} AS z, {p_two(_fz)} AS p_value FROM ("
    "SELECT max(rho) FILTER (WHERE is_organic = 0) AS rho_rec, max(rho) FILTER (WHERE is_organic = 1) AS rho_org, "
    "max(n) FILTER (WHERE is_organic = 0) AS n_rec, max(n) FILTER (WHERE is_organic = 1) AS n_org "
    f"FROM ({spearman_sql(H4SRC, 'played_ratio', 'liked', 'is_organic')}))",
    ["rho_rec", "rho_org", "z", "p_value"])


# ---------------------------------------------------------------- sampling

def hu(key: str, seed: int = 42) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0)"


ELIG = ("ELIG AS (SELECT uid, CAST(count_if(is_organic = 1) AS BIGINT) AS organic_cnt, "
        "CAST(count_if(is_organic = 0) AS BIGINT) AS rec_cnt "
        "FROM ELIS GROUP BY uid HAVING count_if(is_organic = 1) >= 5 AND count_if(is_organic = 0) >= 1)")

ORACLE["hash_sample"] = q(f"SELECT DISTINCT uid FROM ELIS WHERE {hu('uid')} < 0.5")
ORACLE["sample_to_target"] = q(
    f"SELECT event_id, uid, item_id FROM ELIS ORDER BY {hu('event_id')}, event_id LIMIT 500")
ORACLE["eligible_users"] = q("SELECT * FROM ELIG", extra_ctes=ELIG)
ORACLE["sampled_user_history"] = q(
    "SELECT uid, event_id, item_id, abs_time_sec, is_organic, listen_plus FROM ELE "
    f"WHERE uid IN (SELECT uid FROM ELIG WHERE {hu('uid')} < 0.5)", extra_ctes=ELIG)


# ---------------------------------------------------------------- vectors

HIST = ELIG + f""",
LK AS (
  SELECT *, CAST(sum(is_organic) OVER (PARTITION BY uid ORDER BY {E_ORDER}
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_org
  FROM ELE WHERE uid IN (SELECT uid FROM ELIG)),
RV AS (
  SELECT r.uid, r.event_id, r.n_org, r.listen_plus, e.normalized_embed AS v
  FROM LK r JOIN EMB e ON e.item_id = r.item_id WHERE r.is_organic = 0 AND r.n_org >= 3),
HV AS (
  SELECT RV.event_id, e.normalized_embed AS hv FROM RV
  JOIN LK o ON o.uid = RV.uid AND o.is_organic = 1 AND o.n_org BETWEEN RV.n_org - 19 AND RV.n_org
  JOIN EMB e ON e.item_id = o.item_id),
HE AS (SELECT event_id, unnest(range(1, len(hv) + 1)) AS i, unnest(hv) AS x FROM HV),
HS AS (SELECT event_id, i, sum(CAST(x AS DOUBLE)) AS s FROM HE GROUP BY event_id, i),
RE AS (SELECT event_id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM RV),
DOTS AS (
  SELECT h.event_id, sum(CAST(r.x AS DOUBLE) * h.s) AS dt, sum(CAST(r.x AS DOUBLE) * CAST(r.x AS DOUBLE)) AS nr,
         sum(h.s * h.s) AS nh
  FROM HS h JOIN RE r ON r.event_id = h.event_id AND r.i = h.i GROUP BY h.event_id),
SIM AS (
  SELECT RV.uid, RV.event_id, RV.n_org, RV.listen_plus,
         CASE WHEN sqrt(nr) * sqrt(nh) < 1e-9 THEN 0.0 ELSE dt / (sqrt(nr) * sqrt(nh)) END AS cosine_sim
  FROM RV JOIN DOTS USING (event_id))
"""

ORACLE["history_similarity"] = q("SELECT * FROM SIM", ["cosine_sim"], extra_ctes=HIST)
ORACLE["history_spearman"] = q(spearman_sql("(SELECT round(cosine_sim, 9) AS cosine_sim, listen_plus FROM SIM)",
                                            "cosine_sim", "listen_plus"), ["rho", "t"], extra_ctes=HIST)

WIN = f"""
WR AS (
  SELECT uid, item_id, is_organic, idx,
         unnest(generate_series(greatest(0, CAST(floor((idx - 20) / 10.0) AS BIGINT) + 1), idx // 10)) AS win
  FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY {E_ORDER}) - 1 AS idx FROM ELE)),
WFULL AS (SELECT uid, win, count(*) AS n, min(idx) AS first_idx FROM WR GROUP BY uid, win HAVING count(*) = 20),
WI AS (SELECT uid, win, item_id, CAST(count(*) AS DOUBLE) AS c,
              CAST(sum(CASE WHEN is_organic = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS r FROM WR GROUP BY ALL),
WS AS (SELECT uid, win, sum(r) / 20.0 AS rec_share, -sum((c / 20.0) * log2(c / 20.0)) AS entropy
       FROM WI GROUP BY uid, win HAVING sum(c) = 20)
"""

ORACLE["sliding_count_windows"] = q("SELECT * FROM WFULL", extra_ctes=WIN)
ORACLE["window_entropy"] = q("SELECT * FROM WS", ["rec_share", "entropy"], extra_ctes=WIN)

DIV = WIN + """,
WV AS (SELECT w.uid, w.win, w.idx, e.normalized_embed AS v FROM WR w JOIN WFULL f USING (uid, win)
       JOIN EMB e ON e.item_id = w.item_id),
WVE AS (SELECT uid, win, idx, unnest(range(1, len(v) + 1)) AS i, CAST(unnest(v) AS DOUBLE) AS x FROM WV),
PD AS (SELECT a.uid, a.win, a.idx AS ia, b.idx AS ib, sum(a.x * b.x) AS dt FROM WVE a JOIN WVE b
       ON a.uid = b.uid AND a.win = b.win AND a.i = b.i AND a.idx < b.idx GROUP BY ALL),
NR AS (SELECT uid, win, idx, sqrt(sum(x * x)) AS nr FROM WVE GROUP BY ALL),
PC AS (SELECT p.uid, p.win, avg(1.0 - CASE WHEN na.nr * nb.nr < 1e-9 THEN 0.0 ELSE p.dt / (na.nr * nb.nr) END) AS diversity
       FROM PD p JOIN NR na ON na.uid = p.uid AND na.win = p.win AND na.idx = p.ia
       JOIN NR nb ON nb.uid = p.uid AND nb.win = p.win AND nb.idx = p.ib GROUP BY p.uid, p.win),
WN AS (SELECT uid, win, count(*) AS n_vec FROM WV GROUP BY uid, win)
"""
ORACLE["window_cosine_diversity"] = q(
    "SELECT WN.uid, WN.win, WN.n_vec, PC.diversity FROM WN LEFT JOIN PC USING (uid, win)", ["diversity"],
    extra_ctes=DIV)

ORACLE["diversity_test"] = q(
    "SELECT * FROM (" + mwu_sql("(SELECT round(entropy, 9) AS entropy, CASE WHEN rec_share > 0.5 THEN 1 ELSE 0 END AS rec_dom FROM WS)",
                                "entropy", "rec_dom", 1, 0, "n1 n2 u1 z p_two_sided") + ") m, "
    "(SELECT avg(entropy) FILTER (WHERE rec_share > 0.5) AS mean_rec, avg(entropy) FILTER (WHERE rec_share <= 0.5) "
    "AS mean_org FROM WS) w", ["u1", "z", "p_two_sided", "mean_rec", "mean_org"], extra_ctes=WIN)


# ---------------------------------------------------------------- analyses in long form

def result_sql(wide: str, hid: str, confirmed: str, metrics: str) -> str:
    """(id, description, confirmed, metric, value) rows of a one-row table of metrics."""
    from playstat.plans.hypotheses import DESCRIPTIONS
    names = metrics.split()
    listed = ", ".join(f"'{m}'" for m in names)
    values = ", ".join(f"CAST({m} AS DOUBLE)" for m in names)
    return (f"SELECT id, description, confirmed, metric, round(value, 6) AS value FROM (SELECT '{hid}' AS id, "
            f"'{DESCRIPTIONS[hid]}' AS description, coalesce({confirmed}, false) AS confirmed, "
            f"unnest([{listed}]) AS metric, unnest([{values}]) AS value FROM ({wide}))")


ORACLE["h1_listen_plus"] = q(result_sql(
    mwu_sql("L", "played_ratio_pct", "is_organic", 0, 1, "n1 n2 u1 z p_less p_two_sided r_rank_biserial"), "H1",
    "p_less < 0.05 AND r_rank_biserial < 0", "n1 n2 u1 z p_less r_rank_biserial"))
ORACLE["h4_correlation"] = result_sql(
    ORACLE["fisher_z"], "H4", "p_value < 0.05 AND rho_rec < rho_org", "rho_rec rho_org n_rec n_org z p_value")
_EXCL = ORACLE["rewind_rate_excl_top"]
ORACLE["h6_rewind"] = result_sql(
    "SELECT *, CASE WHEN rec_pos * org_neg > 0 THEN CAST(org_pos AS DOUBLE) * rec_neg / (CAST(rec_pos AS DOUBLE) * org_neg) "
    "WHEN org_pos * rec_neg > 0 THEN CAST('inf' AS DOUBLE) END AS or_org_over_rec "
    f"FROM ({ORACLE['chi2_rewind']}) c, (SELECT max(rewind_rate) FILTER (WHERE is_organic = 0) AS rate_rec_excl_top, "
    f"max(rewind_rate) FILTER (WHERE is_organic = 1) AS rate_org_excl_top FROM ({_EXCL})) x", "H6",
    "p_value < 0.05 AND or_org_over_rec > 1", "chi2 p_value or_org_over_rec rate_rec_excl_top rate_org_excl_top")
ORACLE["h7_session_fatigue"] = result_sql(
    ORACLE["session_fatigue"], "H7", "p_value < 0.05 AND p_end > p_begin", "p_end n_end p_begin n_begin z p_value")
ORACLE["h10_asymmetry"] = result_sql(
    ORACLE["asymmetry_test"], "H10", "confirmed",
    "p_like_adj p_dislike_adj like_rec like_org dislike_rec dislike_org")
_DIVP = q(mwu_sql("(SELECT round(PC.diversity, 9) AS diversity, CASE WHEN WS.rec_share > 0.5 THEN 1 ELSE 0 END AS rec_dom "
                  "FROM WN LEFT JOIN PC USING (uid, win) JOIN WS USING (uid, win))", "diversity", "rec_dom", 1, 0,
                  "p_two_sided"), extra_ctes=DIV)
ORACLE["h11_diversity"] = result_sql(
    f"SELECT t.*, d.p_two_sided AS diversity_p_value FROM ({ORACLE['diversity_test']}) t, ({_DIVP}) d", "H11",
    "p_two_sided < 0.05 AND mean_rec > mean_org", "n1 n2 mean_rec mean_org p_two_sided diversity_p_value")


# ---------------------------------------------------------------- keyed bootstrap

def boot_sql(src: str, outcome: str, b: int = 2000, seed: int = 42) -> str:
    """diff, ci_low, ci_high: binomial draws as inverse values of md5 uniforms."""
    u = f"(CAST('0x' || substr(md5('{seed}:' || b || ':' || g), 1, 8) AS BIGINT) / 4294967296.0)"
    return f"""
WITH grp AS MATERIALIZED (
  SELECT CASE WHEN is_organic = 0 THEN 1 ELSE 2 END AS g, count(*) AS n, sum({outcome}) / CAST(count(*) AS DOUBLE) AS p
  FROM {src} WHERE is_organic IN (0, 1) GROUP BY 1),
span AS (SELECT *, CASE WHEN p <= 0 OR p >= 1 THEN CAST(round(n * p) AS BIGINT)
                        ELSE greatest(0, CAST(floor(n * p - 10 * sqrt(n * p * (1 - p)) - 10) AS BIGINT)) END AS lo,
                   CASE WHEN p <= 0 OR p >= 1 THEN CAST(round(n * p) AS BIGINT)
                        ELSE least(n, CAST(ceil(n * p + 10 * sqrt(n * p * (1 - p)) + 10) AS BIGINT)) END AS hi FROM grp),
term AS (SELECT *, exp(sum(CASE WHEN k = lo THEN 0.0 ELSE ln((n - k + 1) / CAST(k AS DOUBLE) * p / (1 - p)) END)
                       OVER (PARTITION BY g ORDER BY k)) AS w
         FROM (SELECT *, unnest(range(lo, hi + 1)) AS k FROM span)),
dist AS MATERIALIZED (SELECT g, k, CASE WHEN k = hi THEN 1.0 ELSE sum(w) OVER (PARTITION BY g ORDER BY k)
                                               / sum(w) OVER (PARTITION BY g) END AS cdf FROM term),
draw AS (SELECT g, b, min(k) AS x FROM (SELECT g, b, {u} AS u FROM grp, range({b}) r(b)) JOIN dist USING (g)
         WHERE cdf >= u GROUP BY g, b),
diffs AS (SELECT b, max(x / CAST(n AS DOUBLE)) FILTER (WHERE g = 1) - max(x / CAST(n AS DOUBLE)) FILTER (WHERE g = 2) AS d
          FROM draw JOIN grp USING (g) GROUP BY b),
ci AS (SELECT list_sort(list(d)) AS l FROM diffs WHERE d IS NOT NULL)
SELECT (SELECT p FROM grp WHERE g = 1) - (SELECT p FROM grp WHERE g = 2) AS diff,
       l[{int(b * 0.025) + 1}] AS ci_low, l[{int(b * 0.975) + 1}] AS ci_high FROM ci"""


ORACLE["bootstrap_rate_diff"] = q(f"SELECT * FROM ({boot_sql('EFLAGS', 'disliked')})", ["diff", "ci_low", "ci_high"])
ORACLE["h2_dislike_rate"] = q(result_sql(
    f"SELECT c.*, b.* FROM ({chi2_sql('EFLAGS', 'disliked')}) c, ({boot_sql('EFLAGS', 'disliked')}) b", "H2",
    "p_value < 0.05 AND odds_ratio_rec_over_org > 1 AND ci_low > 0",
    "chi2 p_value odds_ratio_rec_over_org diff ci_low ci_high"))
_CANCELLED = "(SELECT * FROM ECANCEL WHERE cancelled = 1)"
ORACLE["h3_cancellation"] = q(result_sql(
    f"SELECT c.*, b.*, m.p_two_sided AS time_p_value, t.* FROM ({chi2_sql('ECANCEL', 'cancelled')}) c, "
    f"({boot_sql('ECANCEL', 'cancelled')}) b, "
    f"({mwu_sql(_CANCELLED, 'time_to_cancel', 'is_organic', 0, 1, 'p_two_sided', ties=False)}) m, "
    "(SELECT quantile_cont(time_to_cancel, 0.5) FILTER (WHERE is_organic = 0) AS median_time_rec, "
    f"quantile_cont(time_to_cancel, 0.5) FILTER (WHERE is_organic = 1) AS median_time_org FROM {_CANCELLED}) t", "H3",
    "p_value < 0.05 AND odds_ratio_rec_over_org > 1",
    "chi2 p_value odds_ratio_rec_over_org diff ci_low ci_high time_p_value median_time_rec median_time_org"))


# ---------------------------------------------------------------- logistic fit by Newton's method

def newton_sql(src: str, passes: int = 9) -> tuple[str, str]:
    """CTEs that end in NEWTON (coefficients b0..b3 and their variances v0..v3).

    Each pass is one aggregate over the weighted rows and one elimination of the
    symmetric system, spelled step by step."""
    ks = range(4)
    ctes = [f"""
HIST4 AS MATERIALIZED (SELECT CAST(is_organic AS DOUBLE) AS a, track_length_seconds AS b, CAST(listen_plus AS DOUBLE) AS y,
                     CAST(count(*) AS DOUBLE) AS w FROM {src} GROUP BY 1, 2, 3),
MOM AS (SELECT sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, sum(w) AS n FROM HIST4),
DEV AS (SELECT any_value(ma) AS ma, any_value(mb) AS mb, sqrt(sum(w * (a - ma) * (a - ma)) / (any_value(n) - 1)) AS sa,
               sqrt(sum(w * (b - mb) * (b - mb)) / (any_value(n) - 1)) AS sb FROM HIST4, MOM),
X4 AS MATERIALIZED (SELECT 1.0::DOUBLE AS x0, (a - ma) / sa AS x1, (b - mb) / sb AS x2, (a - ma) / sa * ((b - mb) / sb) AS x3, y, w
                  FROM HIST4, DEV),
B0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3)"""]
    for t in range(passes):
        prob = "1.0 / (1.0 + exp(-(b0 + b1 * x1 + b2 * x2 + b3 * x3)))"
        sums = ", ".join([f"sum(w * (y - p) * x{i}) AS r{i}" for i in ks]
                         + [f"sum(w * p * (1 - p) * x{i} * x{j}) AS m{i}{j}" for i in ks for j in ks]
                         + [f"{1.0 if i == j else 0.0} AS e{i}{j}" for i in ks for j in ks])
        ctes.append(f"S{t}_0 AS MATERIALIZED (SELECT {sums} FROM (SELECT *, {prob} AS p FROM X4, B{t}))")
        for c in ks:                        # Gauss-Jordan: column c to a unit column
            cols = []
            for i in ks:
                for name in [f"r{i}"] + [f"m{i}{j}" for j in ks] + [f"e{i}{j}" for j in ks]:
                    pivot = name[0] + str(c) + name[2:]
                    cols.append(f"{pivot} / m{c}{c} AS {name}" if i == c
                                else f"{name} - m{i}{c} / m{c}{c} * {pivot} AS {name}")
            ctes.append(f"S{t}_{c + 1} AS MATERIALIZED (SELECT {', '.join(cols)} FROM S{t}_{c})")
        moved = ", ".join([f"b{i} + r{i} AS b{i}" for i in ks] + [f"e{i}{i} AS v{i}" for i in ks])
        ctes.append(f"B{t + 1} AS MATERIALIZED (SELECT {moved} FROM B{t}, S{t}_4)")
    return ",".join(ctes), f"B{passes}"


_NEWTON, _FIT = newton_sql("(SELECT * FROM LE WHERE played_ratio_pct IS NOT NULL AND track_length_seconds IS NOT NULL)")
_FIT_NAMES = ["intercept", "s_is_organic", "s_track_length_seconds", "interaction"]
_FIT_METRICS = ", ".join(f"b{i} AS coef_{n}, b{i} / sqrt(v{i}) AS wald_z_{n}, {p_two(f'(b{i} / sqrt(v{i}))')} AS p_{n}"
                         for i, n in enumerate(_FIT_NAMES))
ORACLE["h5_length_interaction"] = q(result_sql(
    f"SELECT {_FIT_METRICS} FROM {_FIT}", "H5", "coef_interaction > 0",
    " ".join(f"{k}_{n}" for n in _FIT_NAMES for k in ("coef", "wald_z", "p"))), extra_ctes=_NEWTON)
ORACLE["logit_interaction"] = f"SELECT metric, value FROM ({ORACLE['h5_length_interaction']})"

ORACLE["h8_experience"] = q(result_sql(
    spearman_p_sql(spearman_sql("RQ", "activity_quartile", "listen_plus")), "H8",
    "p_value < 0.05 AND rho > 0", "n rho p_value"), extra_ctes=ACT)
ORACLE["h9_similarity"] = q(result_sql(
    spearman_p_sql(spearman_sql("(SELECT round(cosine_sim, 9) AS cosine_sim, listen_plus FROM SIM)", "cosine_sim", "listen_plus")),
    "H9", "p_value < 0.05 AND rho > 0", "n rho p_value"), extra_ctes=HIST)

_VERDICTS = " UNION ALL ".join(f"SELECT id, description, confirmed FROM ({ORACLE[k]})" for k in (
    "h1_listen_plus", "h2_dislike_rate", "h3_cancellation", "h4_correlation", "h5_length_interaction", "h6_rewind",
    "h7_session_fatigue", "h8_experience", "h9_similarity", "h10_asymmetry", "h11_diversity"))
ORACLE["hypothesis_summary"] = f"""
WITH per AS (SELECT id, description, max(CAST(confirmed AS BIGINT)) AS confirmed FROM ({_VERDICTS}) GROUP BY id, description)
SELECT id, description, confirmed, CAST(1 AS BIGINT) AS total FROM per
UNION ALL SELECT 'ALL', 'confirmed / total', CAST(sum(confirmed) AS BIGINT), count(*) FROM per"""


# ---------------------------------------------------------------- sampling in groups, sketch, folder run

ORACLE["sample_to_target_by_group"] = q(
    "SELECT event_id, uid, item_id, is_organic FROM ELIS "
    f"QUALIFY row_number() OVER (PARTITION BY is_organic ORDER BY {hu('event_id')}, event_id) <= 500")
# below 10,000 users the sketch is exact
ORACLE["activity_cutpoints_approx"] = q("SELECT * FROM CUTS", extra_ctes=ACT)

# all analyses on the events views: the listens of H1, H5 and H6 come from events too
_L_VIEW = BASE[BASE.index("L AS ("):BASE.index("LE AS (")]
_L_EVENTS = """L AS (
  SELECT user_id AS uid, CAST(props->>'k' AS BIGINT) AS item_id, epoch_us(ts) // 5000000 AS "timestamp",
         CAST(event_id % 2 AS INTEGER) AS is_organic, CASE WHEN event_id % 53 = 0 THEN NULL ELSE value END AS played_ratio_pct,
         CAST(30 + (CAST(props->>'k' AS BIGINT) * 37) % 571 AS DOUBLE) AS track_length_seconds,
         ts AS l_shipdate, event_id AS l_orderkey, 0 AS l_linenumber, 0 AS l_suppkey, 0 AS l_extendedprice
  FROM events WHERE event_type IN ('view', 'click')),
"""
_ON_FOLDER = {k: ORACLE[k].replace(_L_VIEW, _L_EVENTS) for k in (
    "h1_listen_plus", "h2_dislike_rate", "h3_cancellation", "h4_correlation", "h5_length_interaction", "h6_rewind",
    "h7_session_fatigue", "h8_experience", "h10_asymmetry")}
_ON_FOLDER["h11_diversity"] = result_sql(
    f"SELECT t.*, NULL AS diversity_p_value FROM ({ORACLE['diversity_test']}) t", "H11",
    "p_two_sided < 0.05 AND mean_rec > mean_org", "n1 n2 mean_rec mean_org p_two_sided diversity_p_value")


def _skipped_sql(hid: str, reason: str) -> str:
    from playstat.plans.hypotheses import DESCRIPTIONS
    return (f"SELECT '{hid}' AS id, '{DESCRIPTIONS[hid]}' AS description, false AS confirmed, '{reason}' AS metric, "
            "CAST(NULL AS DOUBLE) AS value")


ORACLE["folder_results"] = " UNION ALL ".join(
    [f"SELECT * FROM ({sql})" for sql in _ON_FOLDER.values()] + [_skipped_sql("H9", "SKIPPED: no embeddings")])
