"""DuckDB text for windows and policies."""

from oracles.base import values, with_payloads
from oracles.evaluate import FB
from oracles.featurise import entropy
from oracles.label import DEPTH, TPL
from paysieve.plans.windows import KNOWN_TEMPLATES, POLICY

T = "event_type||'|'||props"
PTS = f"""ep AS MATERIALIZED (SELECT event_id, ts, user_id, {entropy('t')} AS entropy, len(regexp_extract_all(t,'[^\\p{{L}}\\p{{N}}]'))/length(t) AS special, 0.0 AS encoded, length(t)::DOUBLE AS len,
  CASE WHEN lag(ts) OVER w IS NULL THEN 1.0 ELSE 1.0/greatest((epoch_us(ts)-epoch_us(lag(ts) OVER w))/1e6,1e-6) END AS qps FROM (SELECT *, {T} AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
mx0 AS MATERIALIZED (SELECT *, list([qps,entropy,special,encoded,len]) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS pts FROM ep),
mx AS MATERIALIZED (SELECT event_id, user_id, len(pts) AS n_points, list_concat(list_transform(range(16-len(pts)), lambda i: [0.0,0.0,0.0,0.0,0.0]), pts) AS m FROM mx0),
se0 AS (SELECT event_id, list_transform(m, lambda p: p[2]) AS x, list_transform(m, lambda p: p[1]) AS r FROM mx),
se1 AS MATERIALIZED (SELECT *, list_transform(range(1,17), lambda i: list_sum(list_slice(x, greatest(i-2,1)::BIGINT, least(i+1,16)::BIGINT))/4) AS trend FROM se0),
se AS (SELECT *, list_sum(list_transform(range(1,17), lambda i: abs(x[i]-trend[i])))/16 AS resid, trend[16]-trend[1] AS slope, list_sum(r)/16 AS qps_mean FROM se1)"""
ROLL = "rl AS (SELECT *, avg(reward) OVER (ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS avg30, avg(reward) OVER (ORDER BY seq ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS avg40, count(*) OVER (ORDER BY seq ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS n40 FROM fb)"
ETIER = "CASE WHEN ('0x'||substr(md5(user_id::VARCHAR),1,8))::BIGINT%100<10 THEN 'canary' WHEN ('0x'||substr(md5(user_id::VARCHAR),1,8))::BIGINT%100<15 THEN 'shadow' ELSE 'stable' END"


def fold(lo, hi):
    return f"list_reduce(list(d ORDER BY seq), lambda a, x: least({hi}::DOUBLE, greatest({lo}::DOUBLE, a+x)), "


SQL = {
    "fea_qps_slot": "SELECT event_id, user_id, round(CASE WHEN p IS NULL THEN 1.0 ELSE 1.0/greatest((epoch_us(ts)-epoch_us(p))/1e6,1e-6) END,8) AS qps FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)",
    "win_source_buffer": f"WITH {PTS} SELECT event_id, user_id, n_points, " + ", ".join(f"round(list_sum(list_transform(m, lambda p: p[{i + 1}])),4) AS sum{i}" for i in range(1, 5)) + ", round(m[1][5],4) AS oldest_len FROM mx",
    "win_moving_average": f"WITH {PTS} SELECT event_id, " + ", ".join(f"round(trend[{i + 1}],5) AS t{i}" for i in (0, 1, 7, 14, 15)) + " FROM se",
    "win_trend_residual": f"WITH {PTS} SELECT event_id, round(resid,5) AS resid, round(slope,5) AS slope, round(qps_mean,5) AS qps_mean FROM se",
    "sco_dlinear": f"WITH {PTS} SELECT event_id, round(1/(1+exp(-(resid*2+abs(slope)+qps_mean*0.1))),5) AS anom FROM se",
    "win_reward_avg": FB("SELECT seq, round(avg30,6) AS avg30 FROM rl", ROLL),
    "str_rollback": FB("SELECT seq, round(avg30,6) AS avg30 FROM rl WHERE n40>=15 AND round(avg30,6)<=0.8", ROLL),
    "str_promote": FB("SELECT seq//1000 AS block, count(*) AS eligible, min(seq) AS first_seq FROM rl WHERE tier='canary' AND n40>=40 AND round(avg30,6)>=0.15 AND round(avg40,6)>=0.15 GROUP BY 1", ROLL),
    "win_reward_history": FB("SELECT seq, row_number() OVER (ORDER BY seq) AS episode, reward FROM (SELECT * FROM fb ORDER BY seq DESC LIMIT 100)"),
    "win_lru_evict": "SELECT vec_id, label, vec_id%7 AS hits FROM embeddings ORDER BY hits DESC, vec_id DESC LIMIT 100",
    "win_round_robin": "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) ORDER BY rn, lang LIMIT 50",
    "win_technique_counter": with_payloads(
        "SELECT template, row_id, n, row_number() OVER (ORDER BY row_id, template) AS num FROM (SELECT template, min(row_id) AS row_id, count(*) AS n FROM (SELECT row_id, unnest(list_distinct(list_filter(" + TPL
        + ", lambda t: t IS NOT NULL))) AS template FROM dd WHERE label<>'Normal') WHERE template NOT IN (" + ",".join(f"'{t}'" for t in KNOWN_TEMPLATES) + ") GROUP BY 1)", DEPTH),
    "win_session_gap": "SELECT user_id, burst, count(*) AS n, min(ts) AS start_ts, max(ts) AS end_ts FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS burst FROM (SELECT *, (p IS NULL OR epoch_us(ts)-epoch_us(p)>21600000000)::INT AS nw FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))) GROUP BY 1,2",
    "ml_online_threshold": FB("SELECT label, round(" + fold(0.2, 0.95) + "0.38::DOUBLE),6) AS threshold FROM (SELECT seq, CASE WHEN reward<0 THEN true_label ELSE predicted END AS label, CASE WHEN reward<0 THEN -0.025 ELSE 0.005 END::DOUBLE AS d FROM fb) GROUP BY 1"),
    "fea_weight_update": FB("SELECT feature, round(" + fold(0.01, 2.0) + "0.5::DOUBLE),6) AS weight FROM (SELECT seq, 'f_'||(seq%15) AS feature, reward*0.05 AS d FROM fb) GROUP BY 1"),
    "str_traffic_tier": f"SELECT user_id, count(*) AS n, any_value({ETIER}) AS tier FROM events GROUP BY 1",
    "jn_policy_thresholds": FB("SELECT seq, fb.tier, fb.predicted, threshold::DOUBLE AS threshold FROM fb JOIN po ON po.tier=fb.tier AND po.predicted=fb.predicted", f"po(tier,predicted,threshold) AS ({values(POLICY)})"),
    "jn_policy_asof": f"WITH e AS (SELECT *, {ETIER} AS tier FROM events), h AS (SELECT tier, date_trunc('day',ts)+INTERVAL 1 DAY AS valid_from, round(0.38-0.1*avg((event_type='error')::INT),6) AS threshold FROM e GROUP BY 1,2) SELECT event_id, e.tier, h.threshold FROM e ASOF LEFT JOIN h ON e.tier=h.tier AND e.ts>=h.valid_from",
    "str_freeze": FB("SELECT tier, 'stable' AS served, count(*) AS observed, 0::BIGINT AS applied FROM fb GROUP BY 1"),
    "str_policy_audit": FB("SELECT tier, count(*) AS episodes, max(seq) AS last_seq, arg_max(predicted,seq) AS last_predicted, arg_max(true_label,seq) AS last_label, round(avg(reward),4) AS avg_reward FROM fb GROUP BY 1"),
}
