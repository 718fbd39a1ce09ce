"""DuckDB batch twins of streaming queries."""

from oracles.base import with_payloads, with_requests
from oracles.decide import decided
from oracles.decompose import QP
from oracles.evaluate import FB, P, ratio
from oracles.label import CLUSTER, RT
from oracles.windows import PTS
from paysieve.functions import rules as R

NORMAL = "'Normal'"
EDGE = "(SELECT date_trunc('millisecond',max(ts)) - INTERVAL 10 MINUTE FROM events)"


def automaton(feeds, reviewed, frozen):
    """The policy batch by batch: one group of CTEs a batch, state s<k> before and s<k+1> after it."""
    ctes = [f"fd AS MATERIALIZED (SELECT *, CASE WHEN predicted=true_label THEN 1.0 WHEN predicted<>'Normal' AND true_label<>'Normal' THEN -0.5 ELSE -1.0 END::DOUBLE AS reward FROM (SELECT row_id AS seq, e, ('0x'||substr(md5(src),1,8))::BIGINT%100 AS b, "
            f"CASE WHEN e={reviewed} THEN pred0 ELSE pred END AS predicted, label AS true_label FROM (SELECT *, row_id*{feeds}//(SELECT max(row_id)+1 FROM pr) AS e FROM pr)) WHERE e<>{reviewed} OR predicted<>true_label)",
            f"s0 AS (SELECT unnest({list(R.LABELS)}) AS label, 0.38::DOUBLE AS canary, 0.38::DOUBLE AS stable, 0.38::DOUBLE AS snapshot, 10::BIGINT AS share, 0::BIGINT AS episodes, 0::BIGINT AS promotions, 0::BIGINT AS rollbacks, []::DOUBLE[] AS ring, '' AS event, 0.0 AS avg30)"]
    for k in range(feeds):
        on = "true" if k < frozen else "false"
        ctes += [
            f"a{k} AS MATERIALIZED (SELECT share, list_concat(ring, l) AS ring, n, learned, observed FROM (SELECT share, any_value(ring) AS ring, coalesce(list(reward ORDER BY seq) FILTER (seq IS NOT NULL), []) AS l, count(seq) AS n, count(*) FILTER ({on} AND b<share) AS learned, count(*) FILTER ({on} AND (b<share OR b>=share+5)) AS observed FROM (SELECT DISTINCT share, ring FROM s{k}) LEFT JOIN fd ON e={k} GROUP BY 1))",
            f"d{k} AS (SELECT CASE WHEN reward<0 THEN true_label ELSE predicted END AS label, list(CASE WHEN reward<0 THEN -0.025 ELSE 0.005 END::DOUBLE ORDER BY seq) AS ds FROM fd, a{k} WHERE e={k} AND {on} AND b<share GROUP BY 1)",
            f"f{k} AS (SELECT s.label, stable, snapshot, s.share, episodes+n AS episodes, promotions, rollbacks, a.ring, learned, observed, list_avg(a.ring[-30:]) AS avg30, list_avg(a.ring[-40:]) AS avg40, "
            f"list_reduce(coalesce(ds,[]), lambda c, x: least(0.95::DOUBLE, stable+0.08, greatest(0.2::DOUBLE, stable-0.08, c+x)), canary) AS v FROM s{k} s CROSS JOIN a{k} a LEFT JOIN d{k} d ON d.label=s.label)",
            f"s{k + 1} AS MATERIALIZED (SELECT label, CASE event WHEN 'rollback' THEN snapshot ELSE v END AS canary, CASE event WHEN 'promote' THEN v WHEN 'rollback' THEN snapshot ELSE stable END AS stable, CASE event WHEN 'promote' THEN stable ELSE snapshot END AS snapshot, "
            "CASE event WHEN 'promote' THEN least(50, share+5) ELSE share END AS share, episodes, promotions+(event='promote')::BIGINT AS promotions, rollbacks+(event='rollback')::BIGINT AS rollbacks, ring, event, avg30 FROM (SELECT *, "
            f"CASE WHEN learned>0 AND len(ring)>=40 AND avg30>=0.15 AND avg40>=0.15 THEN 'promote' WHEN observed>0 AND len(ring)>=15 AND avg30<=-0.25 THEN 'rollback' WHEN learned>0 THEN 'learn' ELSE 'observe' END AS event FROM f{k}))"]
    out = "label, event, share, episodes, promotions, rollbacks, round(avg30,6) AS avg30, round(canary,6) AS canary, round(stable,6) AS stable, round(snapshot,6) AS snapshot"
    return P(" UNION ALL ".join(f"SELECT {k}::BIGINT AS batch, {out} FROM s{k + 1}" for k in range(feeds)), ", ".join(ctes))


SQL = {
    "str_policy_automaton": automaton(5, 2, 4),
    "str_dedupe": "SELECT substr(h,1,1) AS h, count(DISTINCT h) AS n FROM (SELECT substr(sha256(concat_ws('|',event_type,props)),1,16) AS h FROM events) GROUP BY 1",
    "str_rule_reload": with_payloads("SELECT version::BIGINT AS version, cluster, verdict, count(*) AS n FROM (SELECT row_id, v.version, r.label AS verdict, r.cluster FROM (SELECT *, (ts >= TIMESTAMP '2024-01-16 00:00:00')::INT AS version FROM payload_rows) v "
        "JOIN rv r ON r.version=v.version AND r.enabled AND regexp_matches(lower(payload),r.pattern) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY r.prio)=1) GROUP BY 1,2,3",
        RT + ", rv AS (SELECT 0 AS version, * FROM rt UNION ALL SELECT 1, prio, pattern, label, confidence, cluster, enabled AND prio<>1 FROM rt UNION ALL SELECT 1, 8, 'onerror(?:=|%3d)', 'XSS', 0.51, 'XSS:added', TRUE)"),
    "str_feedback_cycle": P(f"SELECT side, recall, fpr, recall>=0.995 AND fpr<=0.013 AS passed FROM (SELECT side, {ratio('count(*) FILTER (atk AND obf AND p<>' + NORMAL + ')', 'count(*) FILTER (atk AND obf)')} AS recall, {ratio('count(*) FILTER (NOT atk AND p<>' + NORMAL + ')', 'count(*) FILTER (NOT atk)')} AS fpr FROM sd GROUP BY 1)",
                            f"cl AS (SELECT *, {CLUSTER} AS c FROM pr), lc AS (SELECT DISTINCT c FROM cl WHERE atk AND pred0='Normal'), sd AS (SELECT atk, obf, 'before' AS side, pred0 AS p FROM cl UNION ALL SELECT atk, obf, 'after', CASE WHEN atk AND c IN (SELECT c FROM lc) THEN label ELSE pred0 END FROM cl)"),
    "str_detect": decided("SELECT row_id, fin_label AS pred FROM dc WHERE fin_mal", "fin_label", "fin_mal"),
    "str_source_state": f"WITH {PTS} SELECT se.event_id, mx.user_id, n_points, round(1/(1+exp(-(resid*2+abs(slope)+qps_mean*0.1))),5) AS anom FROM se JOIN mx USING (event_id)",
    "str_windowed_stats": f"SELECT date_trunc('hour',ts) AS win_start, event_type, count(*) AS n, round(avg(value),4) AS mean_value FROM events GROUP BY 1,2 HAVING date_trunc('hour',ts)+INTERVAL 1 HOUR <= {EDGE}",
    "str_session_bursts": f"SELECT user_id, start_ts, end_ts, n FROM (SELECT user_id, b, min(ts) AS start_ts, max(ts)+INTERVAL 30 MINUTE AS end_ts, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM (SELECT *, (p IS NULL OR epoch_us(ts)-epoch_us(p)>=1800000000)::INT AS nw FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))) GROUP BY 1,2) WHERE end_ts <= {EDGE}",
    "str_adaptive_feedback": FB("SELECT label, count(*) AS episodes, round(list_reduce(list(d ORDER BY seq), lambda a, x: least(0.46::DOUBLE, greatest(0.30::DOUBLE, a+x)), 0.38::DOUBLE),6) AS threshold FROM (SELECT seq, CASE WHEN reward<0 THEN true_label ELSE predicted END AS label, CASE WHEN reward<0 THEN -0.025 ELSE 0.005 END::DOUBLE AS d FROM fb WHERE tier='canary') GROUP BY 1"),
    "udtf_parts": with_requests("SELECT req_id, 'query' AS location, k AS field, replace(v,chr(0),'<NUL>') AS raw FROM qp", QP),
}
