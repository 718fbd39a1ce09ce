"""DuckDB text for memory and retrieval."""

from oracles.base import with_payloads
from oracles.decide import infer
from oracles.evaluate import MRAW

MEM = "me AS (SELECT vec_id, embedding::DOUBLE[] AS v, label::VARCHAR AS label FROM embeddings WHERE vec_id%10<3)"
NN = MEM + ", nn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, mid) AS rank FROM (SELECT q.vec_id AS qid, m.vec_id AS mid, m.label, round(list_dot_product(q.embedding::DOUBLE[], m.v),9) AS sim FROM embeddings q CROSS JOIN me m WHERE q.vec_id%10>=3))"
CH = "sc AS (SELECT q.vec_id AS qid, c.vec_id AS chunk_id, 'c'||(c.label%4) AS category, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]),9) AS sim FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id%50=0)"
MD = "md AS (SELECT doc_id, replace(text,chr(10),chr(10)||'## ') AS text FROM documents)"
WS = "' '||chr(10)||chr(13)||chr(9)"
PARTS = MD + ", pt AS (SELECT doc_id, unnest(range(0,len(l))) AS part, unnest(l) AS t0 FROM (SELECT doc_id, list_transform(string_split(text,chr(10)||'## '), lambda x, i: CASE WHEN i>1 THEN '## '||x ELSE x END) AS l FROM md))"
CORPUS = ("co AS (SELECT 'doc:'||doc_id AS chunk_id, CASE WHEN source IN ('src0','src1') THEN 'community' WHEN lang='en' THEN 'literature' ELSE 'dataset' END AS category, text AS chunk FROM documents "
          "UNION ALL SELECT 'page:'||page_id, 'architecture', html FROM pages UNION ALL SELECT 'miss:'||row_id, 'miss_pattern', payload FROM mr)")

SQL = {
    "udf_encoder": "SELECT lang, count(*) AS n, round(avg(384),1) AS dim FROM documents GROUP BY 1",
    "str_feedback_memory": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
      b AS (SELECT 0 AS batch, vec_id, v FROM e WHERE vec_id%10 BETWEEN 3 AND 6 UNION ALL SELECT 1, vec_id, v FROM e WHERE vec_id%10>=7 UNION ALL SELECT 1, vec_id+1000000, v FROM e WHERE vec_id%10=3),
      s0 AS (SELECT q.batch, q.vec_id, q.v, m.vec_id AS mid, round(list_dot_product(q.v, m.v),9) AS sim FROM b q JOIN e m ON m.vec_id%10<3 WHERE q.batch=0),
      p0 AS MATERIALIZED (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, mid)=1),
      m1 AS (SELECT vec_id, v FROM e WHERE vec_id%10<3 UNION ALL SELECT vec_id, v FROM p0 WHERE sim<0.98),
      p1 AS (SELECT q.batch, q.vec_id, q.v, m.vec_id AS mid, round(list_dot_product(q.v, m.v),9) AS sim FROM b q CROSS JOIN m1 m WHERE q.batch=1 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY sim DESC, m.vec_id)=1)
      SELECT batch::BIGINT AS batch, CASE WHEN sim>=0.98 THEN 'update' ELSE 'insert' END AS action, count(*) AS n, sum(CASE WHEN sim>=0.98 THEN mid END)::BIGINT AS targets FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1) GROUP BY 1,2""",
    "rag_build_index": with_payloads("SELECT category, count(*) AS n, round(avg((length(chunk)>=3)::INT),4) AS mean_norm FROM co GROUP BY 1", MRAW + ", " + CORPUS),
    "jn_memory_knn": f"WITH {NN} SELECT qid, mid, label, round(sim,5) AS sim, rank FROM nn WHERE rank<=8",
    "udaf_class_vote": f"WITH {NN} SELECT qid, label, count(*) AS n, round(sum(exp(-5.0*(1-greatest(sim,0)))),5) AS score FROM nn WHERE rank<=8 GROUP BY 1,2",
    "jn_memory_exact": "WITH me AS (SELECT arg_min(lang,doc_id) AS stored, trim(text) AS t FROM (SELECT * FROM documents WHERE doc_id%10<3) GROUP BY 2) SELECT doc_id, stored FROM documents JOIN me ON trim(text)=t WHERE doc_id%10>=3",
    "jn_near_duplicate": f"WITH {NN} SELECT qid, CASE WHEN sim>=0.55 THEN 'update' ELSE 'insert' END AS action, CASE WHEN sim>=0.55 THEN mid END AS target, round(sim,5) AS sim FROM nn WHERE rank=1",
    "agg_memory_stats": "SELECT sum(n)::BIGINT AS size, string_agg(label||'='||n,',' ORDER BY label||'='||n) AS by_label, sum(v)::BIGINT AS n_values FROM (SELECT label, count(*) AS n, sum(len(embedding)) AS v FROM embeddings WHERE vec_id%10<3 GROUP BY 1)",
    "ml_encoder_guard": "SELECT label, count(*) AS n FROM embeddings WHERE vec_id%5<>0 AND len(embedding)=64 GROUP BY 1",
    "snk_memory_table": "SELECT label, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings WHERE vec_id%5<>0 AND len(embedding)=64 GROUP BY 1",
    "jn_retrieve": f"WITH {CH}, pc AS (SELECT *, row_number() OVER (PARTITION BY qid, category ORDER BY sim DESC, chunk_id) AS r FROM sc), pk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, chunk_id) AS rank FROM pc WHERE r<=2) SELECT qid, chunk_id, category, round(sim,5) AS sim, rank FROM pk WHERE rank<=5",
    "rag_context": f"WITH {CH}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, chunk_id) AS rank FROM sc), b AS (SELECT qid, rank, '['||rank||' '||category||'] '||substr(text,1,800) AS block FROM k JOIN documents ON doc_id=chunk_id WHERE rank<=6), u AS (SELECT *, sum(length(block)) OVER (PARTITION BY qid ORDER BY rank) AS used FROM b) SELECT qid, string_agg(block,chr(10) ORDER BY rank) AS context FROM u WHERE used<=3500 GROUP BY 1",
    "rag_chunk_headings": f"WITH {PARTS}, t AS (SELECT doc_id, part, trim(t0,{WS}) AS t FROM pt) SELECT doc_id, part, trim(ltrim(string_split(t,chr(10))[1],'#')) AS title, length(t) AS n_chars FROM t WHERE length(t)>=80",
    "rag_chunk_catalog": f"WITH {PARTS}, t AS (SELECT doc_id, part, t0, lower(regexp_extract(t0,'^##\\s+([A-Za-z0-9_]+)',1)) AS name FROM pt) SELECT doc_id, part, name, length(trim(t0)) AS n_chars FROM t WHERE name<>'' AND length(trim(t0))>=40",
    "rag_chunk_misses": with_payloads(f"SELECT row_id, 'miss true='||label||' pred='||({infer('payload')})||' source='||source||chr(10)||'payload: '||payload AS chunk FROM mr", MRAW),
    "rag_collect": with_payloads("SELECT chunk_id, category, length(chunk) AS n_chars FROM co", MRAW + ", " + CORPUS),
    "rag_stats": with_payloads("SELECT category, count(*) AS n FROM co GROUP BY 1", MRAW + ", " + CORPUS),
    "rag_miss_query": with_payloads("""SELECT qid, chunk_id, category, round(sim,3) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, chunk_id) AS rank FROM
      (SELECT q.id AS qid, d.id AS chunk_id, any_value(lang) AS category, round(sum(q.w*d.w),9) AS sim FROM vv q JOIN vv d ON q.kind='q' AND d.kind='d' AND q.bucket=d.bucket JOIN documents ON doc_id=d.id GROUP BY 1,2)) WHERE rank<=6""",
      MRAW + """, qt AS (SELECT list_position(['Normal','SQLi','XSS','CMD','PathTraversal','FileInclusion','XXE','PromptInjection'],label)::BIGINT AS id, label||' '||string_agg(payload,' ' ORDER BY row_id) AS t FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_id) AS rn FROM mr) WHERE rn<=3 GROUP BY label),
      al AS (SELECT 'q' AS kind, id, lower(t) AS l FROM qt UNION ALL SELECT 'd', doc_id, lower(text) FROM documents),
      tri AS (SELECT kind, id, substr(l,i::BIGINT,3) AS tok, 1.0 AS w FROM (SELECT *, unnest(range(1,length(l)-1)) AS i FROM al) UNION ALL SELECT kind, id, tok, 0.5 FROM (SELECT kind, id, unnest(regexp_extract_all(l,'[^\\s]+')) AS tok FROM al) WHERE length(tok)>=3),
      bb AS (SELECT kind, id, ('0x'||substr(md5(tok),1,8))::BIGINT%384 AS bucket, sum(w)::DOUBLE AS w FROM tri GROUP BY 1,2,3), vv AS MATERIALIZED (SELECT kind, id, bucket, (w/sqrt(sum(w*w) OVER (PARTITION BY kind, id)))::FLOAT::DOUBLE AS w FROM bb)"""),
}
