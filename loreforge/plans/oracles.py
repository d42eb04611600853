"""DuckDB SQL that gives the rows of the registered queries."""

from functools import reduce

from ..functions.text import PATTERNS

_TOK = r"tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS w FROM documents)"
_TF = _TOK + ", tf AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"


def _queries(sql):
    return r"q AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> ''))) AS term FROM (" + sql + "))"


_BENCH = "SELECT item_id AS query_id, text FROM benchmark"
_QA = "SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER o AS next, lead(text) OVER o AS answer FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant'"


def _top(cte, key, item, k, score="score"):
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {score} DESC, {item}) AS rank FROM {cte}) WHERE rank <= {k}"


def _bm25(queries, k):
    return f"""{_TF}, {_queries(queries)}, dl AS (SELECT doc_id, len(w) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS m FROM dl),
 sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / m))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL), bm AS ({_top('sc', 'query_id', 'doc_id', k)})"""


_TFIDF = "ti0 AS (SELECT query_id, doc_id, round(sum((1 + ln(tf)) * ln((SELECT count(*) FROM documents)::DOUBLE / df)), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) GROUP BY ALL), ti AS (" + _top("ti0", "query_id", "doc_id", 10) + ")"
_TERMS = _TF + ", w AS (SELECT doc_id, term, round(tf * ln((SELECT count(*) FROM documents)::DOUBLE / df), 6) AS weight FROM tf JOIN df USING (term)), tt AS (" + _top("w", "doc_id", "term", 5, "weight") + ")"
_NEAR = _TOK + r""", m AS (SELECT doc_id, coalesce(array_to_string(w, ' '), '') AS line, w FROM tok), c AS (SELECT doc_id, min(doc_id) OVER o AS class_id, count(*) OVER o AS class_size FROM m WINDOW o AS (PARTITION BY line)),
 l AS (SELECT line, any_value(w) AS w, min(doc_id) AS id FROM m WHERE line <> '' GROUP BY 1),
 s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 5 THEN [line] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM l), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.id < y.id GROUP BY ALL),
 near AS (SELECT a, b, round(c::DOUBLE / (u.n + v.n - c), 6) AS score FROM p JOIN n u ON u.id = a JOIN n v ON v.id = b WHERE c::DOUBLE / (u.n + v.n - c) >= 0.8)"""


def _knn(where):
    return f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT *, sqrt(list_inner_product(e, e)) AS r FROM v),
 sc AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_inner_product(q.e, d.e) / (q.r * d.r), 6) AS score FROM u q JOIN u d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0 AND {where}),
 kn AS ({_top('sc', 'query_id', 'vec_id', 10)})"""


_LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), rep AS (SELECT line, count(DISTINCT doc_id) AS n_docs FROM ln WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2)"
_SESSIONS = "WITH a AS (SELECT *, CASE WHEN ts <= lag(ts) OVER o + INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM b GROUP BY user_id, s"
_USAGE = "event_type, count(*) AS n, round(sum(value), 4) AS value"

ORACLES = {
    "k01_load": "SELECT conv_id, turn, role, text FROM conversations",
    "k02_canonical_pages": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS u FROM pages),
 b AS (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/]*')), '^(www|m)\.', '') || regexp_replace(u, '^[^/]*', ''), '/$', '') AS key FROM a) SELECT key, min(page_id) AS page_id, count(*) AS n_pages FROM b GROUP BY 1""",
    "k03_page_text": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages""",
    "k04_page_links": """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""",
    "k05_catalogue": "SELECT lang, source, grouping(lang, source)::BIGINT AS level, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY CUBE (lang, source)",
    "k06_find_docs": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src1' AND n_chars >= 100 ORDER BY n_chars DESC, doc_id LIMIT 20",
    "k07_length_stats": "SELECT lang, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, count(*) AS n_docs FROM documents GROUP BY 1",
    "k08_quality_measures": f"WITH {_TOK}, " + r"""l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines, text FROM documents)
 SELECT doc_id, len(w)::BIGINT AS n_tokens, round(length(array_to_string(w, ''))::DOUBLE / nullif(len(w), 0), 6) AS mean_token_length, round(1 - length(regexp_replace(text, '[^\p{L}]', '', 'g'))::DOUBLE / nullif(length(text), 0), 6) AS non_letter_share,
 round(1 - len(list_distinct(lines))::DOUBLE / nullif(len(lines), 0), 6) AS repeated_line_share FROM tok JOIN l USING (doc_id)""",
    "k09_find_pii": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(regexp_extract_all(text, '{p}'))::BIGINT AS n FROM documents" for k, p in PATTERNS.items()) + ") WHERE n > 0",
    "k10_mask_pii": "SELECT doc_id, " + reduce(lambda text, kind: f"regexp_replace({text}, '{PATTERNS[kind]}', '<{kind}>', 'g')", PATTERNS, "text") + " AS text FROM documents",
    "k11_repeated_lines": f"WITH {_LINES} SELECT * FROM rep",
    "k12_drop_repeated_lines": f"WITH {_LINES}, k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM ln WHERE line NOT IN (SELECT line FROM rep) GROUP BY 1) SELECT doc_id, coalesce(k.text, '') AS text FROM documents d LEFT JOIN k USING (doc_id)",
    "k13_exact_duplicates": "SELECT md5(text) AS digest, count(*) AS n_docs, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "k14_near_duplicates": f"WITH {_NEAR} SELECT * FROM near",
    "k14_near_duplicate_classes": f"WITH {_NEAR}, k AS (SELECT id, count(*) AS n_links FROM (SELECT a AS id FROM near UNION ALL SELECT b FROM near) GROUP BY 1) SELECT doc_id, class_id, class_size, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN k ON k.id = class_id",
    "k16_duplicate_clusters": f"""WITH RECURSIVE {_NEAR}, e AS (SELECT a, b FROM near UNION SELECT b, a FROM near), r(node, other) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
 t AS (SELECT node, least(node, min(other)) AS cluster FROM r GROUP BY node) SELECT doc_id AS node, coalesce(cluster, class_id) AS cluster FROM c LEFT JOIN t ON t.node = class_id WHERE class_size > 1 OR cluster IS NOT NULL""",
    "k17_contains_passage": "SELECT item_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "k18_chunk": r"""WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT doc_id, w, unnest(range(0, (len(w) + 199) // 200)) AS c FROM a)
 SELECT doc_id, c::BIGINT AS chunk_no, len(w[c*200+1:c*200+250])::BIGINT AS n_tokens, array_to_string(w[c*200+1:c*200+250], ' ') AS text FROM b""",
    "k19_postings": f"WITH {_TOK}, e AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM tok) SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM e GROUP BY ALL",
    "k20_term_stats": f"WITH {_TF}, st AS (SELECT count(*) AS n, round(avg(len(w)), 6) AS mean_length FROM tok) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, any_value(n) AS n, any_value(mean_length) AS mean_length FROM tf, st GROUP BY 1",
    "k21_write_index": f"WITH {_TF} SELECT substr(md5(term), 1, 1) AS bucket, count(DISTINCT term) AS n_terms, count(*) AS n_postings FROM tf GROUP BY 1",
    "k22_boolean_search": f"WITH {_TF} SELECT doc_id FROM tf WHERE term = 'the' INTERSECT SELECT doc_id FROM tf WHERE term IN ('tion', 'this', 'that') EXCEPT SELECT doc_id FROM tf WHERE term = 'was'",
    "k23_bm25": f"WITH {_bm25(_BENCH, 10)} SELECT * FROM bm",
    "k24_top_terms": f"WITH {_TERMS} SELECT * FROM tt",
    "k25_phrase_search": f"WITH {_TOK}, e AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM tok) SELECT doc_id, count(*) AS n_matches, min(a.pos) AS first_pos FROM e a JOIN e b USING (doc_id) WHERE a.term = 'of' AND b.term = 'the' AND b.pos = a.pos + 1 GROUP BY 1",
    "k26_knn": f"WITH {_knn('true')} SELECT * FROM kn",
    "k28_knn_filtered": f"WITH {_knn('d.label = 3')} SELECT * FROM kn",
    "k29_fuse": f"WITH {_bm25(_BENCH, 10)}, {_TFIDF}, f AS (SELECT query_id, doc_id, round(sum(1::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM ti) GROUP BY ALL) {_top('f', 'query_id', 'doc_id', 10)}",
    "k30_similar_docs": f"WITH {_TERMS}, s AS (SELECT x.doc_id AS query_id, y.doc_id, round(sum(x.weight * y.weight), 4) AS score FROM tt x JOIN tt y USING (term) WHERE x.doc_id % 20 = 0 AND x.doc_id <> y.doc_id GROUP BY ALL) {_top('s', 'query_id', 'doc_id', 3)}",
    "k31_evaluate": f"""WITH {_bm25(_BENCH, 10)}, rel AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)), f AS (SELECT rel.*, rank FROM rel LEFT JOIN bm USING (query_id, doc_id)),
 m AS (SELECT round(avg(rr), 6) AS mrr FROM (SELECT query_id, coalesce(max(1::DOUBLE / rank), 0) AS rr FROM f GROUP BY 1)) SELECT k::BIGINT AS k, (SELECT round(count_if(rank <= k)::DOUBLE / count(*), 6) FROM f) AS recall, (SELECT mrr FROM m) AS mrr FROM (SELECT unnest([1, 5, 10]) AS k)""",
    "k32_label_rates": "SELECT source, count(*) AS n_docs, count(quality) AS n_labelled, round(avg(quality), 6) AS quality_rate, round(avg(toxic), 6) AS toxic_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "k33_unlabelled": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "k34_cooccurrence": f"""WITH {_TOK}, e AS (SELECT DISTINCT doc_id, unnest(w) AS t FROM tok), m AS (SELECT count(*) AS total FROM documents),
 c AS (SELECT t, count(*) AS c FROM e GROUP BY 1 HAVING count(*) >= 0.1 * (SELECT total FROM m)), f AS (SELECT doc_id, t, c FROM e JOIN c USING (t)),
 p AS (SELECT x.t AS a, y.t AS b, any_value(x.c) AS ca, any_value(y.c) AS cb, count(*) AS n FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.t < y.t GROUP BY x.t, y.t)
 SELECT a, b, n, round(ln(n::DOUBLE * total / (ca::DOUBLE * cb)), 6) AS pmi FROM p, m WHERE n >= 0.1 * total""",
    "k35_centroids": "SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL",
    "k36_knn_label": f"WITH {_knn('true')}, t AS (SELECT query_id, label, count(*) AS votes FROM kn JOIN embeddings e ON kn.vec_id = e.vec_id GROUP BY ALL) SELECT query_id, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS n FROM t) WHERE n = 1",
    "k38_threads": "SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1",
    "k39_qa_pairs": _QA,
    "k40_retrieve_for_turns": f"WITH {_bm25(f'SELECT conv_id * 1000 + turn AS query_id, question AS text FROM ({_QA}) WHERE conv_id % 20 = 0', 3)} SELECT * FROM bm",
    "k41_usage_tumbling": f"SELECT time_bucket(INTERVAL 1 hour, ts) AS start, {_USAGE} FROM events GROUP BY 1, 2",
    "k42_usage_sliding": f"SELECT time_bucket(INTERVAL 1 hour, ts) - INTERVAL 1 hour * k AS start, {_USAGE} FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2",
    "k43_sessions": _SESSIONS,
    "k44_running_usage": "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS running, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS rank FROM events",
    "k45_funnel": "WITH u AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS v, max(ts) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1) SELECT count(*) AS users, count(v) AS viewed, count_if(p > v)::BIGINT AS bought_after FROM u",
    "k46_usage_by_prop": "SELECT json_extract_string(props, '$.k') AS prop, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1",
    "k48_stream_usage": "SELECT * FROM (SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 1 hour",
    "k49_stream_sessions": f"SELECT user_id, start, n FROM ({_SESSIONS}) WHERE last + INTERVAL 30 minutes <= (SELECT max(ts) FROM events) - INTERVAL 1 hour",
    "k51_stream_view_purchase": "SELECT v.user_id, v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL 6 hours WHERE v.event_type = 'view' AND p.event_type = 'purchase'",
    "k50_stream_dedup": """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
 nx AS (SELECT a.event_id, min(b.n) AS after FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts > a.ts + INTERVAL 1 hour GROUP BY 1),
 r(event_id, user_id, event_type, ts) AS (SELECT event_id, user_id, event_type, ts FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.ts FROM r JOIN nx ON nx.event_id = r.event_id JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.n = nx.after)
 SELECT event_id, user_id, event_type, ts FROM r WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 1 hour""",
    "k52_stream_user_state": """WITH a AS (SELECT *, CASE WHEN ts <= lag(ts) OVER o + INTERVAL 1 day THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
 b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a), c AS (SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, round(sum(value), 4) AS value FROM b GROUP BY user_id, s)
 SELECT * FROM c WHERE last + INTERVAL 1 day < (SELECT max(ts) FROM events) - INTERVAL 1 hour""",
    "k53_stream_index": f"WITH {_TF} SELECT term, doc_id, tf FROM tf",
    "k54_register_fn": "SELECT doc_id, len(regexp_extract_all(text, '[aeiouAEIOU]'))::BIGINT AS n_vowels FROM documents",
    "k55_register_table_fn": "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents",
    "k56_register_agg": "SELECT user_id, round(max(value) - min(value), 6) AS value_range FROM events GROUP BY 1",
}
