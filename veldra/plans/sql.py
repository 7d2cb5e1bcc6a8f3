"""SQL that gives the same rows as the registered queries, for an independent engine.

Its regular expressions know no look-around, so word edges are written with ``\\b``.
"""

from __future__ import annotations

from veldra.functions.text import STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[A-Za-zÅÄÖåäö][A-Za-zÅÄÖåäö0-9''\-]+')"


def _content(text: str) -> str:
    return f"list_filter(list_distinct(list_transform({_WORDS.format(text)}, lambda w: lower(w))), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))"


def _rare(text: str) -> str:
    return f"list_distinct(list_transform(list_filter({_WORDS.format(text)}, lambda w: length(w) >= 7 OR (regexp_matches(w, '^[A-ZÅÄÖ]') AND length(w) >= 4)), lambda w: lower(w)))"


def _numbers(text: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all(coalesce({text}, ''), '\b\d+[.,]?\d*\b'), lambda x: replace(x, ',', '.')))"


_GAP = "'(\\d)[   ](\\d)', '\\1\\2', 'g'"


def _tokens(text: str) -> str:
    joined = f"regexp_replace(regexp_replace(coalesce({text}, ''), {_GAP}), {_GAP})"
    return rf"regexp_extract_all(lower(regexp_replace({joined}, '(\d),(\d{{3}}\b)', '\1\2', 'g')), '§|[\p{{L}}\p{{N}}_]+')"


def _unit(v: str) -> str:
    n = f"sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[]))"
    return f"list_transform({v}::DOUBLE[], lambda x: x / CASE WHEN {n} = 0 THEN 1 ELSE {n} END)"


_QUESTIONS = f"q AS (SELECT item_id AS qid, b.text AS question, {_unit('embedding')} AS qv FROM benchmark b JOIN embeddings ON vec_id = item_id)"
_CHUNKS = f"""c AS (
  SELECT doc_id AS idx, text, {_unit('embedding')} AS v, source AS statute_name, 'file' || (doc_id // 10) AS source_file,
    CASE WHEN doc_id % 10 < 7 THEN lang ELSE '' END AS chapter,
    CASE WHEN doc_id % 10 IN (3, 4, 5) THEN 'split section ' || (doc_id // 10) ELSE substring(text, 1, 60) END AS section_title,
    CASE WHEN doc_id % 10 IN (3, 4, 5) THEN '7' WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id % 50 AS VARCHAR) END AS section_number,
    CASE WHEN doc_id % 10 IN (3, 4, 5) THEN 3 ELSE 1 END AS part_total, doc_id % 7 = 0 AS is_superseded
  FROM documents JOIN embeddings ON doc_id = vec_id)"""
_SIM = "sim AS (SELECT qid, idx, list_dot_product(v, qv) AS similarity FROM q, c)"


def _top(source: str, score: str, k: int, by: str = "qid", tie: str = "idx") -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, {tie}) - 1 AS INT) AS rank FROM {source} QUALIFY rank < {k}"


def _bm25(corpus: str) -> str:
    """CTEs post, stats, idf and bm (scores) over ``corpus(idx, text)``."""
    return f"""tok AS MATERIALIZED (SELECT idx, {_tokens('text')} AS t FROM {corpus}),
w AS (SELECT idx, len(t) AS dl, unnest(t) AS token FROM tok),
post AS MATERIALIZED (SELECT token, idx, dl, count(*) AS tf FROM w GROUP BY ALL),
stats AS MATERIALIZED (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
raw AS MATERIALIZED (SELECT token, count(*) AS df, ln((SELECT n FROM stats) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY token),
idf AS MATERIALIZED (SELECT token, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT qid, token, count(*) AS qtf FROM (SELECT qid, unnest({_tokens('question')}) AS token FROM q) GROUP BY ALL),
bm AS MATERIALIZED (SELECT qid, idx, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM stats)))) AS bm25_score
       FROM qt JOIN idf USING (token) JOIN post USING (token) GROUP BY ALL),
pool AS (SELECT qid, idx, round(bm25_score, 9) AS bm25_score FROM bm
         UNION ALL SELECT q.qid, f.idx, 0.0 FROM q, (SELECT idx FROM {corpus} ORDER BY idx LIMIT 60) f ANTI JOIN bm ON bm.qid = q.qid AND bm.idx = f.idx)"""


_EDGES = """pos AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY idx) AS pos, row_number() OVER (PARTITION BY source_file, chapter ORDER BY idx) AS cpos FROM nodes),
part AS (SELECT a.idx AS a, b.idx AS b, 'part' AS etype FROM pos a JOIN pos b ON a.source_file = b.source_file AND a.section_title = b.section_title
         AND a.section_number = b.section_number AND a.idx < b.idx AND a.part_total > 1 AND b.part_total > 1),
sib AS (SELECT a.idx AS a, b.idx AS b, 'sibling' AS etype FROM pos a JOIN pos b ON a.source_file = b.source_file AND b.pos IN (a.pos + 1, a.pos + 2)),
cha AS (SELECT a.idx AS a, b.idx AS b, 'chapter' AS etype FROM pos a JOIN pos b ON a.source_file = b.source_file AND a.chapter = b.chapter AND a.chapter <> '' AND b.cpos IN (a.cpos + 1, a.cpos + 2)),
one AS (SELECT *, a AS turn FROM part UNION ALL SELECT *, a FROM sib UNION ALL SELECT *, a FROM cha UNION ALL SELECT *, b FROM cha),
seen AS (SELECT DISTINCT a, b FROM one),
sta AS (SELECT a.idx AS a, b.idx AS b, 'statute' AS etype, a.idx AS turn FROM pos a JOIN pos b ON a.source_file = b.source_file AND b.pos > a.pos
        ANTI JOIN seen ON seen.a = a.idx AND seen.b = b.idx QUALIFY row_number() OVER (PARTITION BY a.idx ORDER BY b.idx) <= 2),
allp AS (SELECT a, b, etype, turn FROM one UNION ALL SELECT a, b, etype, turn FROM sta),
edge AS (SELECT a AS src, b AS dst, etype, turn FROM allp UNION ALL SELECT b, a, etype, turn FROM allp),
adj AS (SELECT src, dst, etype, CAST(row_number() OVER (PARTITION BY src ORDER BY list_position(['part', 'sibling', 'chapter', 'statute'], etype), turn, dst) - 1 AS INT) AS rn FROM edge QUALIFY rn < 6)"""
_TALKS = "nodes AS (SELECT conv_id * 1000 + turn AS idx, CAST(conv_id AS VARCHAR) AS source_file, role AS chapter, 't' AS section_title, '1' AS section_number, CASE WHEN turn < 3 THEN 3 ELSE 1 END AS part_total FROM conversations)"
#: Two levels of expansion from seeds(qid, idx, ord) over adj.
_EXPAND = """s1 AS (SELECT qid, dst AS idx, idx AS seed, etype AS edge, ord, rn FROM seeds JOIN adj ON src = idx),
l1 AS (SELECT * FROM s1 ANTI JOIN seeds ON seeds.qid = s1.qid AND seeds.idx = s1.idx QUALIFY row_number() OVER (PARTITION BY s1.qid, s1.idx ORDER BY s1.ord, rn) = 1),
f1 AS (SELECT qid, idx, seed, edge, row_number() OVER (PARTITION BY qid ORDER BY ord, rn) AS ord FROM l1),
v1 AS (SELECT qid, idx FROM seeds UNION ALL SELECT qid, idx FROM f1),
s2 AS (SELECT qid, dst AS idx, seed, etype AS edge, ord, adj.rn FROM f1 JOIN adj ON src = idx),
l2 AS (SELECT * FROM s2 ANTI JOIN v1 ON v1.qid = s2.qid AND v1.idx = s2.idx QUALIFY row_number() OVER (PARTITION BY s2.qid, s2.idx ORDER BY s2.ord, rn) = 1),
reach AS (SELECT qid, idx, 0 AS distance, CAST(NULL AS VARCHAR) AS edge, idx AS seed FROM seeds UNION ALL SELECT qid, idx, 1, edge, seed FROM f1 UNION ALL SELECT qid, idx, 2, edge, seed FROM l2)"""
_NODES = "nodes AS (SELECT * FROM c)"
_HYBRID_GRAPH = f"""{_QUESTIONS}, {_CHUNKS}, {_SIM}, {_bm25('c')}, {_NODES}, {_EDGES},
ds AS ({_top('sim', 'similarity', 10)}), bs AS ({_top('pool', 'bm25_score', 10)}),
ei AS (SELECT coalesce(ds.qid, bs.qid) AS qid, coalesce(ds.idx, bs.idx) AS idx, ds.rank AS dr, bs.rank AS br FROM ds FULL JOIN bs ON ds.qid = bs.qid AND ds.idx = bs.idx),
seeds AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dr ASC NULLS LAST, br) AS ord FROM ei), {_EXPAND},
cand AS (SELECT r.*, similarity, coalesce(bm.bm25_score, 0) AS bm25_score FROM reach r JOIN sim ON sim.qid = r.qid AND sim.idx = r.idx LEFT JOIN bm ON bm.qid = r.qid AND bm.idx = r.idx),
fused AS (SELECT *, 1 / (60.0 + row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, idx) - 1) + 1 / (60.0 + row_number() OVER (PARTITION BY qid ORDER BY round(bm25_score, 9) DESC, idx) - 1) AS rrf_score FROM cand),
best AS ({_top('fused', 'round(rrf_score, 12)', 12)}),
hits AS (SELECT best.qid, best.rank, best.idx, similarity, bm25_score, CAST(coalesce(dr, -1) AS INT) AS dense_rank, CAST(coalesce(br, -1) AS INT) AS bm25_rank, rrf_score,
         distance AS graph_distance, edge AS graph_edge, seed AS graph_seed_origin FROM best LEFT JOIN ei ON ei.qid = best.qid AND ei.idx = best.idx)"""


def _fingerprint(hits: str, hybrid: bool) -> str:
    """Features of ``hits`` by grouping; ``hits`` is a CTE chain that also holds q and c."""
    optional = "" if hybrid else ", CAST(NULL AS DOUBLE) AS bm25_score, -1 AS dense_rank, -1 AS bm25_rank, CAST(NULL AS DOUBLE) AS rrf_score, CAST(NULL AS INT) AS graph_distance, CAST(NULL AS BIGINT) AS graph_seed_origin"
    g = "CASE WHEN graph THEN {0} ELSE 0 END"
    lex = "CASE WHEN len(qw) > 0 THEN {0} ELSE 0 END"
    share = lambda whole, part: f"CASE WHEN len({whole}) = 0 THEN 0 ELSE len(list_intersect({whole}, {part})) / len({whole}) END"
    jac = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"
    word = lambda p: rf"(?i)\b(?:{p})\b"
    base = {
        "top1_similarity": "s0", "top1_gap": "s0 - s1", "top1_dominance": "s0 - (ss - s0) / (k - 1)", "std_similarity": "sd", "sim_decay_slope": "slope",
        "softmax_entropy_norm": "ent / ln(k)", "top3_similarity_mass": "mass", "sim_gini": "greatest(0, least(1, gini))", "chunk_cohesion": "cohesion",
        "centroid_concentration": "conc", "max_pairwise_distance": "spread", "max_statute_share": "mx / k", "statute_switch_rate": "sw / (k - 1)", "n_unique_files": "files",
        "frac_section_number_present": "numbered", "total_context_chars": "chars", "question_token_count": r"len(regexp_extract_all(question, '\S+'))",
        "n_numbers": r"len(regexp_extract_all(question, '\S*\d\S*'))",
        "n_conditionals": f"len(regexp_extract_all(question, '{word('if|when|whether|depending|provided|unless|in\\s+case|jos|kun|mikäli|ellei')}'))",
        "has_statute_ref": f"regexp_matches(question, '(?i)§|{word('TVL|EPL|PerVL|AVL|EVL|laki')}')", "has_year": r"regexp_matches(question, '\b(?:19|20)\d{2}\b')",
        "numeric_question": "len(qn) > 0", "numeric_hit_coverage": "numhits", "numeric_overlap_ratio": share("qn", "nums"),
        "statute_ref_alignment": f"regexp_matches(question, '(?i)§|{word('TVL|EPL|PerVL|AVL|EVL|laki')}') AND marks", "confidence_x_focus": "s0 * mx / k",
        "title_token_jaccard_top1": lex.format("j1"), "title_token_jaccard_topk": lex.format("jk"), "title_token_coverage_topk": lex.format(share("qw", "tws")),
        "body_content_overlap_top1": lex.format("o1"), "body_content_overlap_topk": lex.format("ok"), "rare_term_recall": lex.format(share("rare", "bws")),
        "near_dup_share": "dups / k", "statute_diversity_norm": "files / k", "superseded_share": "old",
        "has_multipart_question": r"regexp_matches(question, '(?i)\?\s*[A-ZÅÄÖ]|\b(?:and|as well as|sekä)\b|\b;\s') OR len(regexp_extract_all(question, '\?')) > 1",
        "question_char_count": "length(question)", "has_currency_amount": r"regexp_matches(question, '(?i)€|\b(?:EUR|euro(?:a|ja|n)?)\b')", "n_question_marks": r"len(regexp_extract_all(question, '\?'))",
        "graph_is_graph_mode": "graph", "graph_seed_share_in_final": g.format("seedshare"), "graph_neighbour_share_in_final": g.format("1 - seedshare"), "graph_mean_distance": g.format("meand"),
        "graph_max_distance": g.format("maxd"), "graph_top1_is_neighbour": g.format("CAST(d0 > 0 AS INT)"), "graph_top1_distance": g.format("d0"), "graph_unique_seeds_used": g.format("nseeds"),
        "graph_neighbour_sim_uplift": "CASE WHEN graph AND nmax IS NOT NULL AND smean IS NOT NULL THEN nmax - smean ELSE 0 END", "graph_neighbour_sim_share": g.format("coalesce(nsum, 0) / CASE WHEN ss = 0 THEN 1 ELSE ss END"),
    }
    more = {
        "bm25_top1_score": "b0", "bm25_score_gap": "b0 - b1", "bm25_score_mean_topk": "bmean", "rrf_top1_score": "r0", "rrf_top1_gap": "r0 - r1", "frac_both_in_topk": "fboth",
        "frac_bm25_only_in_topk": "fb", "frac_dense_only_in_topk": "fd", "top1_in_dense_pool": "t1d", "top1_in_bm25_pool": "t1b", "top1_both_retrievers": "t1d AND t1b",
        "bm25_rank_mean_topk": "coalesce(brm, 0)", "dense_rank_mean_topk": "coalesce(drm, 0)",
        "query_num_in_top1_chunk": "len(list_intersect(list_filter(qn, lambda x: length(x) >= 3), num0)) > 0",
    }
    chosen = base | (more if hybrid else {})
    cols = ", ".join(f"round(CAST(coalesce({e}, 0) AS DOUBLE), 5) AS {n}" for n, e in chosen.items())
    first = lambda e: f"max({e}) FILTER (WHERE rank = 0)"
    share_of = lambda e: f"avg(CAST({e} AS INT))"
    return f"""WITH {hits},
hh AS (SELECT h.*{optional} FROM hits h),
x AS (SELECT hh.*, c.v, c.text, statute_name, source_file, section_number, is_superseded, {_numbers('c.text')} AS nums, {_content('section_title')} AS tw, {_content('c.text')} AS bw,
      exp(similarity - max(similarity) OVER (PARTITION BY qid)) AS e FROM hh JOIN c USING (idx)),
p AS (SELECT x.*, e / sum(e) OVER (PARTITION BY qid) AS p, lag(statute_name) OVER (PARTITION BY qid ORDER BY rank) AS prev,
      row_number() OVER (PARTITION BY qid, substring(text, 1, 80) ORDER BY rank) AS copy, count(*) OVER (PARTITION BY qid, statute_name) AS per FROM x),
qq AS (SELECT qid, question, {_content('question')} AS qw, {_rare('question')} AS rare, {_numbers('question')} AS qn FROM q),
o AS (SELECT p.*, row_number() OVER (PARTITION BY qid ORDER BY p) AS i, qw, question FROM p JOIN qq USING (qid)),
pair AS (SELECT a.qid, sum(list_dot_product(a.v, b.v)) FILTER (WHERE a.rank <> b.rank) AS off, 1 - min(list_dot_product(a.v, b.v)) FILTER (WHERE a.rank <> b.rank) AS spread, sum(list_dot_product(a.v, b.v)) AS gram FROM p a JOIN p b ON a.qid = b.qid GROUP BY a.qid),
agg AS (SELECT qid, count(*) AS k, {first('similarity')} AS s0, max(similarity) FILTER (WHERE rank = 1) AS s1, sum(similarity) AS ss, stddev_pop(similarity) AS sd, regr_slope(similarity, rank) AS slope,
  -sum(p * ln(p + 1e-12)) AS ent, sum(p) FILTER (WHERE rank < 3) AS mass, 2 * sum(i * p) / (count(*) * sum(p)) - (count(*) + 1) / count(*) AS gini,
  max(per) AS mx, count(*) FILTER (WHERE prev <> statute_name) AS sw, count(DISTINCT source_file) AS files, {share_of("section_number <> ''")} AS numbered, sum(length(text)) AS chars,
  {share_of('len(nums) > 0')} AS numhits, flatten(list(nums)) AS nums, bool_or(contains(text, '§')) AS marks, flatten(list(tw)) AS tws, flatten(list(bw)) AS bws,
  {first(jac.format('qw', 'tw'))} AS j1, max({jac.format('qw', 'tw')}) AS jk, {first(share('qw', 'bw'))} AS o1, max({share('qw', 'bw')}) AS ok,
  count(*) FILTER (WHERE copy > 1 AND text <> '') AS dups, {share_of('is_superseded')} AS old, bool_or(graph_distance IS NOT NULL) AS graph, {share_of('coalesce(graph_distance, 0) = 0')} AS seedshare,
  avg(coalesce(graph_distance, 0)) AS meand, max(coalesce(graph_distance, 0)) AS maxd, {first('coalesce(graph_distance, 0)')} AS d0, count(DISTINCT graph_seed_origin) AS nseeds,
  max(similarity) FILTER (WHERE graph_distance > 0) AS nmax, avg(similarity) FILTER (WHERE coalesce(graph_distance, 0) = 0) AS smean, sum(similarity) FILTER (WHERE graph_distance > 0) AS nsum,
  {first('bm25_score')} AS b0, max(bm25_score) FILTER (WHERE rank = 1) AS b1, avg(bm25_score) AS bmean, {first('rrf_score')} AS r0, max(rrf_score) FILTER (WHERE rank = 1) AS r1,
  {share_of('dense_rank >= 0 AND bm25_rank >= 0')} AS fboth, {share_of('bm25_rank >= 0 AND dense_rank < 0')} AS fb, {share_of('dense_rank >= 0 AND bm25_rank < 0')} AS fd,
  bool_or(dense_rank >= 0) FILTER (WHERE rank = 0) AS t1d, bool_or(bm25_rank >= 0) FILTER (WHERE rank = 0) AS t1b, avg(bm25_rank) FILTER (WHERE bm25_rank >= 0) AS brm, avg(dense_rank) FILTER (WHERE dense_rank >= 0) AS drm,
  arg_min(nums, rank) AS num0 FROM o GROUP BY qid),
full_row AS (SELECT qq.*, agg.* EXCLUDE (qid), off / (k * (k - 1)) AS cohesion, sqrt(gram) / k AS conc, spread FROM qq JOIN agg USING (qid) JOIN pair USING (qid))
SELECT qid, {cols} FROM full_row"""


_RESULTS = "r AS (SELECT l.doc_id AS id, lang AS tier, source AS method, quality = 1 AS passed FROM labels l JOIN documents d USING (doc_id))"
_PARTS = "f AS (SELECT p_name || '/' || replace(p_type, ' ', '_') || '_' || p_partkey || '.html' AS path FROM part)"
_PRED = "p AS (SELECT doc_id AS id, quality AS label, CAST(doc_id % 3 <> 0 AS INT) AS prediction FROM labels)"
_CONFUSION = "count(*) FILTER (WHERE prediction = 1 AND label = 1) AS tp, count(*) FILTER (WHERE prediction = 0 AND label = 0) AS tn, count(*) FILTER (WHERE prediction = 1 AND label = 0) AS fp, count(*) FILTER (WHERE prediction = 0 AND label = 1) AS fn"
_FOLDS = "fold AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(id || '|42'), id) - 1) % 5 AS INT) AS fold FROM p)"
_SUMMARY = f"""{_RESULTS}, cat AS (SELECT DISTINCT method AS id FROM r),
res AS (SELECT method, count(*) AS n_total, count(*) FILTER (WHERE passed) AS n_pass, count(*) FILTER (WHERE tier = 'basic') AS n_basic_total, count(*) FILTER (WHERE tier = 'basic' AND passed) AS n_basic_pass FROM r WHERE method <> 'src5' GROUP BY method),
fits AS (SELECT method, tier AS model, avg(CAST(passed AS INT)) AS b FROM r WHERE method <> 'src3' GROUP BY ALL),
bst AS (SELECT method, max(b) AS classifier_bal_acc FROM fits GROUP BY method),
mod AS (SELECT method, model AS classifier_model FROM fits QUALIFY row_number() OVER (PARTITION BY method ORDER BY b DESC, model DESC) = 1),
summ AS (SELECT cat.id, n_total, n_pass, n_basic_total, n_basic_pass, classifier_model, round(classifier_bal_acc, 6) AS classifier_bal_acc, n_total IS NOT NULL AS evaluated_actual, round(n_pass / n_total, 6) AS pass_rate,
  CASE WHEN n_total IS NOT NULL THEN coalesce(round(n_basic_pass / nullif(n_basic_total, 0), 6), 0.0) END AS basic_pass_rate, round(classifier_bal_acc - 0.5, 6) AS classifier_delta_bal_acc
  FROM cat LEFT JOIN res ON res.method = cat.id LEFT JOIN bst ON bst.method = cat.id LEFT JOIN mod ON mod.method = cat.id)"""

_BLUE = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "dense_topk_batch": f"WITH {_QUESTIONS}, s AS (SELECT qid, vec_id AS idx, list_dot_product({_unit('embedding')}, qv) AS similarity FROM q, embeddings), t AS ({_top('s', 'similarity', 5)}) SELECT qid, idx, round(similarity, 6) AS similarity, rank FROM t",
    "vector_norms": f"WITH u AS (SELECT vec_id AS idx, embedding AS e, {_unit('embedding')} AS v FROM embeddings) SELECT idx, round(sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])), 6) AS norm, round(sqrt(list_dot_product(v, v)), 6) AS unit, round(v[1], 6) AS first FROM u",
    "tokenize_counts": f"WITH t AS (SELECT doc_id AS idx, {_tokens('text')} AS t FROM documents) SELECT idx, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM t",
    "content_words": f"WITH t AS (SELECT doc_id AS idx, {_content('text')} AS w FROM documents) SELECT idx, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(list_sort(w), ' ')) AS digest FROM t",
    "rare_terms": f"WITH t AS (SELECT doc_id AS idx, {_rare('text')} AS w FROM documents) SELECT idx, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(list_sort(w), ' ')) AS digest FROM t",
    "numeric_tokens": f"SELECT doc_id AS idx, array_to_string(list_sort({_numbers('text')}), ' ') AS numbers FROM documents",
    "window_chunks": f"""WITH w AS (SELECT doc_id, source, lang, {_BLUE} AS w FROM documents),
n AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 512 THEN 1 ELSE CAST(ceil((len(w) - 512) / 462.0) AS INT) + 1 END AS n FROM w),
e AS (SELECT *, unnest(range(n)) AS part FROM n)
SELECT doc_id, source AS source_file, lang AS publisher, CAST(part AS INT) AS part, CAST(len(w[part * 462 + 1 : part * 462 + 512]) AS INT) AS n_tokens, md5(array_to_string(w[part * 462 + 1 : part * 462 + 512], ' ')) AS digest FROM e""",
    "chunk_numbers": "SELECT doc_id, lang || '_' || lpad(CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR), 7, '0') AS chunk_id FROM documents",
    "next_chunk_numbers": "SELECT lang AS publisher, max(CASE WHEN doc_id % 97 <> 0 THEN doc_id ELSE -1 END) + 1 AS next_number FROM documents GROUP BY lang",
    "embedding_preflight": f"WITH t AS (SELECT len({_BLUE}) AS n FROM documents) SELECT count(*) AS chunks, CAST(sum(n) AS BIGINT) AS tokens, round(sum(n) / 1e6 * 0.02, 8) AS usd, round(count(*) / 200 / 60, 6) AS minutes FROM t",
    "bm25_idf": f"WITH q AS (SELECT 0 AS qid, '' AS question), docs AS (SELECT doc_id AS idx, text FROM documents), {_bm25('docs')} SELECT token, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {_QUESTIONS}, docs AS (SELECT doc_id AS idx, text FROM documents), {_bm25('docs')}, t AS ({_top('pool', 'bm25_score', 30)}) SELECT qid, idx, round(bm25_score, 5) AS bm25_score, rank FROM t",
    "rrf_hybrid": f"""WITH {_QUESTIONS}, {_CHUNKS}, {_SIM}, {_bm25('c')}, d AS ({_top('sim', 'similarity', 30)}), b AS ({_top('pool', 'bm25_score', 30)}),
m AS (SELECT coalesce(d.qid, b.qid) AS qid, coalesce(d.idx, b.idx) AS idx, d.rank AS dr, b.rank AS br, coalesce(1 / (60.0 + d.rank), 0) + coalesce(1 / (60.0 + b.rank), 0) AS rrf_score FROM d FULL JOIN b ON d.qid = b.qid AND d.idx = b.idx),
t AS ({_top('m', 'round(rrf_score, 12)', 12)})
SELECT t.qid, t.rank, t.idx, round(sim.similarity, 5) AS similarity, round(coalesce(bm.bm25_score, 0), 5) AS bm25_score, CAST(coalesce(dr, -1) AS INT) AS dense_rank, CAST(coalesce(br, -1) AS INT) AS bm25_rank, round(rrf_score, 5) AS rrf_score
FROM t JOIN sim ON sim.qid = t.qid AND sim.idx = t.idx LEFT JOIN bm ON bm.qid = t.qid AND bm.idx = t.idx""",
    "context_build": f"""WITH {_QUESTIONS}, {_CHUNKS}, {_SIM}, t AS ({_top('sim', 'similarity', 5)}),
x AS (SELECT qid, string_agg('[' || text || ']' || chr(10) || '(source: ' || source_file || ')', chr(10) || chr(10) ORDER BY rank) AS ctx FROM t JOIN c USING (idx) GROUP BY qid)
SELECT qid, length(ctx) AS n_chars, md5(ctx) AS digest FROM x""",
    "query_rewrite": f"WITH {_QUESTIONS} SELECT qid, CASE WHEN qid % 4 = 0 THEN trim(substring(question, 1, 20), '\"') ELSE trim(question, ' ') END AS retrieval_query FROM q",
    "graph_edges": f"WITH {_TALKS}, {_EDGES} SELECT src, dst, etype, count(*) AS n FROM edge GROUP BY ALL",
    "graph_edge_counts": f"WITH {_TALKS}, {_EDGES} SELECT etype, CAST(count(*) // 2 AS BIGINT) AS edges FROM edge GROUP BY etype",
    "graph_adjacency": f"WITH {_CHUNKS}, {_NODES}, {_EDGES} SELECT src, dst, etype, rn FROM adj",
    "graph_expand": f"WITH {_QUESTIONS}, {_CHUNKS}, {_NODES}, {_EDGES}, seeds AS (SELECT qid, qid * 7 % (SELECT count(*) FROM c) AS idx, 0 AS ord FROM q UNION ALL SELECT qid, (qid * 7 + 11) % (SELECT count(*) FROM c), 1 FROM q), {_EXPAND} SELECT qid, idx, distance, edge, seed FROM reach",
    "graph_retrieve": f"""WITH {_QUESTIONS}, {_CHUNKS}, {_SIM}, {_NODES}, {_EDGES}, ds AS ({_top('sim', 'similarity', 6)}), seeds AS (SELECT qid, idx, rank AS ord FROM ds), {_EXPAND},
cand AS (SELECT reach.*, similarity FROM reach JOIN sim ON sim.qid = reach.qid AND sim.idx = reach.idx), t AS ({_top('cand', 'similarity', 12)})
SELECT qid, rank, idx, round(similarity, 6) AS similarity, distance AS graph_distance, edge AS graph_edge, seed AS graph_seed_origin FROM t""",
    "hybrid_graph_retrieve": f"WITH {_HYBRID_GRAPH} SELECT qid, rank, idx, round(similarity, 5) AS similarity, round(bm25_score, 5) AS bm25_score, dense_rank, bm25_rank, round(rrf_score, 5) AS rrf_score, graph_distance, graph_edge, graph_seed_origin FROM hits",
    "fingerprint": _fingerprint(_HYBRID_GRAPH, True),
    "fingerprint_dense": _fingerprint(f"{_QUESTIONS}, {_CHUNKS}, {_SIM}, hits AS ({_top('sim', 'similarity', 12)})", False),
    "sanitize_paths": r"""SELECT page_id, array_to_string(list_filter(list_transform(string_split(translate(replace(url, '\', '/'), ':?*"<>|', '_______'), '/'), lambda s: trim(s, ' .')), lambda s: s <> ''), '/') AS path FROM pages""",
    "case_rescue": r"""WITH n AS (SELECT page_id AS pos, (CASE WHEN page_id % 2 = 0 THEN upper(substring(url, 1, 14)) ELSE substring(url, 1, 14) END) || '.html' AS path FROM pages),
s AS (SELECT pos, array_to_string(list_filter(list_transform(string_split(translate(replace(path, '\', '/'), ':?*"<>|', '_______'), '/'), lambda s: trim(s, ' .')), lambda s: s <> ''), '/') AS safe FROM n),
i AS (SELECT *, row_number() OVER (PARTITION BY lower(safe) ORDER BY pos) - 1 AS i FROM s)
SELECT pos, CASE WHEN i > 0 THEN left(safe, length(safe) - 5) || '__case' || i || '.html' ELSE safe END AS stored FROM i""",
    "corpus_filter": "WITH f AS (SELECT p_name AS path, CASE WHEN p_size % 2 = 0 THEN 'finlex' ELSE 'vero' END AS publisher FROM part) SELECT publisher, count(*) AS kept FROM f WHERE publisher <> 'finlex' OR contains(path, 'pale') OR regexp_matches(lower(path), 'blue|steel|almond') GROUP BY publisher",
    "keyword_promote": f"WITH {_PARTS} SELECT path FROM f WHERE regexp_matches(lower(string_split(path, '/')[-1]), 'promo|economy')",
    "dir_promote": "SELECT url AS path FROM pages WHERE starts_with(url, 'en') OR starts_with(url, 'de/') OR contains(url, '/en') OR contains(url, '/de/')",
    "anchor_files": rf"""WITH {_PARTS}, a AS (SELECT r_regionkey::BIGINT AS qid, unnest(['html', 'promo', 'economy', 'standard', 'medium'][1 : r_regionkey + 1]) AS anchor FROM region WHERE r_regionkey >= 1),
n AS (SELECT path, lower(string_split(path, '/')[-1]) AS name FROM f),
t AS (SELECT *, list_filter(regexp_split_to_array(name, '[^a-z0-9]+'), lambda x: length(x) >= 4) AS toks FROM n),
h AS (SELECT qid, path, name, count(DISTINCT anchor) AS hits FROM a JOIN t ON list_contains(toks, anchor) OR name = anchor OR (length(anchor) >= 8 AND contains(name, anchor)) GROUP BY ALL HAVING count(DISTINCT anchor) >= 2)
SELECT qid, path, hits, CAST(row_number() OVER (PARTITION BY qid ORDER BY hits DESC, length(name), path) AS INT) AS rank FROM h QUALIFY rank <= 5""",
    "not_indexed": "SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "selection_union": f"WITH {_PARTS} SELECT DISTINCT path FROM f WHERE regexp_matches(lower(string_split(path, '/')[-1]), 'economy') OR starts_with(path, 'blue') OR contains(path, '/blue')",
    "tier_accuracy": f"WITH {_RESULTS} SELECT tier, count(*) AS total, count(*) FILTER (WHERE passed) AS n_pass, count(*) FILTER (WHERE NOT passed) AS n_fail, round(avg(CAST(passed AS INT)), 6) AS accuracy FROM r GROUP BY tier",
    "overall_accuracy": f"WITH {_RESULTS} SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS n_pass, count(*) FILTER (WHERE NOT passed) AS n_fail, round(avg(CAST(passed AS INT)), 6) AS accuracy FROM r",
    "running_accuracy": f"WITH {_RESULTS}, w AS (SELECT method, id, CAST(sum(CAST(passed AS INT)) OVER o AS BIGINT) AS n_pass, count(*) OVER o AS n FROM r WINDOW o AS (PARTITION BY method ORDER BY id ROWS UNBOUNDED PRECEDING)) SELECT method, id, n_pass, round(n_pass / n, 6) AS accuracy FROM w",
    "method_summary": f"WITH {_SUMMARY} SELECT * FROM summ",
    "best_method": f"WITH {_SUMMARY}, b AS (SELECT * FROM summ WHERE classifier_delta_bal_acc IS NOT NULL ORDER BY classifier_delta_bal_acc DESC, id DESC LIMIT 1) SELECT (SELECT max(n_total) FROM summ) AS n_questions, id AS best_method, classifier_model AS best_classifier, classifier_bal_acc AS best_bal_acc, classifier_delta_bal_acc AS best_delta_bal_acc FROM b",
    "confusion_metrics": f"WITH {_PRED}, k AS (SELECT {_CONFUSION}, avg(label) AS ra FROM p) SELECT tp, tn, fp, fn, tp + tn + fp + fn AS n, round(ra, 6) AS raw_accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS confident_precision, round((tp + fp) / (tp + tn + fp + fn), 6) AS confident_coverage, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS flag_catch_rate, round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS flag_wrong_rate FROM k",
    "majority_baseline": f"WITH {_PRED} SELECT count(*) FILTER (WHERE label = 1) AS n_pass, count(*) FILTER (WHERE label = 0) AS n_fail, round(greatest(count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0)) / count(*), 6) AS baseline_accuracy FROM p",
    "stratified_folds": f"WITH {_PRED}, {_FOLDS} SELECT id, label, fold FROM fold",
    "fold_metrics": f"WITH {_PRED}, {_FOLDS}, k AS (SELECT fold, {_CONFUSION} FROM fold GROUP BY fold), m AS (SELECT (tp + tn) / (tp + tn + fp + fn) AS a, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS b, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM k) SELECT round(avg(a), 6) AS cv_mean_accuracy, round(stddev_pop(a), 6) AS cv_std_accuracy, round(avg(b), 6) AS cv_mean_balanced_accuracy, round(stddev_pop(b), 6) AS cv_std_balanced_accuracy, round(avg(f), 6) AS cv_mean_f1, round(stddev_pop(f), 6) AS cv_std_f1 FROM m",
    "resume_antijoin": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "id_difference": "SELECT doc_id AS id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'right' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)",
    "percent_sample": "SELECT doc_id, lang FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT (SELECT CAST(greatest(1, round_even(count(*) * 0.125, 0)) AS BIGINT) FROM documents)",
    "html_links": r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*?href="([^"]+)"', 1) AS l FROM pages)
SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS links FROM l""",
    "html_text": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM b)
SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM c""",
    "question_anchors": rf"""WITH {_QUESTIONS}, w AS (SELECT qid, regexp_extract_all(array_to_string(regexp_extract_all('(' || question || ')', '\(([^)]*)\)', 1), ' '), '[A-Za-zÅÄÖåäö-]{{5,}}') AS raw FROM q),
k AS (SELECT qid, list_transform(list_filter(raw, lambda w: length(trim(translate(lower(w), 'åäö', 'aao'), '-_')) >= 6 AND (regexp_matches(trim(translate(lower(w), 'åäö', 'aao'), '-_'), 'ation|thing') OR (length(w) >= 10 AND regexp_matches(w, '[ÅÄÖåäö]')))), lambda w: trim(translate(lower(w), 'åäö', 'aao'), '-_')) AS l FROM w)
SELECT qid, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS anchors FROM k""",
    "source_previews": rf"""WITH {_QUESTIONS}, {_CHUNKS}, {_SIM}, t AS ({_top('sim', 'similarity', 3)})
SELECT qid, rank, source_file AS title, CASE WHEN section_title <> '' THEN section_title ELSE statute_name END AS section, CAST(length(substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 280)) AS INT) AS n_preview FROM t JOIN c USING (idx)""",
    "report_summary": f"""WITH {_RESULTS}, m AS (SELECT method, tier AS model, avg(CAST(passed AS INT)) AS b, count(*) AS n FROM r GROUP BY ALL), pr AS (SELECT method, round(avg(CAST(passed AS INT)), 6) AS pass_rate, CAST(count(*) AS INT) AS n FROM r GROUP BY method)
SELECT m.method, model, row_number() OVER (PARTITION BY m.method ORDER BY b DESC, model DESC) = 1 AS is_best, pr.n, pass_rate, round(b, 6) AS cv_bal_acc, round(b - 0.5, 6) AS delta_bal, CAST(1 AS INT) AS nonzero_count, 'x' AS top FROM m JOIN pr USING (method)""",
    "paragraph_pack": rf"""WITH RECURSIVE d AS (SELECT doc_id, len({_tokens('substring(text, 1, 60)')}) AS t,
  list_transform(list_filter(string_split(text, chr(10)), lambda p: p <> ''), lambda p: len({_tokens('p')})) AS c FROM documents),
r AS (SELECT doc_id, 0 AS i, 0 AS k, t AS n, '' AS done FROM d
  UNION ALL SELECT r.doc_id, i + 1, CASE WHEN k > 0 AND n + c[i + 1] > 512 THEN 1 ELSE k + 1 END, CASE WHEN k > 0 AND n + c[i + 1] > 512 THEN t ELSE n END + c[i + 1],
    CASE WHEN k > 0 AND n + c[i + 1] > 512 THEN done || k || ',' ELSE done END FROM r JOIN d USING (doc_id) WHERE i < len(c))
SELECT doc_id, done || CASE WHEN k > 0 THEN CAST(k AS VARCHAR) ELSE '' END AS pieces FROM r JOIN d USING (doc_id) WHERE i = len(c)""",
    "answer_judgement": rf"""WITH a AS (SELECT documents.doc_id AS id, lang AS tier, text, string_split(text, chr(10)) AS facts, {_content('text')} AS words, {_numbers('text')} AS numbers
  FROM documents JOIN labels ON labels.doc_id = documents.doc_id),
f AS (SELECT id, words, numbers, unnest(facts) AS fact FROM a),
k AS (SELECT id, words, numbers, {_content('fact')} AS fw, {_numbers('fact')} AS fn FROM f),
g AS (SELECT id, len(list_filter(fn, lambda x: NOT list_contains(numbers, x))) = 0 AND CASE WHEN len(fw) = 0 THEN 0 ELSE len(list_filter(fw, lambda x: list_contains(words, x))) / len(fw) END >= 0.6 AS good FROM k),
n AS (SELECT id, count(*) AS total, count(*) FILTER (WHERE good) AS good FROM g GROUP BY id)
SELECT a.id, tier, CAST(total AS INT) AS n_facts_total, CAST(CASE WHEN trim(text) <> '' THEN good ELSE 0 END AS INT) AS n_facts_passed, trim(text) <> '' AND good = total AS passed FROM a JOIN n USING (id)""",
    "corpus_complement": "WITH f AS (SELECT p_name || '/' || p_partkey AS path, CASE WHEN p_size % 2 = 0 THEN 'finlex' ELSE 'vero' END AS publisher FROM part) SELECT path FROM f WHERE publisher = 'finlex' AND NOT contains(path, 'hot') AND NOT regexp_matches(lower(string_split(path, '/')[-1]), '7|13')",
    "kept_and_total": "WITH f AS (SELECT p_name || '/' || p_partkey AS path, CASE WHEN p_size % 2 = 0 THEN 'finlex' ELSE 'vero' END AS publisher FROM part) SELECT publisher, count(*) FILTER (WHERE publisher <> 'finlex' OR contains(path, 'hot') OR regexp_matches(lower(string_split(path, '/')[-1]), '7|13')) AS kept, count(*) AS total FROM f GROUP BY publisher",
    "results_with_bank": f"WITH {_RESULTS} SELECT id, tier, passed, text AS question FROM r LEFT JOIN benchmark ON item_id = id",
    "ask": rf"""WITH {_QUESTIONS}, {_CHUNKS}, {_SIM}, t AS ({_top('sim', 'similarity', 12)}),
x AS (SELECT qid, count(*) AS n_sources, string_agg('[' || text || ']' || chr(10) || '(source: ' || source_file || ')', chr(10) || chr(10) ORDER BY rank) AS context, min(source_file) FILTER (WHERE rank = 0) AS top_title FROM t JOIN c USING (idx) GROUP BY qid)
SELECT qid, CAST(n_sources AS INT) AS n_sources, top_title, md5(substring(context, 1, 512)) AS digest FROM x""",
}
