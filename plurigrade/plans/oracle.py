"""DuckDB SQL of the registered queries, on the driver's tables."""

from __future__ import annotations

from functools import cache

_EXPR = """expr AS (
  SELECT l_suppkey AS cell_id, p_brand || '_' || p_size AS feature, SUM(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), feat AS (
  SELECT feature, CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS feature_idx FROM (SELECT DISTINCT feature FROM expr)
), cells AS (
  SELECT DISTINCT cell_id FROM expr
)"""
_DENSE = (
    _EXPR
    + """, m AS (
  SELECT c.cell_id, f.feature_idx, COALESCE(e.value, 0e0) AS v FROM cells c CROSS JOIN feat f LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.feature = f.feature
), total AS (
  SELECT cell_id, SUM(v) AS s FROM m GROUP BY 1
), ln AS (
  SELECT m.cell_id, feature_idx, v, log2(v * 1e6 / s + 1) AS lg,
    rank() OVER (PARTITION BY m.cell_id ORDER BY v DESC) + (COUNT(*) OVER (PARTITION BY m.cell_id, v) - 1) / 2e0 AS rk
  FROM m JOIN total USING (cell_id)
)"""
)
_DISP = (
    _DENSE
    + """, disp AS (
  SELECT feature_idx, CASE WHEN MIN(lg) = MAX(lg) THEN 0e0 ELSE var_pop(lg) / AVG(lg) END AS disp FROM ln GROUP BY 1
)"""
)
_MODEL = (
    _DENSE
    + """, heads AS (
  SELECT CAST(a.range AS INTEGER) AS model, CAST(b.range AS INTEGER) AS layer, (a.range * 6 + b.range) % 5 / 10e0 AS maxrank, (b.range - 2.5e0) * 0.1e0 AS bias FROM range(3) a, range(6) b
), geneset AS (
  SELECT model, layer, CAST(k.range AS INTEGER) AS k, feature_idx FROM heads, range(4) k, feat WHERE (feature_idx * 31 + k.range * 17 + layer * 7 + model * 13) % 10 < 3
), weight AS (
  SELECT model, layer, j.range AS j, j.range % 5 * 0.1e0 AS rm, 0.5e0 + j.range % 3 * 0.25e0 AS rv, ((j.range * 7 + layer * 3 + model) % 11 - 5) / 10e0 AS ow FROM heads, range(8) j
), background AS (
  SELECT a.feature_idx AS r, b.feature_idx AS c, (1 + (a.feature_idx + b.feature_idx) % 5) / 10e0 AS v FROM feat a, feat b WHERE (a.feature_idx * 7 + b.feature_idx * 11) % 97 = 0
), gs AS (
  SELECT model, layer, k, c AS feature_idx, SUM(v) AS gs FROM background JOIN geneset ON r = feature_idx GROUP BY ALL HAVING SUM(v) <> 0
), sizes AS (
  SELECT model, layer, k, n, MAX(n) OVER (PARTITION BY model, layer) + 10 + GREATEST(maxrank, 0) * 1000 AS maxrank
  FROM (SELECT model, layer, k, COUNT(*) AS n FROM geneset GROUP BY ALL) JOIN heads USING (model, layer)
)"""
)
_MEASURES = (
    _MODEL
    + """, ranks AS (
  SELECT cell_id, model, layer, k, 1 - (SUM(LEAST(rk, maxrank)) - ANY_VALUE(n) * (ANY_VALUE(n) + 1) / 2e0) / (ANY_VALUE(n) * ANY_VALUE(maxrank)) AS score
  FROM ln JOIN geneset USING (feature_idx) JOIN sizes USING (model, layer, k) GROUP BY 1, 2, 3, 4
), stored AS (
  SELECT * FROM ln WHERE v <> 0
), raw AS (
  SELECT cell_id, model, layer, k, SUM(lg) AS raw FROM stored JOIN geneset USING (feature_idx) GROUP BY ALL
), bg AS (
  SELECT cell_id, model, layer, k, SUM(lg * gs) AS bg FROM stored JOIN gs USING (feature_idx) GROUP BY ALL
), diffs AS (
  SELECT cell_id, model, layer, k, COALESCE(raw, 0) / n - COALESCE(bg, 0) / w AS diff
  FROM cells CROSS JOIN sizes JOIN (SELECT model, layer, k, SUM(gs) AS w FROM gs GROUP BY ALL) USING (model, layer, k)
  LEFT JOIN raw USING (cell_id, model, layer, k) LEFT JOIN bg USING (cell_id, model, layer, k)
)"""
)
_LOGITS = (
    _MEASURES
    + """, x AS (
  SELECT cell_id, model, layer, k AS j, score AS x FROM ranks UNION ALL SELECT cell_id, model, layer, k + 4, diff FROM diffs
), logits AS (
  SELECT cell_id, model, layer, SUM((x - rm) / sqrt(rv + 1e-5) * ow) + ANY_VALUE(bias) AS z FROM x JOIN weight USING (model, layer, j) JOIN heads USING (model, layer) GROUP BY 1, 2, 3
), prob AS (
  SELECT cell_id, model, layer, exp(z - MAX(z) OVER w) / SUM(exp(z)) OVER w * exp(MAX(z) OVER w) AS p FROM logits WINDOW w AS (PARTITION BY cell_id, model)
), per_model AS (
  SELECT cell_id, model, SUM(p * layer / 5e0) AS order_score, MAX(p) AS top_prob FROM prob GROUP BY 1, 2
), means AS (
  SELECT cell_id, layer, AVG(p) AS p FROM prob GROUP BY 1, 2
)"""
)
_GRAPH = (
    _DISP
    + """, top AS (
  SELECT feature_idx FROM disp ORDER BY round(disp, 9) DESC, feature_idx LIMIT 1000
), numbered AS (
  SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS pos, COUNT(*) OVER () AS n, CASE WHEN 1000 > COUNT(*) OVER () THEN 1 ELSE CAST(ceil(COUNT(*) OVER () / 1000e0) AS BIGINT) END AS p FROM cells
), chunked AS (
  SELECT cell_id, CASE WHEN pos < n % p * (n // p + 1) THEN pos // (n // p + 1) ELSE n % p + (pos - n % p * (n // p + 1)) // GREATEST(n // p, 1) END AS chunk FROM numbered
), vec AS (
  SELECT cell_id, chunk, feature_idx, lg FROM ln JOIN chunked USING (cell_id) WHERE feature_idx IN (SELECT feature_idx FROM top)
), cor AS (
  SELECT ANY_VALUE(a.chunk) AS chunk, a.cell_id AS i, b.cell_id AS j, corr(a.lg, b.lg) AS w FROM vec a JOIN vec b ON a.feature_idx = b.feature_idx AND a.chunk = b.chunk GROUP BY a.cell_id, b.cell_id
), open AS (
  SELECT chunk, i, j, CASE WHEN i = j OR NOT isfinite(w) THEN 0e0 ELSE w END AS w FROM cor
), cut AS (
  SELECT i, j, CASE WHEN w < GREATEST(AVG(w) OVER (PARTITION BY chunk), 0) THEN 0e0 ELSE w END AS w FROM open
), a AS (
  SELECT i, j, w / (SUM(w) OVER (PARTITION BY i) + 1e-5) AS w FROM cut
)"""
)
_SCORES = """span AS (
  SELECT MIN(value) AS low, MAX(value) AS high FROM events
), scores AS (
  SELECT event_id AS cell_id, CAST(CASE WHEN event_id = 7 THEN 5 ELSE event_id % 5 END AS INTEGER) AS category, (value - low) / (high - low) AS smooth,
    CASE WHEN event_id % 50 <> 3 THEN (value - low) / (high - low) END AS score FROM events, span
)"""
_RESULTS = (
    _SCORES
    + """, ra AS (
  SELECT cell_id, score, smooth AS relative, smooth * 0.5e0 AS preknn_score, 'class ' || category AS potency, 'class ' || category AS preknn_potency FROM scores WHERE cell_id % 101 <> 6
), rb AS (
  SELECT cell_id, CASE WHEN cell_id % 11 = 0 THEN score + cell_id % 3 * 0.25e0 ELSE score END AS score, smooth AS relative, smooth * 0.5e0 AS preknn_score,
    'class ' || (category + CASE WHEN cell_id % 13 = 0 THEN 1 ELSE 0 END) AS potency, 'class ' || category AS preknn_potency FROM scores WHERE cell_id % 101 <> 5
)"""
)
_POINTS = """p AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, (label + 0.5e0) / 10e0 * 0.9e0 + vec_id % 7 * 0.01e0 AS s FROM embeddings
), raw AS (
  SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.x, b.x) AS d FROM p a, p b
), dist AS (
  SELECT i, j, d / MAX(d) OVER (PARTITION BY i) AS d FROM raw
), near AS (
  SELECT i, j, d, rn, s FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS rn FROM dist) JOIN p ON j = vec_id WHERE rn <= 30
)"""


def _category(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN -1 " + " ".join(f"WHEN {x} <= {k + 1}e0 / 6e0 THEN {k}" for k in range(6)) + " ELSE -1 END"


_KEEP = (
    _POINTS
    + f""", run AS (
  SELECT i, rn, SUM(s) OVER (PARTITION BY i ORDER BY rn) AS t FROM near
), halves AS (
  SELECT a.i, a.rn, {_category("round(a.t / a.rn, 9)")} = {_category("round((b.t - a.t) / a.rn, 9)")} AS same FROM run a JOIN run b ON a.i = b.i AND b.rn = 2 * a.rn WHERE a.rn >= 2
), keep AS (
  SELECT i, CAST(2 * COALESCE(MIN(CASE WHEN same THEN rn END), 2) AS INTEGER) AS keep FROM halves GROUP BY 1
)"""
)
_ALIAS = (
    _EXPR
    + """, names AS (
  SELECT DISTINCT name FROM (
    SELECT CASE WHEN feature_idx % 3 = 0 THEN 'A_' || feature ELSE feature END AS name FROM feat WHERE feature_idx % 4 <> 1
    UNION ALL SELECT feature FROM feat WHERE feature_idx % 8 = 0)
)"""
)
_PAIRS = """cand AS (
  SELECT 'H_' || p_brand || '_' || p_size AS human, 'M_' || p_type || '_' || p_partkey % 7 AS mouse, CAST(p_partkey * 37 % 101 AS DOUBLE) AS id1, CAST(p_partkey * 53 % 103 AS DOUBLE) AS id2 FROM part
), best AS (
  SELECT human, mouse, id2 FROM (SELECT *, row_number() OVER (PARTITION BY human ORDER BY id1 DESC, mouse, id2) AS rn FROM cand) WHERE rn = 1
), hits AS (
  SELECT human, mouse FROM (SELECT *, row_number() OVER (PARTITION BY mouse ORDER BY id2 DESC, human) AS rn FROM best) WHERE rn = 1
)"""


def _steps(n: int) -> str:
    """The diffusion's rounds as so many common table expressions."""
    out = [", s0 AS (SELECT cell_id AS i, cell_id % 10 / 10e0 AS x FROM cells)"]
    for k in range(1, n + 1):
        out.append(f", s{k} AS (SELECT a.i, 0.9e0 * SUM(a.w * s.x) + 0.1e0 * ANY_VALUE(z.x) AS x FROM a JOIN s{k - 1} s ON s.i = a.j JOIN s0 z ON z.i = a.i GROUP BY 1)")
    return "".join(out)


def _number(name: str) -> str:
    return (
        f"SELECT '{name}' AS name, COUNT(b.{name} - a.{name}) AS n, COUNT(*) - COUNT(a.{name}) AS n_missing_a, COUNT(*) - COUNT(b.{name}) AS n_missing_b, "
        f"COUNT(*) FILTER ((a.{name} IS NULL) <> (b.{name} IS NULL)) AS n_mask_mismatch, COUNT(*) FILTER (abs(b.{name} - a.{name}) > 0.3e0) AS n_outside, "
        f"round(MAX(abs(b.{name} - a.{name})), 6) + 0e0 AS max_abs_delta, round(AVG(b.{name} - a.{name}), 6) + 0e0 AS mean_delta, CAST(NULL AS BIGINT) AS n_mismatch FROM ra a JOIN rb b USING (cell_id)"
    )


def _label(name: str) -> str:
    return (
        f"SELECT '{name}', COUNT(*), COUNT(*) - COUNT(a.{name}), COUNT(*) - COUNT(b.{name}), COUNT(*) FILTER ((a.{name} IS NULL) <> (b.{name} IS NULL)), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), "
        f"COUNT(*) FILTER (a.{name} IS DISTINCT FROM b.{name}) FROM ra a JOIN rb b USING (cell_id)"
    )


@cache
def sql() -> dict[str, str]:
    labels = "['Differentiated', 'Unipotent', 'Oligopotent', 'Multipotent', 'Pluripotent', 'Totipotent']"
    cat = _category("t")
    return {
        "expr_matrix": f"WITH {_EXPR} SELECT * FROM expr",
        "expr_unpivot": f"WITH {_EXPR} SELECT * FROM expr",
        "dup_names": "SELECT p_type AS name, COUNT(*) AS n FROM part GROUP BY 1 HAVING COUNT(*) > 1",
        "number_tokens": """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN CAST(t AS DOUBLE) WHEN 1 THEN -CAST(t AS DOUBLE) WHEN 2 THEN CAST(t AS DOUBLE) WHEN 3 THEN CAST(t || 'e-3' AS DOUBLE) END AS value
            FROM (SELECT o_orderkey, CAST(CAST(round(o_totalprice, 2) AS DECIMAL(20, 2)) AS VARCHAR) AS t FROM orders)""",
        "model_order": "SELECT row_number() OVER (ORDER BY n_name) - 1 AS position, n_name AS model FROM nation",
        "alias_map": f"""WITH {_ALIAS} SELECT n.name, CASE WHEN f.feature IS NULL AND t.feature IS NOT NULL AND t.feature NOT IN (SELECT name FROM names) THEN t.feature ELSE n.name END AS mapped
            FROM names n LEFT JOIN feat f ON f.feature = n.name LEFT JOIN feat t ON 'A_' || t.feature = n.name""",
        "feature_coverage": f"WITH {_ALIAS} SELECT COUNT(*) AS n_present FROM feat WHERE feature IN (SELECT name FROM names)",
        "ortholog_double_top_hit": f"WITH {_PAIRS} SELECT * FROM hits",
        "ortholog_map": f"""WITH {_PAIRS}, g AS (SELECT 'H_' || p_brand || '_' || p_size AS name, MIN(p_partkey) AS gene_idx FROM part GROUP BY 1),
            m AS (SELECT gene_idx, name, COALESCE(mouse, CASE WHEN gene_idx % 2 = 0 THEN 'M_alias_' || gene_idx % 40 END) AS mapped FROM g LEFT JOIN hits ON human = name)
            SELECT gene_idx, name, mapped FROM (SELECT *, row_number() OVER (PARTITION BY mapped ORDER BY gene_idx) AS rn FROM m WHERE mapped IS NOT NULL) WHERE rn = 1""",
        "cpm_log2": f"WITH {_DENSE} SELECT cell_id, feature_idx, round(lg, 6) + 0e0 AS lg FROM ln WHERE v <> 0",
        "avg_rank_desc": f"WITH {_DENSE} SELECT cell_id, feature_idx, rk FROM ln",
        "row_zscore": f"""WITH {_DENSE}, st AS (SELECT cell_id, AVG(lg) AS mu, stddev_pop(lg) AS sd FROM ln GROUP BY 1)
            SELECT cell_id, feature_idx, round((lg - mu) / sd, 6) + 0e0 AS z, round(-mu / sd, 6) + 0e0 AS zero_z FROM ln JOIN st USING (cell_id) WHERE v <> 0""",
        "col_center": f"WITH {_DENSE} SELECT * FROM (SELECT cell_id, feature_idx, round(lg - AVG(lg) OVER (PARTITION BY feature_idx), 6) + 0e0 AS centred FROM ln) WHERE (cell_id, feature_idx) IN (SELECT (cell_id, feature_idx) FROM ln WHERE v <> 0)",
        "qc_lowcount": f"WITH {_DENSE} SELECT COUNT(*) AS n_cells, COUNT(*) FILTER (n < 500) AS n_low, COUNT(*) FILTER (n < 500) / CAST(COUNT(*) AS DOUBLE) >= 0.2e0 AS warn FROM (SELECT cell_id, COUNT(*) FILTER (lg > 0) AS n FROM ln GROUP BY 1)",
        "log_like_check": f"WITH {_EXPR} SELECT GREATEST(MAX(value), 0e0) AS top, GREATEST(MAX(value), 0e0) <= 20 AS warn FROM expr",
        "dispersion": f"WITH {_DISP} SELECT feature_idx, round(disp, 6) + 0e0 AS disp FROM disp",
        "top_features": f"WITH {_DISP} SELECT feature_idx, round(disp, 6) + 0e0 AS disp FROM disp ORDER BY round(disp.disp, 9) DESC, feature_idx LIMIT 1000",
        "coo_last_wins": """SELECT r, c, v FROM (SELECT l_partkey % 300 AS r, l_suppkey % 50 AS c, l_quantity % 5 AS v, row_number() OVER (PARTITION BY l_partkey % 300, l_suppkey % 50 ORDER BY l_orderkey * 10 + l_linenumber DESC, l_quantity % 5 DESC) AS rn FROM lineitem) WHERE rn = 1 AND v <> 0""",
        "background_product": f"WITH {_MODEL} SELECT model, layer, k, feature_idx, round(gs, 6) + 0e0 AS gs FROM gs",
        "geneset_sizes": f"WITH {_MODEL} SELECT model, layer, k, n, round(maxrank, 6) + 0e0 AS maxrank, n * (n + 1) / 2e0 AS half, round(n * maxrank, 6) + 0e0 AS denom FROM sizes",
        "geneset_rank_score": f"WITH {_MEASURES} SELECT cell_id, model, layer, k, round(score, 6) + 0e0 AS score FROM ranks",
        "geneset_mean_vs_bg": f"WITH {_MEASURES} SELECT cell_id, model, layer, k, round(diff, 6) + 0e0 AS diff FROM diffs",
        "head_logits": f"WITH {_LOGITS} SELECT cell_id, model, layer, round(z, 6) + 0e0 AS z FROM logits",
        "softmax_order": f"WITH {_LOGITS} SELECT cell_id, model, round(order_score, 6) + 0e0 AS order_score, round(top_prob, 6) + 0e0 AS top_prob FROM per_model",
        "ensemble_mean": f"""WITH {_LOGITS} SELECT cell_id, o.order_score, t.top_prob FROM (SELECT cell_id, round(AVG(order_score), 6) + 0e0 AS order_score FROM per_model GROUP BY 1) o
            JOIN (SELECT cell_id, round(MAX(p), 6) + 0e0 AS top_prob FROM means GROUP BY 1) t USING (cell_id)""",
        "ensemble_argmax": f"WITH {_LOGITS} SELECT cell_id, layer AS category FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY p DESC, layer) AS rn FROM means) WHERE rn = 1",
        "array_split_chunks": """WITH o AS (SELECT o_orderkey AS cell_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, COUNT(*) OVER () AS n FROM orders)
            SELECT cell_id, CAST(CASE WHEN pos < n % 7 * (n // 7 + 1) THEN pos // (n // 7 + 1) ELSE n % 7 + (pos - n % 7 * (n // 7 + 1)) // GREATEST(n // 7, 1) END AS INTEGER) AS chunk FROM o""",
        "batch_plan": "SELECT n_nationkey, CAST(n_nationkey * 450 AS BIGINT) AS n, CAST(CASE WHEN n_nationkey * 450 < 1000 OR 4000 > n_nationkey * 450 THEN 1 ELSE ceil(n_nationkey * 450 / 4000e0) END AS INTEGER) AS batches FROM nation",
        "chunk_correlation": f"WITH {_GRAPH} SELECT i, j, round(w, 6) + 0e0 AS w FROM cor",
        "markov_matrix": f"WITH {_GRAPH} SELECT i, j, round(w, 6) + 0e0 AS w FROM a",
        "diffusion_fixed_steps": f"WITH {_GRAPH}{_steps(5)} SELECT i AS cell_id, round(x, 6) + 0e0 AS smooth FROM s5",
        "rank_binning": f"""WITH {_SCORES}, o AS (SELECT cell_id, category, row_number() OVER (PARTITION BY category ORDER BY smooth, cell_id) - 1 AS place, COUNT(*) OVER (PARTITION BY category) AS n FROM scores)
            SELECT cell_id, category, round(CASE WHEN n > 1 THEN category / 6e0 + 1e-8 + place * ((1 / 6e0 - 2e-8) / (n - 1)) END, 6) + 0e0 AS binned FROM o""",
        "bin_label": f"WITH {_SCORES}, r AS (SELECT cell_id, round(score * 1.3e0 - 0.1e0, 9) AS t FROM scores) SELECT cell_id, CASE WHEN t >= 0 AND {cat} >= 0 THEN {labels}[{cat} + 1] END AS label, CAST({cat} AS INTEGER) AS category FROM r",
        "relative_minmax": f"WITH {_SCORES} SELECT cell_id, round((score - MIN(score) OVER ()) / (MAX(score) OVER () - MIN(score) OVER ()), 6) + 0e0 AS relative FROM scores",
        "pair_distance": f"WITH {_POINTS} SELECT i, j, round(d, 6) + 0e0 AS d FROM dist",
        "knn30": f"WITH {_POINTS} SELECT i, j, CAST(rn AS INTEGER) AS rn FROM near",
        "shortest_consensus": f"WITH {_KEEP} SELECT i, keep FROM keep",
        "knn_smooth": f"WITH {_KEEP} SELECT i AS cell_id, ANY_VALUE(keep) AS keep, round(SUM(s * (1 - d) * (1 - d)) / SUM((1 - d) * (1 - d)), 6) + 0e0 AS score FROM near JOIN keep USING (i) WHERE rn <= keep GROUP BY 1",
        "pca_distance": """WITH z AS (SELECT vec_id, list_transform(x, lambda v: (v - mu) / sd) AS z FROM (SELECT vec_id, x, list_avg(x) AS mu, list_stddev_pop(x) AS sd FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)))
            SELECT a.vec_id AS cell_id, round(list_distance(a.z, b.z), 6) + 0e0 AS d FROM z a JOIN z b ON b.vec_id = a.vec_id + 1""",
        "matrix_text": f"WITH {_EXPR} SELECT * FROM expr",
        "line_list": "SELECT p_name AS value FROM part WHERE p_partkey % 5 <> 0",
        "pair_table": "SELECT p_type AS alias, CAST(MAX(p_partkey) AS VARCHAR) AS target FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1",
        "result_table": """SELECT CAST(o_orderkey AS VARCHAR) AS cell_id, CASE WHEN o_orderkey % 9 <> 2 THEN round(o_totalprice, 2) END AS score, CASE WHEN o_orderkey % 7 <> 1 THEN o_orderstatus END AS potency,
            o_orderkey % 64 / 64e0 AS relative, -round(o_totalprice, 2) AS preknn_score, o_orderstatus AS preknn_potency FROM orders""",
        "gene_set_members": "SELECT CAST(p_partkey % 3 AS INTEGER) AS model, CAST(p_partkey % 6 AS INTEGER) AS layer, CAST(p_size % 4 AS INTEGER) AS k, CAST(p_partkey AS INTEGER) AS feature_idx FROM part WHERE p_partkey % 5 > 2",
        "aligned_strict": f"WITH {_EXPR} SELECT cell_id, feature_idx, value FROM expr JOIN feat USING (feature) WHERE feature_idx % 2 = 0 AND value <> 0",
        "file_sums": "SELECT sha256(string_agg(n_name || chr(10), '' ORDER BY n_name)) AS sha256 FROM nation",
        "result_exponents": "SELECT o_orderkey, CAST(1 + o_orderkey % 9 || 'e' || (o_orderkey % 37 - 18) AS DOUBLE) AS value FROM orders",
        "compare_results": f"WITH {_RESULTS} " + " UNION ALL ".join([*map(_number, ("score", "relative", "preknn_score")), *map(_label, ("potency", "preknn_potency"))]),
        "result_identity": f"WITH {_RESULTS} SELECT COUNT(a.cell_id) AS n_a, COUNT(b.cell_id) AS n_b, COUNT(*) FILTER (a.cell_id IS NOT NULL AND b.cell_id IS NOT NULL) AS n_both FROM ra a FULL JOIN rb b ON a.cell_id = b.cell_id",
        "cells_in_one": f"WITH {_RESULTS} SELECT cell_id, 'a' AS side FROM ra WHERE cell_id NOT IN (SELECT cell_id FROM rb) UNION ALL SELECT cell_id, 'b' FROM rb WHERE cell_id NOT IN (SELECT cell_id FROM ra)",
        "spearman_pair": f"""WITH {_RESULTS}, pr AS (SELECT a.score AS x, b.score AS y FROM ra a JOIN rb b USING (cell_id) WHERE a.score IS NOT NULL AND b.score IS NOT NULL),
            rk AS (SELECT rank() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2e0 AS rx, rank() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2e0 AS ry FROM pr)
            SELECT round(corr(rx, ry), 6) + 0e0 AS rho FROM rk""",
        "result_lines": """SELECT CAST(-1 AS BIGINT) AS at, chr(9) || 'score' || chr(9) || 'potency' || chr(9) || 'relative' || chr(9) || 'preknn_score' || chr(9) || 'preknn_potency' AS line UNION ALL
            SELECT o_orderkey, concat_ws(chr(9), o_orderkey, CASE WHEN o_orderkey % 9 <> 2 THEN CAST(round(o_totalprice, 2) AS VARCHAR) ELSE '' END, CASE WHEN o_orderkey % 7 <> 1 THEN o_orderstatus ELSE '' END,
              CAST(o_orderkey % 64 / 64e0 AS VARCHAR), CAST(-round(o_totalprice, 2) AS VARCHAR), o_orderstatus) FROM orders""",
    }
