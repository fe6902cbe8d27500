"""The same results in plain SQL, for an independent engine to compute.

``CTES`` derive the graph of :mod:`twinedge.plans.fixture` from the tables;
each query names the ones it needs and they are put in front in order.
"""

from __future__ import annotations

import re

from twinedge.plans.fixture import GIVEN, SURNAMES
from twinedge.schema import EDGE_TYPES, RAW_DATASETS, THRESHOLDS


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def _fold(expr: str) -> str:
    """Written out, and by the other engine's own function, so that an error in
    the library's folding tables shows."""
    for letter, spelled in (("Ł", "L"), ("ł", "l"), ("Ø", "O"), ("ø", "o"), ("Æ", "AE"), ("æ", "ae"), ("ß", "ss"), ("Đ", "D"), ("đ", "d"), ("ı", "i")):
        expr = f"replace({expr}, '{letter}', '{spelled}')"
    return f"strip_accents({expr})"


_LNFI = _fold("surname || substr(name, 1, 1)")
_VIEWS_OF = {
    "potentially_equates": "SELECT src, dst FROM potentially_equates",
    "colleague": "SELECT src, dst FROM colleague",
    "citation": "SELECT src, dst FROM citation",
    "collaboration": "SELECT src, dst FROM collaborates",
}


def _path(middle: str) -> str:
    return (
        "SELECT DISTINCT a.src, b.src AS dst FROM writes a "
        f"JOIN {middle} m ON m.src = a.dst JOIN writes b ON b.dst = m.dst"
    )


CTES = {
    "par": """SELECT (SELECT count(*) FROM customer) AS n, (SELECT count(*) FROM customer) // 3 AS p,
              (SELECT count(*) FROM customer) // 12 AS k, (SELECT count(*) FROM embeddings) AS v""",
    "author": f"""SELECT c_custkey AS idx, 'a' || c_custkey AS id, c_custkey % p AS person, (c_custkey % p) % k AS block,
              CASE WHEN c_custkey % 97 = 13 THEN '' WHEN c_custkey % 101 = 3 THEN NULL
                   ELSE {_list(GIVEN)}[c_custkey % {len(GIVEN)} + 1] END AS name,
              CASE WHEN c_custkey % 89 = 7 THEN '' ELSE {_list(SURNAMES)}[(c_custkey % p) % {len(SURNAMES)} + 1] END AS surname,
              {_list(SURNAMES)}[(c_custkey % p) % {len(SURNAMES)} + 1] || ', ' || {_list(GIVEN)}[c_custkey % {len(GIVEN)} + 1] AS fullname,
              CASE WHEN (c_custkey % p) % 211 = 5 THEN '' ELSE '0000-' || lpad(CAST(c_custkey % p AS VARCHAR), 8, '0') END AS orcid,
              c_nationkey, c_mktsegment, c_acctbal, c_name FROM customer, par""",
    "gapped": """SELECT idx, fullname, CASE WHEN idx % 50 = 1 THEN '' WHEN idx % 50 = 2 THEN NULL ELSE orcid END AS orcid FROM author""",
    "feats": """SELECT c_custkey AS idx, list_transform(list_zip(a.embedding, b.embedding),
              lambda z: 0.7 * CAST(z[1] AS DOUBLE) + 0.3 * CAST(z[2] AS DOUBLE)) AS feat
              FROM customer CROSS JOIN par JOIN embeddings a ON a.vec_id = (c_custkey % p) % v
              JOIN embeddings b ON b.vec_id = (c_custkey * 7 + 3 + 11 * (c_custkey // p)) % v""",
    "writes": """SELECT o_custkey AS src, o_orderkey AS dst FROM orders
              UNION SELECT o_orderkey % n, o_orderkey FROM orders, par""",
    "cites": """WITH ol AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p, l_suppkey AS s FROM lineitem)
              SELECT DISTINCT a.k AS src, f.k AS dst FROM ol a
              JOIN (SELECT p, s, min(k) AS k FROM ol GROUP BY p, s) f ON a.p = f.p AND a.s = f.s WHERE a.k > f.k""",
    "coprojected": """SELECT min(o_orderkey) OVER w AS src, o_orderkey AS dst FROM orders
              WINDOW w AS (PARTITION BY o_orderdate, o_orderpriority, o_orderstatus)
              QUALIFY src < dst""",
    "collaborates": """SELECT DISTINCT x.src, y.src AS dst FROM writes x JOIN writes y USING (dst) WHERE x.src <> y.src""",
    "potentially_equates": """SELECT min(idx) OVER w AS src, idx AS dst FROM author
              WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 1000)) QUALIFY src < dst""",
    "equates": """SELECT a.idx AS src, b.idx AS dst FROM author a JOIN author b USING (orcid)
              WHERE orcid <> '' AND a.idx < b.idx""",
    "similar_edges": """SELECT a.idx AS src, b.idx AS dst FROM author a JOIN author b ON a.block = b.block AND a.idx < b.idx""",
    "scored": """SELECT src, dst, round((1 + list_cosine_similarity(f.feat, g.feat)) / 2, 6) AS score FROM similar_edges
              JOIN feats f ON f.idx = src JOIN feats g ON g.idx = dst""",
    "dedup": """SELECT * FROM similar_edges WHERE (src + dst) % 3 <> 0""",
    "dedup_scored": """SELECT * FROM scored WHERE (src + dst) % 3 <> 0""",
    "labelled": """SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM equates e WHERE e.src = s.src AND e.dst = s.dst)
              THEN 1 ELSE 0 END AS label FROM scored s""",
    "bag": """SELECT s.src, s.dst, CASE WHEN EXISTS (SELECT 1 FROM equates e WHERE e.src = s.src AND e.dst = s.dst)
              THEN 1 ELSE 0 END AS label
              FROM (SELECT * FROM similar_edges UNION ALL SELECT * FROM similar_edges WHERE src % 7 = 0) s""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(src || '|' || dst), src, dst) - 1 AS r,
              (SELECT min(c) FROM (SELECT count(*) AS c FROM bag GROUP BY label)) AS m FROM bag""",
    "split": """SELECT label, src, dst, CASE WHEN r < floor(CAST(0.6 AS DOUBLE) * m) THEN 'train'
              WHEN r < floor((CAST(0.6 AS DOUBLE) + CAST(0.2 AS DOUBLE)) * m) THEN 'valid' ELSE 'test' END AS split
              FROM ranked WHERE r < m""",
    "both_bag": """SELECT s.src, s.dst, least(s.src, s.dst) AS a, greatest(s.src, s.dst) AS b, CASE WHEN EXISTS (SELECT 1 FROM equates e
              WHERE e.src = s.src AND e.dst = s.dst) THEN 1 ELSE 0 END AS label
              FROM (SELECT * FROM similar_edges UNION ALL SELECT * FROM similar_edges WHERE src % 7 = 0
                    UNION ALL SELECT dst, src FROM similar_edges WHERE src % 5 = 0) s""",
    "pair_group": """SELECT a, b, md5(a || '|' || b) AS draw, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM both_bag GROUP BY a, b""",
    "cut_at": """SELECT m, CAST(floor(CAST(0.6 AS DOUBLE) * m) AS BIGINT) AS c1, CAST(floor((CAST(0.6 AS DOUBLE) + CAST(0.2 AS DOUBLE)) * m) AS BIGINT) AS c2
              FROM (SELECT least(sum(pos), sum(neg))::BIGINT AS m FROM pair_group)""",
    "pos_split": """SELECT a, b, neg, CASE WHEN before < c1 THEN 'train' WHEN before < c2 THEN 'valid' ELSE 'test' END AS split FROM cut_at,
              (SELECT *, sum(pos) OVER (ORDER BY draw, a, b) - pos AS before FROM pair_group WHERE pos > 0) WHERE before < m""",
    "neg_cut": """SELECT greatest(0, c1 - coalesce(sum(neg) FILTER (split = 'train'), 0)) AS q1, greatest(0, c2 - c1 - coalesce(sum(neg) FILTER (split = 'valid'), 0)) AS q2,
              greatest(0, m - c2 - coalesce(sum(neg) FILTER (split = 'test'), 0)) AS q3 FROM cut_at LEFT JOIN pos_split ON true GROUP BY m, c1, c2""",
    "neg_split": """SELECT a, b, CASE WHEN before < q1 THEN 'train' WHEN before < q1 + q2 THEN 'valid' ELSE 'test' END AS split FROM neg_cut,
              (SELECT *, sum(neg) OVER (ORDER BY draw, a, b) - neg AS before FROM pair_group WHERE pos = 0) WHERE before < q1 + q2 + q3""",
    "whole_split": """SELECT split, label, src, dst FROM both_bag JOIN (SELECT a, b, split FROM pos_split UNION ALL SELECT a, b, split FROM neg_split) USING (a, b)""",
    "tested": "SELECT t.label, score FROM split t JOIN scored USING (src, dst) WHERE split = 'test'",
    "colleague": _path("coprojected"),
    "citation": _path("cites"),
    "view_edges": " UNION ALL ".join(
        f"SELECT '{v}' AS view, src, dst FROM ({q}) UNION ALL SELECT '{v}', idx, idx FROM author"
        for v, q in _VIEWS_OF.items()
    ),
    "views": "SELECT view, src, dst, count(*) AS w FROM view_edges GROUP BY view, src, dst",
    "typed": """SELECT 'cites' AS etype, src, dst FROM cites UNION ALL SELECT 'collaborates', src, dst FROM collaborates
              UNION ALL SELECT 'coprojected', src, dst FROM coprojected UNION ALL SELECT 'writes', src, dst FROM writes
              UNION ALL SELECT 'is_written_by', dst, src FROM writes
              UNION ALL SELECT 'potentially_equates', src, dst FROM potentially_equates
              UNION ALL SELECT 'equates', src, dst FROM equates UNION ALL SELECT 'similar', src, dst FROM similar_edges
              UNION ALL SELECT 'similar_for_dedup', src, dst FROM dedup""",
    "linked": "SELECT * FROM dedup_scored WHERE score >= 0.6",
    "linked_both": "SELECT src AS a, dst AS b FROM linked UNION SELECT dst, src FROM linked",
    "reach": """SELECT idx, idx AS seen FROM author
              UNION SELECT r.idx, l.b FROM reach r JOIN linked_both l ON l.a = r.seen""",
    "components": "SELECT idx, min(seen) AS component FROM reach GROUP BY idx",
    # a scorer with weights from a formula, 64 inputs and width 8; what Spark
    # shuffles as FLOAT is cut to FLOAT here as well
    "kinds": "SELECT * FROM (VALUES " + ", ".join(f"('{v}', {k})" for k, v in enumerate(_VIEWS_OF)) + ") AS x(view, k)",
    "dims": "SELECT unnest(range(8)) AS i",
    "shares": "SELECT view, src, dst, w / sum(w) OVER (PARTITION BY view, dst) AS share FROM views",
    "l1": """SELECT view, idx, i, CAST(CAST(sum(x * sin(i * 64 + j + 10 * k) / sqrt(8)) + any_value(cos(i + 10 * k) / 8) AS FLOAT) AS DOUBLE) AS own,
              CAST(CAST(sum(x * sin(i * 64 + j + 10 * k + 1) / sqrt(8)) AS FLOAT) AS DOUBLE) AS near
              FROM (SELECT idx, unnest(range(64)) AS j, unnest(feat) AS x FROM feats), dims, kinds GROUP BY view, idx, i""",
    "h1": """SELECT s.view, s.dst AS idx, n.i, any_value(o.own) + sum(share * n.near) AS h FROM shares s
              JOIN l1 n ON n.view = s.view AND n.idx = s.src JOIN l1 o ON o.view = s.view AND o.idx = s.dst AND o.i = n.i
              GROUP BY s.view, s.dst, n.i""",
    "l2_raw": """SELECT view, idx, d.i, k, sum(greatest(h, 0) * sin(d.i * 8 + h1.i + 10 * k + 5) / sqrt(8)) + any_value(cos(d.i + 10 * k + 5) / 8) AS own,
              sum(greatest(h, 0) * sin(d.i * 8 + h1.i + 10 * k + 6) / sqrt(8)) AS near
              FROM h1 JOIN kinds USING (view) CROSS JOIN dims d GROUP BY view, idx, d.i, k""",
    "l2": """SELECT view, idx, i, CAST(CAST(own AS FLOAT) AS DOUBLE) AS own, CAST(CAST(near AS FLOAT) AS DOUBLE) AS near FROM l2_raw
              UNION ALL SELECT view, idx, 8, CAST(CAST(sum(sin(i + 100 + k) * own) + any_value(cos(100 + k)) AS FLOAT) AS DOUBLE),
              CAST(CAST(sum(sin(i + 100 + k) * near) AS FLOAT) AS DOUBLE) FROM l2_raw GROUP BY view, idx""",
    "h2": """SELECT s.view, s.dst AS idx, n.i, any_value(o.own) + sum(share * n.near) AS h FROM shares s
              JOIN l2 n ON n.view = s.view AND n.idx = s.src JOIN l2 o ON o.view = s.view AND o.idx = s.dst AND o.i = n.i
              GROUP BY s.view, s.dst, n.i""",
    "att": """SELECT view, idx, exp(h - max(h) OVER (PARTITION BY idx)) AS e FROM h2 WHERE i = 8""",
    "attention": "SELECT view, idx, e / sum(e) OVER (PARTITION BY idx) AS weight FROM att",
    "z": """SELECT idx, i, sum(weight * h) AS z FROM h2 JOIN attention USING (view, idx) WHERE i < 8 GROUP BY idx, i""",
    "halves": """SELECT idx, d.i, CAST(CAST(sum(z * sin(d.i * 16 + z.i + 200) / sqrt(8)) AS FLOAT) AS DOUBLE) AS a,
              CAST(CAST(sum(z * sin(d.i * 16 + 8 + z.i + 200) / sqrt(8)) + any_value(cos(d.i + 200) / 8) AS FLOAT) AS DOUBLE) AS b
              FROM z CROSS JOIN dims d GROUP BY idx, d.i""",
    "cuts": "SELECT unnest([" + ", ".join(f"CAST({t} AS DOUBLE)" for t in THRESHOLDS) + "]) AS t",
    "kept": "SELECT t, src, dst FROM dedup_scored, cuts WHERE score >= t",
    "kept_both": "SELECT t, src AS a, dst AS b FROM kept UNION SELECT t, dst, src FROM kept",
    "t_reach": """SELECT t, idx, idx AS seen FROM author, cuts
              UNION SELECT r.t, r.idx, l.b FROM t_reach r JOIN kept_both l ON l.t = r.t AND l.a = r.seen""",
    "t_groups": """SELECT t, idx, min(seen) AS component, any_value(orcid) AS orcid
              FROM t_reach JOIN author USING (idx) GROUP BY t, idx""",
    "t_sizes": """SELECT t, count(*) AS groups, count(*) FILTER (n = 1) AS singles, sum(n) AS nodes, sum(n * (n - 1) // 2) AS q
              FROM (SELECT t, component, count(*) AS n FROM t_groups GROUP BY t, component) GROUP BY t""",
    "t_common": """SELECT t, sum(n * (n - 1) // 2) AS tp
              FROM (SELECT t, component, orcid, count(*) AS n FROM t_groups GROUP BY t, component, orcid) GROUP BY t""",
    "t_true": "SELECT sum(n * (n - 1) // 2) AS truth FROM (SELECT count(*) AS n FROM author GROUP BY orcid)",
    "t_edges": """SELECT t, count(*) AS edges, avg(CASE WHEN e.src IS NULL THEN 0 ELSE 1 END) AS accuracy
              FROM kept k LEFT JOIN equates e ON e.src = k.src AND e.dst = k.dst GROUP BY t""",
    "t_rates": """SELECT t AS threshold, coalesce(edges, 0) AS edges, accuracy AS simrels_accuracy, groups,
              singles / nodes AS singleton_fraction,
              CASE WHEN q > 0 THEN tp / q ELSE 0.0 END AS precision, CASE WHEN truth > 0 THEN tp / truth ELSE 0.0 END AS recall
              FROM t_sizes JOIN t_common USING (t) CROSS JOIN t_true LEFT JOIN t_edges USING (t)""",
    "sweep": """SELECT threshold, edges, round(simrels_accuracy, 6) AS simrels_accuracy, groups,
              round(singleton_fraction, 6) AS singleton_fraction, round(precision, 6) AS precision, round(recall, 6) AS recall,
              round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1
              FROM t_rates""",
}

_ROUNDED_CELLS = """SELECT count(*) FILTER (label = 0 AND NOT score > 0.5) AS tn, count(*) FILTER (label = 0 AND score > 0.5) AS fp,
    count(*) FILTER (label = 1 AND NOT score > 0.5) AS fn, count(*) FILTER (label = 1 AND score > 0.5) AS tp FROM labelled"""


def _agreement(rows: str, more: str) -> str:
    """Blocking report of ``rows(t, p)``."""
    return f"""
    WITH x AS ({rows}), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM x),
    c AS (SELECT t, p, count(*) AS k FROM x GROUP BY t, p), a AS (SELECT t, sum(k) AS k FROM c GROUP BY t),
    b AS (SELECT p, sum(k) AS k FROM c GROUP BY p),
    e AS (SELECT n, (SELECT -sum(k / n * ln(k / n)) FROM a) AS ht, (SELECT -sum(k / n * ln(k / n)) FROM b) AS hp,
          (SELECT sum(c.k / n * ln(c.k * n / (a.k * b.k))) FROM c JOIN a USING (t) JOIN b USING (p)) AS mi,
          (SELECT CAST(sum(k * (k - 1) // 2) AS DOUBLE) FROM c) AS tp, (SELECT CAST(sum(k * (k - 1) // 2) AS DOUBLE) FROM a) AS st,
          (SELECT CAST(sum(k * (k - 1) // 2) AS DOUBLE) FROM b) AS sp, n * (n - 1) / 2 AS whole,
          (SELECT count(*) FROM b) AS blocks, (SELECT count(*) FROM b WHERE k = 1) AS singletons FROM n),
    s AS (SELECT *, mi / ht AS h, mi / hp AS c, st * sp / whole AS expected FROM e)
    SELECT {more} round(h, 6) AS homogeneity, round(c, 6) AS completeness, round((whole + 2 * tp - st - sp) / whole, 6) AS rand_index,
    round((tp - expected) / ((st + sp) / 2 - expected), 6) AS adjusted_rand_index,
    round(2 * h * c / (h + c), 6) AS v_measure, round(mi / ((ht + hp) / 2), 6) AS nmi FROM s"""


def _raw(etype: str) -> str:
    kind, prefix = EDGE_TYPES[etype], {"author": "a", "publication": "p"}
    s, d = prefix[kind.src_type], prefix[kind.dst_type]
    etype = {"similar": "similar_edges", "similar_for_dedup": "dedup"}.get(etype, etype)
    return (
        f"SELECT '{s}' || src AS src_id, '{d}' || dst AS dst_id FROM {etype} "
        f"UNION ALL SELECT '{s}' || src, 'x' || dst FROM {etype} WHERE src % 50 = 0"
    )


def _extremes(condition: str) -> str:
    shown = "{0}.fullname || ' (ORCID: ' || {0}.orcid || ')'"
    return f"""SELECT src, dst, score, {shown.format('a')} AS source, {shown.format('b')} AS target
    FROM (SELECT * FROM scored WHERE {condition} ORDER BY src, dst LIMIT 3) e
    JOIN author a ON a.idx = e.src JOIN author b ON b.idx = e.dst"""


_GROUPED_BAG = "SELECT label, src, dst, count(*) AS copies"
_CELLS = f"WITH q AS ({_ROUNDED_CELLS})"

SQL = {
    "scan_nodes": """SELECT a.idx, id, a.fullname, name, surname, g.orcid, CAST(len(feat) AS INTEGER) AS width,
        round(CAST(CAST(feat[1] AS FLOAT) AS DOUBLE), 4) AS first_feat FROM author a JOIN gapped g USING (idx) JOIN feats USING (idx)""",
    "scan_publications": """SELECT o_orderkey AS idx, 'p' || o_orderkey AS id, CAST(len(embedding) AS INTEGER) AS width,
        round(CAST(embedding[-1] AS DOUBLE), 4) AS last_feat FROM orders CROSS JOIN par JOIN embeddings ON vec_id = o_orderkey % v""",
    "quarantined_lines": """SELECT '(''{"id": "' || id || '"'', ' AS line FROM author WHERE idx % 40 = 0""",
    "quarantine_reasons": """SELECT CASE idx % 11 WHEN 1 THEN 'no tuple' WHEN 2 THEN 'bad JSON' WHEN 3 THEN 'no object' WHEN 4 THEN 'no id'
          ELSE 'index out of range' END AS reason, count(*) AS lines FROM author WHERE idx % 11 BETWEEN 1 AND 7 GROUP BY 1""",
    "label_sketches": """SELECT c_mktsegment, count(*) AS rows, count(DISTINCT block) AS blocks, true AS within_2_percent FROM author GROUP BY 1""",
    "scan_edges": _raw("writes"),
    "author_orcids": "SELECT idx, orcid FROM gapped",
    "dataset_completeness": "SELECT 'authors' AS dataset, true AS ok, count(*) + count(*) FILTER (idx % 40 = 0) AS rows FROM author"
    " UNION ALL SELECT 'publications', true, count(*) FROM orders"
    + "".join(
        f" UNION ALL SELECT {quoted(k.dataset)}, true, count(*) FROM ({_raw(t)})" if k.dataset != "simrels_dedup"
        else f" UNION ALL SELECT {quoted(k.dataset)}, false, 0"
        for t, k in EDGE_TYPES.items() if k.dataset
    ),
    "raw_to_graph_drops": """SELECT 'authors' AS dataset, count(*) FILTER (idx % 40 = 0) AS malformed, CAST(0 AS BIGINT) AS unknown_src,
        CAST(0 AS BIGINT) AS unknown_dst FROM author UNION ALL SELECT 'publications', 0, 0, 0"""
    + "".join(
        f" UNION ALL SELECT {quoted(k.dataset)}, 0, 0, count(*) FILTER (dst_id LIKE 'x%') FROM ({_raw(t)})" for t, k in EDGE_TYPES.items() if k.dataset
    ),
    "model_store_roundtrip": "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing, CAST(1 AS BIGINT) AS models_kept FROM embeddings",
    "train_edge_scorer": "SELECT true AS kept_is_best, true AS loss_fell, true AS stopped_in_time",
    "resumed_run": "SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS epoch, CAST(4 AS BIGINT) AS metrics, CAST(0 AS BIGINT) AS differing, true AS same_model",
    "training_metrics": "SELECT CAST(0 AS BIGINT) AS incomplete, true AS from_one, true AS no_gap",
    "evaluate_edge_scorer": """WITH c AS (SELECT count(*) FILTER (e.src IS NOT NULL) AS pos, count(*) FILTER (e.src IS NULL) AS neg
          FROM similar_edges s LEFT JOIN (SELECT DISTINCT src, dst FROM equates) e ON e.src = s.src AND e.dst = s.dst)
        SELECT CAST(unnest([0, 1]) AS INTEGER) AS label, least(pos, neg) - CAST(floor(0.8 * least(pos, neg)) AS BIGINT) AS edges FROM c""",
    "split_leakage": """SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(split) AS first_split, max(split) AS last_split, count(*) AS copies
        FROM split GROUP BY 1, 2 HAVING min(split) <> max(split)""",
    "graph_integrity_broken": """WITH a AS (SELECT idx, CASE WHEN idx = 12 THEN 3 ELSE len(feat) END AS w FROM feats WHERE idx < 5 OR idx > 9),
          twice AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE idx IN (1, 2)),
          e AS (SELECT src, dst FROM similar_edges UNION ALL SELECT -1 - src, dst FROM similar_edges WHERE src % 11 = 0), n AS (SELECT count(*) AS n FROM twice)
        SELECT 'contiguous' AS "check", 'author' AS subject, CAST(1 AS BIGINT) AS violations
        UNION ALL SELECT 'contiguous', 'publication', CASE WHEN min(o_orderkey) = 0 AND max(o_orderkey) = count(*) - 1 THEN 0 ELSE 1 END FROM orders
        UNION ALL SELECT 'unique', 'author', count(*) - count(DISTINCT idx) FROM twice
        UNION ALL SELECT 'unique', 'publication', count(*) - count(DISTINCT o_orderkey) FROM orders
        UNION ALL SELECT 'feature_width', 'author', count(*) FILTER (w = 3) FROM twice
        UNION ALL SELECT 'feature_width', 'publication', 0
        UNION ALL SELECT 'edge_range', 'similar', count(*) FILTER (src < 0 OR dst < 0 OR src >= n OR dst >= n) FROM e CROSS JOIN n""",
    "sink_json_gz": "SELECT idx, fullname, name, true AS name_written FROM author",
    "graph_store_roundtrip": """SELECT etype, count(*) AS edges, count(DISTINCT src) AS sources,
        count(DISTINCT dst) AS destinations FROM typed GROUP BY etype""",
    "raw_to_graph": """SELECT etype, count(*) AS edges, count(DISTINCT src) AS sources,
        count(DISTINCT dst) AS destinations FROM typed GROUP BY etype""",
    "author_id": """SELECT src, dst, '00|author______::' || md5('p' || dst || fullname) AS author_id
        FROM writes JOIN author ON idx = src""",
    "lnfi_key": f"""SELECT idx, CASE WHEN name IS NULL OR name = '' THEN '' ELSE trim(lower({_LNFI})) END AS key FROM author""",
    "wellformed_authors": "SELECT idx, name, surname FROM author WHERE name IS DISTINCT FROM '' AND surname IS DISTINCT FROM ''",
    "replace_char": """SELECT idx, CASE WHEN p >= 0 AND p < length(c_name) THEN substr(c_name, 1, p) || '<>' || substr(c_name, p + 2) END AS replaced
        FROM (SELECT idx, c_name, CASE WHEN idx % 42 < 21 THEN length(c_name) + idx % 42 - 21 ELSE idx % 42 - 21 END AS p FROM author)""",
    "author_display": "SELECT idx, fullname || ' (ORCID: ' || orcid || ')' AS shown FROM gapped",
    "prune_edges": "SELECT * FROM scored WHERE score >= 0.5",
    "binarise_scores": "SELECT *, round_even(score, 0) AS rounded, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS above FROM scored",
    "extreme_edges_high": _extremes("score > 0.95"),
    "extreme_edges_low": _extremes("score < 0.35"),
    **{
        f"resolve_{t}": "SELECT src, dst FROM "
        + {"similar": "similar_edges", "similar_for_dedup": "dedup"}.get(t, t)
        for t, kind in EDGE_TYPES.items()
        if kind.dataset
    },
    "resolve_all_relations": """SELECT etype, count(*) AS edges, CAST(sum(src) AS BIGINT) AS src_sum, CAST(sum(dst) AS BIGINT) AS dst_sum
        FROM typed WHERE etype <> 'is_written_by' GROUP BY etype""",
    "unresolved_edge_report": f"""SELECT count(*) AS raw_edges, count(*) FILTER (dst_id LIKE 'p%') AS resolved,
        CAST(0 AS BIGINT) AS unknown_src, count(*) FILTER (dst_id LIKE 'x%') AS unknown_dst FROM ({_raw("writes")})""",
    "label_candidates": "SELECT src, dst, label FROM bag",
    "orcid_labels": "SELECT idx, dense_rank() OVER (ORDER BY orcid NULLS FIRST) - 1 AS label FROM gapped",
    "pair_counts": """SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs
        FROM (SELECT count(*) AS n FROM author GROUP BY block, orcid)""",
    "block_count": "SELECT count(DISTINCT block) AS blocks FROM author",
    "dense_index": """SELECT orcid, row_number() OVER (ORDER BY orcid NULLS FIRST) - 1 AS label FROM (SELECT DISTINCT orcid FROM gapped)""",
    "block_size_histogram": """SELECT n AS block_size, count(*) AS blocks FROM (SELECT count(*) AS n FROM author GROUP BY orcid) GROUP BY n""",
    "singleton_blocks": """SELECT count(*) FILTER (n = 1) AS singletons FROM (SELECT count(*) AS n FROM components GROUP BY component)""",
    "reduction_ratio": """SELECT round(1 - sum(n * (n - 1) / 2) / (sum(n) * (sum(n) - 1) / 2), 6) AS reduction_ratio
        FROM (SELECT count(*) AS n FROM author GROUP BY block)""",
    "author_stats": """SELECT count(*) AS authors, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n > 1) AS groups,
        CAST(sum(n) AS BIGINT) AS raw_authors FROM (SELECT count(*) AS n FROM gapped GROUP BY orcid)""",
    "cluster_noise_stats": """SELECT count(DISTINCT c) FILTER (c <> -1) AS clusters, count(*) FILTER (c = -1) AS noise,
        count(*) FILTER (c <> -1 AND core) AS core_points, count(*) FILTER (c <> -1 AND NOT core) AS border_points
        FROM (SELECT CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS c, vec_id % 3 <> 0 AS core FROM embeddings)""",
    "simrel_counts": """SELECT count(*) AS simrels, CAST(sum(label) AS BIGINT) AS correct, CAST(sum(1 - label) AS BIGINT) AS wrong,
        round(avg(label), 6) AS accuracy FROM bag""",
    "pairwise_prf": """WITH s AS (SELECT
          (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM author GROUP BY block, orcid)) AS tp,
          (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM author GROUP BY block)) AS q,
          (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM author GROUP BY orcid)) AS t)
        SELECT round(tp / q, 6) AS precision, round(tp / t, 6) AS recall, round(2 * (tp / q) * (tp / t) / (tp / q + tp / t), 6) AS f1 FROM s""",
    "blocking_quality": _agreement("SELECT orcid AS t, block AS p FROM author", ""),
    "blocking_report": _agreement("SELECT orcid AS t, block AS p FROM author", "blocks, singletons,"),
    "blocking_report_lnfi": _agreement(
        f"SELECT orcid AS t, CASE WHEN name IS NULL OR name = '' THEN '' ELSE trim(lower({_LNFI})) END AS p FROM author",
        "blocks, singletons,",
    ),
    "blocking_report_documents": _agreement("SELECT md5(text) AS t, source AS p FROM documents", "blocks, singletons,"),
    "scored_union": "SELECT score, label FROM labelled",
    "confusion_matrix": f"""{_CELLS} SELECT 0 AS label, 0 AS predicted, tn AS edges FROM q UNION ALL SELECT 0, 1, fp FROM q
        UNION ALL SELECT 1, 0, fn FROM q UNION ALL SELECT 1, 1, tp FROM q""",
    "confusion_metrics": f"""{_CELLS} SELECT round((tp + tn) / nullif(tn + fp + fn + tp, 0), 6) AS accuracy,
        round(tp / nullif(fn + tp, 0), 6) AS tpr, round(tn / nullif(tn + fp, 0), 6) AS tnr, round(fn / nullif(fn + tp, 0), 6) AS fnr,
        round(fp / nullif(tn + fp, 0), 6) AS fpr, round(tp / nullif(tp + fp, 0), 6) AS precision,
        round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
        round((tp / nullif(fn + tp, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM q""",
    "round_accuracy": "SELECT round(avg(CASE WHEN round_even(score, 0) = label THEN 1 ELSE 0 END) * 100, 6) AS accuracy_pct FROM labelled",
    "roc_auc": """WITH r AS (SELECT label, (rank() OVER (ORDER BY score)) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS mid FROM labelled),
        s AS (SELECT sum(mid) FILTER (label = 1) AS rp, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS p,
              CAST(count(*) FILTER (label = 0) AS DOUBLE) AS n FROM r)
        SELECT round((rp - p * (p + 1) / 2) / (p * n), 6) AS auc, round(1 - (rp - p * (p + 1) / 2) / (p * n), 6) AS auc_distance FROM s""",
    "bce_loss": """SELECT round(avg(-(label * CASE WHEN score <= 0 THEN -100 ELSE greatest(ln(score), -100) END
        + (1 - label) * CASE WHEN score >= 1 THEN -100 ELSE greatest(ln(1 - score), -100) END)), 6) AS bce FROM labelled""",
    "bce_logits_loss": """SELECT round(avg(greatest(x, 0) - x * label + ln(1 + exp(-abs(x)))), 6) AS bce_logits
        FROM (SELECT label, (score - 0.5) * 10 AS x FROM labelled)""",
    "margin_loss": """WITH d AS (SELECT src, score AS pos, ('0x' || substr(md5(src || '|' || dst || '|' || i || '|0'), 1, 15))::BIGINT % n AS nd
          FROM scored CROSS JOIN par CROSS JOIN (SELECT unnest([0, 1]) AS i))
        SELECT round(avg(greatest(1 - pos + round((1 + list_cosine_similarity(f.feat, g.feat)) / 2, 6), 0)), 6) AS margin_loss
        FROM d JOIN feats f ON f.idx = src JOIN feats g ON g.idx = nd""",
    "contrastive_loss": """SELECT round(avg(CASE WHEN label = 1 THEN d * d ELSE pow(greatest(1 - d, 0), 2) END), 6) AS contrastive_loss
        FROM (SELECT label, 1 - score AS d FROM labelled)""",
    "threshold_stats": """WITH g AS (SELECT component, orcid FROM components JOIN author USING (idx)), s AS (SELECT
          (SELECT avg(CASE WHEN e.src IS NULL THEN 0 ELSE 1 END) FROM linked l LEFT JOIN equates e ON e.src = l.src AND e.dst = l.dst) AS accuracy,
          (SELECT count(*) FILTER (n = 1) / sum(n) FROM (SELECT count(*) AS n FROM g GROUP BY component)) AS single,
          (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM g GROUP BY component, orcid)) AS tp,
          (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM g GROUP BY component)) AS q,
          (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM g GROUP BY orcid)) AS t)
        SELECT round(accuracy, 6) AS simrels_accuracy, round(single, 6) AS singleton_fraction, round(tp / q, 6) AS precision,
        round(tp / t, 6) AS recall, round(2 * (tp / q) * (tp / t) / (tp / q + tp / t), 6) AS f1 FROM s""",
    "threshold_sweep": "SELECT * FROM sweep",
    "threshold_sweep_long": """SELECT threshold, unnest(['simrels_accuracy', 'singleton_fraction', 'precision', 'recall', 'f1']) AS metric,
        unnest([simrels_accuracy, singleton_fraction, precision, recall, f1]) AS value FROM sweep""",
    "sweep_header": """SELECT (SELECT count(*) FROM author) AS nodes, (SELECT count(*) FROM dedup) AS edges,
        round((SELECT count(*) FROM (SELECT 1 FROM author GROUP BY orcid HAVING count(*) = 1)) / (SELECT count(*) FROM author), 6) AS singleton_orcid_share""",
    "best_threshold": "SELECT threshold, f1 FROM sweep ORDER BY f1 DESC, threshold LIMIT 1",
    "cosine_scores": "SELECT * FROM scored",
    "inspection_report": f"""{_CELLS}, c AS (SELECT 'simrels' AS section, unnest(['simrels', 'correct', 'wrong']) AS item,
          unnest([CAST(count(*) AS DOUBLE), CAST(sum(label) AS DOUBLE), CAST(sum(1 - label) AS DOUBLE)]) AS value, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS target FROM labelled)
        SELECT * FROM c
        UNION ALL SELECT 'confusion', unnest(['tn', 'fp', 'fn', 'tp']), unnest([CAST(tn AS DOUBLE), CAST(fp AS DOUBLE), CAST(fn AS DOUBLE), CAST(tp AS DOUBLE)]), NULL, NULL FROM q
        UNION ALL SELECT 'metrics', unnest(['accuracy', 'tpr', 'tnr', 'fnr', 'fpr', 'precision', 'f1', 'balanced_accuracy']),
          unnest([round((tp + tn) / (tn + fp + fn + tp), 6), round(tp / (fn + tp), 6), round(tn / (tn + fp), 6), round(fn / (fn + tp), 6),
          round(fp / (tn + fp), 6), round(tp / (tp + fp), 6), round(2 * tp / (2 * tp + fp + fn), 6), round((tp / (fn + tp) + tn / (tn + fp)) / 2, 6)]), NULL, NULL FROM q
        UNION ALL SELECT 'inferred right', src || '-' || dst, score, source, target FROM ({_extremes("score > 0.99")})
        UNION ALL SELECT 'inferred wrong', src || '-' || dst, score, source, target FROM ({_extremes("score < 0.35")})""",
    "global_index": "SELECT c_custkey AS idx, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS position FROM customer",
    "balanced_edges": f"{_GROUPED_BAG} FROM ranked WHERE r < m GROUP BY ALL",
    "grouped_splits": "SELECT split, label, src, dst, count(*) AS copies FROM whole_split GROUP BY ALL",
    "grouped_split_sizes": "SELECT split, label, count(*) AS edges FROM whole_split GROUP BY ALL",
    "grouped_split_leakage": """SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(split) AS first_split, max(split) AS last_split, count(*) AS copies
        FROM whole_split GROUP BY 1, 2 HAVING min(split) <> max(split)""",
    "evaluate_test_split": """SELECT unnest(['loss', 'accuracy', 'tn', 'fp', 'fn', 'tp']) AS metric, unnest([
          round(avg(-(label * CASE WHEN score <= 0 THEN -100 ELSE greatest(ln(score), -100) END
            + (1 - label) * CASE WHEN score >= 1 THEN -100 ELSE greatest(ln(1 - score), -100) END)), 6),
          round(avg(CASE WHEN round_even(score, 0) = label THEN 1 ELSE 0 END) * 100, 6),
          CAST(count(*) FILTER (label = 0 AND NOT score > 0.5) AS DOUBLE), count(*) FILTER (label = 0 AND score > 0.5),
          count(*) FILTER (label = 1 AND NOT score > 0.5), count(*) FILTER (label = 1 AND score > 0.5)]) AS value FROM tested""",
    "edge_splits": "SELECT split, label, src, dst, count(*) AS copies FROM split GROUP BY ALL",
    "split_sizes": "SELECT split, label, count(*) AS edges FROM split GROUP BY ALL",
    "negative_edges": """SELECT src, dst, draw, ('0x' || substr(md5(src || '|' || dst || '|' || draw || '|0'), 1, 15))::BIGINT % n AS neg_dst
        FROM similar_edges CROSS JOIN par CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS draw)""",
    "reverse_edges": "SELECT dst AS src, src AS dst FROM writes",
    "graph_summary": """SELECT etype, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS destinations
        FROM typed GROUP BY etype""",
    "degree_stats": """WITH d AS (SELECT etype, 'src' AS side, src AS idx, count(*) AS k FROM typed GROUP BY ALL
          UNION ALL SELECT etype, 'dst', dst, count(*) FROM typed GROUP BY ALL)
        SELECT etype, side, count(*) AS nodes, CAST(sum(k) AS BIGINT) AS edges, max(k) AS max_degree FROM d GROUP BY etype, side""",
    "graph_integrity": """WITH s AS (SELECT 'author' AS subject, count(*) AS n, count(DISTINCT idx) AS d, min(idx) AS lo, max(idx) AS hi,
            min(len(feat)) AS w1, max(len(feat)) AS w2 FROM feats
          UNION ALL SELECT 'publication', count(*), count(DISTINCT o_orderkey), min(o_orderkey), max(o_orderkey), 64, 64 FROM orders)
        SELECT 'contiguous' AS "check", subject, CAST(CASE WHEN lo = 0 AND hi = n - 1 THEN 0 ELSE 1 END AS BIGINT) AS violations FROM s
        UNION ALL SELECT 'unique', subject, n - d FROM s
        UNION ALL SELECT 'feature_width', subject, CAST(CASE WHEN w1 = w2 THEN 0 ELSE 1 END AS BIGINT) FROM s
        UNION ALL SELECT 'edge_range', etype, count(*) FILTER (src < 0 OR dst < 0 OR src >= CASE WHEN etype IN ('cites', 'coprojected', 'is_written_by') THEN np ELSE na END
          OR dst >= CASE WHEN etype IN ('cites', 'coprojected', 'writes') THEN np ELSE na END) FROM typed CROSS JOIN (SELECT max(n) FILTER (subject = 'author') AS na, max(n) FILTER (subject = 'publication') AS np FROM s) GROUP BY etype""",
    **{
        f"subgraph_{t}": "SELECT src, dst FROM "
        + {"similar": "similar_edges", "similar_for_dedup": "dedup"}.get(t, t)
        for t in ("potentially_equates", "collaborates", "similar", "equates", "similar_for_dedup")
    },
    "metapath_colleague": "SELECT * FROM colleague",
    "metapath_citation": "SELECT * FROM citation",
    "view_with_self_loops": """SELECT src, dst, count(*) AS w FROM (SELECT * FROM citation UNION ALL SELECT idx, idx FROM author) GROUP BY src, dst""",
    "author_views": """SELECT view, count(*) AS edges, CAST(sum(w) AS BIGINT) AS weight, max(w) AS max_weight FROM views GROUP BY view""",
    "connected_components": "SELECT * FROM components",
    "components_by_batches": "SELECT * FROM components",
    "neighbour_mean": """WITH m AS (SELECT view, dst AS idx, pos, sum(w * feat[pos]) / sum(w) AS x
          FROM views JOIN feats ON feats.idx = src CROSS JOIN (SELECT unnest(range(1, 65)) AS pos) GROUP BY view, dst, pos)
        SELECT view, idx, round(max(x) FILTER (pos = 1), 6) AS first, round(sum(x), 4) AS total, round(sum(x * pos), 2) AS placed FROM m GROUP BY view, idx""",
    "neighbour_mean_stored": """WITH m AS (SELECT view, dst AS idx, pos, sum(w * feat[pos]) / sum(w) AS x
          FROM views JOIN feats ON feats.idx = src CROSS JOIN (SELECT unnest(range(1, 65)) AS pos) GROUP BY view, dst, pos)
        SELECT view, idx, round(max(x) FILTER (pos = 1), 6) AS first, round(sum(x), 4) AS total, round(sum(x * pos), 2) AS placed FROM m GROUP BY view, idx""",
    "neighbour_mean_wide": """WITH m AS (SELECT view, dst AS idx, pos, sum(w * feat[pos]) / sum(w) AS x
          FROM views JOIN feats ON feats.idx = src CROSS JOIN (SELECT unnest(range(1, 65)) AS pos) GROUP BY view, dst, pos)
        SELECT view, idx, round(max(x) FILTER (pos = 1), 6) AS first, round(78 * sum(x), 4) AS total,
          round(sum(x * (78 * pos + 64 * 572)), 2) AS placed FROM m GROUP BY view, idx""",
    "sage_layer": "SELECT view, idx, round(max(h) FILTER (i = 0), 6) AS first, round(sum(h), 4) AS total, round(sum(h * (i + 1)), 2) AS placed FROM h1 GROUP BY view, idx",
    "view_embeddings": """SELECT view, idx, round(max(h) FILTER (i = 0), 6) AS first, round(sum(h), 4) AS total, round(sum(h * (i + 1)), 2) AS placed
        FROM h2 WHERE i < 8 GROUP BY view, idx""",
    "view_attention": "SELECT view, idx, round(weight, 6) AS weight FROM attention",
    "node_embeddings": "SELECT idx, round(max(z) FILTER (i = 0), 6) AS first, round(sum(z), 4) AS total, round(sum(z * (i + 1)), 2) AS placed FROM z GROUP BY idx",
    "edge_scores": """SELECT src, dst, round(1 / (1 + exp(-(sum(greatest(s.a + d.b, 0) * sin(s.i + 300)) + cos(300)))), 6) AS score
        FROM similar_edges JOIN halves s ON s.idx = src JOIN halves d ON d.idx = dst AND d.i = s.i GROUP BY src, dst""",
}


def _needed(text: str, found: list[str], within: tuple[str, ...] = ()) -> None:
    """Append the CTEs that ``text`` mentions, each after those it needs itself."""
    for name, body in CTES.items():
        if name not in found and name not in within and re.search(rf"\b{name}\b", text):
            _needed(body, found, (*within, name))
            found.append(name)


def oracle_sql() -> dict[str, str]:
    """Full statements, each with the CTEs it needs."""
    statements = {}
    for name, body in SQL.items():
        found: list[str] = []
        _needed(body, found)
        ctes = ",\n".join(f"{c} AS ({CTES[c]})" for c in found)
        if not ctes:
            statements[name] = body
        elif re.match(r"\s*WITH\b", body):
            # CTEs of the query itself follow the shared ones
            statements[name] = f"WITH RECURSIVE {ctes},\n" + re.sub(r"^\s*WITH\b", "", body)
        else:
            statements[name] = f"WITH RECURSIVE {ctes}\n{body}"
    return statements
