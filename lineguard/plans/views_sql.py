"""The fixture views as SQL, for the comparison engine."""

from __future__ import annotations

_SPACE = r"[ \t\n\r\f]+"
_SOLID = r"[^ \t\n\r\f]+"

VIEWS: dict[str, tuple[str, str]] = {}


def _view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = (needs, sql)


def with_views(names: str, select: str) -> str:
    """*select* behind the WITH clauses of the views and what they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in VIEWS[name][0].split():
            visit(n)
        order.append(name)

    for n in names.split():
        visit(n)
    if not order:
        return select.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    body = select.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def r(expr: str, places: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"(round({expr}, {places}) + 0.0::double)"


_view(
    "base_preds",
    "",
    """
SELECT event_id AS id, event_id AS request_id, ts, epoch_us(ts) AS ts_us, event_type AS scenario,
  value * ((CASE WHEN event_type = 'error' THEN 2.0::double ELSE 1.0::double END)
    * (CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN 3.0::double ELSE 1.0::double END)) AS v,
  (props::json->>'$.k')::int AS k, value, user_id
FROM events""",
)
_view(
    "preds",
    "base_preds",
    """
SELECT id, request_id, ts, ts_us, scenario, v, k, user_id, probability, ground_truth, 0.5::double AS model_threshold,
  CASE WHEN probability >= 0.5::double THEN 1 ELSE 0 END AS predicted_label,
  CASE WHEN probability >= 0.5::double THEN 'defect' ELSE 'ok' END AS predicted_class,
  CASE WHEN probability BETWEEN 0.47::double AND 0.53::double THEN 'human_review'
       WHEN probability >= 0.5::double THEN 'auto_reject' ELSE 'auto_accept' END AS decision,
  v AS f1, probability AS f2, k::double AS f3, hour(ts)::double AS f4, (user_id % 97)::double AS f5,
  v AS latency_ms, CASE WHEN scenario = 'error' THEN 400 ELSE 200 END AS status
FROM (SELECT *, v / (v + 50.0::double) AS probability,
        CASE WHEN id % 3 = 0 THEN NULL WHEN value + (k - 50) >= 50 THEN 1 ELSE 0 END AS ground_truth
      FROM base_preds)""",
)
_view(
    "feedback",
    "preds",
    """
SELECT request_id, ground_truth, ts_us + (k % 48)::bigint * 3600000000 AS arrival, 'line' AS source
FROM preds WHERE ground_truth IS NOT NULL""",
)
_view(
    "all_feedback",
    "feedback",
    """
SELECT request_id, ground_truth, arrival, source FROM feedback
UNION ALL SELECT request_id, 1 - ground_truth, arrival + 18000000000, 'audit' FROM feedback WHERE request_id % 10 = 1
UNION ALL SELECT -request_id, ground_truth, arrival, source FROM feedback WHERE request_id % 25 = 2""",
)
_view(
    "ref_rows",
    "base_preds",
    """
SELECT id, value AS f1, value / (value + 50.0::double) AS f2, k::double AS f3, hour(ts)::double AS f4,
  (user_id % 97)::double AS f5, CASE WHEN value + (k - 50) >= 50 THEN 'defect' ELSE 'ok' END AS class_name
FROM base_preds WHERE ts < TIMESTAMP '2024-01-11'""",
)
_view("cur", "preds", "SELECT * FROM preds WHERE ts >= TIMESTAMP '2024-01-11'")


def _long(source: str, keys: str) -> str:
    lead = f"{keys}, " if keys else ""
    return "\nUNION ALL ".join(f"SELECT {lead}'f{i}' AS feature, {i - 1} AS pos, f{i} AS value FROM {source}" for i in range(1, 6))


_view("ref_long", "ref_rows", _long("ref_rows", ""))
_view("cur_long", "cur", _long("cur", "scenario"))
_view(
    "edges",
    "ref_long",
    """
SELECT feature, count(*) AS n_ref, avg(value) AS ref_mean,
  list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q
FROM ref_long GROUP BY feature""",
)
_view(
    "bins",
    "edges",
    """
SELECT feature, n_ref, ref_mean, q[2:len(q) - 1] AS inner_edges, unnest(range(greatest(len(q) - 1, 1))) AS bin FROM edges""",
)
_view(
    "ref_share",
    "bins ref_long",
    """
SELECT b.feature, b.bin, b.inner_edges, b.n_ref, b.ref_mean, coalesce(c.n, 0) / b.n_ref::double AS share
FROM bins b LEFT JOIN (
  SELECT l.feature, len(list_filter(e.q[2:len(e.q) - 1], lambda x: x <= l.value)) AS bin, count(*) AS n
  FROM ref_long l JOIN edges e USING (feature) GROUP BY 1, 2) c ON c.feature = b.feature AND c.bin = b.bin""",
)


def drift_sql(source: str, key: str) -> str:
    """PSI, means and counts per (key, feature) of a long table, as three chained clauses."""
    return f"""
cnt AS (
  SELECT l.{key}, l.feature, l.pos, len(list_filter(e.q[2:len(e.q) - 1], lambda x: x <= l.value)) AS bin, count(*) AS n, sum(l.value) AS s
  FROM {source} l JOIN edges e USING (feature) GROUP BY 1, 2, 3, 4),
tot AS (SELECT {key}, feature, pos, sum(n)::bigint AS n_cur, sum(s) / sum(n) AS cur_mean FROM cnt GROUP BY 1, 2, 3),
shares AS (
  SELECT t.{key}, t.feature, t.pos, r.bin, t.n_cur, t.cur_mean, r.n_ref, r.ref_mean, coalesce(c.n, 0)::bigint AS n,
    coalesce(c.n, 0) / t.n_cur::double AS share, r.share AS ref_share
  FROM tot t JOIN ref_share r ON r.feature = t.feature
  LEFT JOIN cnt c ON c.{key} = t.{key} AND c.feature = t.feature AND c.bin = r.bin),
drift AS (
  SELECT {key}, feature, pos, any_value(n_cur) AS n_current, any_value(n_ref)::bigint AS n_reference,
    any_value(cur_mean) AS current_mean, any_value(ref_mean) AS reference_mean,
    sum((greatest(share, 1e-6::double) - greatest(ref_share, 1e-6::double)) * ln(greatest(share, 1e-6::double) / greatest(ref_share, 1e-6::double))) AS psi
  FROM shares GROUP BY 1, 2, 3)"""


_view(
    "doc_cells",
    "",
    f"""
SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::bigint % 72 AS cell, count(*) AS n
FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS t
      FROM documents)
GROUP BY 1, 2""",
)
_view(
    "doc_keys",
    "doc_cells",
    """
SELECT d.doc_id, string_agg(lpad(lower(to_hex(b)), 2, '0'), '' ORDER BY i) AS dhash FROM (
  SELECT doc_id, i, sum(CASE WHEN coalesce(hi, 0) > coalesce(lo, 0) THEN (128 >> j) ELSE 0 END)::bigint AS b FROM (
    SELECT d.doc_id, g.i, g.j, a.n AS lo, c.n AS hi
    FROM (SELECT DISTINCT doc_id FROM documents) d
    CROSS JOIN (SELECT i, j FROM range(8) a(i), range(8) b(j)) g
    LEFT JOIN doc_cells a ON a.doc_id = d.doc_id AND a.cell = g.i * 9 + g.j
    LEFT JOIN doc_cells c ON c.doc_id = d.doc_id AND c.cell = g.i * 9 + g.j + 1)
  GROUP BY 1, 2) d GROUP BY 1""",
)
_view(
    "doc_stats",
    "doc_keys",
    f"""
SELECT 'doc_' || d.doc_id AS relpath, d.doc_id, CASE WHEN l.quality = 1 THEN 'ok' WHEN l.quality IS NOT NULL THEN 'defect' END AS class_name,
  CASE WHEN l.quality = 1 THEN 0 WHEN l.quality IS NOT NULL THEN 1 END AS label, d.n_chars::bigint AS file_bytes,
  len(regexp_extract_all(d.text, '{_SOLID}'))::bigint AS width,
  (length(d.text) - length(replace(d.text, chr(10), '')) + 1)::bigint AS height,
  sha256(d.text) AS sha256, k.dhash, d.lang, d.n_chars::double AS n_chars,
  length(regexp_replace(d.text, '{_SPACE}', '', 'g'))::double AS solid,
  length(regexp_replace(d.text, '[^0-9]', '', 'g'))::double AS digits
FROM documents d LEFT JOIN labels l USING (doc_id) JOIN doc_keys k USING (doc_id)""",
)
_view(
    "doc_features",
    "doc_stats",
    """
SELECT *, width::double AS words, solid / nullif(width, 0)::double AS mean_word_length, digits / nullif(n_chars, 0) AS digit_share FROM doc_stats""",
)
_view(
    "scan_docs",
    "doc_features",
    """
SELECT *, issue_text = '' AS is_valid FROM (
SELECT *, CASE
  WHEN lower(lang) NOT IN ('en', 'de', 'fr') THEN 'format_not_allowed:' || lower(lang)
  WHEN file_bytes = 0 THEN 'empty_file'
  ELSE concat_ws('|',
    CASE WHEN file_bytes > 20000 THEN 'file_too_large:' || file_bytes END,
    CASE WHEN width < 8 OR height < 2 THEN 'too_small:' || width || 'x' || height END,
    CASE WHEN width > 3000 OR height > 4096 THEN 'too_large:' || width || 'x' || height END,
    CASE WHEN coalesce(digit_share, 0.0::double) * 255.0::double > 12.75::double
      THEN 'too_bright:mean=' || printf('%.1f', coalesce(digit_share, 0.0::double) * 255.0::double) END,
    CASE WHEN coalesce(mean_word_length, 0.0::double) / 255.0::double * 255.0::double < 2.0::double
      THEN 'no_variation:std=' || printf('%.1f', coalesce(mean_word_length, 0.0::double) / 255.0::double * 255.0::double) END)
  END AS issue_text
FROM doc_features)""",
)
_view("valid_docs", "scan_docs", "SELECT * FROM scan_docs WHERE is_valid")
_view(
    "manifest",
    "valid_docs",
    """
SELECT *, CASE WHEN d < 65 THEN 'train' WHEN d < 80 THEN 'val' ELSE 'test' END AS split FROM (
SELECT *, ('0x' || substr(md5('42' || grp), 1, 8))::bigint % 100 AS d FROM (
SELECT *, coalesce(nullif(dhash, ''), 'row:' || relpath) AS grp FROM (
  SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY label, relpath) AS copy_no FROM valid_docs) WHERE copy_no = 1))""",
)
_view(
    "corpus_files",
    "",
    """
SELECT '/raw/' || d.doc_id || '/cam' || (d.doc_id % 2) || '/' ||
  CASE WHEN l.quality = 1 THEN 'ok_front' WHEN l.quality = 0 THEN 'def_front' ELSE 'unsorted' END ||
  '/part_' || (d.doc_id % 40) || '.' || CASE WHEN d.doc_id % 11 = 0 THEN 'txt' ELSE 'png' END AS path,
  d.doc_id, l.quality
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
_view(
    "normalised",
    "corpus_files",
    """
SELECT path, class_name, CASE WHEN k = 0 THEN name ELSE regexp_extract(name, '^(.*)(\\.[^.]+)$', 1) || '__' || k || regexp_extract(name, '^(.*)(\\.[^.]+)$', 2) END AS dest
FROM (SELECT *, row_number() OVER (PARTITION BY class_name, name ORDER BY path) - 1 AS k FROM (
  SELECT path, CASE WHEN quality = 1 THEN 'ok' ELSE 'defect' END AS class_name,
    'cam' || (doc_id % 2) || '_part_' || (doc_id % 40) || '.png' AS name
  FROM corpus_files WHERE quality IS NOT NULL AND doc_id % 11 <> 0))""",
)
_view(
    "pixels",
    "",
    """
SELECT vec_id AS image_id, label % 2 AS label,
  list_transform(embedding, lambda e: least(greatest(e::double + 0.5::double, 0.0::double), 1.0::double)) AS px
FROM embeddings""",
)
_view(
    "gray",
    "pixels",
    """
SELECT image_id, label, list_transform(px, lambda v: floor(v * 255.0::double + 0.5::double) / 255.0::double) AS g FROM pixels""",
)
_view(
    "cells",
    "gray",
    """
SELECT image_id, label, i // 8 AS y, i % 8 AS x, g[i + 1] AS v FROM (SELECT image_id, label, g, unnest(range(64)) AS i FROM gray)""",
)
_view(
    "grid3",
    "cells",
    """
SELECT image_id, y, x, v,
  lag(v) OVER w AS l, lead(v) OVER w AS rr,
  lag(v, 1) OVER c AS u, lead(v, 1) OVER c AS dn
FROM cells WINDOW w AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)""",
)
_view(
    "grid9",
    "grid3",
    """
SELECT a.image_id, a.y, a.x, a.v, a.l, a.rr, a.u, a.dn,
  p.l AS ul, p.rr AS ur, q.l AS dl, q.rr AS dr
FROM grid3 a
LEFT JOIN grid3 p ON p.image_id = a.image_id AND p.x = a.x AND p.y = a.y - 1
LEFT JOIN grid3 q ON q.image_id = a.image_id AND q.x = a.x AND q.y = a.y + 1
WHERE a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6""",
)
_view(
    "pixel_stats",
    "cells grid9",
    """
SELECT s.image_id, s.label, s.mean_intensity, s.std_intensity, s.p05_intensity, s.p95_intensity, e.edge_density, e.laplacian_var, h.entropy
FROM (SELECT image_id, any_value(label) AS label, avg(v) AS mean_intensity, stddev_pop(v) AS std_intensity,
        quantile_cont(v, 0.05) AS p05_intensity, quantile_cont(v, 0.95) AS p95_intensity FROM cells GROUP BY image_id) s
JOIN (SELECT image_id,
        avg(CASE WHEN sqrt(gx * gx + gy * gy) / 4.0::double > 0.12::double THEN 1.0::double ELSE 0.0::double END) AS edge_density,
        var_pop(lap) AS laplacian_var
      FROM (SELECT image_id, (ur + 2 * rr + dr) - (ul + 2 * l + dl) AS gx, (dl + 2 * dn + dr) - (ul + 2 * u + ur) AS gy,
              u + dn + l + rr - 4 * v AS lap FROM grid9) GROUP BY image_id) e USING (image_id)
JOIN (SELECT image_id, -sum(n / 64.0::double * log2(n / 64.0::double)) AS entropy
      FROM (SELECT image_id, least(floor(v * 64), 63) AS b, count(*) AS n FROM cells GROUP BY 1, 2) GROUP BY 1) h USING (image_id)""",
)
_view(
    "runs",
    "",
    """
SELECT p_brand AS model, p_type AS arch, p_partkey AS run_id, p_partkey AS start_time,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size / 50.0::double END AS test_f1,
  (p_partkey % 50) / 50.0::double AS test_recall,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size / 60.0::double END AS test_precision,
  p_retailprice - 850 AS latency_p95_ms,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size / 50.0::double END - 0.02::double AS ci_lo,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size / 50.0::double END + 0.02::double AS ci_hi
FROM part""",
)
_view(
    "best_runs",
    "runs",
    """
SELECT model, arch, substr(run_id::varchar, 1, 8) AS run_id, start_time, round_even(test_f1, 4) AS test_f1,
  round_even(test_recall, 4) AS test_recall, coalesce(round_even(test_precision, 4), 0.0::double) AS test_precision,
  round_even(latency_p95_ms, 2) AS latency_p95_ms, ci_lo, ci_hi
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY test_f1 DESC, start_time DESC) AS rn
      FROM runs WHERE test_f1 IS NOT NULL AND model IS NOT NULL) WHERE rn = 1""",
)
_view(
    "gated",
    "best_runs",
    """
SELECT *, concat_ws('; ',
    CASE WHEN test_f1 < 0.85::double THEN 'test_f1 ' || printf('%.4f', test_f1) || ' < 0.8500' END,
    CASE WHEN test_recall < 0.5::double THEN 'test_recall ' || printf('%.4f', test_recall) || ' < 0.5000' END,
    CASE WHEN latency_p95_ms > 140.0::double THEN 'latency_p95_ms ' || printf('%.1f', latency_p95_ms) || ' > 140.0' END) AS why,
  NOT (test_f1 < 0.85::double OR test_recall < 0.5::double OR latency_p95_ms > 140.0::double) AS eligible
FROM best_runs""",
)
_view(
    "scored",
    "preds",
    """
SELECT scenario, probability AS s, sum(ground_truth)::bigint AS pos, sum(1 - ground_truth)::bigint AS neg
FROM preds WHERE ground_truth IS NOT NULL GROUP BY 1, 2""",
)
_view(
    "ranked",
    "scored",
    """
SELECT *, sum(pos) OVER (PARTITION BY scenario ORDER BY s DESC)::bigint AS tp, sum(neg) OVER (PARTITION BY scenario ORDER BY s DESC)::bigint AS fp,
  sum(pos) OVER (PARTITION BY scenario)::bigint AS n_pos, sum(neg) OVER (PARTITION BY scenario)::bigint AS n_neg,
  coalesce(sum(neg) OVER (PARTITION BY scenario ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS neg_below
FROM scored""",
)
