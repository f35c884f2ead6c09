"""SQL for DuckDB that gives the rows of each query, from long pixel rows and joins instead of arrays."""

from __future__ import annotations

#: Formulas of this module's own, from the definitions and not from the closed forms that the queries use.
_EPS = "power(2E0, -52)"


def _f(p: str, r: str) -> str:
    """F: nothing where precision or recall is nothing, else a weighted harmonic mean (in this order of factors, as some values lie on the edge of rounding)."""
    return f"coalesce(1.3E0 * {p} * {r} / nullif(0.3E0 * {p} + {r}, 0), 0)"


def _alike(m: str, s: str) -> str:
    return f"(2 * {m} / (power({m}, 2) + 1 + {s} + {_EPS}))"


def _ssim(k: int) -> str:
    """Likeness of quadrant ``k``: from its moments."""
    top, low = f"(4 * x{k} * y{k} * c{k})", f"((power(x{k}, 2) + power(y{k}, 2)) * (vx{k} + vy{k}))"
    return f"(CASE {top} WHEN 0 THEN CASE {low} WHEN 0 THEN 1 ELSE 0 END ELSE {top} / ({low} + {_EPS}) END + 0 * {top})"


def _aligned(cut: str) -> str:
    """E of one image, pixel by pixel: how both deviate from their means; ``cut`` tells what is predicted."""
    return f"""sum(CASE WHEN f = 0 THEN 1 - b WHEN f = n THEN b ELSE power(1 + 2 * (b - mb) * (g - f / CAST(n AS DOUBLE)) / (power(b - mb, 2) + power(g - f / CAST(n AS DOUBLE), 2) + {_EPS}), 2) / 4 END) / (any_value(n) - 1 + {_EPS})"""


_BASE = """
WITH RECURSIVE v AS (SELECT vec_id AS img_id, label AS class, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pr AS (SELECT class, arg_min(e, img_id) AS pe FROM v GROUP BY class),
lv AS (SELECT img_id, v.class, unnest(range(0, len(e))) AS pos, unnest(e) AS val, unnest(pe) AS pval,
              list_min(e) AS lo, list_max(e) AS hi, list_position(e, list_max(e)) - 1 AS amax, list_position(e, list_min(e)) - 1 AS amin,
              list_min(pe) AS plo, list_max(pe) AS phi
       FROM v JOIN pr USING (class)),
raw AS (SELECT img_id, 'm' || (img_id % 3) AS method, 'R' AS dataset, class, pos, pos // 8 AS y, pos % 8 AS x, 8 AS h, 8 AS w, val, pval,
               CASE WHEN img_id % 16 = 7 THEN 128 ELSE CAST(floor((val - lo) / (hi - lo) * 255) AS INTEGER) END AS pred,
               CASE WHEN CASE img_id % 16 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN pos = amax WHEN 3 THEN pos <> amin WHEN 4 THEN pos >= 56
                    WHEN 5 THEN pos // 8 < 2 AND pos % 8 < 2 WHEN 6 THEN pos // 8 BETWEEN 2 AND 5 AND pos % 8 BETWEEN 2 AND 5 ELSE pval > 0 END
                    THEN 255 ELSE 0 END AS gt,
               (val - lo) / (hi - lo + 1e-8) AS s, (pval - plo) / (phi - plo + 1e-8) AS t FROM lv),
un AS (SELECT *, pred / 255.0::DOUBLE AS u FROM raw),
mm AS (SELECT img_id, min(u) AS ulo, max(u) AS uhi FROM un GROUP BY img_id),
px AS (SELECT un.*, CASE WHEN uhi <> ulo THEN (u - ulo) / (uhi - ulo) ELSE u END AS p, CASE WHEN gt > 128 THEN 1 ELSE 0 END AS g FROM un JOIN mm USING (img_id)),
im AS (SELECT img_id, method, dataset, class, h, w, count(*) AS n, sum(g)::BIGINT AS f, avg(p) AS mean_p FROM px GROUP BY ALL)
"""
_ADAPTIVE = f""",
bn AS (SELECT px.img_id, g, f, n, CASE WHEN p >= least(2 * mean_p, 1) THEN 1 ELSE 0 END AS b FROM px JOIN im USING (img_id)),
bm AS (SELECT *, avg(b) OVER (PARTITION BY img_id) AS mb FROM bn),
ad AS (SELECT im.*, tp, ps, CASE WHEN tp = 0 THEN 0E0 ELSE {_f("(tp / CAST(nullif(ps, 0) AS DOUBLE))", "(tp / CAST(nullif(f, 0) AS DOUBLE))")} END AS adp_fm, adp_em
       FROM im JOIN (SELECT img_id, sum(b * g)::BIGINT AS tp, sum(b)::BIGINT AS ps, {_aligned("b")} AS adp_em FROM bm GROUP BY img_id) USING (img_id))
"""
# A pixel counts from the threshold that its value reaches on; E is summed over all pixels at each of the thresholds.
_CURVE = f""",
tk AS (SELECT unnest(range(0, 256)) AS k),
cc AS (SELECT px.img_id, k, g, CASE WHEN floor(p * 255) >= 255 - k THEN 1 ELSE 0 END AS b FROM px, tk),
cm AS (SELECT img_id, k, sum(b * g)::BIGINT AS tp, sum(b)::BIGINT AS ps, avg(b) AS mb FROM cc GROUP BY img_id, k),
ce_ AS (SELECT img_id, k, g, b, count(*) AS many FROM cc GROUP BY ALL),
cv AS (SELECT im.*, k, tp, ps, precision, recall, {_f("precision", "recall")} AS fm, em FROM im JOIN (
  SELECT img_id, k, any_value(tp) AS tp, any_value(ps) AS ps, CASE WHEN any_value(ps) = 0 THEN 0E0 ELSE any_value(tp) / CAST(any_value(ps) AS DOUBLE) END AS precision,
         CASE WHEN any_value(f) = 0 THEN 0E0 ELSE any_value(tp) / CAST(any_value(f) AS DOUBLE) END AS recall, {_aligned("b").replace("sum(CASE", "sum(many * CASE")} AS em
  FROM ce_ JOIN cm USING (img_id, k) JOIN (SELECT img_id, f, n FROM im) USING (img_id) GROUP BY img_id, k) USING (img_id))
"""
_Q = ", ".join(f"avg(p) FILTER (q = {k}) AS x{k}, avg(g) FILTER (q = {k}) AS y{k}, var_samp(p) FILTER (q = {k}) AS vx{k}, var_samp(g) FILTER (q = {k}) AS vy{k}, covar_samp(p, g) FILTER (q = {k}) AS c{k}" for k in range(4))
_W = ["(cx * cy / CAST(n AS DOUBLE))", "(cy * (w - cx) / CAST(n AS DOUBLE))", "((h - cy) * cx / CAST(n AS DOUBLE))"]
_W.append(f"(1 - {_W[0]} - {_W[1]} - {_W[2]})")
_REG = " + ".join(f"{_W[k]} * {_ssim(k)}" for k in range(4))
_U = "(f / CAST(n AS DOUBLE))"
_STRUCTURE = f""",
ce AS (SELECT img_id, CAST(round_even(sum(g * x) / CAST(nullif(sum(g), 0) AS DOUBLE), 0) + 1 AS INTEGER) AS cx, CAST(round_even(sum(g * y) / CAST(nullif(sum(g), 0) AS DOUBLE), 0) + 1 AS INTEGER) AS cy FROM px GROUP BY img_id),
qd AS (SELECT px.*, cx, cy, CASE WHEN y < cy THEN 0 ELSE 2 END + CASE WHEN x < cx THEN 0 ELSE 1 END AS q FROM px JOIN ce USING (img_id)),
qs AS (SELECT img_id, cx, cy, avg(p) FILTER (g = 1) AS m1, stddev_samp(p) FILTER (g = 1) AS s1, avg(1 - p) FILTER (g = 0) AS m0, stddev_samp(1 - p) FILTER (g = 0) AS s0, {_Q} FROM qd GROUP BY img_id, cx, cy),
so AS (SELECT im.*, {_U} * {_alike("m1", "s1")} + (1 - {_U}) * {_alike("m0", "s0")} AS sm_object, {_REG} AS sm_region FROM im JOIN qs USING (img_id)),
sm AS (SELECT *, CASE f WHEN 0 THEN 1 - mean_p WHEN n THEN mean_p ELSE greatest(coalesce((sm_object + sm_region) / 2, 0), 0) END AS sm FROM so)
"""
_NEAR = """,
nf AS (SELECT a.img_id, a.pos, arg_min(b.pos, ((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) * 64 + b.pos) AS np
       FROM px a JOIN px b ON a.img_id = b.img_id AND a.g = 0 AND b.g = 1 GROUP BY a.img_id, a.pos),
nr AS (SELECT nf.img_id, nf.pos, (nf.pos // 8 - np // 8) * (nf.pos // 8 - np // 8) + (nf.pos % 8 - np % 8) * (nf.pos % 8 - np % 8) AS d2, np // 8 AS ny, np % 8 AS nx FROM nf)
"""
_KERNEL = """,
kr AS (SELECT dy, dx, exp(-(dx * dx + dy * dy) / 50.0::DOUBLE) AS k FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx)),
kn AS (SELECT dy, dx, k / (SELECT sum(k) FROM kr) AS k FROM kr)
"""
_WEIGHTED = f"""{_NEAR}{_KERNEL},
ee AS (SELECT px.*, abs(p - g) AS er, d2, CASE WHEN px.g = 1 THEN px.pos ELSE ny * 8 + nx END AS src FROM px LEFT JOIN nr USING (img_id, pos)),
et AS (SELECT a.*, b.er AS et FROM ee a JOIN ee b ON a.img_id = b.img_id AND b.pos = a.src),
ea AS (SELECT a.img_id, a.pos, sum(k * b.et) AS ea FROM et a, kn JOIN et b ON b.img_id = a.img_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.img_id, a.pos),
ew AS (SELECT et.img_id, g, CASE WHEN g = 1 AND ea < er THEN ea ELSE er END * CASE WHEN g = 1 THEN 1 ELSE 2 - exp(ln(0.5::DOUBLE) / 5 * sqrt(d2)) END AS ew FROM et JOIN ea USING (img_id, pos)),
wq AS (SELECT img_id, sum(g) - sum(ew) FILTER (g = 1) AS tpw, coalesce(sum(ew) FILTER (g = 0), 0) AS fpw, 1 - avg(ew) FILTER (g = 1) AS r FROM ew GROUP BY img_id),
wf AS (SELECT im.*, CASE WHEN f = 0 THEN 0E0 ELSE 2 * r * (tpw / (tpw + fpw + {_EPS})) / (r + tpw / (tpw + fpw + {_EPS}) + {_EPS}) END AS wfm FROM im LEFT JOIN wq USING (img_id))
"""
_EDGE = """,
sobel AS (SELECT * FROM (VALUES (-1,-1,1,1),(-1,0,0,2),(-1,1,-1,1),(0,-1,2,0),(0,1,-2,0),(1,-1,1,-1),(1,0,0,-2),(1,1,-1,-1)) k(dy, dx, kx, ky)),
"""


def _edge(column: str, name: str) -> str:
    return f"{name} AS (SELECT a.img_id, a.pos, sqrt(power(sum(kx * b.{column}), 2) + power(sum(ky * b.{column}), 2) + 1e-8) AS edge FROM px a, sobel JOIN px b ON b.img_id = a.img_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.img_id, a.pos)"


_LOSS = f"""{_EDGE}{_edge("s", "es")}, {_edge("t", "eo")},
ls AS (SELECT px.img_id, px.class, 0.7 * avg(abs(es.edge - eo.edge)) + 0.3 * avg(-(t * greatest(CASE WHEN s > 0 THEN ln(s) ELSE -100 END, -100) + (1 - t) * greatest(CASE WHEN 1 - s > 0 THEN ln(1 - s) ELSE -100 END, -100)) WEIGHT) AS loss
       FROM px JOIN es USING (img_id, pos) JOIN eo USING (img_id, pos) GROUP BY px.img_id, px.class)
"""
_PLAIN = _LOSS.replace(" WEIGHT", "")
_SELECT = f"""{_PLAIN},
lr AS (SELECT img_id, round(loss, 9) AS loss FROM ls),
sel AS (SELECT * FROM lr WHERE loss < 0.8 * (SELECT avg(loss) FROM lr)),
pk AS (SELECT px.img_id, pos, CASE WHEN t < 0.4 THEN 0E0 ELSE t END AS z FROM px JOIN sel USING (img_id)),
pm AS (SELECT img_id, min(z) AS lo, max(z) AS hi FROM pk GROUP BY img_id HAVING max(z) >= 0.4)
"""


def _taps(size: int = 31, reach: float = 4.0) -> str:
    """One axis of the attention kernel: roots of normal probabilities of equal cells; the two ends lie half a cell beyond the reach."""
    from statistics import NormalDist

    half = reach + reach / size + 1 / (2 * size)
    edges = [-half + k * (2 * reach + (2 * reach + 1) / size) / size for k in range(size + 1)]
    roots = [(NormalDist().cdf(b) - NormalDist().cdf(a)) ** 0.5 for a, b in zip(edges, edges[1:], strict=False)]
    return "(VALUES " + ", ".join(f"({k - size // 2}, {r / sum(roots)!r}::DOUBLE)" for k, r in enumerate(roots)) + ") k(d, wt)"


_TAPS = _taps()
_PATH = "SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '.tif' END AS path FROM pages"
_R6 = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _report(by: str) -> str:
    scores = ["sm", "wfm", "mae", "adp_em", "mean_em", "max_em", "adp_fm", "mean_fm", "max_fm"]
    return f"""{_BASE}{_ADAPTIVE}{_CURVE}{_STRUCTURE}{_WEIGHTED},
    ma AS (SELECT img_id, avg(abs(p - g)) AS mae FROM px GROUP BY img_id),
    a AS (SELECT {by}, avg(sm) AS sm, avg(wfm) AS wfm, avg(mae) AS mae, avg(adp_em) AS adp_em, avg(adp_fm) AS adp_fm
          FROM im JOIN (SELECT img_id, sm FROM sm) USING (img_id) JOIN (SELECT img_id, wfm FROM wf) USING (img_id) JOIN ma USING (img_id) JOIN (SELECT img_id, adp_em, adp_fm FROM ad) USING (img_id) GROUP BY {by}),
    c AS (SELECT {by}, k, avg(fm) AS fm, avg(em) AS em FROM cv GROUP BY {by}, k),
    d AS (SELECT {by}, avg(em) AS mean_em, max(em) AS max_em, avg(fm) AS mean_fm, max(fm) AS max_fm FROM c GROUP BY {by})
    SELECT {by}, {", ".join(f"round_even({s}, 4) AS {s}" for s in scores)} FROM a JOIN d USING ({by})"""


def _resized(corners: bool) -> str:
    sy = "j * 7 / 10.0::DOUBLE" if corners else "least(greatest((j + 0.5) * 8 / 11.0::DOUBLE - 0.5, 0), 7)"
    coordinate = lambda a: f"CAST({sy.replace('j', a)} AS DOUBLE)"
    return f"""SELECT img_id, pos, round((p00 * (1 - fx) + p01 * fx) * (1 - fy) + (p10 * (1 - fx) + p11 * fx) * fy, 6) AS v, {str(corners).lower()} AS corners FROM (
      SELECT q.img_id, i * 11 + j AS pos, cy - floor(cy) AS fy, cx - floor(cx) AS fx,
             q.p[CAST(floor(cy) * 8 + floor(cx) + 1 AS INTEGER)] AS p00, q.p[CAST(floor(cy) * 8 + least(floor(cx) + 1, 7) + 1 AS INTEGER)] AS p01,
             q.p[CAST(least(floor(cy) + 1, 7) * 8 + floor(cx) + 1 AS INTEGER)] AS p10, q.p[CAST(least(floor(cy) + 1, 7) * 8 + least(floor(cx) + 1, 7) + 1 AS INTEGER)] AS p11
      FROM (SELECT img_id, list(p ORDER BY pos) AS p FROM px GROUP BY img_id) q,
           (SELECT i, j, {coordinate("i")} AS cy, {coordinate("j")} AS cx FROM (SELECT unnest(range(0, 11)) AS i), (SELECT unnest(range(0, 11)) AS j)))"""


def _cycle() -> str:
    """Two rounds of selection: the second with the teachers that the first has labelled."""
    again = _BASE.replace("pr AS (SELECT class, arg_min(e, img_id) AS pe FROM v GROUP BY class)", "pr AS (SELECT class, coalesce(arg_min(e, img_id) FILTER (img_id IN (SELECT img_id FROM one)), arg_min(e, img_id)) AS pe FROM v GROUP BY class)")
    assert again != _BASE
    second = again.replace("WITH RECURSIVE", f"WITH RECURSIVE one AS (SELECT img_id FROM ({_BASE}{_SELECT} SELECT img_id FROM pm)),", 1)
    return f"""{second}{_SELECT},
    two AS (SELECT img_id || '.png' AS name FROM pm), fst AS (SELECT img_id || '.png' AS name FROM one)
    SELECT name, 'round 2' AS origin FROM two UNION ALL SELECT name, 'round 1' FROM fst WHERE name NOT IN (SELECT name FROM two)
    UNION ALL SELECT doc_id || '.png', 'source' FROM labels WHERE doc_id || '.png' NOT IN (SELECT name FROM two UNION SELECT name FROM fst)"""


ORACLE_SQL: dict[str, str] = {
    "prepare_pixels": f"{_BASE} SELECT img_id, pos, round(p, 6) AS p, g FROM px",
    "mae_image": f"{_BASE} SELECT img_id, round(avg(abs(p - g)), 6) AS mae FROM px GROUP BY img_id",
    "mae_report": f"{_BASE} SELECT method, round(avg(mae), 6) AS mae, count(*) AS images FROM (SELECT img_id, method, avg(abs(p - g)) AS mae FROM px GROUP BY ALL) GROUP BY method",
    "mae_stream": f"{_BASE} SELECT method, round(avg(mae), 6) AS mae, count(*) AS images FROM (SELECT img_id, method, avg(abs(p - g)) AS mae FROM px GROUP BY ALL) GROUP BY method",
    "fm_adaptive": f"{_BASE}{_ADAPTIVE} SELECT img_id, tp, ps, {_R6('adp_fm')} FROM ad",
    "em_adaptive": f"{_BASE}{_ADAPTIVE} SELECT img_id, {_R6('adp_em')} FROM ad",
    "pr_curve": f"{_BASE}{_CURVE} SELECT img_id, k, tp, ps, {_R6('precision', 'recall', 'fm')} FROM cv",
    "fm_curve_mean": f"{_BASE}{_CURVE} SELECT method, k, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(fm), 6) AS fm FROM cv GROUP BY method, k",
    "em_curve": f"{_BASE}{_CURVE} SELECT img_id, k, {_R6('em')} FROM cv",
    "em_curve_mean": f"{_BASE}{_CURVE} SELECT method, k, round(avg(em), 6) AS em FROM cv GROUP BY method, k",
    "sm_object": f"{_BASE}{_STRUCTURE} SELECT img_id, {_R6('sm_object')} FROM sm WHERE f > 0 AND f < n",
    "sm_region": f"{_BASE}{_STRUCTURE} SELECT img_id, {_R6('sm_region')} FROM sm WHERE f > 0 AND f < n",
    "sm_image": f"{_BASE}{_STRUCTURE} SELECT img_id, {_R6('sm')} FROM sm",
    "edt_nearest": f"{_BASE}{_NEAR} SELECT img_id, pos, d2, ny, nx FROM nr",
    "wfm_image": f"{_BASE}{_WEIGHTED} SELECT img_id, {_R6('wfm')} FROM wf",
    "dice_loss": f"{_BASE} SELECT img_id, round(1 - 2 * (sum(pred / 255.0::DOUBLE * (gt / 255.0::DOUBLE)) + 1) / (sum(pred / 255.0::DOUBLE) + sum(gt / 255.0::DOUBLE) + 1), 6) AS dice_loss FROM px GROUP BY img_id",
    "iou_soft": f"{_BASE} SELECT img_id, round(i / nullif(sg + sp - i, 0), 6) AS iou FROM (SELECT img_id, sum(pred / 255.0::DOUBLE * (gt / 255.0::DOUBLE)) AS i, sum(pred / 255.0::DOUBLE) AS sp, sum(gt / 255.0::DOUBLE) AS sg FROM px GROUP BY img_id)",
    "iou_confusion": f"{_BASE} SELECT method, round(count(*) FILTER (g = 0 AND p < 0.5) / CAST(nullif(count(*) FILTER (g = 0 OR p < 0.5), 0) AS DOUBLE), 6) AS iou_0, round(count(*) FILTER (g = 1 AND p >= 0.5) / CAST(nullif(count(*) FILTER (g = 1 OR p >= 0.5), 0) AS DOUBLE), 6) AS iou_1 FROM px GROUP BY method",
    "eval_report": _report("dataset, method"),
    "eval_superclass": _report("class, method"),
    "eval_subclass": f"SELECT 'cls' || class || '_' AS class, * EXCLUDE (class) FROM ({_report('class, method')}) WHERE class IN (1, 2, 3)",
    "eval_sets": f"SELECT *, NULL::INTEGER AS class FROM ({_report('dataset, method')}) UNION ALL BY NAME SELECT *, NULL::VARCHAR AS dataset FROM ({_report('class, method')})",
    "raw_mae": f"""{_BASE}, mx AS (SELECT img_id, min(pred) AS plo, max(pred) AS phi, max(gt) AS ghi FROM raw GROUP BY img_id)
        SELECT method, round(avg(mae), 6) AS mae, count(*) AS images FROM (
          SELECT img_id, method, avg(abs((pred - mx.plo) / (mx.phi - mx.plo + 1e-8) - gt / (ghi + 1e-8))) AS mae FROM raw JOIN mx USING (img_id) GROUP BY ALL) GROUP BY method""",
    "grey_levels": f"{_BASE} SELECT img_id, pos, CAST(floor(pred * 0.299::DOUBLE + gt * 0.587::DOUBLE + (255 - pred) * 0.114::DOUBLE + 0.5::DOUBLE) AS INTEGER) AS v FROM raw",
    "class_predicate": "SELECT page_id, class FROM pages, (VALUES ('/en/'), ('/fr/'), ('casino'), ('example.org')) c(class) WHERE contains(url, class)",
    "batch_shuffled": "SELECT doc_id AS img_id, (row_number() OVER (ORDER BY md5(doc_id || ':7')) - 1) // 16 AS batch FROM documents",
    "manifest_scan": f"SELECT * FROM ({_PATH}) WHERE path LIKE '%.jpg' OR path LIKE '%.png'",
    "name_normalise": f"SELECT page_id, CASE WHEN n LIKE '%.jpg' THEN split_part(n, '.jpg', 1) || '.png' ELSE n END AS name FROM (SELECT page_id, split_part(path, '/', -1) AS n FROM ({_PATH}))",
    "manifest_positional": "SELECT a.rank, a.img_id, b.img_id AS mask_id FROM (SELECT doc_id AS img_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents) a JOIN (SELECT doc_id AS img_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM labels) b USING (rank)",
    "manifest_pair": "SELECT doc_id AS img_id, quality, source, n_chars FROM labels JOIN documents USING (doc_id)",
    "integrity_check": "SELECT coalesce(d.doc_id, l.doc_id) AS img_id, CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'right' END AS only_in FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
    "list_difference": "SELECT doc_id AS img_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)",
    "size_filter": "SELECT doc_id AS img_id, n_chars % 7 AS img_w, doc_id % 7 AS gt_w FROM documents JOIN labels USING (doc_id) WHERE n_chars % 7 = doc_id % 7",
    "es_loss": f"{_BASE}{_PLAIN} SELECT img_id, {_R6('loss')} FROM ls",
    "es_loss_weighted": f"{_BASE}{_LOSS.replace('WEIGHT', '* (t + 0.5)')} SELECT img_id, {_R6('loss')} FROM ls",
    "sobel_edges": f"{_BASE}{_EDGE}{_edge('p', 'ep')} SELECT img_id, pos, round(edge, 6) AS v FROM ep",
    "structure_loss": f"""{_BASE},
        bx AS (SELECT a.img_id, a.pos, sum(b.g) / 961.0::DOUBLE AS box FROM px a JOIN px b ON a.img_id = b.img_id AND abs(a.y - b.y) <= 15 AND abs(a.x - b.x) <= 15 GROUP BY a.img_id, a.pos),
        sx AS (SELECT px.img_id, g, val, 1 + 5 * abs(box - g) AS wt, 1 / (1 + exp(-val)) AS s FROM (SELECT img_id, pos, g, val FROM px) px JOIN bx USING (img_id, pos)),
        ag AS (SELECT img_id, sum(s * g * wt) AS i, sum((s + g) * wt) AS un, avg(greatest(val, 0) - val * g + ln(1 + exp(-abs(val)))) AS bce FROM sx GROUP BY img_id)
        SELECT img_id, round(bce + 1 - (i + 1) / (un - i + 1), 6) AS loss FROM ag""",
    "bce_logits": f"{_BASE} SELECT img_id, round(avg(greatest(val, 0) - val * g + ln(1 + exp(-abs(val)))), 6) AS loss FROM px GROUP BY img_id",
    "cls_mean_loss": f"{_BASE}{_SELECT} SELECT round(avg(loss), 6) AS mean_loss, count(*) AS images FROM lr",
    "cls_select": f"{_BASE}{_SELECT} SELECT img_id, {_R6('loss')} FROM sel",
    "cls_pseudo": f"{_BASE}{_SELECT} SELECT img_id, pos, round((z - lo) / (hi - lo + 1e-8), 6) AS v FROM pk JOIN pm USING (img_id)",
    "cls_union": f"{_BASE}{_SELECT} SELECT img_id || '.png' AS name, 'pseudo' AS origin FROM pm UNION ALL SELECT doc_id || '.png', 'source' FROM labels WHERE doc_id NOT IN (SELECT img_id FROM pm)",
    "checkpoint_fallback": "SELECT user_id, coalesce(max(event_id) FILTER (event_type = 'purchase'), max(event_id) FILTER (event_type = 'click'), -1) AS chosen FROM events GROUP BY user_id",
    "resize_bilinear": f"{_BASE} {_resized(True)} UNION ALL {_resized(False)}",
    "attn_norm": f"{_BASE} SELECT img_id, pos, round(s, 6) AS v FROM raw",
    "attn_blur": f"{_BASE}{_KERNEL} SELECT a.img_id, a.pos, round(sum(k * b.p), 6) AS v FROM px a, kn JOIN px b ON b.img_id = a.img_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.img_id, a.pos",
    "search_attention": f"""{_BASE},
        br AS (SELECT a.img_id, a.pos, a.y, a.x, sum(wt * b.p) AS r FROM px a, {_TAPS} JOIN px b ON b.img_id = a.img_id AND b.y = a.y AND b.x = a.x + d GROUP BY ALL),
        bc AS (SELECT a.img_id, a.pos, sum(wt * b.r) AS c FROM br a, {_TAPS} JOIN br b ON b.img_id = a.img_id AND b.x = a.x AND b.y = a.y + d GROUP BY ALL),
        bm AS (SELECT img_id, min(c) AS clo, max(c) AS chi FROM bc GROUP BY img_id)
        SELECT px.img_id, px.pos, round(val * greatest((c - clo) / (chi - clo + 1e-8), p), 6) AS v FROM px JOIN bc USING (img_id, pos) JOIN bm USING (img_id)""",
    "mask_sink": f"{_BASE} SELECT img_id, pos, CAST(round_even(p * 255, 0) AS INTEGER) AS px FROM px",
    "gt_scale": f"{_BASE} SELECT img_id, pos, round(gt / (max(gt) OVER (PARTITION BY img_id) + 1e-8), 6) AS v FROM raw",
    "normalise_channels": f"{_BASE} SELECT img_id, pos, round((p - 0.485) / 0.229, 6) AS c0, round((p - 0.456) / 0.224, 6) AS c1, round((p - 0.406) / 0.225, 6) AS c2 FROM px",
    "flip_h": f"{_BASE} SELECT img_id, CASE WHEN img_id % 2 = 0 THEN y * 8 + 7 - x ELSE pos END AS pos, round(p, 6) AS v FROM px",
    "straight_through": f"{_BASE} SELECT img_id, pos, CASE WHEN p >= 0.5 THEN 1E0 ELSE 0E0 END AS v FROM px",
    "batch_assign": "SELECT doc_id AS img_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents",
    "batch_zip": "WITH a AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents), b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM labels) SELECT batch, a.first, a.rows, b.first AS target_first, b.rows AS target_rows FROM (SELECT batch, min(doc_id) AS first, count(*) AS rows FROM a GROUP BY batch) a JOIN (SELECT batch, min(doc_id) AS first, count(*) AS rows FROM b GROUP BY batch) b USING (batch)",
    "running_best": "SELECT event_id, value, best_before, value < best_before AS improves FROM (SELECT event_id, value, least(1000.0::DOUBLE, min(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS best_before FROM events)",
    "ema_params": f"{_BASE} SELECT img_id, pos, round(0.9996 * pval + (1 - 0.9996) * val, 6) AS v FROM raw",
    "channel_stretch": f"""{_BASE}, ch AS (SELECT img_id, pos, unnest([0, 1, 2]) AS channel, unnest([pred, gt, 255 - pred]) AS u FROM raw)
        SELECT img_id, channel, pos, round((u - min(u) OVER w) / (max(u) OVER w - min(u) OVER w + 1e-8), 6) AS v FROM ch WINDOW w AS (PARTITION BY img_id, channel)""",
    "channel_normalise": f"""{_BASE}, ch AS (SELECT img_id, pos, unnest([0, 1, 2]) AS channel, unnest([pred, gt, 255 - pred]) AS u FROM raw)
        SELECT img_id, channel, pos, round((u / 255.0::DOUBLE - m) / s, 6) AS v FROM ch JOIN (VALUES (0, 0.485::DOUBLE, 0.229::DOUBLE), (1, 0.456::DOUBLE, 0.224::DOUBLE), (2, 0.406::DOUBLE, 0.225::DOUBLE)) z(channel, m, s) USING (channel)""",
    "pairing_outcomes": """WITH m AS (SELECT doc_id AS img_id, doc_id % 3 AS h FROM labels WHERE doc_id % 5 > 0), p AS (SELECT doc_id AS img_id, n_chars % 3 AS h FROM documents WHERE doc_id % 7 > 0)
        SELECT img_id, CASE WHEN p.h IS NULL THEN 'no_prediction' WHEN m.h IS NULL THEN 'no_mask' WHEN m.h = p.h THEN 'paired' ELSE 'resized' END AS outcome FROM m FULL JOIN p USING (img_id)""",
    "output_selection": f"{_BASE} SELECT img_id, pos, round(CASE WHEN img_id % 2 = 0 THEN val ELSE pval END, 6) AS v FROM raw",
    "eval_stream": _report("dataset, method"),
    "snapshot_versions": """SELECT doc_id AS img_id, 'GT/' || doc_id || '.png' AS path, quality, seen FROM labels JOIN (VALUES (1, 'before'), (0, 'after'), (1, 'as of 1')) t(q, seen) ON q = quality""",
    "checkpoint_catalogue": """WITH e AS (SELECT label AS run, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, CAST(embedding AS DOUBLE[]) AS w FROM embeddings),
        b AS (SELECT *, abs(w[1]) < min(abs(w[1])) OVER (PARTITION BY run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS better FROM e),
        s AS (SELECT run, 'epoch_' || k AS name, k FROM e WHERE k % 10 = 0 OR k > 45 UNION ALL SELECT run, 'best', max(k) FROM b WHERE better AND run % 2 = 1 GROUP BY run),
        c AS (SELECT run, name, k, row_number() OVER (PARTITION BY run ORDER BY r) AS place FROM s JOIN (VALUES ('best', 1), ('epoch_50', 2), ('epoch_10', 3)) t(name, r) USING (name))
        SELECT run, name, k - 1 AS epoch, unnest(range(0, len(w))) AS pos, round(unnest(w), 6) AS w FROM c JOIN e USING (run, k) WHERE place = 1""",
    "snapshot_copy": "SELECT doc_id AS img_id, 'GT/' || doc_id || '.png' AS path, quality FROM labels",
    "report_sink": "SELECT dataset, method, " + ", ".join(f"printf('%.4f', {c}) AS {c}" for c in ("sm", "wfm", "mae", "adp_em", "mean_em", "max_em", "adp_fm", "mean_fm", "max_fm")) + f" FROM ({_report('dataset, method')})",
    "log_sink": "SELECT CAST(epoch AS INTEGER) AS epoch, event_id AS step, round(value * epoch, 6) AS loss FROM events, (VALUES (1), (2)) t(epoch) WHERE event_id % 10 = 0",
    "self_training": _cycle(),
    "ema_series": "WITH z AS (SELECT user_id, value, count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ago FROM events) SELECT user_id, round(sum(0.1 * value * power(0.9, ago)), 6) AS ema FROM z GROUP BY user_id",
    "grad_clip": f"{_BASE} SELECT img_id, pos, round(least(greatest(val, -0.1), 0.1), 6) AS v FROM raw",
    "log_cadence": "SELECT event_type, count(*) AS steps FROM events WHERE event_id % 10 = 0 GROUP BY event_type",
}
