"""The registered queries of the raster engine and their DuckDB SQL.

The rasters come from the driver's tables: "emb" is one grey image (embeddings), "evt" one image of
30 by 24 cells with four channels (event counts). Templates are parts of them, one degraded and one
flat. SQL builds the same pixels and sums; scores are compared in double precision.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import matching, peaks, rules
from .plans import geometry
from .sources import rasters

Query = Callable[[SparkSession, str], DataFrame]

#: (template_id, x0, y0, w, h, kind) of the grey and the colour templates.
GREY = [(0, 10, 100, 8, 8, "crop"), (1, 30, 20, 12, 6, "crop"), (2, 0, 200, 5, 5, "crop"), (3, 0, 0, 4, 4, "flat"), (4, 40, 300, 8, 8, "degraded")]
COLOUR = [(10, 3, 5, 5, 6, "crop"), (11, 10, 12, 8, 4, "crop"), (12, 0, 0, 3, 3, "flat"), (13, 14, 20, 6, 6, "degraded")]
#: Larger grey templates: a tall, a wide and a square one.
LARGE = [(50, 10, 20, 24, 24, "crop"), (51, 2, 40, 60, 9, "degraded"), (52, 30, 30, 9, 60, "crop")]
#: (rule_id, name, roi, gray, threshold, mode, template_ids) over the colour raster.
RULES = [
    (1, "first-of-two", None, False, 0.95, rules.FIRST, [13, 10]),
    (2, "best-in-region", (8, 24, 24, 10), True, 0.5, rules.ALL, [11, 13]),
    (3, "grey-flat", (0, 0, 12, 12), True, 0.9, rules.FIRST, [12, 10]),
    (4, "does-not-fit", (0, 0, 4, 4), False, 0.1, rules.ALL, [10, 11]),
    (5, "best-of-all", None, False, 0.2, rules.ALL, [10, 11, 13]),
]
PLANS = [(8, 8, 57, 493), (128, 128, 1793, 953), (300, 200, 1301, 801), (17, 13, 81, 49), (33, 257, 8, 44), (3000, 2000, 1, 1), (24, 24, 1577, 977), (96, 32, 3745, 2129), (1, 1, 50, 40), (1, 400, 2000, 1), (400, 1, 1, 2000)]

#: (template_id, w, h, flat, channels): the sides of the grey and colour templates, and some that cover others, or don't.
SIDES = [(i, w, h, k == "flat", c) for c, specs in ((1, GREY), (4, COLOUR)) for i, _, _, w, h, k in specs] + [(30, 300, 8, False, 3), (31, 8, 300, False, 3), (32, 200, 100, False, 3), (33, 24, 24, False, 4), (34, 400, 300, True, 4)]

R_EMB = "emb AS (SELECT vec_id::INT AS y, (i - 1)::INT AS x, 0 AS c, least(255, greatest(0, floor((embedding[i]::DOUBLE + 1) * 127.5)))::BIGINT AS v FROM embeddings, generate_series(1, len(embedding)) g(i))"
R_EVT = """cell AS (SELECT (day(ts) - 1)::INT AS y, hour(ts)::INT AS x, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS c, count(*) AS n
  FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup') GROUP BY ALL),
evt AS (SELECT y::INT AS y, x::INT AS x, c::INT AS c, floor(255 * coalesce(n, 0) / (SELECT max(n) FROM (SELECT sum(n) AS n FROM cell GROUP BY y, x, c)))::BIGINT AS v
  FROM generate_series(0, 29) a(y) CROSS JOIN generate_series(0, 23) b(x) CROSS JOIN generate_series(0, 3) d(c) LEFT JOIN cell USING (y, x, c))"""
R_ORD = """line AS (SELECT (l_orderkey % 256)::INT AS y, (l_linenumber - 1)::INT AS x, sum(round(l_quantity * 100)::BIGINT)::BIGINT * 5 // (100 * count(*)) AS a, sum(round(l_discount * 100)::BIGINT)::BIGINT * 2550 // (100 * count(*)) AS b, sum(round(l_tax * 100)::BIGINT)::BIGINT * 3187 // (100 * count(*)) AS d FROM lineitem GROUP BY ALL),
ord AS (SELECT y.y, x.x, c.c, coalesce(CASE c.c WHEN 0 THEN a WHEN 1 THEN b ELSE d END, 0) AS v FROM (SELECT DISTINCT y FROM line) y CROSS JOIN (SELECT i::INT AS x FROM generate_series(0, 6) g(i)) x CROSS JOIN (SELECT i::INT AS c FROM generate_series(0, 2) g(i)) c LEFT JOIN line USING (y, x))"""
R_GREY = "gry AS (SELECT y, x, 0 AS c, (4899 * max(v) FILTER (c = 0) + 9617 * max(v) FILTER (c = 1) + 1868 * max(v) FILTER (c = 2) + 8192) >> 14 AS v FROM evt GROUP BY y, x)"


def altered(kind: str, v: str) -> str:
    return {"crop": v, "flat": "100", "degraded": f"least(255, greatest(0, {v} + (7 * ty + 13 * tx) % 41 - 20))"}[kind]


def templates_sql(source: str, specs: list, name: str = "tpl") -> str:
    parts = [f"SELECT template_id, w, h, ty, tx, c, {altered(k, 'v')}::BIGINT AS tv FROM (SELECT {i}::BIGINT AS template_id, {w} AS w, {h} AS h, y - {y0} AS ty, x - {x0} AS tx, c, v FROM {source} WHERE y >= {y0} AND y < {y0 + h} AND x >= {x0} AND x < {x0 + w})" for i, x0, y0, w, h, k in specs]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def response_sql(source: str, tpl: str = "tpl", name: str = "resp") -> str:
    p = name
    return f"""{p}_st AS (SELECT template_id, c, count(*) AS area, sum(tv)::BIGINT AS tsum, sum(tv * tv)::BIGINT AS tsq FROM {tpl} GROUP BY ALL),
{p}_var AS (SELECT template_id, sum(area * tsq - tsum * tsum)::BIGINT AS var_sum FROM {p}_st GROUP BY ALL),
{p}_ch AS (SELECT t.template_id, p.y - t.ty AS y, p.x - t.tx AS x, p.c, sum(p.v * t.tv)::BIGINT AS corr, sum(p.v)::BIGINT AS s, sum(p.v * p.v)::BIGINT AS s2
  FROM {source} p JOIN {tpl} t ON p.c = t.c CROSS JOIN (SELECT max(y) + 1 AS ih, max(x) + 1 AS iw FROM {source}) d
  WHERE p.y - t.ty BETWEEN 0 AND d.ih - t.h AND p.x - t.tx BETWEEN 0 AND d.iw - t.w GROUP BY ALL),
{p}_sum AS (SELECT k.template_id, y, x, area, var_sum, sum(corr)::BIGINT AS corr, sum(s * tsum)::BIGINT AS cr, sum(s * s)::BIGINT AS sq, sum(s2)::BIGINT AS s2
  FROM {p}_ch k JOIN {p}_st USING (template_id, c) JOIN {p}_var USING (template_id) GROUP BY ALL),
{p}_num AS (SELECT *, corr::DOUBLE - cr::DOUBLE / area::DOUBLE AS num, (area * s2 - sq)::DOUBLE / area::DOUBLE AS spread FROM {p}_sum),
{p}_den AS (SELECT *, CASE WHEN spread > least(0.5::DOUBLE, 1.1920928955078125e-06::DOUBLE * s2::DOUBLE) THEN sqrt(spread) * sqrt(var_sum::DOUBLE / area::DOUBLE) ELSE 0.0::DOUBLE END AS den FROM {p}_num),
{p} AS (SELECT 0::BIGINT AS image_id, template_id, y::INT AS y, x::INT AS x, CASE WHEN var_sum = 0 THEN 1.0::DOUBLE WHEN abs(num) < den THEN num / den WHEN abs(num) < 1.125::DOUBLE * den THEN sign(num)::DOUBLE ELSE 0.0::DOUBLE END AS score FROM {p}_den)"""


def extrema_sql(source: str, keys: str = "image_id, template_id") -> str:
    return f"""SELECT {keys}, first(s ORDER BY s, y, x) AS min_v, first(x ORDER BY s, y, x) AS min_x, first(y ORDER BY s, y, x) AS min_y,
  first(s ORDER BY s DESC, y, x) AS max_v, first(x ORDER BY s DESC, y, x) AS max_x, first(y ORDER BY s DESC, y, x) AS max_y
FROM (SELECT *, score::FLOAT AS s FROM {source}) GROUP BY {keys}"""


EMB = f"WITH {R_EMB}, {templates_sql('emb', GREY)}, {response_sql('emb')}"
EVT = f"WITH {R_EVT}, {templates_sql('evt', COLOUR)}, {response_sql('evt')}"
EVT_GREY = f"WITH {R_EVT}, {R_GREY}, {templates_sql('evt', COLOUR, 'colour')}, tpl AS (SELECT template_id, w, h, ty, tx, 0 AS c, (4899 * max(tv) FILTER (c = 0) + 9617 * max(tv) FILTER (c = 1) + 1868 * max(tv) FILTER (c = 2) + 8192) >> 14 AS tv FROM colour GROUP BY ALL), {response_sql('gry')}"


def only(sql: str, *ids: int) -> str:
    """The same SQL for a few of the templates."""
    return sql.replace("FROM resp_den)", f"FROM resp_den WHERE template_id IN ({', '.join(map(str, ids))}))")


def cut_templates(rows: DataFrame, specs: list, channels: int) -> DataFrame:
    out = []
    for k, (i, x0, y0, w, h, kind) in enumerate(specs):
        part = rasters.crop(rows, channels, x0, y0, w, h)
        if kind == "flat":
            part = part.withColumn("data", F.transform("data", lambda v: F.lit(100)))
        if kind == "degraded":
            part = part.withColumn("data", F.transform("data", lambda v, j: F.least(F.lit(255), F.greatest(F.lit(0), v + (7 * F.col("y") + 13 * F.floor(j / channels).cast("int")) % 41 - 20))))
        out.append(matching.template(rows.sparkSession, part, i, k, channels=channels))
    return reduce(DataFrame.unionByName, out)


def grey_templates(templates: DataFrame, channels: int) -> DataFrame:
    return rasters.grey_rows(templates, channels).withColumn("gray", F.lit(True))


def emb(spark: SparkSession, sf: str, *ids: int) -> tuple[DataFrame, DataFrame]:
    rows = rasters.embedding_rows(spark, sf)
    return rows, cut_templates(rows, [g for g in GREY if not ids or g[0] in ids], 1)


def evt(spark: SparkSession, sf: str, *ids: int) -> tuple[DataFrame, DataFrame]:
    rows = rasters.event_rows(spark, sf)
    return rows, cut_templates(rows, [g for g in COLOUR if not ids or g[0] in ids], 4)


def template_stats(spark, sf):
    return matching.template_stats(evt(spark, sf)[1], 4)


def alpha_const(spark, sf):
    rows, _ = evt(spark, sf)
    solid = rows.withColumn("data", F.transform("data", lambda v, i: F.when(i % 4 == 3, 255).otherwise(v))).withColumn("image_id", F.lit(1).cast("long"))
    return matching.alpha_constant(rows.unionByName(solid))


def rgb_to_gray(spark, sf):
    return rasters.pixels(rasters.grey_rows(rasters.event_rows(spark, sf), 4), 1).select("image_id", "y", "x", "v")


def window_sums(spark, sf):
    return matching.window_sums(rasters.embedding_rows(spark, sf), 1, 8, 8)


def corr_map(spark, sf):
    rows, t = emb(spark, sf, 0)
    return matching.sums_by_join(rows, t, 1).select("template_id", "y", "x", "corr", "s", "s2")


def response_map_gray(spark, sf):
    return matching.response_map(*emb(spark, sf, 0, 1))


def response_map_join(spark, sf):
    return matching.response_map(*emb(spark, sf, 0), method="join")


def response_map_color(spark, sf):
    return matching.response_map(*evt(spark, sf), 4)


def match_gray(spark, sf):
    return matching.match(*emb(spark, sf, 0))


def match_color(spark, sf):
    return matching.match(*evt(spark, sf, 10), 4)


def match_constant_alpha(spark, sf):
    """Channels beyond the third are left out where alpha is constant in both images."""
    rows, t = evt(spark, sf, 10)
    return matching.match(rasters.select_channels(rows, 4, 3), rasters.select_channels(t, 4, 3), 3)


def match_auto_alpha(spark, sf):
    """All four channels are passed; alpha is 200 in the image and 90 in the template, so it is left out."""
    rows, t = evt(spark, sf, 10)
    solid = lambda df, a: df.withColumn("data", F.transform("data", lambda v, i: F.when(i % 4 == 3, a).otherwise(v)))
    return matching.match(solid(rows, 200), solid(t, 90), 4)


def match_large(spark, sf):
    """Templates over the size at which sums are taken by transforms, in two buckets."""
    rows = rasters.embedding_rows(spark, sf)
    return matching.match(rows, cut_templates(rows, LARGE, 1))


def fleet_buckets(spark, sf):
    """Large and small, degraded and flat templates in one search."""
    rows = rasters.embedding_rows(spark, sf)
    return matching.find_all(rows, cut_templates(rows, GREY + LARGE, 1))


def peak_digest(spark, sf):
    """How many positions each map has, and that two physical forms have one digest."""
    rows, t = emb(spark, sf, 0, 1)
    a, b = (peaks.digest(matching.response_map(rows, t, method=m)) for m in ("tiles", "join"))
    return a.join(b.withColumnRenamed("digest", "other"), ["image_id", "template_id", "positions"]).select("image_id", "template_id", "positions", (F.col("digest") == F.col("other")).alias("same"))


def match_gray_of_color(spark, sf):
    rows, t = evt(spark, sf)
    return matching.match(rasters.grey_rows(rows, 4), grey_templates(t, 4))


def flat_template(spark, sf):
    return matching.match(*emb(spark, sf, 3))


def fleet_find_all(spark, sf):
    return matching.find_all(*emb(spark, sf))


def threshold_hits(spark, sf):
    return peaks.hits(matching.response_map(*emb(spark, sf, 0, 1, 2)), 0.3)


def nms_peaks(spark, sf):
    return peaks.local_maxima(matching.response_map(*emb(spark, sf, 0, 1, 2)), 0.3, 4, 4)


def topk_peaks(spark, sf):
    return peaks.ranked(peaks.local_maxima(matching.response_map(*emb(spark, sf, 0, 1, 2)), 0.2, 4, 4), 5)


def ambiguity(spark, sf):
    return peaks.ambiguity(peaks.local_maxima(matching.response_map(*emb(spark, sf, 0, 1, 2)), 0.2, 4, 4))


def roi_match(spark, sf):
    """A search within x 4..44, y 40..240; positions in the whole image."""
    rows, t = emb(spark, sf, 0)
    found = matching.match(rasters.crop(rows, 1, 4, 40, 40, 200), t)
    return found.select("image_id", "template_id", "min_v", (F.col("min_x") + 4).alias("min_x"), (F.col("min_y") + 40).alias("min_y"), "max_v", (F.col("max_x") + 4).alias("max_x"), (F.col("max_y") + 40).alias("max_y"))


def fit_filter(spark, sf):
    rows, t = emb(spark, sf)
    return matching.match(rasters.crop(rows, 1, 0, 90, 20, 6), t)


def rule_tables(spark, sf, *ids: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, t = evt(spark, sf)
    own = [(i, k, n, roi, g, th, m, ts) for k, (i, n, roi, g, th, m, ts) in enumerate(RULES) if not ids or i in ids]
    return rows, spark.createDataFrame(own, rules.RULES), t


def flat_verdicts(df: DataFrame) -> DataFrame:
    b = F.col("best")
    return df.select("rule_id", "name", "matched", b["template_id"].alias("template_id"), b["score"].alias("score"), b["rect"]["x0"].alias("x0"), b["rect"]["y0"].alias("y0"), b["rect"]["x1"].alias("x1"), b["rect"]["y1"].alias("y1"), F.size("all").cast("long").alias("evaluated"))


def rule_first(spark, sf):
    return flat_verdicts(rules.verdicts(*rule_tables(spark, sf, 1, 3)))


def rule_all(spark, sf):
    rows, r, t = rule_tables(spark, sf, 2, 5)
    got = rules.verdicts(rows, r, t).select("rule_id", F.posexplode("all").alias("slot", "hit"))
    return got.select("rule_id", F.col("hit.template_id").alias("template_id"), F.col("hit.score").alias("score"), F.col("hit.rect.x0").alias("x0"), F.col("hit.rect.y0").alias("y0"))


def rule_verdicts(spark, sf):
    return flat_verdicts(rules.verdicts(*rule_tables(spark, sf)))


def template_dedupe(spark, sf):
    _, r, t = rule_tables(spark, sf)
    return rules.searches(rules.compiled(r, t, 4)).groupBy("template_id", "gray").agg(F.count("*").alias("regions"))


def bucket_maxima(spark, sf):
    return geometry.bucket_maxima(spark.createDataFrame(SIDES, "template_id long, w int, h int, flat boolean, channels int"))


def plan_argmin(spark, sf):
    return geometry.best_tiles(geometry.shape_table(spark, PLANS))


def tile_grid(spark, sf):
    shapes = geometry.shape_table(spark, PLANS)
    return geometry.tile_grid(shapes.join(geometry.best_tiles(shapes), "plan_id"))


def parity_worst_abs(spark, sf):
    """The two physical forms against each other: the sums are equal, so are the scores."""
    rows, t = emb(spark, sf, 0)
    return peaks.parity(matching.response_map(rows, t), matching.response_map(rows, t, method="join"))


def order_match(spark, sf):
    """Three channels from order lines, one template of 5 by 3."""
    rows = rasters.order_rows(spark, sf)
    return matching.match(rows, cut_templates(rows, [(20, 1, 40, 5, 3, "crop")], 3), 3)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (template_stats, alpha_const, rgb_to_gray, window_sums, corr_map, response_map_gray, response_map_join, response_map_color, match_gray, match_color, match_constant_alpha, match_auto_alpha, match_large, fleet_buckets, peak_digest, match_gray_of_color, flat_template, fleet_find_all, threshold_hits, nms_peaks, topk_peaks, ambiguity, roi_match, fit_filter, rule_first, rule_all, rule_verdicts, template_dedupe, bucket_maxima, plan_argmin, tile_grid, parity_worst_abs, order_match)
}

BUCKETED = ", ".join(f"({i}::BIGINT, {w}, {h}, {str(f).lower()}, {c})" for i, w, h, f, c in SIDES)
NMS = """peak AS (SELECT a.* FROM resp a WHERE a.score::FLOAT >= {t}::FLOAT AND NOT EXISTS (SELECT 1 FROM resp b WHERE b.template_id = a.template_id AND b.y BETWEEN a.y - 4 AND a.y + 4 AND b.x BETWEEN a.x - 4 AND a.x + 4 AND b.score > a.score))"""
SPECS = ", ".join(f"({i}::BIGINT, {k}, {w}, {h})" for k, (i, _, _, w, h, _) in enumerate(GREY))


def rules_sql() -> str:
    """CTEs slot (rule_id, ..., evaluated extrema) over colour and grey response maps."""
    slots = ", ".join(f"({i}::BIGINT, '{n}', {th}::FLOAT, {m}, {str(g).lower()}, {s}, {t}::BIGINT, {', '.join(map(str, (min(r[0], r[2]), min(r[1], r[3]), max(r[0], r[2]), max(r[1], r[3])) if r else (0, 0, 24, 30)))})" for i, n, r, g, th, m, ts in RULES for s, t in enumerate(ts))
    grey_tpl = "gtpl AS (SELECT template_id, w, h, ty, tx, 0 AS c, (4899 * max(tv) FILTER (c = 0) + 9617 * max(tv) FILTER (c = 1) + 1868 * max(tv) FILTER (c = 2) + 8192) >> 14 AS tv FROM tpl GROUP BY ALL)"
    return f"""WITH {R_EVT}, {R_GREY}, {templates_sql('evt', COLOUR)}, {grey_tpl}, {response_sql('evt')}, {response_sql('gry', 'gtpl', 'gresp')},
slot(rule_id, name, threshold, mode, gray, slot, template_id, x0, y0, x1, y1) AS (VALUES {slots}),
every AS (SELECT false AS gray, * FROM resp UNION ALL SELECT true, * FROM gresp),
tsize AS (SELECT DISTINCT template_id, w, h FROM tpl),
hit AS (SELECT s.rule_id, s.name, s.threshold, s.mode, s.slot, s.template_id, any_value(w) AS w, any_value(h) AS h, first(e.score::FLOAT ORDER BY e.score::FLOAT DESC, e.y, e.x) AS score, first(e.x ORDER BY e.score::FLOAT DESC, e.y, e.x) AS x, first(e.y ORDER BY e.score::FLOAT DESC, e.y, e.x) AS y
  FROM slot s JOIN tsize t USING (template_id) JOIN every e ON e.template_id = s.template_id AND e.gray = s.gray AND e.x >= s.x0 AND e.y >= s.y0 AND e.x + t.w <= s.x1 AND e.y + t.h <= s.y1 GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY CASE WHEN mode = 0 THEN slot ELSE 0 END, CASE WHEN mode = 1 THEN score ELSE 0 END DESC, slot) AS k FROM hit WHERE score >= threshold) WHERE k = 1),
verdict AS (SELECT r.rule_id, r.name, b.rule_id IS NOT NULL AS matched, b.template_id, b.score, b.x AS x0, b.y AS y0, b.x + b.w AS x1, b.y + b.h AS y1, coalesce(n, 0)::BIGINT AS evaluated
  FROM (SELECT DISTINCT rule_id, name FROM slot) r LEFT JOIN best b USING (rule_id) LEFT JOIN (SELECT rule_id, count(*) AS n FROM hit WHERE mode = 1 GROUP BY ALL) a USING (rule_id))"""


def plans_sql() -> str:
    shapes = ", ".join(f"({k}::BIGINT, {a}::BIGINT, {b}::BIGINT, {c}::BIGINT, {d}::BIGINT)" for k, (a, b, c, d) in enumerate(PLANS))
    p2 = lambda e: f"(1::BIGINT << ceil(log2(greatest(2, {e})))::INT)"
    band = lambda bh: f"((((least({bh} + th - 1, dh) + 1) // 2) + (({bh} + 1) // 2)) * 5 * dw * log2(dw)::BIGINT + 2 * 5 * dh * log2(dh)::BIGINT * (dw // 2 + 1) + 16 * dh * (dw // 2 + 1))"
    return f"""WITH shape(plan_id, tw, th, rw, rh) AS (VALUES {shapes}),
pow AS (SELECT 1::BIGINT << k::INT AS p FROM generate_series(0, 22) g(k)),
cand AS (SELECT s.*, a.p AS dw, b.p AS dh, least(a.p - tw + 1, rw) AS bw, least(b.p - th + 1, rh) AS bh FROM shape s, pow a, pow b
  WHERE a.p BETWEEN {p2('tw')} AND {p2('rw + tw - 1')} AND b.p BETWEEN {p2('th')} AND {p2('rh + th - 1')} AND a.p * b.p <= 4194304),
cost AS (SELECT *, ((rw + bw - 1) // bw) * ((rh // bh) * {band('bh')} + CASE WHEN rh % bh > 0 THEN {band('(rh % bh)')} ELSE 0 END) AS cost FROM cand),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY cost, dw * dh, dw) AS k FROM cost) WHERE k = 1),
plan AS (SELECT s.plan_id, s.rw, s.rh, coalesce(dw, {p2('s.tw')}) AS dft_w, coalesce(dh, {p2('s.th')}) AS dft_h, coalesce(bw, least({p2('s.tw')} - s.tw + 1, s.rw)) AS block_w, coalesce(bh, least({p2('s.th')} - s.th + 1, s.rh)) AS block_h, coalesce(cost, -1)::BIGINT AS cost
  FROM shape s LEFT JOIN best USING (plan_id))"""


ORACLE_SQL: dict[str, str] = {
    "template_stats": f"{EVT} SELECT s.template_id, s.c, s.area, s.tsum, s.tsq, v.var_sum FROM resp_st s JOIN resp_var v USING (template_id)",
    "alpha_const": f"WITH {R_EVT} SELECT 0::BIGINT AS image_id, min(v) = max(v) AS a_const FROM evt WHERE c = 3 UNION ALL SELECT 1::BIGINT, true",
    "rgb_to_gray": f"WITH {R_EVT}, {R_GREY} SELECT 0::BIGINT AS image_id, y, x, v FROM gry",
    "window_sums": f"WITH {R_EMB} SELECT 0::BIGINT AS image_id, 0 AS c, a.y, a.x, sum(b.v)::BIGINT AS s, sum(b.v * b.v)::BIGINT AS s2 FROM emb a JOIN emb b ON b.y BETWEEN a.y AND a.y + 7 AND b.x BETWEEN a.x AND a.x + 7 GROUP BY a.y, a.x HAVING count(*) = 64",
    "corr_map": f"{EMB} SELECT template_id, y::INT AS y, x::INT AS x, corr, s, s2 FROM resp_ch WHERE template_id = 0",
    "response_map_gray": f"{only(EMB, 0, 1)} SELECT * FROM resp",
    "response_map_join": f"{only(EMB, 0)} SELECT * FROM resp",
    "response_map_color": f"{EVT} SELECT * FROM resp",
    "match_gray": f"{only(EMB, 0)} {extrema_sql('resp')}",
    "match_color": f"{only(EVT, 10)} {extrema_sql('resp')}",
    "match_constant_alpha": f"WITH {R_EVT}, rgb AS (SELECT * FROM evt WHERE c < 3), {templates_sql('rgb', [COLOUR[0]])}, {response_sql('rgb')} {extrema_sql('resp')}",
    "match_auto_alpha": f"WITH {R_EVT}, rgb AS (SELECT * FROM evt WHERE c < 3), {templates_sql('rgb', [COLOUR[0]])}, {response_sql('rgb')} {extrema_sql('resp')}",
    "match_large": f"WITH {R_EMB}, {templates_sql('emb', LARGE)}, {response_sql('emb')} {extrema_sql('resp')}",
    "fleet_buckets": f"WITH {R_EMB}, {templates_sql('emb', GREY + LARGE)}, {response_sql('emb')} SELECT m.*, t.ord FROM ({extrema_sql('resp')}) m JOIN (VALUES {', '.join(f'({i}::BIGINT, {k})' for k, (i, *_) in enumerate(GREY + LARGE))}) t(template_id, ord) USING (template_id)",
    "peak_digest": f"{only(EMB, 0, 1)} SELECT image_id, template_id, count(*) AS positions, true AS same FROM resp GROUP BY ALL",
    "order_match": f"WITH {R_ORD}, {templates_sql('ord', [(20, 1, 40, 5, 3, 'crop')])}, {response_sql('ord')} {extrema_sql('resp')}",
    "match_gray_of_color": f"{EVT_GREY} {extrema_sql('resp')}",
    "flat_template": "SELECT 0::BIGINT AS image_id, 3::BIGINT AS template_id, 1::FLOAT AS min_v, 0 AS min_x, 0 AS min_y, 1::FLOAT AS max_v, 0 AS max_x, 0 AS max_y",
    "fleet_find_all": f"{EMB} SELECT m.*, t.ord FROM ({extrema_sql('resp')}) m JOIN (VALUES {SPECS}) t(template_id, ord, w, h) USING (template_id)",
    "threshold_hits": f"{only(EMB, 0, 1, 2)} SELECT * FROM resp WHERE score::FLOAT >= 0.3::FLOAT",
    "nms_peaks": f"{only(EMB, 0, 1, 2)}, {NMS.format(t=0.3)} SELECT * FROM peak",
    "topk_peaks": f"{only(EMB, 0, 1, 2)}, {NMS.format(t=0.2)} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY score DESC, y, x)::INT AS rank FROM peak) WHERE rank <= 5",
    "ambiguity": f"{only(EMB, 0, 1, 2)}, {NMS.format(t=0.2)}, r AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY score DESC, y, x) AS k FROM peak) SELECT image_id, template_id, max(score) AS best, max(score) FILTER (k = 2) AS second, max(score) - max(score) FILTER (k = 2) AS gap FROM r WHERE k <= 2 GROUP BY ALL",
    "roi_match": f"{only(EMB, 0)} {extrema_sql('(SELECT * FROM resp WHERE x BETWEEN 4 AND 36 AND y BETWEEN 40 AND 232)')}",
    "fit_filter": f"{EMB} {extrema_sql('(SELECT image_id, template_id, y - 90 AS y, x, score FROM resp JOIN (SELECT DISTINCT template_id, w, h FROM tpl) USING (template_id) WHERE y BETWEEN 90 AND 96 - h AND x BETWEEN 0 AND 20 - w)')}",
    "rule_first": f"{rules_sql()} SELECT * FROM verdict WHERE rule_id IN (1, 3)",
    "rule_all": f"{rules_sql()} SELECT rule_id, template_id, score, x AS x0, y AS y0 FROM hit WHERE rule_id IN (2, 5)",
    "rule_verdicts": f"{rules_sql()} SELECT * FROM verdict",
    "template_dedupe": f"{rules_sql()} SELECT template_id, gray, count(DISTINCT (x0, y0, x1, y1)) AS regions FROM slot GROUP BY ALL",
    "bucket_maxima": f"""WITH t AS (SELECT *, 1::BIGINT << ceil(log2(w))::INT AS cw, 1::BIGINT << ceil(log2(h))::INT AS ch FROM (VALUES {BUCKETED}) t(template_id, w, h, flat, channels) WHERE NOT flat),
home AS (SELECT a.cw, a.ch, max({{'area': b.cw * b.ch, 'w': b.cw, 'h': b.ch}}) AS b FROM (SELECT DISTINCT cw, ch FROM t) a JOIN (SELECT DISTINCT cw, ch FROM t) b ON b.cw >= a.cw AND b.ch >= a.ch GROUP BY ALL)
SELECT b.w AS w_class, b.h AS h_class, count(*) AS members, max(w) AS max_w, max(h) AS max_h, max(channels) AS max_channels FROM t JOIN home USING (cw, ch) GROUP BY ALL""",
    "plan_argmin": f"{plans_sql()} SELECT plan_id, dft_w, dft_h, block_w, block_h, cost FROM plan",
    "tile_grid": f"{plans_sql()} SELECT plan_id, ty * ((rw + block_w - 1) // block_w) + tx AS tile_id, tx * block_w AS x0, ty * block_h AS y0, least(block_w, rw - tx * block_w) AS bw, least(block_h, rh - ty * block_h) AS bh FROM plan, generate_series(0, (SELECT max((rh + block_h - 1) // block_h) FROM plan)) a(ty), generate_series(0, (SELECT max((rw + block_w - 1) // block_w) FROM plan)) b(tx) WHERE tx * block_w < rw AND ty * block_h < rh",
    "parity_worst_abs": f"{only(EMB, 0)} SELECT image_id, template_id, 0.0::DOUBLE AS worst, 0 AS y, 0 AS x, count(*) AS positions, 0.0::DOUBLE AS peak_dv, 'ok' AS status FROM resp GROUP BY ALL",
}
