"""Rules over frames: ordered templates in an optional region of interest, a threshold and a mode.

Mode FIRST takes the first template in the rule's order that reaches the threshold; mode ALL
evaluates each and takes the best that does. Every distinct (template, grey, region) is matched once
however many rules refer to it, and all regions in one pass over the rows. A template that doesn't fit its region, or a region outside the
frame, isn't evaluated; the rule still has a verdict.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import AREA_CAPS, rect
from .matching import BAND, EXTREMA, MAX_TEMPLATE_VALUES, Block, Held, alpha_flags, bands, extremes, grey_values, held_templates, merged, stacked

FIRST, ALL = 0, 1
RULES = "rule_id long, ord int, name string, roi struct<x0:int,y0:int,x1:int,y1:int>, gray boolean, threshold float, mode int, template_ids array<long>"
BOX = "struct<x0:int,y0:int,x1:int,y1:int>"
SLOTS = f"rule_id long, ord int, name string, threshold float, mode int, gray boolean, roi {BOX}, slot int, template_id long"
REGIONS = "search int, x0 int, y0 int, x1 int, y1 int, tallest int"
SEARCHED = f"image_id long, search int, template_id long, {EXTREMA}"
#: Where a region without an end ends.
FAR = 1 << 24


def region(rule) -> tuple[int, int, int, int] | None:
    """A rule's region with its corners in order; None for the whole frame, which null and all zeros mean."""
    roi = rule["roi"]
    if roi is None or not any(roi):
        return None
    if roi["x0"] == roi["x1"] or roi["y0"] == roi["y1"]:
        raise ValueError(f"rule {rule['rule_id']} has a region without area")
    return min(roi["x0"], roi["x1"]), min(roi["y0"], roi["y1"]), max(roi["x0"], roi["x1"]), max(roi["y0"], roi["y1"])


def checked(rules: list, sizes: list[tuple[int, int, int]], channels: int) -> list[tuple]:
    """Rows of SLOTS; raises ValueError for rules that aren't valid. sizes: (template_id, w, h) in the templates' order."""
    own: dict[int, tuple[int, int]] = {}
    for i, w, h in sizes:
        if own.setdefault(i, (w, h)) != (w, h):
            raise ValueError(f"template {i} has two sizes, {own[i][0]}x{own[i][1]} and {w}x{h}")
    if sum(w * h for w, h in own.values()) * channels > MAX_TEMPLATE_VALUES:
        raise ValueError("too many template pixels to broadcast")
    out = []
    for r in rules:
        if r["mode"] not in (FIRST, ALL):
            raise ValueError(f"rule {r['rule_id']} has an unknown mode {r['mode']}")
        roi = region(r)
        if not r["template_ids"]:
            raise ValueError(f"rule {r['rule_id']} has no templates")
        for slot, i in enumerate(r["template_ids"]):
            if i not in own:
                raise ValueError(f"rule {r['rule_id']} refers to template {i}, which isn't there")
            if own[i][0] * own[i][1] > AREA_CAPS[1 if r["gray"] else channels]:
                raise ValueError(f"rule {r['rule_id']}, template {i}: the template is too large")
            out.append((r["rule_id"], r["ord"], r["name"], r["threshold"], r["mode"], r["gray"], roi, slot, i))
    return out


def compiled(rules: DataFrame, templates: DataFrame, channels: int) -> DataFrame:
    """SLOTS of valid rules; raises ValueError for others.

    Rules and templates are configuration: a few rows, checked on the driver. A region's corners may
    be reversed; null or all zeros means the whole frame, one without area is an error. One template
    id with two sizes is an error; of two rows with the same size the first by ord is used.
    """
    sizes = sorted(templates.select("ord", "template_id", "w", "h").collect())
    return rules.sparkSession.createDataFrame(checked(rules.collect(), [tuple(t)[1:] for t in sizes], channels), SLOTS)


def searches(slots: DataFrame) -> DataFrame:
    """Distinct (template_id, gray, roi): what has to be matched."""
    return slots.select("template_id", "gray", "roi").distinct()


def evaluate(rows: DataFrame, groups: dict[tuple, list[Held]], channels: int, band: int = BAND) -> DataFrame:
    """SEARCHED, in frame coordinates, of each template that fits its region. groups: (gray, region) -> templates; a search's number is its place.

    A row is sent once for every region that holds it and every band that needs it.
    """
    spark = rows.sparkSession
    table, found = [], []
    for k, ((gray, roi), own) in enumerate(groups.items()):
        x0, y0, x1, y1 = roi or (0, 0, FAR, FAR)
        box = (max(0, x0), max(0, y0), min(x1, FAR), min(y1, FAR))
        table.append((k, *box, max(t.values.shape[0] for t in own)))
        found.append((gray and channels >= 3, box[0], box[1], own))
    held = spark.sparkContext.broadcast(found)  # template values, checked by checked()
    regions = F.broadcast(spark.createDataFrame(table, REGIONS))  # a row of six numbers for each region of the rules
    inside = rows.select("image_id", "y", "data").withColumnRenamed("y", "fy").join(regions, (F.col("fy") >= F.col("y0")) & (F.col("fy") < F.col("y1")))
    cut = F.slice("data", F.col("x0") * channels + 1, F.greatest(F.lit(0), F.col("x1") - F.col("x0")) * channels)
    view = inside.select("image_id", "search", (F.col("fy") - F.col("y0")).alias("y"), cut.alias("data"), "tallest").where(F.size("data") > 0)
    view = alpha_flags(view, channels, [t for gray, *_, own in found for t in own if not gray], "image_id", "search")
    names = [c.split()[0] for c in SEARCHED.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        gray, x0, y0, own = held.value[int(key[1])]
        solid, block = bool(pdf["a_const"].iloc[0]), stacked(pdf, channels)
        if gray:
            block, pairs = grey_values(block)[:, :, None], [(t, 1) for t in own]
        else:
            pairs = [(t, 3 if solid and t.alpha_constant else channels) for t in own]
        out = [(int(key[0]), int(key[1]), t.template_id, *extremes(m[:band].astype("f4"), x0, int(key[2]) * band + y0)) for t, m in Block(block).scores(pairs)]
        return pd.DataFrame(out, columns=names)

    return merged(bands(view, F.col("tallest"), band).groupBy("image_id", "search", "band").applyInPandas(run, SEARCHED), "image_id", "search", "template_id")


def verdicts(rows: DataFrame, rules: DataFrame, templates: DataFrame, channels: int = 4) -> DataFrame:
    """(image_id, rule_id, ord, name, matched, best, all) of each rule and frame; order by image_id and ord.

    best and all hold (template_id, score, rect); all has every evaluated template in the rule's
    order, in mode ALL only. Scores are compared in single precision, the threshold included.
    """
    spark, held = rows.sparkSession, {}
    own = held_templates(templates, channels)
    for t in own:
        held.setdefault(t.template_id, t)
    config = rules.collect()
    slots = checked(config, [(t.template_id, t.values.shape[1], t.values.shape[0]) for t in own], channels)
    groups: dict[tuple, dict[int, Held]] = {}
    for *_, gray, roi, _, i in slots:
        groups.setdefault((gray, roi), {})[i] = held[i].grey() if gray else held[i]
    number = {g: k for k, g in enumerate(groups)}
    found = evaluate(rows, {g: list(m.values()) for g, m in groups.items()}, channels)
    wanted = [(r, slot, mode, th, number[gray, roi], i, held[i].values.shape[1], held[i].values.shape[0]) for r, _, _, th, mode, gray, roi, slot, i in slots]
    asked = F.broadcast(spark.createDataFrame(wanted, "rule_id long, slot int, mode int, threshold float, search int, template_id long, w int, h int"))  # configuration
    each = found.join(asked, ["search", "template_id"])
    x, y = F.col("max_x"), F.col("max_y")
    hit = F.struct("template_id", F.col("max_v").alias("score"), rect(x, y, x + F.col("w"), y + F.col("h")).alias("rect"))
    each = each.select("image_id", "rule_id", "slot", "mode", "max_v", (F.col("max_v") >= F.col("threshold")).alias("passes"), hit.alias("hit"))
    first = F.min(F.when(F.col("passes"), F.struct("slot", "hit")))
    top = F.max(F.when(F.col("passes"), F.struct(F.col("max_v"), (-F.col("slot")).alias("back"), "hit")))
    seen = F.transform(F.array_sort(F.collect_list(F.struct("slot", "hit"))), lambda s: s["hit"])
    picked = each.groupBy("image_id", "rule_id", "mode").agg(first.alias("first"), top.alias("top"), seen.alias("seen"))
    picked = picked.withColumn("best", F.when(F.col("mode") == FIRST, F.col("first.hit")).otherwise(F.col("top.hit")))
    none = F.array().cast(picked.schema["seen"].dataType)
    picked = picked.withColumn("all", F.when(F.col("mode") == ALL, F.col("seen")).otherwise(none))
    asked = spark.createDataFrame([(r["rule_id"], r["ord"], r["name"]) for r in config], "rule_id long, ord int, name string")
    every = rows.select("image_id").distinct().crossJoin(F.broadcast(asked))  # rules are configuration
    out = every.join(picked, ["image_id", "rule_id"], "left")
    return out.select("image_id", "rule_id", "ord", "name", F.coalesce(F.col("best").isNotNull(), F.lit(False)).alias("matched"), "best", F.coalesce("all", none).alias("all"))


def changes(results: DataFrame, span: int = 1 << 16) -> DataFrame:
    """Verdicts with what they were in the frame before (image ids number the frames), for rules whose answer moved.

    Frames are dealt into spans of so many ids, each with the frame before it, so that no task has all frames of a rule.
    """
    home = F.floor(F.col("image_id") / span)
    dealt = results.withColumn("span", F.explode(F.array_distinct(F.array(home, F.floor((F.col("image_id") + 1) / span)))))
    before = Window.partitionBy("rule_id", "span").orderBy("image_id")
    out = dealt.withColumn("was", F.lag("matched").over(before)).withColumn("best_was", F.lag("best").over(before)).where(F.col("span") == home).drop("span")
    return out.where(F.col("was").isNotNull() & (~F.col("matched").eqNullSafe(F.col("was")) | ~F.col("best").eqNullSafe(F.col("best_was"))))
