"""Planning: FFT tile sizes by cost, tile grids, and buckets of templates that share a tile size."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest tile in cells, and the least side of a tile.
TILE_CAP, LEAST_SIDE = 1 << 22, 2


def power(k: Column) -> Column:
    """2^k as a long."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def least_power(c: Column | str) -> Column:
    """The exponent of the least side that holds so many cells."""
    return F.ceil(F.log2(F.greatest(F.lit(LEAST_SIDE), F.col(c) if isinstance(c, str) else c))).cast("int")


def candidates(shapes: DataFrame) -> DataFrame:
    """All pairs of power-of-two tile sizes of each (plan_id, tw, th, rw, rh), with block sizes and integer cost.

    The cost of a tile is that of its row transforms, forward and inverse, of its column transforms
    and of the product, over the bands of blocks that cover the result.
    """
    def sizes(t: str, r: str):
        low, high = least_power(t), least_power(F.col(r) + F.col(t) - 1)
        return F.transform(F.sequence(low, high), power)

    grid = shapes.withColumn("dft_w", F.explode(sizes("tw", "rw"))).withColumn("dft_h", F.explode(sizes("th", "rh")))
    grid = grid.where(F.col("dft_w") * F.col("dft_h") <= TILE_CAP)
    grid = grid.withColumn("block_w", F.least(F.col("dft_w") - F.col("tw") + 1, F.col("rw"))).withColumn("block_h", F.least(F.col("dft_h") - F.col("th") + 1, F.col("rh")))
    half = F.col("dft_w").bitwiseAND(F.lit(-2)) / 2 + 1
    half = F.floor(half)
    bits = lambda c: F.length(F.bin(c)) - 1

    def band(bh):
        loaded = F.least(bh + F.col("th") - 1, F.col("dft_h"))
        rows = F.floor((loaded + 1) / 2) + F.floor((bh + 1) / 2)
        return rows * 5 * F.col("dft_w") * bits(F.col("dft_w")) + 2 * 5 * F.col("dft_h") * bits(F.col("dft_h")) * half + 16 * F.col("dft_h") * half

    across = F.ceil(F.col("rw") / F.col("block_w"))
    full = F.floor(F.col("rh") / F.col("block_h"))
    rest = F.col("rh") % F.col("block_h")
    cost = across * (full * band(F.col("block_h")) + F.when(rest > 0, band(rest)).otherwise(F.lit(0)))
    return grid.withColumn("cost", cost.cast("long"))


def best_tiles(shapes: DataFrame) -> DataFrame:
    """The cheapest tile of each shape: ties to the smaller area, then to the narrower tile. Where all are over the cap, the least one with cost -1."""
    best = candidates(shapes).groupBy("plan_id").agg(F.min(F.struct("cost", (F.col("dft_w") * F.col("dft_h")).alias("area"), "dft_w", "dft_h", "block_w", "block_h")).alias("b"))
    low_w, low_h = (power(least_power(c)) for c in ("tw", "th"))
    got = shapes.join(best, "plan_id", "left")
    pick = lambda name, other: F.coalesce(F.col(f"b.{name}"), other).cast("long").alias(name)
    return got.select("plan_id", pick("dft_w", low_w), pick("dft_h", low_h), pick("block_w", F.least(low_w - F.col("tw") + 1, F.col("rw"))), pick("block_h", F.least(low_h - F.col("th") + 1, F.col("rh"))), pick("cost", F.lit(-1)))


def tile_grid(plans: DataFrame) -> DataFrame:
    """(plan_id, tile_id, x0, y0, bw, bh): the tiles that cover each (plan_id, rw, rh, block_w, block_h), the last ones short."""
    across, down = F.ceil(F.col("rw") / F.col("block_w")), F.ceil(F.col("rh") / F.col("block_h"))
    grid = plans.withColumn("ty", F.explode(F.sequence(F.lit(0).cast("long"), down - 1))).withColumn("tx", F.explode(F.sequence(F.lit(0).cast("long"), across - 1)))
    x0, y0 = F.col("tx") * F.col("block_w"), F.col("ty") * F.col("block_h")
    return grid.select("plan_id", (F.col("ty") * across + F.col("tx")).alias("tile_id"), x0.alias("x0"), y0.alias("y0"), F.least("block_w", F.col("rw") - x0).alias("bw"), F.least("block_h", F.col("rh") - y0).alias("bh"))


def side_class(c: str) -> Column:
    """The least power of two that is the side or more."""
    return power(F.ceil(F.log2(F.col(c))))


def buckets(templates: DataFrame) -> DataFrame:
    """(w_class, h_class, template_id) of templates (template_id, w, h, flat): the class of the bucket that each is matched in.

    Templates of equal power-of-two sides are a class. A class goes to the largest class that covers it in
    both directions (ties: the wider, then the higher one), itself where no other does; as covering
    is transitive, that one stays where it is. Flat templates are in no bucket. There are some hundred
    classes at most, so they are compared two by two.
    """
    sided = templates.where("not flat").select("template_id", side_class("w").alias("w"), side_class("h").alias("h"))
    classes = sided.select("w", "h").distinct()
    over = classes.select(F.col("w").alias("w_class"), F.col("h").alias("h_class"))
    best = F.max(F.struct((F.col("w_class") * F.col("h_class")).alias("area"), "w_class", "h_class")).alias("b")
    home = classes.join(F.broadcast(over), (F.col("w_class") >= F.col("w")) & (F.col("h_class") >= F.col("h"))).groupBy("w", "h").agg(best)
    return sided.join(F.broadcast(home), ["w", "h"]).select("b.w_class", "b.h_class", "template_id")


def bucket_maxima(templates: DataFrame) -> DataFrame:
    """(w_class, h_class, members, max_w, max_h, max_channels) of each bucket of templates (template_id, w, h, flat, channels)."""
    own = buckets(templates).join(templates.select("template_id", "w", "h", "channels"), "template_id")
    return own.groupBy("w_class", "h_class").agg(F.count("*").alias("members"), F.max("w").alias("max_w"), F.max("h").alias("max_h"), F.max("channels").alias("max_channels"))


@lru_cache(maxsize=4096)
def tile_for(tw: int, th: int, rw: int, rh: int) -> tuple[int, int, int, int]:
    """(dft_w, dft_h, block_w, block_h) as best_tiles() has them, for a task that plans what it has before it."""
    def sides(t: int, r: int) -> list[int]:
        low = max(LEAST_SIDE, t)
        return [1 << k for k in range((low - 1).bit_length(), (max(LEAST_SIDE, r + t - 1) - 1).bit_length() + 1)]

    def block(dft: int, t: int, r: int) -> int:
        return min(dft - t + 1, r)

    options = []
    for dw in sides(tw, rw):
        for dh in sides(th, rh):
            if dw * dh > TILE_CAP:
                continue
            bw, bh = block(dw, tw, rw), block(dh, th, rh)
            full, rest = divmod(rh, bh)
            heights = [(bh, full)] + ([(rest, 1)] if rest else [])
            rows = sum(n * ((min(b + th - 1, dh) + 1) // 2 + (b + 1) // 2) for b, n in heights)
            columns = sum(n for _, n in heights) * (dw // 2 + 1) * dh * (10 * (dh.bit_length() - 1) + 16)
            options.append((-(-rw // bw) * (rows * 5 * dw * (dw.bit_length() - 1) + columns), dw * dh, dw, dh, bw, bh))
    if options:
        return min(options)[2:]
    dw, dh = sides(tw, 1)[0], sides(th, 1)[0]
    return dw, dh, block(dw, tw, rw), block(dh, th, rh)


def shape_table(spark: SparkSession, shapes: list[tuple[int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame([(k, *s) for k, s in enumerate(shapes)], "plan_id long, tw long, th long, rw long, rh long")
