"""Template statistics, response maps and extrema, in two physical forms of one definition.

"join": pixels are joined to the broadcast template pixels by offset and exact integer sums are
grouped by position; all of it stays in the JVM. "tiles": rows are dealt into bands that overlap by
the template height, and an Arrow function computes the same integers per band, by shifted sums for
small templates and by FFT for large ones. Templates of a bucket share the planned tiles and the
tiles' spectra, templates of one size the window sums; a template's own spectrum stays in the Python worker
from band to band. `auto` estimates the pairs that the join would make.

A fourth channel is left out where it is constant in the image and in the template: it is alpha that
says nothing. Callers pass all four channels; each image and each template decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import AREA_CAPS, FLAT_CAP, FLAT_SCALE, GREY_HALF, GREY_SHIFT, GREY_WEIGHTS, SATURATION, score
from ..plans.geometry import tile_for
from ..sources.rasters import pixels

TEMPLATE = "template_id long, ord int, w int, h int, gray boolean, data array<int>"
#: Bytes of template values that may be broadcast, a byte each; more are an error. The join broadcasts rows of some 50 bytes a value and image.
MAX_TEMPLATE_VALUES, MAX_JOINED_VALUES = 64 << 20, 1 << 20
#: Pairs of pixels up to which the join is used.
JOIN_PAIRS = 20_000_000
#: Rows of results in a band, and the template area up to which shifted sums are used.
BAND, SHIFTED_AREA = 256, 400
#: Bytes of template spectra that a Python worker keeps.
SPECTRA_BYTES = 256 << 20
EXTREMA = "min_v float, min_x int, min_y int, max_v float, max_x int, max_y int"


def template(spark: SparkSession, rows: DataFrame, template_id: int, ord_: int = 0, gray: bool = False, channels: int = 1) -> DataFrame:
    """A prepared template (one row of TEMPLATE) from an image's rows; a template fits in one row by its area cap."""
    lines = F.array_sort(F.collect_list(F.struct("y", "data")))
    one = rows.groupBy().agg(F.flatten(F.transform(lines, lambda r: r["data"])).alias("data"), F.count("*").cast("int").alias("h"))
    return one.select(F.lit(template_id).cast("long").alias("template_id"), F.lit(ord_).alias("ord"), (F.size("data") / F.col("h") / channels).cast("int").alias("w"), "h", F.lit(gray).alias("gray"), "data")


def template_pixels(templates: DataFrame, channels: int) -> DataFrame:
    """(template_id, ty, tx, c, tv)."""
    flat = templates.select("template_id", "w", F.posexplode("data").alias("i", "tv"))
    at = F.floor(F.col("i") / channels)
    return flat.select("template_id", F.floor(at / F.col("w")).cast("int").alias("ty"), (at % F.col("w")).cast("int").alias("tx"), (F.col("i") % channels).cast("int").alias("c"), F.col("tv").cast("long").alias("tv"))


def template_stats(templates: DataFrame, channels: int) -> DataFrame:
    """(template_id, c, area, tsum, tsq, var_sum): exact sums by channel; var_sum is over all channels, 0 if flat."""
    per = template_pixels(templates, channels).groupBy("template_id", "c").agg(F.count("*").alias("area"), F.sum("tv").alias("tsum"), F.sum(F.col("tv") * F.col("tv")).alias("tsq"))
    total = per.groupBy("template_id").agg(F.sum(F.col("area") * F.col("tsq") - F.col("tsum") * F.col("tsum")).alias("var_sum"))
    return per.join(total, "template_id")


def alpha_constant(rows: DataFrame, channels: int = 4) -> DataFrame:
    """(image_id, a_const): whether the fourth channel has one value."""
    alpha = F.filter("data", lambda v, i: i % channels == 3)
    return rows.groupBy("image_id").agg((F.min(F.array_min(alpha)) == F.max(F.array_max(alpha))).alias("a_const"))


def check_sizes(sizes: list[tuple[int, int, bool]], channels: int) -> None:
    """Raises for no templates, mixed grey and colour, too large ones, or too many to broadcast. sizes: (w, h, gray)."""
    if not sizes:
        raise ValueError("no templates")
    if len({g for *_, g in sizes}) > 1:
        raise ValueError("templates must be all grey or all colour")
    if any(w * h > AREA_CAPS[channels] or w < 1 or h < 1 for w, h, _ in sizes):
        raise ValueError(f"a template has no pixels or more than {AREA_CAPS[channels]}")
    if sum(w * h for w, h, _ in sizes) * channels > MAX_TEMPLATE_VALUES:
        raise ValueError("too many template pixels to broadcast; match in several calls")


def check_templates(templates: DataFrame, channels: int) -> list:
    """The templates' sizes, on the driver: one row of five numbers each; raises as check_sizes() does."""
    sizes = templates.select("template_id", "ord", "w", "h", "gray").collect()
    check_sizes([(r["w"], r["h"], r["gray"]) for r in sizes], channels)
    return sizes


@dataclass
class Held:
    """A template as tasks have it: values of shape (h, w, channels), and what follows from them."""

    template_id: int
    ord: int
    gray: bool
    values: np.ndarray

    def __post_init__(self):
        h, w, cn = self.values.shape
        self.name = hashlib.sha1(self.values.tobytes()).digest() + bytes(self.values.shape[2:])
        self.alpha_constant = cn == 4 and bool((self.values[:, :, 3] == self.values[0, 0, 3]).all())
        t = self.values.reshape(-1, cn).astype(np.int64)
        self.tsum, squares = t.sum(0), (t * t).sum(0)
        self.var = w * h * squares - self.tsum**2

    def grey(self) -> Held:
        """The same template in grey."""
        if self.values.shape[2] < 3:
            return self
        return Held(self.template_id, self.ord, True, grey_values(self.values)[:, :, None])


def grey_values(values: np.ndarray) -> np.ndarray:
    return ((values[:, :, :3].astype(np.int64) @ np.array(GREY_WEIGHTS) + GREY_HALF) >> GREY_SHIFT).astype(np.uint8)


def held_templates(templates: DataFrame, channels: int) -> list[Held]:
    """The templates on the driver, read once, in order; their number of values must fit w, h and channels."""
    table = templates.select("template_id", "ord", "w", "h", "gray", "data").toArrow()
    ids, order, ws, hs, grays = (table.column(i).to_pylist() for i in range(5))
    check_sizes(list(zip(ws, hs, grays, strict=True)), channels)
    out = []
    for k, lists in enumerate(table.column(5).combine_chunks() if table.num_rows else ()):
        flat = lists.values.to_numpy(zero_copy_only=False)
        if len(flat) != ws[k] * hs[k] * channels:
            raise ValueError(f"template {ids[k]} has {len(flat)} values, not {ws[k]} x {hs[k]} x {channels}")
        out.append(Held(ids[k], order[k], grays[k], flat.astype(np.uint8).reshape(hs[k], ws[k], channels)))
    return sorted(out, key=lambda t: t.ord)


def alpha_flags(rows: DataFrame, channels: int, templates: list[Held], *keys: str) -> DataFrame:
    """rows with a_const, whether the image's fourth channel has one value; it is looked for only where a template's has."""
    if channels != 4 or not any(t.alpha_constant for t in templates):
        return rows.withColumn("a_const", F.lit(False))
    alpha = F.filter("data", lambda v, i: i % 4 == 3)
    flags = rows.groupBy(*keys).agg((F.min(F.array_min(alpha)) == F.max(F.array_max(alpha))).alias("a_const"))
    return rows.join(flags, [*keys])


def dims(rows: DataFrame, channels: int) -> DataFrame:
    """(image_id, iw, ih)."""
    return rows.groupBy("image_id").agg((F.max(F.size("data")) / channels).cast("int").alias("iw"), (F.max("y") + 1).alias("ih"))


def sums_by_join(rows: DataFrame, templates: DataFrame, channels: int) -> DataFrame:
    """(image_id, template_id, y, x, c, corr, s, s2) of each window and channel; templates is broadcast, checked by check_templates()."""
    px = pixels(rows, channels)
    sized = templates.select("template_id", "w", "h").crossJoin(dims(rows, channels))
    tp = template_pixels(templates, channels).withColumnRenamed("c", "tc").join(F.broadcast(sized), "template_id").withColumnRenamed("image_id", "t_image")
    y, x = F.col("y") - F.col("ty"), F.col("x") - F.col("tx")
    pairs = px.join(F.broadcast(tp), (F.col("c") == F.col("tc")) & (F.col("image_id") == F.col("t_image")) & (y >= 0) & (x >= 0) & (y <= F.col("ih") - F.col("h")) & (x <= F.col("iw") - F.col("w")))
    return pairs.groupBy("image_id", "template_id", y.alias("y"), x.alias("x"), "c").agg(F.sum(F.col("v") * F.col("tv")).alias("corr"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("s2"))


def map_by_join(rows: DataFrame, templates: DataFrame, channels: int) -> DataFrame:
    held = held_templates(templates, channels)
    n_images = rows.select("image_id").distinct().count() if sum(t.values.size for t in held) else 0
    if n_images * sum(t.values.size for t in held) > MAX_JOINED_VALUES:
        raise ValueError("too many template pixels for this many images to broadcast; use tiles")
    sums = sums_by_join(rows, templates, channels)
    stats = F.broadcast(template_stats(templates, channels))  # a row for each template and channel
    joined = sums.join(stats, ["template_id", "c"])
    if channels == 4 and any(t.alpha_constant for t in held):
        flags = alpha_constant(rows)
        said = F.col("template_id").isin([t.template_id for t in held if t.alpha_constant])
        joined = joined.join(flags, "image_id").where(~((F.col("c") == 3) & F.col("a_const") & said)).drop("a_const")
    total = joined.groupBy("image_id", "template_id", "y", "x", "area", "var_sum").agg(F.sum("corr").alias("corr"), F.sum(F.col("s") * F.col("tsum")).alias("cross"), F.sum(F.col("s") * F.col("s")).alias("squares"), F.sum("s2").alias("s2"))
    return total.select("image_id", "template_id", "y", "x", score(*(F.col(k) for k in ("corr", "cross", "squares", "s2", "area", "var_sum"))).alias("score"))


def integral(a: np.ndarray) -> np.ndarray:
    """Sums over all above and to the left, with a row and a column of zeros before."""
    out = np.zeros((a.shape[0] + 1, a.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(a, 0), 1, out=out[1:, 1:])
    return out


def window_sum(a: np.ndarray, th: int, tw: int) -> np.ndarray:
    """Sums over th x tw windows from an integral image."""
    return a[th:, tw:] - a[:-th, tw:] - a[th:, :-tw] + a[:-th, :-tw]


_spectra: dict[tuple, np.ndarray] = {}


def template_spectrum(t: Held, channel: int, shape: tuple[int, int]) -> np.ndarray:
    """The conjugate spectrum of a template's channel, kept from band to band."""
    key = (t.name, channel, shape)
    if key not in _spectra:
        if sum(x.nbytes for x in _spectra.values()) > SPECTRA_BYTES:
            _spectra.clear()
        _spectra[key] = np.conj(np.fft.rfft2(t.values[:, :, channel].astype(float), shape))
    return _spectra[key]


def bucket_of(sides: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """(h, w) of templates -> (h, w) of what their bucket's tiles are planned for: classes as geometry.buckets() has them."""
    up = {s: tuple(1 << (n - 1).bit_length() for n in s) for s in sides}
    home = {c: max((d for d in up.values() if d[0] >= c[0] and d[1] >= c[1]), key=lambda d: (d[0] * d[1], d[1], d[0])) for c in set(up.values())}
    return {s: tuple(max(x[i] for x in sides if home[up[x]] == home[up[s]]) for i in (0, 1)) for s in sides}


class Block:
    """Rows of an image, (y, x, channel), and what its templates share."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.int64)
        self.sums = [integral(self.values[:, :, k]) for k in range(values.shape[2])]
        self.squares = [integral(self.values[:, :, k] ** 2) for k in range(values.shape[2])]

    def scores(self, templates: list[tuple[Held, int]]) -> Iterator[tuple[Held, np.ndarray]]:
        """The response map of each template that fits, in double precision, with the operations of functions.scores.score(). templates: with the number of channels used."""
        rows, width = self.values.shape[:2]
        fit = [(t, cn) for t, cn in templates if t.values.shape[0] <= rows and t.values.shape[1] <= width]
        small, large = [], []
        for t, cn in fit:
            if t.var[:cn].sum() == 0:
                yield t, np.ones((rows - t.values.shape[0] + 1, width - t.values.shape[1] + 1))
            else:
                (small if t.values.shape[0] * t.values.shape[1] <= SHIFTED_AREA else large).append((t, cn))
        shared: dict[tuple, tuple[list[np.ndarray], np.ndarray]] = {}
        for t, cn in small:
            yield t, self.finish(t, cn, self.shifted(t, cn), shared)
        planned = bucket_of([t.values.shape[:2] for t, _ in large])
        for bucket in dict.fromkeys(planned.values()):
            own = [(t, cn) for t, cn in large if planned[t.values.shape[:2]] == bucket]
            for (t, cn), corr in zip(own, self.transformed(own, bucket), strict=True):
                yield t, self.finish(t, cn, corr, shared)

    def shifted(self, t: Held, cn: int) -> np.ndarray:
        """Exact sums of products with each window, by shifting the block."""
        th, tw = t.values.shape[:2]
        rh, rw = self.values.shape[0] - th + 1, self.values.shape[1] - tw + 1
        out = np.zeros((rh, rw), np.int64)
        for k in range(cn):
            own = np.ascontiguousarray(self.values[:, :, k])
            for y in range(th):
                for x in range(tw):
                    if v := int(t.values[y, x, k]):
                        out += v * own[y : y + rh, x : x + rw]
        return out

    def transformed(self, templates: list[tuple[Held, int]], bucket: tuple[int, int]) -> list[np.ndarray]:
        """The same sums by transforms of tiles, planned for the bucket's sides; every tile's channels are transformed once for all templates."""
        rows, width = self.values.shape[:2]
        th, tw = bucket
        dw, dh, _, _ = tile_for(tw, th, max(1, width - tw + 1), max(1, rows - th + 1))
        bw, bh = dw - tw + 1, dh - th + 1  # smaller templates of the bucket have more positions than it
        out = [np.zeros((rows - t.values.shape[0] + 1, width - t.values.shape[1] + 1), np.int64) for t, _ in templates]
        down, across = max(o.shape[0] for o in out), max(o.shape[1] for o in out)
        for y in range(0, down, bh):
            for x in range(0, across, bw):
                tile = self.values[y : y + dh, x : x + dw]
                spectra = [np.fft.rfft2(tile[:, :, k].astype(float), (dh, dw)) for k in range(max(cn for _, cn in templates))]
                for (t, cn), own in zip(templates, out, strict=True):
                    h, w = min(bh, own.shape[0] - y), min(bw, own.shape[1] - x)
                    if h < 1 or w < 1:
                        continue
                    real = np.fft.irfft2(sum(spectra[k] * template_spectrum(t, k, (dh, dw)) for k in range(cn)), (dh, dw))[:h, :w]
                    exact = np.rint(real)
                    if np.abs(real - exact).max(initial=0) >= 0.25:
                        raise ArithmeticError("the transform is too coarse for this size")
                    own[y : y + h, x : x + w] = exact
        return out

    def finish(self, t: Held, cn: int, corr: np.ndarray, shared: dict) -> np.ndarray:
        th, tw = t.values.shape[:2]
        if (th, tw, cn) not in shared:
            shared[th, tw, cn] = [window_sum(a, th, tw) for a in self.sums[:cn]], sum(window_sum(a, th, tw) for a in self.squares[:cn])
        s, s2 = shared[th, tw, cn]
        area, var_sum = th * tw, int(t.var[:cn].sum())
        num = corr.astype(float) - sum(x * int(m) for x, m in zip(s, t.tsum, strict=False)).astype(float) / area
        spread = (area * s2 - sum(x * x for x in s)).astype(float) / area
        den = np.where(spread > np.minimum(FLAT_CAP, FLAT_SCALE * s2), np.sqrt(np.maximum(spread, 0)) * np.sqrt(var_sum / area), 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(np.abs(num) < den, num / den, np.where(np.abs(num) < SATURATION * den, np.sign(num), 0.0))


def scores(block: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The response map of one template over one block, all channels used."""
    return next(Block(block).scores([(Held(0, 0, False, t.astype(np.uint8)), t.shape[2])]))[1]


def stacked(pdf: pd.DataFrame, channels: int) -> np.ndarray:
    """A band's rows, in order, as (y, x, channel); raises for rows of unequal lengths or lengths that aren't whole pixels."""
    lines = pdf.sort_values("y")["data"].to_numpy()
    if len({len(v) for v in lines}) != 1 or len(lines[0]) % channels:
        raise ValueError(f"an image's rows must have equal lengths, a multiple of {channels}")
    return np.stack(lines).reshape(len(lines), -1, channels)


def extremes(f: np.ndarray, x0: int, y0: int) -> tuple:
    """(min, its x, its y, max, its x, its y) of a map in single precision whose first position is (x0, y0)."""
    lo, hi, rw = int(f.argmin()), int(f.argmax()), f.shape[1]
    return f.ravel()[lo], lo % rw + x0, lo // rw + y0, f.ravel()[hi], hi % rw + x0, hi // rw + y0


def bands(rows: DataFrame, tallest: int | Column, band: int = BAND) -> DataFrame:
    """Adds band to the rows: band b owns result rows b * band to (b + 1) * band and gets `tallest` - 1 rows more."""
    first = F.greatest(F.lit(0), F.floor((F.col("y") - (tallest - 1)) / band)).cast("int")
    return rows.withColumn("band", F.explode(F.sequence(first, F.floor(F.col("y") / band).cast("int"))))


def by_tiles(rows: DataFrame, templates: DataFrame, channels: int, extrema_only: bool, band: int = BAND) -> DataFrame:
    """Response maps, or each band's extrema, by the Arrow function."""
    own = held_templates(templates, channels)
    held = rows.sparkSession.sparkContext.broadcast(own)  # checked by check_sizes()
    schema = f"image_id long, template_id long, {EXTREMA}" if extrema_only else "image_id long, template_id long, y int, x int, score double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        image, down = int(key[0]), int(key[1]) * band
        solid, block = bool(pdf["a_const"].iloc[0]), stacked(pdf, channels)
        out = []
        for t, m in Block(block).scores([(t, 3 if solid and t.alpha_constant else channels) for t in held.value]):
            m = m[:band]
            if extrema_only:
                out.append((image, t.template_id, *extremes(m.astype(np.float32), 0, down)))
            else:
                y, x = np.divmod(np.arange(m.size), m.shape[1])
                out.append(pd.DataFrame({"image_id": image, "template_id": t.template_id, "y": (y + down).astype(np.int32), "x": x.astype(np.int32), "score": m.ravel()}))
        if extrema_only:
            return pd.DataFrame(out, columns=names)
        return pd.concat(out) if out else pd.DataFrame({n: [] for n in names})

    flagged = alpha_flags(rows.select("image_id", "y", "data"), channels, own, "image_id")
    return bands(flagged, max(t.values.shape[0] for t in own), band).groupBy("image_id", "band").applyInPandas(run, schema)


def chosen(rows: DataFrame, templates: DataFrame, channels: int, method: str) -> str:
    if method != "auto":
        return method
    sizes = check_templates(templates, channels)
    values = rows.select(F.sum(F.size("data")).alias("n")).first()["n"] or 0
    return "join" if values * sum(r["w"] * r["h"] for r in sizes) <= JOIN_PAIRS else "tiles"


def response_map(rows: DataFrame, templates: DataFrame, channels: int = 1, method: str = "tiles", band: int = BAND) -> DataFrame:
    """(image_id, template_id, y, x, score) of each position; score in double precision. Templates larger than an image have none."""
    if chosen(rows, templates, channels, method) == "tiles":
        return by_tiles(rows, templates, channels, False, band)
    check_templates(templates, channels)
    return map_by_join(rows, templates, channels)


def extrema(responses: DataFrame, *keys: str) -> DataFrame:
    """Least and greatest score, rounded to single precision, and where they occur first row by row."""
    s = F.col("score").cast("float")
    got = responses.groupBy(*keys).agg(F.min(F.struct(s.alias("v"), "y", "x")).alias("lo"), F.max(F.struct(s.alias("v"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("hi"))
    return got.select(*keys, F.col("lo.v").alias("min_v"), F.col("lo.x").alias("min_x"), F.col("lo.y").alias("min_y"), F.col("hi.v").alias("max_v"), (-F.col("hi.x")).alias("max_x"), (-F.col("hi.y")).alias("max_y"))


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Extrema of parts as extrema of the whole."""
    lo, hi = F.min(F.struct("min_v", "min_y", "min_x")), F.max(F.struct("max_v", (-F.col("max_y")).alias("y"), (-F.col("max_x")).alias("x")))
    got = parts.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi"))
    return got.select(*keys, "lo.min_v", "lo.min_x", "lo.min_y", "hi.max_v", (-F.col("hi.x")).alias("max_x"), (-F.col("hi.y")).alias("max_y"))


def match(rows: DataFrame, templates: DataFrame, channels: int = 1, method: str = "tiles", band: int = BAND) -> DataFrame:
    """(image_id, template_id, min_v, min_x, min_y, max_v, max_x, max_y); a flat template gives (1, 0, 0, 1, 0, 0).

    Of four channels the fourth is left out where it is constant in the image and the template.
    """
    if chosen(rows, templates, channels, method) == "tiles":
        return merged(by_tiles(rows, templates, channels, True, band), "image_id", "template_id")
    return extrema(response_map(rows, templates, channels, "join"), "image_id", "template_id")


def find_all(rows: DataFrame, templates: DataFrame, channels: int = 1, method: str = "tiles") -> DataFrame:
    """match() for an ordered set of templates, with ord; order by image_id and ord."""
    return match(rows, templates, channels, method).join(F.broadcast(templates.select("template_id", "ord")), "template_id")


def window_sums(rows: DataFrame, channels: int, w: int, h: int) -> DataFrame:
    """(image_id, c, y, x, s, s2): sums and sums of squares over w x h windows, by window functions over columns, then rows."""
    from pyspark.sql.window import Window

    px = pixels(rows, channels)
    down = Window.partitionBy("image_id", "c", "x").orderBy("y").rowsBetween(0, h - 1)
    over = Window.partitionBy("image_id", "c", "y").orderBy("x").rowsBetween(0, w - 1)
    cols = px.select("image_id", "c", "y", "x", F.sum("v").over(down).alias("s"), F.sum(F.col("v") * F.col("v")).over(down).alias("s2"), F.count("*").over(down).alias("n")).where(F.col("n") == h)
    sums = cols.select("image_id", "c", "y", "x", F.sum("s").over(over).alias("s"), F.sum("s2").over(over).alias("s2"), F.count("*").over(over).alias("n"))
    return sums.where(F.col("n") == w).drop("n")


def iterate(frames: list[DataFrame], templates: DataFrame, channels: int = 1) -> Iterator[DataFrame]:
    """match() frame after frame against templates that are prepared and cached once."""
    kept = templates.cache()
    for rows in frames:
        yield match(rows, kept, channels)
