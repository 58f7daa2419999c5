"""Rasters: images as rows of 8-bit values, from tables, image files and raw dumps.

The row form is (image_id, y, data): data holds a row's values, channels interleaved. It keeps a
frame's rows apart, so that a region of interest becomes a predicate on y and a frame of any size
is dealt over tasks. The pixel form is (image_id, y, x, c, v).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "image_id long, y int, data array<int>"
IMAGES = "image struct<origin string, height int, width int, nChannels int, mode int, data binary>"
#: Lines in one Arrow batch.
LINES = 64
#: Magic numbers of the raw dumps, before two little-endian int32 sizes and the payload.
RAW_RGBA, RAW_FLOAT = b"CVMS", b"CVMR"
EVENT_CHANNELS = ("click", "error", "purchase", "signup")


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grey image: a row for each vector, a column for each component, scaled to 0..255."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    scaled = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * 127.5).cast("int"))))
    return table.select(F.lit(0).cast("long").alias("image_id"), F.col("vec_id").cast("int").alias("y"), scaled.alias("data"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image of 30 days by 24 hours with four channels: counts of event types, scaled so that the largest is 255."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type").isin(*EVENT_CHANNELS))
    channel = reduce(lambda a, k: F.when(F.col("event_type") == EVENT_CHANNELS[k], k).otherwise(a), range(len(EVENT_CHANNELS)), F.lit(None).cast("int"))
    cells = events.groupBy((F.dayofmonth("ts") - 1).alias("y"), (F.hour("ts") * 4 + channel).alias("i")).agg(F.count("*").alias("n"))
    most = cells.agg(F.max("n").alias("most"))
    days = spark.range(30).select(F.col("id").cast("int").alias("y"))
    filled = days.join(dense(cells, 24 * 4), "y", "left").crossJoin(F.broadcast(most))  # one row is broadcast
    counts = F.coalesce("data", F.array_repeat(F.lit(0).cast("long"), 24 * 4))
    return filled.select(F.lit(0).cast("long").alias("image_id"), "y", F.transform(counts, lambda n: F.floor(255 * n / F.col("most")).cast("int")).alias("data"))


def dense(cells: DataFrame, width: int) -> DataFrame:
    """(y, data) of cells (y, i, n): data[i] = n, 0 where there is no cell."""
    rows = cells.groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"))
    return rows.select("y", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("data"))


def order_rows(spark: SparkSession, sf_dir: str, rows: int = 256) -> DataFrame:
    """One image with three channels: quantity, discount and tax of order lines by hashed order and line number."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    scaled = lambda c, k: F.floor(F.sum(F.round(F.col(c) * 100).cast("long")) * k / (100 * F.count("*"))).alias(c)  # noqa: E731  of whole hundredths: no order of rows changes it
    cells = lines.groupBy((F.col("l_orderkey") % rows).cast("int").alias("y"), F.col("l_linenumber").alias("x")).agg(scaled("l_quantity", 5), scaled("l_discount", 2550), scaled("l_tax", 3187))
    parts = [cells.select("y", ((F.col("x") - 1) * 3 + k).cast("int").alias("i"), F.col(c).cast("long").alias("n")) for k, c in enumerate(("l_quantity", "l_discount", "l_tax"))]
    full = dense(reduce(DataFrame.unionByName, parts), 7 * 3)
    return full.select(F.lit(0).cast("long").alias("image_id"), "y", F.transform("data", lambda v: v.cast("int")).alias("data"))


def pixels(rows: DataFrame, channels: int) -> DataFrame:
    """(image_id, y, x, c, v) from the row form."""
    flat = rows.select("image_id", "y", F.posexplode("data").alias("i", "v"))
    return flat.select("image_id", "y", F.floor(F.col("i") / channels).cast("int").alias("x"), (F.col("i") % channels).cast("int").alias("c"), F.col("v").cast("long").alias("v"))


def rows_of(px: DataFrame) -> DataFrame:
    """The row form from pixels; every row must be complete."""
    parts = F.array_sort(F.collect_list(F.struct("x", "c", "v")))
    return px.groupBy("image_id", "y").agg(F.transform(parts, lambda p: p["v"].cast("int")).alias("data"))


def grey_rows(rows: DataFrame, channels: int) -> DataFrame:
    """Colour rows (red, green, blue first) as grey rows."""
    from ..functions.scores import grey

    at = F.sequence(F.lit(0), (F.size("data") / channels).cast("int") - 1)
    value = F.transform(at, lambda i: grey(*(F.get("data", i * channels + k) for k in range(3))).cast("int"))
    return rows.withColumn("data", value)


def select_channels(rows: DataFrame, channels: int, used: int) -> DataFrame:
    """The first `used` of a row's interleaved channels."""
    return rows if used == channels else rows.withColumn("data", F.filter("data", lambda v, i: i % channels < used))


def crop(rows: DataFrame, channels: int, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """A part of each image as an image of its own; the predicate on y reaches the scan."""
    cut = F.slice("data", x0 * channels + 1, w * channels)
    return rows.where((F.col("y") >= y0) & (F.col("y") < y0 + h)).select("image_id", (F.col("y") - y0).alias("y"), cut.alias("data"))


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths, or patterns, that lead to something, in any store that Spark reads."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    found = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).globStatus(path):
            found.append(p)
    return found


def read_images(spark: SparkSession, path: str | list[str], premultiply: bool = False) -> tuple[DataFrame, DataFrame]:
    """(frames, rows) of image files; frames: (image_id, origin, width, height, n_channels).

    Files that aren't images are left out, and so are paths that lead nowhere. The image source gives
    blue, green, red; rows hold red, green, blue (alpha). Straight alpha is kept unless premultiply.
    image_id is a hash of the file's name.
    """
    there = present(spark, [path] if isinstance(path, str) else path)
    if not there:
        return decoded(spark.createDataFrame([], IMAGES), premultiply)
    return decoded(spark.read.format("image").option("dropInvalid", True).load(there), premultiply)


def decoded(images: DataFrame, premultiply: bool = False) -> tuple[DataFrame, DataFrame]:
    """(frames, rows) of a table, or a stream, with the image source's struct."""
    flat = images.select(F.xxhash64("image.origin").alias("image_id"), "image.origin", "image.width", "image.height", F.col("image.nChannels").alias("n_channels"), "image.data")
    flat = flat.where((F.col("width") > 0) & (F.col("height") > 0))

    def values(data: bytes, width: int, n: int) -> np.ndarray:
        lines = np.frombuffer(data, np.uint8).astype(np.int32).reshape(-1, width, n)
        if n >= 3:
            lines = lines[:, :, [2, 1, 0, *range(3, n)]]
        if premultiply and n == 4:
            lines[:, :, :3] = lines[:, :, :3] * lines[:, :, 3:] // 255
        return lines.reshape(len(lines), -1)

    return flat.drop("data"), line_rows(flat.select("image_id", "width", "n_channels", "data"), values)


def line_rows(raw: DataFrame, values: Callable[[bytes, int, int], np.ndarray]) -> DataFrame:
    """The row form of (image_id, width, channels, bytes); values makes an array with a row for each line."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, width, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                v = values(data, width, n)
                for at in range(0, len(v), LINES):
                    some = np.ascontiguousarray(v[at : at + LINES], np.int32)
                    ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * some.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), image, np.int64)), pa.array(np.arange(at, at + len(some), dtype=np.int32)), pa.ListArray.from_arrays(ends, pa.array(some.ravel()))], names=["image_id", "y", "data"])

    return raw.mapInArrow(lines, ROWS)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(name, width, height, magic, payload) of raw dumps; raises on a wrong magic number or length."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                magic, (w, h) = content[:4], struct.unpack("<ii", content[4:12])
                if magic not in (RAW_RGBA, RAW_FLOAT) or len(content) != 12 + 4 * w * h:
                    raise ValueError(f"{name} isn't a raw dump")
                rows.append((name, w, h, magic.decode(), content[12:]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["name", "width", "height", "magic", "payload"])

    return files.mapInArrow(parse, "name string, width long, height long, magic string, payload binary")


def raw_bytes(magic: bytes, width: int, height: int, payload: bytes) -> bytes:
    """A raw dump's content: RGBA bytes, or little-endian float32 scores row by row."""
    if len(payload) != 4 * width * height:
        raise ValueError("the payload must have four bytes a pixel")
    return magic + struct.pack("<ii", width, height) + payload


def raw_rgba_rows(raw: DataFrame) -> DataFrame:
    """The row form of raw RGBA dumps; image_id is a hash of the name."""
    own = raw.where(F.col("magic") == RAW_RGBA.decode()).select(F.xxhash64("name").alias("image_id"), "width", F.lit(4).alias("channels"), "payload")
    return line_rows(own, lambda data, width, n: np.frombuffer(data, np.uint8).reshape(-1, width * n))


def raw_dumps(rows: DataFrame, channels: int = 4) -> DataFrame:
    """(image_id, width, height, content): each image of the row form as a raw RGBA dump. An image is one value, so it must fit in a task.

    With two channels or fewer the first is red, green and blue; alpha is 255 where there is none.
    """
    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf.sort_values("y")["data"].to_numpy()).astype(np.uint8).reshape(len(pdf), -1, channels)
        full = np.full((*v.shape[:2], 4), 255, np.uint8)
        full[:, :, :3] = v[:, :, :3] if channels >= 3 else v[:, :, :1]
        if channels == 4:
            full[:, :, 3] = v[:, :, 3]
        return pd.DataFrame([(int(key[0]), v.shape[1], v.shape[0], raw_bytes(RAW_RGBA, v.shape[1], v.shape[0], full.tobytes()))], columns=["image_id", "width", "height", "content"])

    return rows.groupBy("image_id").applyInPandas(write, "image_id long, width long, height long, content binary")


def score_dumps(responses: DataFrame) -> DataFrame:
    """(image_id, template_id, width, height, content): each response map as a raw dump of single-precision scores."""
    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        w, h = int(pdf["x"].max()) + 1, int(pdf["y"].max()) + 1
        return pd.DataFrame([(int(key[0]), int(key[1]), w, h, raw_bytes(RAW_FLOAT, w, h, pdf["score"].to_numpy("<f4").tobytes()))], columns=["image_id", "template_id", "width", "height", "content"])

    return responses.groupBy("image_id", "template_id").applyInPandas(write, "image_id long, template_id long, width long, height long, content binary")


def write_manifest(dumps: DataFrame, path: str, *columns: str) -> None:
    """The dumps' names and sizes as tab-separated text with a header."""
    dumps.select(*(columns or [c for c in dumps.columns if c != "content"])).write.option("sep", "\t").option("header", True).csv(path)


def raw_scores(raw: DataFrame) -> DataFrame:
    """(name, y, x, score) of raw float32 dumps."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, w, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                v = np.frombuffer(payload, "<f4")
                at = np.arange(len(v))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array((at // w).astype("i4")), pa.array((at % w).astype("i4")), pa.array(v)], names=["name", "y", "x", "score"])

    return raw.where(F.col("magic") == RAW_FLOAT.decode()).select("name", "width", "payload").mapInArrow(parse, "name string, y int, x int, score float")


def noise_rows(spark: SparkSession, width: int, height: int, channels: int = 4, seed: int = 1, alpha: bool = False) -> DataFrame:
    """A synthetic image: ramps over x and y with six bits of hashed noise; alpha 255, or 64 to 255 if asked for."""
    def value(i: Column) -> Column:
        x, c = F.floor(i / channels), i % channels
        noise = F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(64))
        ramp = F.when(c == 0, x * 160 / width).when(c == 1, F.col("id") * 160 / height).otherwise((x + F.col("id")) * 80 / (width + height))
        a = F.pmod(F.xxhash64(F.lit(seed + 1), "id", i), F.lit(192)) + 64 if alpha else F.lit(255)
        return F.when(c == 3, a).otherwise(F.floor(ramp) + noise).cast("int")

    return spark.range(height).select(F.lit(0).cast("long").alias("image_id"), F.col("id").cast("int").alias("y"), F.transform(F.sequence(F.lit(0), F.lit(width * channels - 1)), value).alias("data"))


def degraded_rows(rows: DataFrame, amplitude: int, channels: int = 4, seed: int = 5) -> DataFrame:
    """Uniform noise within +-amplitude on all but a fourth channel, cut off at 0 and 255."""
    from ..functions.scores import saturated

    def value(v: Column, i: Column) -> Column:
        noise = F.pmod(F.xxhash64(F.lit(seed), "image_id", "y", i), F.lit(2 * amplitude + 1)).cast("int") - amplitude
        return F.when((i % channels) == 3, v).otherwise(saturated(v + noise))

    return rows.withColumn("data", F.transform("data", value))
