"""Synthetic scenes: a desktop with a window, a small frame with textured widgets, and scenes with photos beside them.

Small images for tests and examples, painted on the driver and handed over as rows. The widgets' texture
and the frame around them are fixed values; the desktop has a fixed layout and noise of our own seed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .rasters import read_images

Box = tuple[int, int, int, int]
SCENES = "name string, image_id long, width int, height int, px int, py int, tw int, th int"


def image_rows(spark: SparkSession, image: np.ndarray, image_id: int = 0) -> DataFrame:
    """The row form of an array (y, x, channel) that the driver has."""
    lines = image.reshape(len(image), -1).astype(np.int32)
    ends = pa.array(np.arange(len(lines) + 1, dtype=np.int32) * lines.shape[1])
    data = pa.ListArray.from_arrays(ends, pa.array(lines.ravel()))
    return spark.createDataFrame(pa.table({"image_id": np.full(len(lines), image_id, np.int64), "y": np.arange(len(lines), dtype=np.int32), "data": data}))


def cut(image: np.ndarray, box: Box) -> np.ndarray:
    x0, y0, x1, y1 = box
    return image[y0:y1, x0:x1].copy()


@dataclass
class Canvas:
    """An opaque RGBA image that shapes are painted on."""

    width: int
    height: int
    noise: np.random.Generator
    pixels: np.ndarray = field(init=False)

    def __post_init__(self):
        self.pixels = np.zeros((self.height, self.width, 4), np.uint8)
        self.pixels[:, :, 3] = 255

    def area(self, box: Box) -> np.ndarray:
        return self.pixels[box[1] : box[3], box[0] : box[2], :3]

    def fill(self, box: Box, colour: tuple[int, int, int]) -> None:
        self.area(box)[:] = colour

    def gradient(self, box: Box, top: tuple[int, int, int], bottom: tuple[int, int, int]) -> None:
        """From the first row's colour to the last one's, cut off to whole values."""
        share = np.arange(box[3] - box[1])[:, None] / max(1, box[3] - box[1] - 1)
        self.area(box)[:] = (np.array(top) + share * (np.array(bottom) - np.array(top))).astype(np.uint8)[:, None, :]

    def outline(self, box: Box, colour: tuple[int, int, int]) -> None:
        own = self.area(box)
        own[0] = own[-1] = colour
        own[:, 0] = own[:, -1] = colour

    def text(self, box: Box, line: int) -> None:
        """Runs of dark pixels, two thirds of them set, in lines of so many pixels."""
        for y in range(box[1] + 4, box[3] - line, line + 6):
            x = box[0] + 8
            while x < box[2] - 20:
                run = min(int(self.noise.integers(3, 27)), box[2] - 8 - x)
                part = self.pixels[y : y + line - 4, x : x + run, :3]
                part[self.noise.random(part.shape[:2]) < 2 / 3] = self.noise.integers(30, 120)
                x += run + int(self.noise.integers(4, 18))

    def mosaic(self, box: Box, cell: int = 4) -> None:
        own = self.area(box)
        tiles = self.noise.integers(0, 256, (-(-own.shape[0] // cell), -(-own.shape[1] // cell), 3))
        own[:] = tiles.repeat(cell, 0).repeat(cell, 1)[: own.shape[0], : own.shape[1]]

    def button(self, box: Box) -> None:
        x0, y0, x1, y1 = box
        self.outline(box, (118, 118, 118))
        self.gradient((x0 + 1, y0 + 1, x1 - 1, y1 - 1), (243, 243, 243), (214, 214, 214))
        middle = y0 + (y1 - y0) // 2
        self.text((x0 + 12, middle - 9, x1 - 12, middle + 11), 10)

    def icon(self, box: Box) -> None:
        self.mosaic(box)
        self.outline(box, (90, 90, 90))


def desktop(width: int, height: int, seed: int = 3) -> tuple[np.ndarray, dict[str, Box]]:
    """A window with title, toolbar, sidebar, text and a dialog; and where the button, icon and panel to look for are."""
    c = Canvas(width, height, np.random.default_rng(seed))
    c.fill((0, 0, width, height), (0, 120, 160))
    c.gradient((0, height - 48, width, height), (40, 40, 48), (24, 24, 30))
    x0, y0, x1, y1 = width // 16, height // 20, width - width // 16, height - height // 10
    c.fill((x0, y0, x1, y1), (255, 255, 255))
    c.outline((x0, y0, x1, y1), (100, 100, 100))
    bar, top = y0 + 34, y0 + 70
    c.gradient((x0, y0, x1, bar), (70, 130, 200), (50, 100, 170))
    c.gradient((x0, bar, x1, top), (240, 240, 240), (222, 222, 222))
    icons = [(x0 + 10 + 34 * k, bar + 6, x0 + 34 + 34 * k, bar + 30) for k in range(18)]
    for box in icons:
        c.icon(box)
    left = x0 + (x1 - x0) // 5
    c.fill((x0, top, left, y1), (245, 245, 247))
    for y in range(top + 12, min(top + 12 + 14 * 30, y1 - 21), 30):
        c.text((x0 + 10, y, left - 10, y + 22), 12)
    c.text((left, top, x1, y1), 14)
    px, py = left + (x1 - left) // 4, top + (y1 - top) // 4
    dx, dy = left + (x1 - left) // 3, top + (y1 - top) // 2
    c.fill((dx, dy, dx + 380, dy + 150), (250, 250, 250))
    c.outline((dx, dy, dx + 380, dy + 150), (80, 80, 80))
    c.gradient((dx, dy, dx + 380, dy + 24), (235, 235, 235), (215, 215, 215))
    c.text((dx + 16, dy + 36, dx + 364, dy + 78), 12)
    buttons = [(dx + 24 + 116 * k, dy + 104, dx + 120 + 116 * k, dy + 136) for k in range(3)]
    for box in buttons:
        c.button(box)
    return c.pixels, {"button": buttons[1], "icon": icons[11], "panel": (px, py, px + 300, py + 200)}


#: The frame's size, its widgets (box and seed, in painting order) and where the button is in the moved frame.
FRAME = (1280, 800)
WIDGETS = {"wifi": ((1180, 12, 1204, 36), 7), "mute": ((1216, 12, 1240, 36), 9), "panel": ((200, 200, 500, 400), 33), "ok": ((860, 700, 980, 736), 21)}
MOVED_OK = (600, 700, 720, 736)


def widget(width: int, height: int, seed: int) -> np.ndarray:
    """A bordered texture from a 32-bit linear congruential generator that steps at every pixel, border included."""
    states, s = np.empty(width * height, np.uint32), seed
    for k in range(len(states)):
        s = (s * 1664525 + 1013904223) & 0xFFFFFFFF
        states[k] = s
    out = np.full((height, width, 4), 255, np.uint8)
    out[:, :, :3] = (20, 20, 24)
    inner = (slice(1, -1), slice(1, -1))
    for k, (base, shift) in enumerate(((140, 8), (120, 16), (90, 24))):
        out[(*inner, k)] = (base + ((states.reshape(height, width) >> shift) & 63))[inner]
    return out


def widget_frame(moved: bool = False) -> np.ndarray:
    """The frame with its four widgets, the button elsewhere if moved."""
    width, height = FRAME
    out = np.full((height, width, 4), 255, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = 30 + np.arange(width) * 50 // width, (40 + np.arange(height) * 50 // height)[:, None], 64
    for name, (box, seed) in WIDGETS.items():
        x0, y0, x1, y1 = MOVED_OK if moved and name == "ok" else box
        out[y0:y1, x0:x1] = widget(x1 - x0, y1 - y0, seed)
    return out


def scenes(spark: SparkSession, photos: str | list[str] | None = None, sizes: tuple[tuple[int, int], ...] = ((1600, 1000),)) -> tuple[DataFrame, DataFrame]:
    """(SCENES, rows) of desktops of these sizes, one scene for each thing to look for, and of the photos that are there, which have none (px -1)."""
    table, images = [], []
    for k, (w, h) in enumerate(sizes):
        pixels, boxes = desktop(w, h)
        images.append(image_rows(spark, pixels, k))
        table += [(f"window{w}_{name}", k, w, h, x0, y0, x1 - x0, y1 - y0) for name, (x0, y0, x1, y1) in boxes.items()]
    found, rows = spark.createDataFrame(table, SCENES), images[0]
    for more in images[1:]:
        rows = rows.unionByName(more)
    if photos:
        frames, lines = read_images(spark, photos)
        found = found.unionByName(frames.selectExpr("concat('photo_', regexp_extract(origin, '([^/]*)[.][^./]*$', 1)) AS name", "image_id", "width", "height", "-1 AS px", "-1 AS py", "0 AS tw", "0 AS th"))
        rows = rows.unionByName(lines)
    return found, rows
