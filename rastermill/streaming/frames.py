"""A stream of frames: image files that arrive in a folder, matched against prepared templates.

Each frame stands for itself, so there is no state and no watermark; every micro-batch runs the
batch plan, and results are appended once a frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import match
from ..sources.rasters import IMAGES, decoded, grey_rows


def frame_stream(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """The files of a folder as a stream in the image source's form."""
    return spark.readStream.format("image").schema(IMAGES).option("maxFilesPerTrigger", per_batch).load(path)


def match_stream(frames: DataFrame, templates: DataFrame, channels: int, sink: Callable[[DataFrame, int], None], checkpoint: str, gray: bool = False, available_now: bool = False) -> StreamingQuery:
    """Runs match() over each micro-batch of frames with so many channels and hands the result to sink(df, batch_id).

    Frames with another number of channels are left out. The checkpoint folder makes each frame
    come once to a sink that repeats batches safely.
    """
    kept = templates.cache()

    def batch(images: DataFrame, batch_id: int) -> None:
        if images.isEmpty():
            return
        _, rows = decoded(images.where(f"image.nChannels = {channels}"))
        rows, cn = (grey_rows(rows, channels), 1) if gray and channels >= 3 else (rows, channels)
        sink(match(rows, kept, cn), batch_id)

    writer = frames.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
