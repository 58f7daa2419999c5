"""What is read off a response map: hits, local maxima, the best few, and how distinct the best one is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hits(responses: DataFrame, threshold: float) -> DataFrame:
    """Positions whose score, in single precision, is the threshold or more."""
    return responses.where(F.col("score").cast("float") >= F.lit(threshold).cast("float"))


def local_maxima(responses: DataFrame, threshold: float, rx: int, ry: int) -> DataFrame:
    """hits() without a strictly greater score within rx columns and ry rows; ties stay.

    The greatest score of the neighbourhood comes from two window functions, along rows and then
    along columns of the row maxima: the cost doesn't grow with the neighbourhood.
    """
    along = Window.partitionBy("image_id", "template_id", "y").orderBy("x").rangeBetween(-rx, rx)
    across = Window.partitionBy("image_id", "template_id", "x").orderBy("y").rangeBetween(-ry, ry)
    top = responses.withColumn("m", F.max("score").over(along)).withColumn("m", F.max("m").over(across))
    return hits(top, threshold).where(F.col("score") >= F.col("m")).drop("m")


def ranked(peaks: DataFrame, k: int) -> DataFrame:
    """The k best peaks of each image and template with their rank; ties in the order of rows, then columns."""
    order = Window.partitionBy("image_id", "template_id").orderBy(F.desc("score"), "y", "x")
    return peaks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ambiguity(peaks: DataFrame) -> DataFrame:
    """(image_id, template_id, best, second, gap): a small gap to the second peak speaks against the first."""
    two = ranked(peaks, 2).groupBy("image_id", "template_id").agg(F.max("score").alias("best"), F.min(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    return two.withColumn("gap", F.col("best") - F.col("second"))


#: Fixed value: how much lower our best position may score in the other map and still be a tie.
TIE = 2e-3


def parity(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Two response maps of the same search: the largest difference and where it is first, the peaks' difference, and whether they agree.

    (image_id, template_id, worst, y, x, positions, peak_dv, status): status is "ok" where both have
    their first greatest score at one place, "tie" where theirs is at most TIE lower at our place, else "mismatch".
    """
    both = ours.join(theirs.withColumnRenamed("score", "other"), ["image_id", "template_id", "y", "x"])
    back = ((-F.col("y")).alias("y"), (-F.col("x")).alias("x"))
    worst = F.max(F.struct(F.abs(F.col("score") - F.col("other")).alias("worst"), *back)).alias("m")
    mine = F.max(F.struct(F.col("score").cast("float").alias("s"), *back, F.col("other"))).alias("a")
    best = F.max(F.struct(F.col("other").cast("float").alias("s"), *back)).alias("b")
    got = both.groupBy("image_id", "template_id").agg(worst, mine, best, F.count("*").alias("positions"))
    same = (F.col("a.y") == F.col("b.y")) & (F.col("a.x") == F.col("b.x"))
    status = F.when(same, "ok").when(F.col("b.s") - F.col("a.other") <= TIE, "tie").otherwise("mismatch")
    peak = F.abs(F.col("a.s").cast("double") - F.col("b.s").cast("double"))
    return got.select("image_id", "template_id", "m.worst", (-F.col("m.y")).alias("y"), (-F.col("m.x")).alias("x"), "positions", peak.alias("peak_dv"), status.alias("status"))


def digest(responses: DataFrame) -> DataFrame:
    """A checksum of a response map that doesn't depend on the order of rows."""
    return responses.groupBy("image_id", "template_id").agg(F.sum(F.xxhash64("y", "x", F.col("score").cast("float")).cast("decimal(38,0)")).cast("string").alias("digest"), F.count("*").alias("positions"))
