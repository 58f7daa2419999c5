"""What the operators share: input columns, scratch tables in the shared folder, code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; Java, Python and DuckDB read it alike.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Rows of an Arrow batch that are turned into Python values at once. Spark bounds the batch itself by rows and bytes.
BATCH_ROWS = 1000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string); a null text becomes empty."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def prepare(spark: SparkSession) -> SparkSession:
    """Puts this package on the Python workers' path where the driver's own path lacks it there. No setting of the session changes."""
    root = Path(__file__).resolve().parents[2]
    seen = [os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(":"), os.getcwd()] if p]
    sc = spark.sparkContext
    if str(root) not in seen and not getattr(sc, "_rastermill_shipped", False):
        archive = Path(tempfile.mkdtemp()) / "rastermill.zip"  # only the driver reads it; Spark hands it out
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted((root / "rastermill").rglob("*.py")):
                z.write(p, p.relative_to(root))
        sc.addPyFile(str(archive))
        sc._rastermill_shipped = True
    return spark


def parts(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, none empty."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: Scratch tables that are there, in the order in which they were named.
_left: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one set by setCheckpointDir(); a temporary one only on a local master."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or getattr(sc, "_rastermill_scratch", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = sc._rastermill_scratch = "file://" + tempfile.mkdtemp(prefix="rastermill-")
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_folder(spark)}/rastermill/{name}-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes df as Parquet. The job's shuffle files go as soon as it has ended, as nothing can read them again."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.mode(mode).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and a lost executor costs nothing.

    The table stays until release(): an operator drops what its result doesn't read.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def release(*tables: DataFrame | None) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "_scratch", None)):
            t._scratch = None
            remove(t.sparkSession, path)
            _left[:] = [x for x in _left if x[1] != path]


def mark() -> int:
    """Where the scratch tables of what runs next begin; for release_since()."""
    return len(_left)


def release_since(at: int) -> None:
    """Deletes the scratch tables named since mark(): for a caller that has written the results that read them."""
    for spark, path in _left[at:]:
        remove(spark, path)
    del _left[at:]


def owned(table: DataFrame) -> DataFrame:
    """A materialized table that release_since() leaves alone; release() deletes it."""
    _left[:] = [x for x in _left if x[1] != table._scratch]
    return table


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(col.cast("string").cast("binary")) % n


def slices(texts: list[str], chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > chars:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
