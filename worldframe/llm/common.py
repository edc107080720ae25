"""Shared helpers: lineage cuts in the cluster's shared folder and the train / held-out split."""

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    A local master without that setting (tests) gets a temporary folder; a cluster without it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[\d*,]+\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='worldframe-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and return the scan: no lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/worldframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._worldframe_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and nothing reads any more."""
    _drop(df.sparkSession, getattr(df, "_worldframe_path", ""))


def _drop(spark: SparkSession, path: str) -> None:
    if not path or spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that are no column of df (names differ by case too)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"__{name}" in taken:
            name += "_"
        out.append(f"__{name}")
    return out


def parts(texts: pa.Array, size: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive parts of about size bytes; a longer text is a part of its own."""
    upto = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
        yield at, end - at
        at = end


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row (null: none) and the texts' bounds there."""
    flat = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    bounds = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(flat.buffers()[2], dtype=np.uint8) if flat.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def trim() -> None:
    """Give freed memory back to the system: Python workers live on between the stages of a job."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; such rows never train a model."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, ones: int, zeros: int) -> DataFrame:
    """doc_id, text, y: at most so many training documents of label 1 and of label 0, chosen by a hash of the id.

    Only ids and labels are ranked; the texts of the chosen (at most ones + zeros) ids are fetched by a join whose broadcast side has that bound, and of rows that repeat an id the least text. Null ids, null labels and labels other than 0 and 1 are left out.
    """
    y = F.col(label).cast("int")
    rows = (
        labels.select("doc_id", y.alias("y")).where(F.col("doc_id").isNotNull() & y.isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = rows.where("y = 1").orderBy(*order).limit(ones).unionByName(rows.where("y = 0").orderBy(*order).limit(zeros))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
