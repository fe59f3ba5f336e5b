"""What the operators of this subpackage share: word rules, shared tables, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

__all__ = ["prepare", "WORD", "shared_dir", "written", "discard", "bounded_broadcast", "attach_groups", "small", "lower_ascii", "documents", "tokenizer_path"]

#: A word: a run without ASCII white space (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch, where the session doesn't say: rows hold whole texts, and both sides hold a batch or two.
BATCH_ROWS = "1000"
#: Bytes of an Arrow batch, where the session has Spark's own 64 MB: the JVM holds buffers of it outside its heap for each task.
BATCH_BYTES, SPARKS_BYTES = "4m", "67108864b"

_own_dirs: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Sends the package to the executors, and keeps Arrow batches of texts small (rows and bytes) unless the session sets their size."""
    session.prepare(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None and not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, BATCH_ROWS)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, SPARKS_BYTES) == SPARKS_BYTES and not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode, where driver and executors are one process, an own temporary folder stands in if it is unset.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="rightsloom_")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: later jobs start from files, whatever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rightsloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that written() gave, once no later plan reads them; others are left alone."""
    for df in tables:
        path = getattr(df, "_written_path", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def bounded_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast only if the counted rows are within a bound; else Spark shuffles."""
    return F.broadcast(df) if rows <= most else df


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Left join of rows with the row of their group, safe where a group holds a large part of all rows.

    Groups with over a thousandth of all rows are fewer than a thousand: those are broadcast. Rows of
    such groups then go on under ``spread`` (a binary that equals no key), so the shuffle stays even.
    """
    limit = max(total // 1000, 1)
    values = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > limit).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in values])
    cold = groups.where(F.col(size) <= limit).select(F.col(key).alias("_ck"), *[F.col(c).alias(f"_c_{c}") for c in values])
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    out = out.withColumn("_jk", F.when(F.col("_hk").isNull(), F.col(key)).otherwise(spread))
    out = out.join(cold, F.col("_jk") == F.col("_ck"), "left")
    return out.select(*rows.columns, *[F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in values])


def small(batches, rows: int = 256):
    """Arrow batches in slices of a few rows, so that a worker holds Python objects of those only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z. Letters beyond ASCII may change case too, never into ASCII: the two that would go the slow way."""
    slow = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(c, F.lit("K")) | F.contains(c, F.lit("İ")), slow).otherwise(F.lower(c))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the folder is ``RIGHTSLOOM_TOKENIZERS`` or the installed package."""
    folder = os.environ.get("RIGHTSLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
