"""Scans of binary files and the paths of what is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binary import container_format, format_of_path

# Fixed value: the limit that is tested before a file is read.
MAX_FILE_BYTES = 100 << 20


def scan_images(spark: SparkSession, path: str, recursive: bool = False, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path, modificationTime, length, content, format of image files; extensions in any case. The size limit is a filter
    on the listing, so larger files aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).where((F.col("length") <= max_bytes) & F.col("path").rlike(r"(?i)\.(png|jpe?g|webp)$")).withColumn("format", container_format(F.col("content")))


def manifest_files(spark: SparkSession, path: str, formats: list[str] | None = None) -> DataFrame:
    """Recursive scan by extension, in lower case only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"\.(png|jpe?g|webp)$"))
    return files.where(format_of_path(F.col("path")).isin(*formats)) if formats else files


def output_paths(files: DataFrame, folder: str) -> DataFrame:
    """path, output: the nth file of a stem (by path) gets a suffix with its number."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    parts = files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"))
    n = F.row_number().over(Window.partitionBy("stem", "ext").orderBy("path")) - 1
    return parts.withColumn("n", n).select("path", F.concat(F.lit(folder.rstrip("/") + "/"), "stem", F.lit("_protected"), F.when(F.col("n") > 0, F.concat(F.lit("_"), F.col("n"))).otherwise(""), F.lit("."), "ext").alias("output"))


def disjoint(paths: DataFrame) -> DataFrame:
    """The same rows; an output equal to its input ends the job."""
    same = F.when(F.col("path") == F.col("output"), F.raise_error(F.concat(F.lit("output would overwrite "), "path")).cast("string")).otherwise(F.col("output"))
    return paths.withColumn("output", same)
