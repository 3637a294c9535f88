"""Uploaded files: a folder of any file system, read by Spark's binary source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.norm import safe_file_name
from ..operators.intake import MOST_BYTES, mime_type

#: Why an upload is refused.
EMPTY, TOO_LONG = "File is empty", "File size exceeds the 20MB limit"
UNKNOWN_TYPE = "Unsupported file format. Please upload PDF, JPEG, PNG, or WEBP"


def uploaded_files(spark: SparkSession, path: str, glob: str = "*", most: int = MOST_BYTES) -> DataFrame:
    """(``path``, ``file_name``, ``length``, ``mime_type``, ``sha256``, ``content``, ``accepted``, ``error``) of all files below ``path`` whose names fit ``glob``.

    Type and fingerprint come from the content. Files over ``most`` bytes are told by their length: their content is never read, so it is null, as are
    type and fingerprint. A folder without files gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = safe_file_name(F.substring_index("path", "/", -1))
    # the source prunes by length before it opens a file, and opens none if content isn't asked for
    fit = files.where(F.col("length") <= most).select("path", "length", "content")
    fit = fit.withColumns({"mime_type": mime_type(F.col("content")), "sha256": F.sha2("content", 256)})
    error = F.when(F.col("mime_type").isNull(), UNKNOWN_TYPE)
    long = files.where(F.col("length") > most).select("path", "length", *(F.lit(None).cast(k).alias(c) for c, k in (("content", "binary"), ("mime_type", "string"), ("sha256", "string"))))
    # the scan leaves out files without a byte, which only the source's index has
    decoded = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    index = spark.createDataFrame([(u,) for u in files.inputFiles()], "uri string").select(F.regexp_replace(decoded, "^file:/+", "file:/").alias("path"))
    empty = index.join(files.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), *(F.lit(v).cast(k).alias(c) for c, k, v in (("content", "binary", ""), ("mime_type", "string", None))))
    empty = empty.withColumns({"sha256": F.sha2("content", 256), "error": F.lit(EMPTY)})
    rows = fit.withColumn("error", error).unionByName(long.withColumn("error", F.lit(TOO_LONG))).unionByName(empty)
    return rows.select("path", name.alias("file_name"), "length", "mime_type", "sha256", "content", F.col("error").isNull().alias("accepted"), "error")
