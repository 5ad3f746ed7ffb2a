"""Fragment records: JSON arrays per document, JSON lines, or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclake import schemas
from doclake.session import stored

CORRUPT = "_corrupt_record"
RECORD = T.StructType([*schemas.FRAGMENT.fields, T.StructField(CORRUPT, T.StringType())])
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed once and written, so both tables can be counted and read again."""
    rows = stored(rows, "json")
    good = rows.where(F.col(CORRUPT).isNull()).select(*schemas.FRAGMENT.fieldNames())
    bad = rows.where(F.col(CORRUPT).isNotNull()).select("file_path", "id", F.col(CORRUPT).alias("record"))
    return good, bad


def read_fragments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(fragments, quarantine)`` of a folder of JSON files, one array per file or one record per line.

    A file that opens with an array must be one array to its end; any other is
    read line by line.  What cannot be read gives no fragment, but a row in the
    quarantine with its path, its text and the id if that much was readable.  A
    file is read in one piece; large files of lines are for
    :func:`read_fragment_lines`.
    """
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    files = files.select(F.col("_metadata.file_path").alias("file_path"), text.alias("text"))
    whole = F.from_json("text", T.ArrayType(schemas.FRAGMENT))
    lines = F.filter(F.split("text", r"\r?\n"), lambda line: line.rlike(r"\S"))
    names = [*schemas.FRAGMENT.fieldNames(), CORRUPT]
    array = F.col("text").startswith("[")
    arrays = files.where(array).withColumn("read", F.when(F.col("text").endswith("]"), whole))
    broken = arrays.where("read is null").select(
        "file_path",
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.FRAGMENT.fields),
        F.col("text").alias(CORRUPT),
    )
    found = arrays.where("read is not null").select("file_path", F.explode("read").alias("r"))
    found = found.select("file_path", "r.*", F.lit(None).cast("string").alias(CORRUPT))
    each = files.where(~array).select("file_path", F.explode(lines).alias("line"))
    each = each.select("file_path", F.from_json("line", RECORD, OPTIONS).alias("r")).select("file_path", "r.*")
    return _split(found.unionByName(broken).unionByName(each).select("file_path", *names))


def read_fragment_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(fragments, quarantine)`` of files with one record per line, of any size."""
    rows = spark.read.schema(RECORD).options(**OPTIONS).json(path)
    return _split(rows.withColumn("file_path", F.col("_metadata.file_path")))


def write_fragments(fragments: DataFrame, path: str) -> None:
    """Fragment table; sorted inside its files, so a document is found by row-group statistics.

    Rows are not shuffled for it: a document with very many fragments stays
    spread over the tasks that made them.
    """
    (
        fragments.sortWithinPartitions("document_id", "chunk_number")
        .write.mode("overwrite")
        .parquet(path)
    )


def write_fragments_json(fragments: DataFrame, path: str) -> None:
    """One record per line; both readers of this module take it."""
    fragments.write.mode("overwrite").json(path)


def read_fragment_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FRAGMENT).parquet(path)
