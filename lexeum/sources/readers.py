"""Readers of raw files: always with a given schema, never inferred."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lexeum.functions.text import na_to_null
from lexeum.sources import quoted


MULTILINE, WHOLE = "spark.lexeum.csv.multiLine", "spark.lexeum.csv.wholeBytes"
log = logging.getLogger(__name__)


def _typed(df: DataFrame, types: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Missing-value strings to null, then the wanted types; what does not cast is null. Columns to ``keep`` stay as they are."""
    return df.select(*(F.col(f"`{c}`") if c in keep else na_to_null(F.col(f"`{c}`")).try_cast(types.get(c, "string")).alias(c) for c in df.columns))


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a file with a header (reads the first line only)."""
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).option("quote", '"').option("escape", '"').csv(path).columns


def sizes(spark: SparkSession, path: str) -> list[int]:
    """Bytes of each file of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while files.hasNext():
        out.append(files.next().getLen())
    return out


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, sep: str = ",", multiline: bool | None = None, order: str | None = None) -> DataFrame:
    """Header, quotes doubled inside quotes, line breaks inside quotes; columns not in ``types`` are strings.

    Files of up to ``spark.lexeum.csv.wholeBytes`` (64 MB) are read by one task
    each; larger ones in ranges whose records are found by counting quotes (see
    :mod:`lexeum.sources.quoted`; this runs a job). ``multiline=True`` reads
    every file by one task; ``multiline=False`` says that quotes hold no line
    breaks, so that Spark splits files itself. All loaders of a session follow
    ``spark.lexeum.csv.multiLine`` (auto, true or false). ``order`` names a
    further column that sorts as the rows stand in the files.
    """
    said = spark.conf.get(MULTILINE, "auto").lower() if multiline is None else str(multiline).lower()
    names = header(spark, path, sep)
    place = order or "_order"
    raw = None
    if said == "auto" and max(sizes(spark, path), default=0) > int(spark.conf.get(WHOLE, str(64 << 20))):
        raw = quoted.read(spark, path, names, sep, place)
    if raw is None:
        schema = StructType()
        for n in names:
            schema = schema.add(n, StringType())
        raw = spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", said != "false").option("quote", '"').option("escape", '"').option("enforceSchema", True).csv(path)
        at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
        raw = raw.withColumn(place, at)
    return _typed(raw, types or {}, (order,)) if order else _typed(raw.drop(place), types or {})


def read_tsv(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    return read_csv(spark, path, types, sep="\t")


def read_json_lines(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """One object a line; a row that lacks a required field stops the read."""
    df = spark.read.schema(schema).json(path)
    for c in required:
        df = df.withColumn(c, F.coalesce(c, F.raise_error(F.lit(f"a row has no {c}")).cast("string")))
    return df


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word list without header, each word once."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''").distinct()


def read_parquet_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, with those in folders below, if it is there and has the columns, else an empty one.

    Only a path that is not there, files that are no Parquet and missing columns count as empty; other errors are raised.
    """
    empty = spark.createDataFrame([], schema)
    try:
        df = spark.read.option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as e:
        if (e.getCondition() or "").split(".")[0] not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        log.info("nothing to read in %s", path)
        return empty
    except Exception as e:
        if "is not a Parquet file" not in str(e) and "CANNOT_READ_FILE" not in str(e):
            raise
        log.warning("%s holds files that are no Parquet; going on without it", path)
        return empty
    if missing := set(empty.columns) - set(df.columns):
        log.warning("%s lacks %s; going on without it", path, sorted(missing))
        return empty
    return df.select(*empty.columns)


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A spreadsheet's export (csv, tsv or parquet), or the sheet itself where a parser is installed.

    The sheet's first table is read on the driver: the format is a single small file.
    """
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".csv", ".tsv")):
        return read_csv(spark, path, sep="\t" if path.endswith(".tsv") else ",")
    import numbers_parser  # optional

    rows = [[cell.value for cell in row] for row in numbers_parser.Document(path).sheets[0].tables[0].iter_rows()]
    schema = StructType()
    for n in rows[0]:
        schema = schema.add(str(n), StringType())
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows[1:]], schema)


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, in order, on any file system Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(str(f.getPath()) for f in found)
