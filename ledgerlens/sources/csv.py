"""Transaction CSV directories: header job, encoding check, layout-wise scan.

1. One text scan, split like any other, gives each file's first line, encoding
   and rows; the result (a row per file) is written once.
2. Detect the layout per file (``headers``), split rejects.
3. Read each (layout, header, encoding) group with one CSV scan, all columns
   STRING, keep the file path, parse to the standard schema, union.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.plans.materialize import materialize
from ledgerlens.sources import headers as hd
from ledgerlens.sources import parse as ps

_FILLED = r"[^\s\x{FEFF}]"  # a line with more than white space and a byte-order mark


def read_headers(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(file_path, path, header, encoding, n_rows) for every file under ``path``.

    One text scan whose splits share the work on a large file; per file it gives
    the first line that is not blank, the lines after it that are not, and
    whether every line is valid UTF-8 (else the file is read as ISO-8859-1,
    which decodes any byte).  A file of blank lines has an empty header and no
    rows; files of no bytes are left out, as by all of Spark's readers.

    ``file_path`` is the name every scan's ``_metadata`` gives (blanks escaped)
    and joins the steps; ``path``, from the listing, opens the file."""
    def reader(fmt):
        return spark.read.format(fmt).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    files = reader("binaryFile").select(F.col("_metadata.file_path").alias("file_path"), "path")
    lines = reader("text").select(
        F.col("_metadata.file_path").alias("file_path"), F.is_valid_utf8("value").alias("valid"),
        F.col("value").rlike(_FILLED).alias("filled"), F.col("value").cast("binary").alias("line"),
        # A split's lines come in order, in one partition.
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    found = lines.groupBy("file_path").agg(
        F.bool_and("valid").alias("utf8"), F.count_if("filled").alias("n"),
        F.min_by("line", F.when(F.col("filled"), F.col("at"))).alias("line"))
    header = F.regexp_replace(F.when(F.col("utf8"), F.decode("line", "UTF-8")).otherwise(F.decode("line", "ISO-8859-1")), r"^\x{FEFF}", "")
    return (files.join(found, "file_path")
            .select("file_path", "path", F.coalesce(header, F.lit("")).alias("header"),
                    F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"),
                    F.greatest(F.col("n") - 1, F.lit(0)).cast("long").alias("n_rows")))


def _names(header: str) -> list[str]:
    """Stripped column names of a header line."""
    return [n.strip() for n in next(csv.reader([header], skipinitialspace=True), [])]


def _last_named(names: list[str]) -> list[tuple[int, str]]:
    """(position, name) per column; the last of columns whose names differ in
    case only, as a frame resolves names without regard to case."""
    last = {n.lower(): i for i, n in enumerate(names)}
    return [(i, n) for i, n in enumerate(names) if last[n.lower()] == i and n]


def scan(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Read a directory of bank exports -> (standard transactions, rejects)."""
    heads = materialize(hd.map_columns(hd.detect_formats(read_headers(spark, path))), "headers")
    rejects = hd.reject_report(heads)
    # A registered layout may use column names the generic mapping rejects.
    plugged = [r["header"] for r in heads.select("header").distinct().collect()
               if ps.format_for(_names(r["header"])).name not in ("chase", "bofa", "plaid", "generic")]
    if plugged:
        own = heads.where(F.col("header").isin(plugged) & (F.col("n_rows") > 0)).select("file_path")
        rejects = rejects.join(own, "file_path", "left_anti")
    good = heads.join(rejects.select("file_path"), "file_path", "left_anti")
    # One CSV scan per distinct layout.  The reader needs each layout's file
    # list; that is the listing the file index holds on the driver anyway
    # (one path per file, no data).
    groups: dict[tuple[str, str, str], list[str]] = {}
    for r in good.select("format", "header", "encoding", "path").collect():
        groups.setdefault((r["format"], r["header"], r["encoding"]), []).append(r["path"])
    out = None
    for (fmt, header, enc), files in groups.items():
        names = _names(header)
        # Read by position: header names may repeat or differ in case only.
        schema = T.StructType([T.StructField(f"_ll_c{i}", T.StringType()) for i in range(len(names))])
        raw = (spark.read.schema(schema).option("header", True).option("encoding", enc)
               .option("multiLine", multi_line).option("enforceSchema", True)
               .option("escape", '"').csv(files)  # a doubled quote inside a quoted field
               .select(*[F.col(f"_ll_c{i}").alias(n) for i, n in _last_named(names)],
                       F.col("_metadata.file_path").alias(ps.FILE_COL),
                       # The input split a line came from: deterministic per row, it
                       # salts the occurrence index so identical lines of one large
                       # file are numbered by several tasks.
                       F.col("_metadata.file_block_start").alias("_ll_line")))
        names = [n for _, n in _last_named(names)]
        spec = ps.format_for(names)          # registry: built-in and plug-in layouts
        if spec.name == "generic":
            std = ps.parse_generic(raw, ps.generic_mapping(names))
        else:
            std = spec.parse(raw)
        out = std if out is None else out.unionByName(std)
    if out is None:
        out = spark.createDataFrame([], "file_path STRING, date TIMESTAMP, description STRING, amount DOUBLE, "
                                        "raw_description STRING, source STRING, transaction_id STRING")
    return out, rejects
