"""File sources and sinks.

CSV columns are bound by header name to a schema (no inference pass over the data);
malformed lines can be kept in ``_corrupt_record`` and never fail the job.  Parquet is the default sink; series are partitioned by
month so date-range reads prune whole folders.
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import normalise_columns, normalise_name
from ..session import scratch_path


CORRUPT = "_corrupt_record"


def _typed(raw: Column, kind: T.DataType, date_format: str) -> Column:
    """A field of a CSV file as its type; NULL where it can't be read."""
    if isinstance(kind, T.StringType):
        return raw
    text = F.trim(raw)
    if isinstance(kind, T.DateType):
        return F.try_to_timestamp(text, F.lit(date_format)).cast("date")
    return text.try_cast(kind)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             date_format: str = "yyyy-MM-dd", keep_corrupt: bool = False, keep_extra: bool = False) -> DataFrame:
    """Header CSV in UTF-8, columns bound by name.

    Header names are normalised (P1: lower case, stripped, BOM dropped, blanks to ``_``), so a raw file with
    "Restaurant ID" in any place fills ``restaurant_id``.  With a ``schema`` the result has its columns: those that the file
    lacks are NULL, others are left out (``keep_extra``: kept behind, as strings).  A field that can't be read as its type is NULL, and so
    are the missing fields of a short row; with ``keep_corrupt`` the column ``_corrupt_record`` holds the raw row then.
    All files of ``path`` have one header; a file with another one raises an error when it is read.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    names = reader.csv(path).columns  # of the first file
    if schema is None:
        return normalise_columns(reader.csv(path))
    strings = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    raw = reader.schema(strings).option("enforceSchema", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path) \
        if keep_corrupt else reader.schema(T.StructType(strings.fields[:-1])).option("enforceSchema", False).csv(path)
    place = {}
    for n in names:
        place.setdefault(normalise_name(n), n)
    column = lambda n: F.col("`" + place[n].replace("`", "``") + "`")
    out = [(_typed(column(f.name), f.dataType, date_format) if f.name in place else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    own = {f.name for f in schema.fields}
    if keep_extra:
        out += [column(n).alias(n) for n in place if n not in own]
    if keep_corrupt:
        lost = F.lit(False)
        for f in schema.fields:
            if f.name in place:
                lost = lost | (column(f.name).isNotNull() & _typed(column(f.name), f.dataType, date_format).isNull())
        row = F.concat_ws(",", *[F.coalesce(column(normalise_name(n)), F.lit("")) for n in names])
        out.append(F.coalesce(F.col(CORRUPT), F.when(lost, row)).alias(CORRUPT))
    return raw.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite, header, ISO dates."""
    df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_series(df: DataFrame, path: str, date_col: str = "date") -> None:
    """Daily series sink: Parquet partitioned by month, rows clustered by entity and date.

    Months are rebalanced, not hashed: a large month is written by several tasks.
    """
    out = df.withColumn("month_partition", F.date_format(date_col, "yyyy-MM"))
    out = out.hint("rebalance", "month_partition").sortWithinPartitions("month_partition", "restaurant_id", date_col)
    out.write.mode("overwrite").partitionBy("month_partition").parquet(path)


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """The table at ``path`` or an empty frame of ``schema`` when it is absent."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return spark.createDataFrame([], schema)
    if fmt == "csv":
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).format(fmt).load(path)


def write_report_text(report: DataFrame, path: str) -> None:
    """One line per report row, ``dataset | check | column: value``."""
    line = F.concat_ws(" | ", F.col("dataset"), F.col("check"),
                       F.concat_ws(": ", F.coalesce(F.col("column"), F.lit("-")), F.col("value").cast("string")))
    report.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def fresh_scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint dir for one job's written table."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def versioned_path(base_dir: str, name: str) -> str:
    """``<dir>/<name>_yyyyMMdd_HHmmss`` for a timestamped model version."""
    return os.path.join(base_dir, f"{name}_{time.strftime('%Y%m%d_%H%M%S')}")


def save_model(model, path: str) -> str:
    """Persist a fitted ``PipelineModel`` (or any ML writable) with overwrite."""
    model.write().overwrite().save(path)
    return path


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
