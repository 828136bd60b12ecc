"""Helpers shared by the training-data operators.

Row identity: ``doc_id`` may be null or repeat, so operators that bring a
decision back to a document join on ``(row_id, text_key)``: the id (null: 0)
and a 64-bit hash of the text and of whether the id is null.  Neither is null,
so plain equality joins them.  Rows that repeat both are the same document and
share their decisions.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that Python works on at once; longer texts are taken alone.
SLICE_BYTES = 1 << 20
#: Words of the contracts: runs without the six ASCII white-space characters.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only in local mode where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors.

    The job's shuffle files go when the table is written; nothing reads them again.
    """
    spark = df.sparkSession
    path, before = stage_path(spark, label), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Take tables of ``stage`` off the shared folder; nothing may read them, or what is built on them, any more."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(conf).delete(path, True)


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``extra`` columns; any other column is dropped."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """``documents`` with ``row_id`` and ``text_key`` in front."""
    return documents(docs, *extra).select(F.coalesce("doc_id", F.lit(0)).alias("row_id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("text_key"), "*")


def with_keys(docs: DataFrame) -> DataFrame:
    """``own`` (a struct of all columns of ``docs``, whatever their names), ``row_id`` and ``text_key`` as in ``keyed``."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*columns).alias("own"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("row_id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("text_key"))


def own_columns(docs: DataFrame, changed: dict[str, Column]) -> list[Column]:
    """The columns of ``docs`` out of ``own``, those in ``changed`` replaced, in their order and of their types."""
    return [changed[f.name].cast(f.dataType).alias(f.name) if f.name in changed else F.col("own").getField(f.name).alias(f.name) for f in docs.schema.fields]


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending cut points of an integer column (approximate quantiles)."""
    if parts < 2:
        return []
    cuts = df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.25 / parts)
    return sorted({int(x) for x in cuts})


def range_bucket(value: Column, bounds: list[int]) -> Column:
    """How many of ``bounds`` are <= ``value`` (null: 0), by binary search over the literal array."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    cuts = F.array(*[F.lit(x).cast("long") for x in bounds])
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda low, step: F.when(
        F.coalesce(F.get(cuts, low + step - F.lit(1)) <= value, F.lit(False)), low + step).otherwise(low)), F.lit(0))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(size, (size[row - 1] if row else 0) + limit, "right"))
        end = max(row + 1, end)
        yield batch.slice(row, end - row)
        row = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows (null: empty)."""
    col = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


# ---- words and rolling hashes, for a slice of documents at once

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"] = np.cumprod(np.full(n, _BASE))
        _POWERS["down"] = np.cumprod(np.full(n, _INVERSE))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the n + 1 offsets of each document's words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~first[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes, in chunks of whole words."""
    out = np.empty(len(starts), np.uint64)
    row = 0
    while row < len(starts):
        base = int(starts[row])
        end = max(row + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        part = data[base:ends[end - 1]]
        if lower:
            part = _LOWER[part]
        up, down = _powers(len(part))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[part] * up)])
        a, b = starts[row:end] - base, ends[row:end] - base
        out[row:end] = mix((total[b] - total[a]) * down[a])
        row = end
    return out


def rolling(words: np.ndarray, n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Rabin-Karp hash (modulo 2^64, odd base) of every run of ``n`` consecutive values, by doubling."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out, done, block, width = None, 0, words, 1
    while True:
        if n & width:  # append a block of this width to what is there
            if out is None:
                out = block
            else:
                factor = np.uint64(pow(base, width, 1 << 64))
                m = len(block) - done
                out = out[:m] * factor + block[done:done + m]
            done += width
        if width * 2 > n:
            return out[:len(words) - n + 1]
        factor = np.uint64(pow(base, width, 1 << 64))
        block = block[:-width] * factor + block[width:]
        width *= 2


def per_document(values: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """Which window starts lie whole inside one document."""
    n = np.diff(offsets)
    left = np.repeat(offsets[1:], n)[:len(values)] - np.arange(len(values))
    return left >= window


def sliding(op, x: np.ndarray, n: int) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over every run of ``n`` values, by doubling."""
    width = 1
    size = len(x) - n + 1
    while width * 2 <= n:
        x = op(x[:-width], x[width:])
        width *= 2
    return op(x[:size], x[n - width:n - width + size])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
