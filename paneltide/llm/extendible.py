"""Exact deduplication over an extendible-hash index on shared files.

* The directory is made first, from the distinct hashes: it starts with one slot and doubles (one more
  leading hash bit) while a bucket is overfull; only overfull buckets split, so a
  bucket keeps its local depth.  Texts behind one and the same hash can't be split and are chained.
* Owners hold contiguous ranges of buckets.  Map tasks fold the copies that they
  see, so of a group that holds a third of all rows one row a task goes on; what is left goes to the owner of its
  bucket, and there, in its bucket and behind its hash, every text is compared byte by byte with the others of the chain.
* Index files lie in the shared folder, one row per distinct text, by owner, bucket, hash and chain.
* Documents look their entry up by owner, bucket, hash and SHA-256, without moving texts again.

DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import documents, stage

#: Entries a bucket may hold before it splits.
BUCKET_CAPACITY = 4096
#: Bits that a directory is longer than evenly filled buckets need; buckets that are still overfull split further.
SLACK = 6
#: Owners for each shuffle partition: their numbers are dealt by hash, so more owners even it out.
OWNERS = 8


def _hash(text: Column, bits: int) -> Column:
    """The leading ``bits`` of a 64-bit hash, as a non-negative number (fewer bits force collisions in tests)."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - min(bits, 63))


def directory(hashes: DataFrame, bits: int = 63, capacity: int = BUCKET_CAPACITY, max_depth: int | None = None) -> DataFrame:
    """The buckets of the distinct ``hash`` values: ``slot`` and ``depth`` (the hash's leading ``depth`` bits), ``bucket``, ``local_depth``.

    Doubling: at depth d a bucket is a prefix of d bits.  A prefix that holds
    more than ``capacity`` hashes splits, the others stay as they are.  Hashes are counted at a
    depth that evenly filled buckets don't reach, and each doubling sums those counts by a longer prefix; what is
    overfull there is counted again, deeper, up to ``max_depth`` (None: all bits of the hash).
    """
    bits = min(bits, 63)
    last = bits if max_depth is None else min(max_depth, bits)
    depth, done, left = 0, [], hashes
    while True:
        deepest = min(last, depth + SLACK + max(0, math.ceil(math.log2(max(1, left.count()) / capacity))))
        open_slots = stage(left.groupBy(F.shiftrightunsigned("hash", bits - deepest).alias("slot")).agg(F.count("*").alias("n")), "slots")
        while True:
            prefix = F.shiftrightunsigned("slot", deepest - depth)
            sizes = open_slots.groupBy(prefix.alias("prefix")).agg(F.sum("n").alias("held"))
            here = open_slots.withColumn("prefix", prefix).join(sizes, "prefix")
            full = (F.col("held") > capacity) & F.lit(depth < last)
            done.append(here.where(~full).select("slot", F.lit(deepest).alias("depth"), F.col("prefix").alias("bucket"), F.lit(depth).alias("local_depth")))
            open_slots = stage(here.where(full).select("slot", "n"), "slots")
            if open_slots.isEmpty():
                out = done[0]
                for part in done[1:]:
                    out = out.union(part)
                return stage(out, "directory")
            depth += 1
            if depth > deepest:
                break
        left = left.withColumn("slot", F.shiftrightunsigned("hash", bits - deepest)).join(open_slots.select("slot"), "slot", "left_semi").drop("slot")


def place(rows: DataFrame, buckets: DataFrame, bits: int, owners: int) -> DataFrame:
    """``rows`` (with ``hash``) and the ``bucket``, ``local_depth`` and ``owner`` of each."""
    out = None
    for r in buckets.select("depth").distinct().orderBy("depth").collect():  # one length of the directory, more only where hashes crowd
        own = buckets.where(F.col("depth") == r["depth"]).select(F.col("slot").alias("_slot"), "bucket", "local_depth")
        part = rows.withColumn("_slot", F.shiftrightunsigned("hash", bits - r["depth"])).join(own, "_slot").drop("_slot")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.withColumns({"bucket": F.lit(0).cast("long"), "local_depth": F.lit(0)}).where("false")
    # buckets are ranges of the hash; an owner is a range of buckets, by their place in the directory
    share = F.col("bucket").cast("double") / F.pow(F.lit(2.0), F.col("local_depth"))
    return out.withColumn("owner", F.floor(share * owners).cast("int"))


def build_index(docs: DataFrame, bits: int = 63, capacity: int = BUCKET_CAPACITY, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The index table, one row per distinct text: owner, bucket, local_depth, hash, chain, text_sha256, n_bytes, keep_id, group_size; and the directory.

    ``keep_id`` is the largest ``doc_id`` of the group (null only if all are).
    ``chain`` numbers the different texts behind one hash.
    """
    bits = min(bits, 63)
    rows = documents(docs).select("doc_id", "text", _hash(F.col("text"), bits).alias("hash"))
    buckets = directory(rows.select("hash").distinct(), bits, capacity, max_depth)
    owners = _owners(docs)
    # copies are folded where they are read: equal texts of one task only
    folded = rows.groupBy(F.spark_partition_id().alias("task"), "hash", "text").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("task")
    dealt = place(folded, buckets, bits, owners).repartition(F.col("owner"))
    entries = dealt.groupBy("owner", "bucket", "local_depth", "hash", "text").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    chain = F.row_number().over(W.partitionBy("owner", "bucket", "hash").orderBy("text")) - 1
    out = entries.withColumn("chain", chain).select("owner", "bucket", "local_depth", "hash", "chain", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("n_bytes"), "keep_id", "group_size")
    return stage(out, "index"), buckets


def _owners(docs: DataFrame) -> int:
    return OWNERS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def exact_dedup(docs: DataFrame, bits: int = 63, capacity: int = BUCKET_CAPACITY, max_depth: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket, local_depth, chain.

    Texts are equal when their bytes are; null counts as empty.  Of equal
    texts the row with the largest ``doc_id`` stays; rows that repeat that
    id are all marked kept.  A null ``doc_id`` is smaller than any other and
    kept only where its whole group has none.  Empty input: no rows.
    """
    bits = min(bits, 63)
    index, buckets = build_index(docs, bits, capacity, max_depth)
    probes = documents(docs).select("doc_id", _hash(F.col("text"), bits).alias("hash"), F.sha2("text", 256).alias("text_sha256"))
    probes = place(probes, buckets, bits, _owners(docs)).drop("local_depth")
    found = probes.join(index, ["owner", "bucket", "hash", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "local_depth", "chain")
