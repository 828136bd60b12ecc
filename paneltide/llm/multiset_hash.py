"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph (line of the text) is hashed to a wide vector; a document's
fingerprint is the lane-wise sum, each lane modulo a power of two.  Sums don't
depend on order, and inserting or deleting a paragraph adds or subtracts its
vector.  The vector has two parts:

* ``EXACT`` lanes modulo 2^32, filled from four independent 64-bit hashes of every paragraph: equality
  (256 bits), and a count of sentences.
* ``LANES`` lanes modulo 2^16: every sentence adds or takes one in the lane that
  its hash names.  In the difference of two fingerprints the sentences of both
  texts cancel.  If few lanes differ, each holds one sentence, and the absolute values
  add up to the number of differing sentences; if many do, the squares
  do (in expectation), with a standard error of sqrt(2 / LANES), 6% of that number.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keyed, range_bounds, range_bucket

EXACT, LANES = 8, 512
#: Lanes are filled in groups of so many, which saves comparing every sentence with every lane.
GROUPS = 16
_M16, _M32 = (1 << 16) - 1, (1 << 32) - 1


def _sum(values: Column, mask: int) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: (a + x).bitwiseAND(F.lit(mask)))


def _seeded(seed: int):
    return lambda paragraph: F.xxhash64(F.lit(seed), paragraph)


def _lanes(hashes: str) -> Column:
    """LANES sums of the signed sentences: first dealt to groups, then to the lanes of each group."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.filter(hashes, lambda h: h.bitwiseAND(F.lit(GROUPS - 1)) == g))
    rest = LANES // GROUPS
    lane = lambda h: F.shiftrightunsigned(h, 8).bitwiseAND(F.lit(rest - 1))
    step = lambda a, h: (a + F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(1)) * F.lit(2) - F.lit(1)).bitwiseAND(F.lit(_M16))
    each = F.transform(groups, lambda own: F.when(F.size(own) == 0, F.array_repeat(F.lit(0).cast("long"), rest)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(rest - 1)), lambda k: F.aggregate(own, F.lit(0).cast("long"), lambda a, h: F.when(lane(h) == k, step(a, h)).otherwise(a)))))
    return F.flatten(each)


def vector(df: DataFrame, text: str, name: str) -> DataFrame:
    """Append ``name``, array<long>: EXACT lanes, the sentence count, then LANES lanes.

    An empty text has no paragraph: the zero vector.
    """
    lines = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(F.col(text), "\n"))
    pieces = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(F.col(text), r"(?<=[.!?]) |\n"))
    out = df.withColumn("_p", lines).withColumn("_s", F.transform(pieces, lambda p: F.xxhash64(p)))
    exact = []
    for i in range(EXACT // 2):  # each 64-bit hash of the paragraph fills two lanes
        out = out.withColumn(f"_x{i}", F.transform("_p", _seeded(i)))
        exact += [_sum(F.transform(f"_x{i}", lambda h: h.bitwiseAND(F.lit(_M32))), _M32),
                  _sum(F.transform(f"_x{i}", lambda h: F.shiftrightunsigned(h, 32)), _M32)]
    head = F.array(*exact, F.size("_s").cast("long"))
    return out.withColumn(name, F.concat(head, _lanes("_s"))).drop("_p", "_s", *[f"_x{i}" for i in range(EXACT // 2)])


def _masks() -> Column:
    return F.array(*[F.lit(m) for m in [_M32] * (EXACT + 1) + [_M16] * LANES])


def insert(fingerprint: Column, part: Column) -> Column:
    """The vector after adding the paragraphs of ``part``."""
    return F.zip_with(F.arrays_zip(fingerprint.alias("x"), part.alias("y")), _masks(), lambda p, m: (p["x"] + p["y"]).bitwiseAND(m))


def delete(fingerprint: Column, part: Column) -> Column:
    """The vector after taking the paragraphs of ``part`` away."""
    return F.zip_with(F.arrays_zip(fingerprint.alias("x"), part.alias("y")), _masks(), lambda p, m: (p["x"] + m + F.lit(1) - p["y"]).bitwiseAND(m))


def to_hex(v: Column) -> Column:
    """EXACT lanes and the count of 8 hex digits, the others of 4."""
    head = F.transform(F.slice(v, 1, EXACT + 1), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    tail = F.transform(F.slice(v, EXACT + 2, LANES), lambda x: F.lpad(F.lower(F.hex(x)), 4, "0"))
    return F.concat(F.array_join(head, ""), F.array_join(tail, ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated overlap of two fingerprints' sentences, in both to in either (1 exactly if they are equal).

    With n sentences in both texts and d in only one of the two it is (n - d) / (n + d).  d comes from the lanes'
    differences: their absolute values where at most a quarter of the lanes differ (nearly exact, repeated
    sentences count as often as they differ), else their squares (standard error 6% of d; a sentence that one text repeats m times
    more often counts m^2).
    """
    total = (F.get(a, F.lit(EXACT)) + F.get(b, F.lit(EXACT))).cast("double")
    least = F.abs(F.get(a, F.lit(EXACT)) - F.get(b, F.lit(EXACT))).cast("double")
    each = F.zip_with(F.slice(a, EXACT + 2, LANES), F.slice(b, EXACT + 2, LANES), lambda x, y: (x - y + F.lit(3 << 15)).bitwiseAND(F.lit(_M16)) - F.lit(1 << 15))
    add = lambda of: lambda apart: F.aggregate(apart, F.lit(0).cast("long"), lambda s, x: s + of(x))
    full = F.lit(float(LANES))
    few = lambda x: add(F.abs)(x) * F.log(full / (full - F.size(x))) * full / F.size(x)
    differing = lambda x: F.when(F.size(x) == 0, F.lit(0.0)).when(F.size(x) * 4 <= LANES, few(x)).otherwise(add(lambda v: v * v)(x).cast("double"))
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  a lambda's variable is worked out once, however often it is used
    d = F.least(total, F.greatest(once(F.filter(each, lambda x: x != 0), differing), least))
    share = once(d, lambda d: (total - d) / (total + d))
    return F.when(a == b, F.lit(1.0)).otherwise(F.when(total == 0, F.lit(0.0)).otherwise(share))


def next_links(rows: DataFrame, parts: int) -> DataFrame:
    """``next_id``, ``next_key`` of every distinct row of ``rows`` (row_id, text_key, known, n_chars), in ascending order; after the last, the first.

    Only ids move.  Rows go to contiguous ranges of ``row_id``; a table of one
    row per range says where the last row of each goes on.
    """
    bounds = range_bounds(rows, "row_id", parts)
    ranged = rows.distinct().withColumn("_range", range_bucket(F.col("row_id"), bounds))
    after = F.lead(F.struct("row_id", "text_key")).over(W.partitionBy("_range").orderBy("row_id", "text_key"))
    firsts = ranged.groupBy("_range").agg(F.min(F.struct("row_id", "text_key")).alias("_first"))
    ring = W.orderBy("_range")  # at most `parts` rows
    follow = firsts.select("_range", F.coalesce(F.lead("_first").over(ring), F.first("_first").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_follow"))
    out = ranged.withColumn("_after", after).join(F.broadcast(follow), "_range")
    out = out.withColumn("_next", F.coalesce("_after", "_follow"))
    return out.select("row_id", "text_key", "known", "n_chars", F.col("_next.row_id").alias("next_id"), F.col("_next.text_key").alias("next_key"))


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by
    the first as many (or all) of the next document in ascending ``doc_id``
    (null: with 0; ties by the text's hash; after the last the first; a lone
    document follows itself).  Rows that repeat id and text are one document
    here and get the same result.  Null text counts as empty.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs)
    links = next_links(rows.select("row_id", "text_key", F.col("doc_id").isNotNull().alias("known"), F.length("text").alias("n_chars")), parts)
    rows = rows.select("row_id", "text_key", "text")  # the same columns in both joins: texts are shuffled once
    share = F.floor(F.col("n_chars") / 4).cast("int")
    # to each document, from the next one: the piece that goes into its edited text, and the fingerprint
    givers = links.select(F.col("next_id").alias("row_id"), F.col("next_key").alias("text_key"), F.col("row_id").alias("to_id"), F.col("text_key").alias("to_key"), "known", share.alias("take"))
    given = vector(rows.join(givers, ["row_id", "text_key"]), "text", "next_vector")
    given = (given.select(F.col("to_id").alias("row_id"), F.col("to_key").alias("text_key"), F.substring("text", F.lit(1), F.col("take")).alias("piece"), "next_vector", "known")
             .groupBy("row_id", "text_key", "known").agg(F.first("piece").alias("piece"), F.first("next_vector").alias("next_vector")))
    out = rows.join(given, ["row_id", "text_key"]).withColumn("n_chars", F.length("text"))
    out = out.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - share), "piece"))
    out = vector(vector(out, "text", "v"), "edited", "e")
    return out.select(F.when(F.col("known"), F.col("row_id")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), to_hex(F.col("v")).alias("fingerprint"), to_hex(F.col("e")).alias("edited_fingerprint"),
                      likeness(F.col("v"), F.col("e")).alias("near_edited"), likeness(F.col("v"), F.col("next_vector")).alias("near_next"))
