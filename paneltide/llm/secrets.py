"""Secret scans with corpus-wide ownership frequency.

Each text is scanned once (Arrow batches, compiled patterns).  Every candidate
value is reduced to a hash; Spark counts the distinct repositories and owners
that hold each hash.  Values that several owners share are widely copied
examples; values of one owner that look random are reported as live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, own_columns, slices, stage, with_keys

#: Fixed patterns of the base kinds, in the order that breaks ties between spans.
BASE = {
    "assign": re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),  # maximal runs, so the same spans as runs of any length with the short ones dropped
}
#: Further kinds that this operator adds.
EXTRA = {
    "hosted": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "chat": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"),
}
KINDS = [*BASE, *EXTRA]
#: Parts of values that stand in examples and templates.
PLACEHOLDERS = re.compile(r"example|sample|changeme|placeholder|your[-_]|dummy|xxxx|<|test", re.I)
#: A value of this many distinct owners is a copied example.
COPIED_OWNERS = 3
#: Bits a character from which a value counts as random.
LIVE_BITS = 3.0

_CUES = re.compile(r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
FINDING = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("value", pa.string()), ("random", pa.bool_())])


def entropy(value: str) -> float:
    """Bits a character of the value's own character counts."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def find(text: str) -> list[tuple[str, int, int, int, str]]:
    """(kind, start, end, start of the value, value) of one text, by start, then kind; offsets in code points, end exclusive."""
    out = []
    if _CUES.search(text):
        out += [("assign", m.start(), m.end(), m.start(2), m[2]) for m in BASE["assign"].finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), m[0]) for m in BASE["access"].finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), m.start(), m[0]) for m in BASE["hex"].finditer(text)]
    for kind, cue in (("hosted", "gh"), ("chat", "xox"), ("jwt", "eyJ"), ("pem", "-----BEGIN")):
        if cue in text:
            out += [(kind, m.start(), m.end(), m.start(), m[0]) for m in EXTRA[kind].finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _joined(found: list) -> str:
    return ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = [find(t) for t in part.column("text").to_pylist()]
            base = [[x for x in f if x[0] in BASE] for f in found]
            rows = [[{"kind": k, "start": a, "end": b, "value_start": s, "value": hashlib.sha256(v.encode()).hexdigest(), "random": entropy(v) >= LIVE_BITS and not PLACEHOLDERS.search(v)} for k, a, b, s, v in f] for f in found]
            counts = [pa.array([sum(x[0] == k for x in f) for f in base], pa.int64()) for k in BASE]
            digest = pa.array([hashlib.sha256(_joined(f).encode()).hexdigest() for f in base], pa.string())
            keep = [part.column(c) for c in ("row_id", "text_key", "doc_id", "repo", "owner")]
            yield pa.RecordBatch.from_arrays([*keep, *counts, digest, pa.array([_joined(f) for f in found], pa.string()), pa.array(rows, pa.list_(FINDING))],
                                             ["row_id", "text_key", "doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "findings"])


def scan(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per document with its spans and findings (values as sha256), kept in the shared folder; null text: no span."""
    rows = keyed(docs, F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"))
    schema = ("row_id long, text_key long, doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
              "findings array<struct<kind:string,start:int,end:int,value_start:int,value:string,random:boolean>>")
    return stage(rows.mapInArrow(_scan, schema), "scan")


def ownership(scanned: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row per candidate value: value, n_repos, n_owners, random, verdict.

    verdict: ``copied`` (held by ``copied_owners`` owners or more), ``live``
    (one owner, looks random) or ``unsure``.  A null repository or owner isn't
    counted; a value without any owner counts as one owner's.  Each count is
    taken over distinct (value, holder) pairs, folded in the map tasks, so a
    value that everybody copies isn't gathered anywhere.
    """
    held = scanned.where(F.size("findings") > 0).select("repo", "owner", F.explode("findings").alias("f")).select("repo", "owner", F.col("f.value").alias("value"), F.col("f.random").alias("random"))
    owners = held.groupBy("value", "owner").agg(F.max("random").alias("random")).groupBy("value").agg(F.count("owner").alias("n_owners"), F.max("random").alias("random"))
    repos = held.groupBy("value", "repo").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("repo").alias("n_repos"))
    verdict = F.when(F.col("n_owners") >= copied_owners, "copied").when((F.col("n_owners") <= 1) & F.col("random"), "live").otherwise("unsure")
    return owners.join(repos, "value").select("value", "n_repos", "n_owners", "random", verdict.alias("verdict"))


def findings(scanned: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per finding: row_id, text_key, doc_id, owner, kind, start, end, value_start, value, n_repos, n_owners, verdict."""
    rows = scanned.where(F.size("findings") > 0).select("row_id", "text_key", "doc_id", "owner", F.explode("findings").alias("f")).select("row_id", "text_key", "doc_id", "owner", "f.*").drop("random")
    return rows.join(verdicts.drop("random"), "value")


def secret_scan(docs: DataFrame, repo: str = "doc_id", owner: str = "source", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    Null and empty texts have no span (the sha256 of nothing).  Rows that
    repeat id and text are one repository.  Empty input: no rows.
    """
    scanned = scan(docs, repo, owner)
    found = findings(scanned, ownership(scanned, copied_owners))
    per_doc = (found.select("row_id", "text_key", "kind", "start", "end", "verdict").distinct().groupBy("row_id", "text_key")
               .agg(F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if(F.col("verdict") == "copied").alias("n_copied")))
    out = scanned.drop("findings", "repo", "owner").join(per_doc, ["row_id", "text_key"], "left")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_copied")])


def _blank(text: Column, spans: Column) -> Column:
    """``text`` with each (start, end, kind) of ``spans``, from the last to the first, replaced by ``[kind]``."""
    return F.aggregate(F.reverse(F.array_sort(spans)), text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit("["), s["kind"], F.lit("]"), F.substring(t, s["end"] + F.lit(1), F.length(t))))


def redact(docs: DataFrame, repo: str = "doc_id", owner: str = "source", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """``docs`` with the live-looking values of single owners replaced by ``[kind]``; copied examples stay.

    Every row stays; ``n_chars``, where there is one, is counted anew in
    changed rows.  Of overlapping findings the first, then the longest, is
    replaced.
    """
    scanned = scan(docs, repo, owner)
    live = findings(scanned, ownership(scanned, copied_owners)).where("verdict = 'live'")
    spans = (live.select("row_id", "text_key", F.struct(F.col("value_start").alias("start"), F.col("end"), "kind").alias("s")).distinct()
             .groupBy("row_id", "text_key").agg(F.array_sort(F.collect_list("s")).alias("_found")))
    # first of overlapping ones: fold left to right, taking a span only where the last taken one has ended
    free = F.aggregate("_found", F.array().cast("array<struct<start:int,end:int,kind:string>>"), lambda kept, s: F.when(F.coalesce(F.try_element_at(kept, F.lit(-1))["end"] <= s["start"], F.lit(True)), F.concat(kept, F.array(s))).otherwise(kept))
    spans = spans.select("row_id", "text_key", free.alias("_spans"))
    out = with_keys(docs).join(spans, ["row_id", "text_key"], "left")
    hit, text = F.col("_spans").isNotNull(), F.col("own").getField("text")
    out = out.withColumn("blanked", F.when(hit, _blank(text, F.col("_spans"))).otherwise(text))
    changed = {"text": F.col("blanked")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length("blanked")).otherwise(F.col("own").getField("n_chars"))
    return out.select(*own_columns(docs, changed))
