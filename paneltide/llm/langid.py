"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter serves all languages: a table of slots, each a bitmask with one bit
per language.  An n-gram sets its language's bit in HASHES slots; the AND of
its slots gives all languages that hold the n-gram in one lookup.  A document
counts, per language, the n-grams whose mask has its bit, takes off the hits
that the filter's fill makes by chance, and goes to the largest count.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import mix, slices

GRAM = 4
#: Bits of the slot number; slots of the filter are 2^SLOT_BITS masks.
SLOT_BITS, HASHES = 19, 2
#: Bounds of what is learned of a language: documents (chosen by hash of id and text) and n-grams.  All languages are learned.
SAMPLE, GRAMS = 4000, 20_000
#: An n-gram belongs to a language if it is at least this share as frequent there as where it is most frequent.
SHARE = 0.1
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def grams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased letters (runs of others are one blank), the document of each, and letters per document."""
    lower = [f" {(t or '').lower()}  " for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(lower)), [len(t) for t in lower])
    letter = _letters()[points]
    n_letters = np.bincount(doc[letter], minlength=len(lower))
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    keep = letter | np.concatenate([[True], letter[:-1]]) | first
    last = np.concatenate([doc[1:] != doc[:-1], [True]])
    keep |= last  # a one-letter document still has an n-gram
    chars, doc, letter = np.where(letter, points, 32)[keep].astype(np.uint64), doc[keep], letter[keep]
    if len(chars) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n_letters
    m = len(chars) - GRAM + 1
    value = np.zeros(m, np.uint64)
    some = np.zeros(m, bool)
    for k in range(GRAM):  # code points have 21 bits; four of them are folded into 64
        value = value * np.uint64(0x100000001B3) ^ chars[k:k + m]
        some |= letter[k:k + m]
    whole = (doc[:m] == doc[GRAM - 1:]) & some
    return mix(value[whole]), doc[:m][whole], n_letters


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            lang = part.column("lang").to_pylist()
            value, doc, _ = grams(part.column("text").to_pylist())
            names = sorted(set(lang))
            of = np.searchsorted(names, lang)[doc] if names else doc
            for i, name in enumerate(names):
                u, n = np.unique(value[of == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


class Filter:
    """Masks of all slots, names of the languages (bit i of word i // 64: language i), chance of a false hit per language."""

    def __init__(self, languages: Sequence[str], held: Sequence[tuple[int, int]], slot_bits: int = SLOT_BITS) -> None:
        self.languages, self.slot_bits = list(languages), slot_bits
        self.masks = np.zeros((max(1, -(-len(self.languages) // 64)), 1 << slot_bits), np.uint64)
        if held:
            index = np.array([i for i, _ in held], np.int64)
            value = np.array([g for _, g in held], np.int64).view(np.uint64)
            for slot in self._slots(value):
                np.bitwise_or.at(self.masks, (index // 64, slot), np.uint64(1) << (index % 64).astype(np.uint64))
        fill = [np.mean(self.masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(self.languages))]
        self.false = np.array([f ** HASHES for f in fill])

    def _slots(self, value: np.ndarray) -> list[np.ndarray]:
        step = 64 // HASHES
        return [((value >> np.uint64(step * k)) & np.uint64((1 << self.slot_bits) - 1)).astype(np.int64) for k in range(HASHES)]

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the corrected share of its n-grams that the language holds.

        ``und`` and 0 for a null text or one without letters; where no
        language has a hit, the most frequent one and 0.
        """
        value, doc, letters = grams(texts)
        total = np.bincount(doc, minlength=len(texts))
        found = None
        slots = self._slots(value)
        share = np.zeros((len(self.languages), len(texts)))
        for w in range(len(self.masks)):
            found = self.masks[w][slots[0]]
            for slot in slots[1:]:
                found &= self.masks[w][slot]
            for i in range(64 * w, min(len(self.languages), 64 * w + 64)):
                hits = np.bincount(doc, weights=found >> np.uint64(i % 64) & np.uint64(1), minlength=len(texts))
                share[i] = np.clip((hits - total * self.false[i]) / np.maximum(total, 1) / max(1e-9, 1 - self.false[i]), 0, 1)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = share.argmax(0)
        known = letters > 0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, share.max(0), 0.0)


def fit(labelled: DataFrame, sample: int = SAMPLE, n_grams: int = GRAMS) -> Filter:
    """Learn from ``labelled`` (doc_id, text, lang; null texts and languages are left out).

    What reaches the driver is one count and at most ``n_grams`` n-grams of each language, counted in Spark over about
    ``sample`` documents a language, chosen by hash of their id and text.
    """
    known = labelled.where("text is not null and lang is not null").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").cast("string").alias("lang"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    names = [r["lang"] for r in counts]
    if not names:
        return Filter([], [])
    rate = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1_000_000, -(-sample * 1_000_000 // r["count"]))))])
    chosen = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < F.try_element_at(rate, "lang"))
    counted = chosen.select("lang", "text").mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("lang"))
    top = counted.withColumn("share", share).withColumn("most", F.max("share").over(W.partitionBy("gram"))).where(F.col("share") >= SHARE * F.col("most"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    held = top.withColumn("rank", rank).where(F.col("rank") <= n_grams).select("lang", "gram").collect()
    at = {name: i for i, name in enumerate(names)}
    return Filter(names, [(at[r["lang"]], r["gram"]) for r in held])


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score``, from ``text`` alone (columns of these names are replaced)."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters of fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lang, score = held.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema.fields)
    return docs.select(*own).mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Documents that are not learned from: crc32 of the id as text leaves 1 modulo 3 (a null id: learned from)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
