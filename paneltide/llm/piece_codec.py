"""SentencePiece models on the tokenizers library: encoding, decoding and parity.

The model file (a protobuf) is parsed here: pieces, scores and types, trainer
and normaliser settings.  From them a Tokenizer is rebuilt: the normaliser (its
precompiled character map, white-space rules, the metaspace mark and the dummy
prefix), unigram scores or the merges that a BPE vocabulary implies, byte
fallback, and the decoder that undoes them.

Distinct units of text (a run of blanks with what follows, cut also at
characters that no longer piece holds) are encoded once per slice, in
multithreaded batches, and remembered in bounded memory.  Each new unit is also
encoded by the sentencepiece library and decoded again, and the first two units
of a text once more behind the dummy prefix, so parity and the round trip are
verified for every piece of every text.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices
from .unit_cache import UNIT_SLICE, UnitCache, assemble

MARK = "▁"
#: Distinct units whose ids a Python worker remembers; threads of a batch.
CACHE, THREADS = 150_000, 2

#: Fixed values of the model format: piece types, model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class Model(NamedTuple):
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    dummy_prefix: bool
    remove_extra: bool
    escape: bool
    plain: bytes  # the model file without the dummy prefix: units inside a text


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, raw bytes) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        start = at
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at:at + size], at + size
        else:
            raise ValueError(f"not a model file: wire type {wire}")
        yield key >> 3, value, data[start:at]


def _length(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def parse(data: bytes) -> Model:
    """The parts of a serialised model that encoding needs (absent fields: the format's defaults)."""
    pieces, trainer, spec, plain, cut = [], {}, {}, b"", b""
    for number, value, raw in fields(data):
        if number == 1:
            piece = {n: v for n, v, _ in fields(value)}
            pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
        elif number == 2:
            trainer = {n: v for n, v, _ in fields(value)}
        elif number == 3:
            spec = {n: v for n, v, _ in fields(value)}
            cut = b"".join(r for n, _, r in fields(value) if n != 3)
            continue
        plain += raw
    inner = cut + b"\x18\x00"  # add_dummy_prefix: false
    plain += b"\x1a" + _length(len(inner)) + inner
    return Model(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0),
                 spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), plain)


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every way to join two pieces to a third, the best third first."""
    score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER, UNUSED)}
    found = []
    for piece in score:
        for cut in range(1, len(piece)):
            if piece[:cut] in score and piece[cut:] in score:
                found.append((-score[piece], -cut, piece[:cut], piece[cut:]))
    return [(a, b) for _, _, a, b in sorted(found)]


def build(model: Model, prefix: bool | None = None):
    """The Tokenizer of a parsed model; ``prefix`` overrides whether a text gets the dummy prefix."""
    from tokenizers import Tokenizer, decoders, models, normalizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model.pieces), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models")
    prefix = model.dummy_prefix if prefix is None else prefix
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace("  ", " "), ]
    mark = MARK if model.escape else " "
    if prefix:
        steps.append(normalizers.Prepend(mark))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out = Tokenizer(core)
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence(undo + ([decoders.Strip(" ", 1, 0)] if prefix else []))
    return out


def cuts(model: Model) -> tuple[bool, bool]:
    """Whether pieces stop at a mark that follows something else, and whether none longer than one holds a line end."""
    plain = [p for p, _, kind in model.pieces if kind in (NORMAL, USER)]
    return all(MARK not in p.lstrip(MARK) for p in plain), all("\n" not in p for p in plain if len(p) > 1)


class Codec:
    """Cached, verified encoding of string columns; batches of new units are encoded on ``threads`` threads."""

    def __init__(self, path: str, cache: int = CACHE, threads: int = THREADS) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        with open(path, "rb") as f:
            self.model = spec = parse(f.read())
        self.inner, self.whole = build(spec, prefix=False), build(spec)
        self.check = sentencepiece.SentencePieceProcessor(model_proto=spec.plain)
        self.full = sentencepiece.SentencePieceProcessor(model_proto=_with_prefix(spec)) if spec.dummy_prefix else self.check
        blanks, self.lines = cuts(spec)
        # units are taken only where they can't change what a text gives
        self.by_unit = blanks and spec.escape and not spec.charsmap and not spec.remove_extra
        end = "\n" if self.lines else ""
        self.finder = re.compile(f"{end}|{MARK}+[^{MARK}{end}]*|[^{MARK}{end}]+" if end else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.values, self.bad = UnitCache(self._learn, cache), {}

    def _learn(self, units: list[str]) -> list[bytes]:
        """Encode units (marks for blanks); ``bad`` remembers those that sentencepiece encodes otherwise or that don't decode to themselves."""
        texts = [u.replace(MARK, " ") for u in units]
        ids = [x.ids for x in self.inner.encode_batch_fast(texts, add_special_tokens=False)]
        want = self.check.encode(texts, num_threads=1)
        back = self.inner.decode_batch(ids, skip_special_tokens=False)
        if ids == want and back == texts:
            return [array("I", x).tobytes() for x in ids]
        for unit, text, got, right, again in zip(units, texts, ids, want, back, strict=True):
            if got != right or again != text:
                self.bad[unit] = got == right, again == text
        return [array("I", x).tobytes() for x in ids]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, ids of each row, rows where sentencepiece gives the same, rows that decode to their text."""
        text = pc.fill_null(column, "").cast(pa.string())
        return self._units(text) if self.by_unit else self._whole(text.to_pylist())

    def _whole(self, texts: list[str]):
        full = self.full
        got = [x.ids for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        want = full.encode(texts, num_threads=1)
        plain = [full.decode(w) for w in want]
        back = self.whole.decode_batch(got, skip_special_tokens=False)
        flat = np.array([i for x in got for i in x], np.uint32)
        return flat, np.array([len(x) for x in got], np.int64), np.array([a == b for a, b in zip(got, want, strict=True)], bool), np.array([a == b for a, b in zip(back, plain, strict=True)], bool)

    def _split(self, text: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Units of all rows, and how many each row has; an empty text has none."""
        prefix = MARK if self.model.dummy_prefix else ""
        found, n = self._single(text, prefix)
        odd = pc.or_(pc.or_(pc.match_substring(text, "  "), pc.match_substring(text, MARK)), pc.starts_with(text, " "))
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(rows):
            return found, n
        edge, parts, counts, at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64), [], n.astype(np.int64), 0
        for row, t in zip(rows.tolist(), text.take(pa.array(rows)).to_pylist(), strict=True):
            units = self.finder.findall(prefix + t.replace(" ", MARK))
            parts += [found.slice(edge[at], edge[row] - edge[at]), pa.array(units, pa.string())]
            counts[row], at = len(units), row + 1
        return pa.concat_arrays([*parts, found.slice(edge[at])]), counts

    def _single(self, text: pa.Array, prefix: str) -> tuple[pa.Array, np.ndarray]:
        """``_split`` of rows that have no mark, no double blank and no blank in front: each blank starts a unit."""
        marked = pc.replace_substring(text, " ", " " + MARK)
        if self.lines:
            marked = pc.replace_substring(marked, "\n", " \n ")
        marked = pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(prefix, marked, ""))
        split = pc.split_pattern(marked, " ")  # the empty units that this leaves have no ids
        return split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)

    def _units(self, text: pa.Array):
        units, per_row = self._split(text)
        flat, n, names, index = assemble(units, per_row, self.values)
        parity = again = np.ones(len(text), bool)
        if self.model.dummy_prefix:
            parity, again = self._heads(per_row, names, index)
        if self.bad and (seen := [self.bad.get(u, (True, True)) for u in names]):
            edge = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)
            whole = [np.diff(np.concatenate([[0], np.cumsum(~np.array(x, bool)[index])])[edge]) == 0 for x in zip(*seen, strict=True)]
            parity, again = parity & whole[0], again & whole[1]
        return flat, n, parity, again

    def _heads(self, per_row: np.ndarray, names: list[str], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the first two units of each row, as a text, get the same ids from the model with the dummy prefix, and decode to it."""
        start = (np.cumsum(per_row) - per_row).astype(np.int64)
        rows = np.flatnonzero(per_row > 0)
        parity, again = np.ones(len(per_row), bool), np.ones(len(per_row), bool)
        if not len(rows):
            return parity, again
        first = index[start[rows]]
        second = np.where(per_row[rows] > 1, index[np.minimum(start[rows] + 1, len(index) - 1)], -1)
        pairs, place = np.unique(np.stack([first, second]), axis=1, return_inverse=True)
        units = [[names[i] for i in pair if i >= 0] for pair in pairs.T.tolist()]
        held = sorted({u for pair in units for u in pair})
        value = dict(zip(held, self.values(held), strict=True))
        ids = [array("I", b"".join(value[u] for u in pair)).tolist() for pair in units]
        texts = ["".join(pair).replace(MARK, " ").removeprefix(" ") for pair in units]
        want, back = self.full.encode(texts, num_threads=1), self.whole.decode_batch(ids, skip_special_tokens=False)
        place = place.reshape(-1)
        parity[rows] = np.array([a == b for a, b in zip(ids, want, strict=True)], bool)[place]
        again[rows] = np.array([a == b for a, b in zip(back, texts, strict=True)], bool)[place]
        return parity, again


def _with_prefix(model: Model) -> bytes:
    """The model file with the dummy prefix: later fields win in a protobuf."""
    spec = next(v for n, v, _ in fields(model.plain) if n == 3)
    inner = spec + b"\x18\x01"
    return b"".join(r for n, _, r in fields(model.plain) if n != 3) + b"\x1a" + _length(len(inner)) + inner


_CODECS: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for part in slices(batch, limit=UNIT_SLICE):
                flat, n, parity, again = codec(part.column("text"))
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(parity), pa.array(again)], ["doc_id", "ids", "parity", "round_trip"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, parity (the sentencepiece library gives the same), round_trip (the ids decode to the text).

    Null and empty texts have no ids, and are in parity.  Where parity is
    false the row still holds this tokenizer's ids.
    """
    return documents(docs).mapInArrow(_encoder(path), "doc_id long, ids array<int>, parity boolean, round_trip boolean")


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _codec(path).whole
        for batch in batches:
            ids = [x or [] for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(whole.decode_batch(ids, skip_special_tokens=False), pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of ``encoded`` (doc_id, ids); null ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path), "doc_id long, text string")


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for part in slices(batch, limit=UNIT_SLICE):
                flat, n, parity, again = codec(part.column("text"))
                raw, stop = memoryview(flat.astype("<u4").tobytes()), np.cumsum(n)
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((stop - n).tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(crc, pa.int64()), pa.array(parity), pa.array(again)], ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"])

    return run


def digest(docs: DataFrame, path: str) -> DataFrame:
    """``encode`` with the ids reduced in the task: doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), parity, round_trip."""
    return documents(docs).mapInArrow(_digest(path), "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")
