"""Token ids of repeated units of text: a bounded memory, and the assembly of documents from units."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut into units at once: longer slices repeat more units.
UNIT_SLICE = 4 << 20


class UnitCache:
    """Values of units in two generations of at most ``limit`` each: units in use survive when the older half is dropped."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], limit: int) -> None:
        self.learn, self.limit = learn, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, units: list[str]) -> list[bytes]:
        """The value of each of these different units; those not held are learned in one batch."""
        young, old = self.young, self.old
        out = [young.get(u) for u in units]
        for i, x in enumerate(out):
            if x is None and (found := old.get(units[i])) is not None:
                out[i] = young[units[i]] = found
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            for i, x in zip(missing, self.learn([units[i] for i in missing]), strict=True):
                out[i] = young[units[i]] = x
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out


def assemble(units: pa.Array, per_row: np.ndarray, values: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Flat ids and ids of each row, from the units of all rows in order and how many each row has; also the different units and their places."""
    words = units.dictionary_encode()
    names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    parts = values(names)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    pool = np.frombuffer(b"".join(parts), np.uint32)
    first = np.cumsum(size) - size
    index = words.indices.to_numpy(zero_copy_only=False)
    n = size[index]
    stop = np.cumsum(n)
    flat = pool[np.repeat(first[index] - stop + n, n) + np.arange(int(n.sum()))]
    bounds = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)]
    return flat, np.diff(bounds), names, index
