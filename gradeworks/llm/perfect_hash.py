"""A minimal perfect hash over 128-bit words, with arrays of what belongs to each word.

Level by level every word not yet placed is hashed into a bit array of ``GAMMA`` bits a word; words that are alone on
their bit are placed, the others go to the next level. The slot of a word is the rank of its bit over all levels, so
the slots of n words are exactly 0 .. n-1. A word that is not in the set may reach a slot too; the fingerprint
stored there, the word's second half, tells it apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

GAMMA = 2
_ONE = np.uint64(1)

#: One row is one shard.
SHARD_TYPES = "shard long, sizes binary, bits binary, fingerprints binary, docs binary, keepers binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of each word (a row of two unsigned longs) in the bit array of a level."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (_mixed(words[:, 0] + _mixed(words[:, 1] ^ salt)) % np.uint64(size)).astype("int64")


class PerfectHash:
    """Bit arrays of the levels one after another, in 64-bit words, and the ranks at the words' starts."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        ones = np.bitwise_count(bits).astype("int64")
        self.ranks = np.cumsum(ones) - ones
        self.count = int(ones.sum())

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        """The perfect hash of distinct ``words``."""
        sizes, arrays = [], []
        left = words
        while len(left):
            size = -(-GAMMA * len(left) // 64) * 64
            places = _places(left, len(sizes), size)
            here = np.bincount(places, minlength=size)
            arrays.append(np.packbits(here == 1, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[here[places] > 1]
        return cls(np.array(sizes, "int64"), np.concatenate(arrays) if arrays else np.empty(0, "<u8"))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slot of each word, -1 where no level has its bit."""
        found = np.full(len(words), -1, "int64")
        open_, base = np.arange(len(words)), 0
        for level, size in enumerate(self.sizes.tolist()):
            places = base + _places(words[open_], level, size)
            word, bit = places >> 6, (places & 63).astype("uint64")
            set_ = (self.bits[word] >> bit) & _ONE == _ONE
            below = np.bitwise_count(self.bits[word] & ((_ONE << bit) - _ONE))
            found[open_[set_]] = (self.ranks[word] + below)[set_]
            open_ = open_[~set_]
            base += size
        return found


def _narrow(values: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    width = next(w for w in (1, 2, 4, 8) if values.max(initial=0) < 1 << (8 * w - 1))
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


class Shard:
    """Fingerprint, number of documents and keeper of each slot of one perfect hash."""

    def __init__(self, row: dict) -> None:
        self.hash = PerfectHash(np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["bits"], "<u8"))
        self.fingerprints = np.frombuffer(row["fingerprints"], "<u8")
        self.docs = np.frombuffer(row["docs"], f"<i{row['docs'][0]}", offset=1)
        self.keepers = np.frombuffer(row["keepers"], "<i8")

    def probe(self, words: np.ndarray) -> np.ndarray:
        """Slot of each word that is in the set, -1 for others."""
        slots = self.hash.slots(words)
        slots[slots >= 0] = np.where(self.fingerprints[slots[slots >= 0]] == words[slots >= 0, 1], slots[slots >= 0], -1)
        return slots


def shard_row(table: pa.Table) -> pa.Table:
    """One shard from the rows (shard, h0, h1, docs, keeper) of its distinct words."""
    words = np.stack([table.column(c).to_numpy().view("uint64") for c in ("h0", "h1")], axis=1)
    made = PerfectHash.build(words)
    slots = made.slots(words)
    fingerprints, docs, keepers = np.empty(len(words), "<u8"), np.empty(len(words), "int64"), np.empty(len(words), "<i8")
    fingerprints[slots], docs[slots], keepers[slots] = words[:, 1], table.column("docs").to_numpy(), table.column("keeper").to_numpy()
    row = {"shard": table.column("shard")[0].as_py(), "sizes": made.sizes.astype("<i8").tobytes(), "bits": made.bits.tobytes(),
           "fingerprints": fingerprints.tobytes(), "docs": _narrow(docs), "keepers": keepers.tobytes()}
    kinds = [pa.int64()] + [pa.binary()] * 5
    return pa.table({name: pa.array([value], kind) for (name, value), kind in zip(row.items(), kinds, strict=True)})
