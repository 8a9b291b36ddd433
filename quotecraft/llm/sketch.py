"""Count-min sketches over blocks of documents, merged by Spark.

Every block of documents makes its own sketch, kept sparse: for each row of
the sketch the sorted slots it hits and how often.  Slots are cut into shards;
the partial sketches of a shard are merged in one group, whose size is set by
the shard and not by any key's frequency (a window held by a third of all
documents costs one entry per block).  Each merged count is sent back to the
blocks that hold the slot, so no task needs the whole sketch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import mix64

#: slots of a shard: at least and at most
SHARD_SLOTS = (1 << 21, 1 << 26)
PARTIAL = "shard int, block int, once binary, more binary, counts binary"
MERGED = "block int, shard int, codes binary"


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned integers as differences in the narrowest type."""
    if not len(a):
        return b""
    d = np.diff(a, prepend=np.zeros(1, dtype=a.dtype)).astype(np.uint64)
    top = int(d.max())
    kind = "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"
    return kind[2].encode() + d.astype(kind).tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, dtype=np.int64)
    return np.cumsum(np.frombuffer(raw, dtype="<u" + chr(raw[0]), offset=1).astype(np.int64))


def scaled(h: np.ndarray, slots: int) -> np.ndarray:
    """``h * slots / 2**64``, rounded down: every slot can be reached, however many there are."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    a, b, c, d = h >> half, h & low, np.uint64(slots >> 32), np.uint64(slots & 0xFFFFFFFF)
    if not c:
        return (a * d + (b * d >> half)) >> half
    ad, bc = a * d, b * c
    middle = (b * d >> half) + (ad & low) + (bc & low)
    return a * c + (ad >> half) + (bc >> half) + (middle >> half)


class Shape:
    """Slots per sketch row and their cut into shards, from the expected entries."""

    def __init__(self, entries: int, depth: int, slots_per_entry: int):
        self.depth = depth
        self.slots = max(1 << 12, entries * slots_per_entry)
        self.shard_slots = int(min(max(SHARD_SLOTS[0], self.slots // 4096), SHARD_SLOTS[1]))
        self.shards = -(-self.slots // self.shard_slots)

    def rows(self, h0: np.ndarray, h1: np.ndarray | None = None) -> list[np.ndarray]:
        """Slot of each entry in each row of the sketch."""
        out = []
        for r in range(self.depth):
            h = h0 if r == 0 else h1 if r == 1 else mix64(h0 + np.uint64(r))
            out.append(scaled(h, self.slots).astype(np.int64))
        return out

    def cuts(self, slots: np.ndarray) -> np.ndarray:
        return np.searchsorted(slots, np.arange(self.shards + 1) * self.shard_slots)

    def partial(self, block: int, r: int, slots: np.ndarray, counts: np.ndarray) -> list[tuple]:
        """Rows of ``PARTIAL`` for the sorted ``slots`` of sketch row ``r``."""
        at, out = self.cuts(slots), []
        for k in range(self.shards):
            a, b = at[k], at[k + 1]
            if a < b:
                s, c = slots[a:b] - k * self.shard_slots, counts[a:b]
                one = c == 1
                out.append((r * self.shards + k, block, pack_sorted(s[one]), pack_sorted(s[~one]),
                            np.minimum(c[~one], 65535).astype("<u2").tobytes()))
        return out

    def codes(self, merged: dict[int, bytes], r: int, slots: np.ndarray) -> np.ndarray:
        """Merged codes of the sorted ``slots`` that this block sent for row ``r``."""
        at = self.cuts(slots)
        parts = [np.frombuffer(merged[r * self.shards + k], dtype=np.uint8)
                 for k in range(self.shards) if at[k] < at[k + 1]]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint8)


def merge_partials(partials: DataFrame, shape: Shape) -> DataFrame:
    """Add up the partial sketches of each shard; per block and shard the code
    of each slot the block sent, in slot order: 1 for a count of one, else
    1 + the number of binary digits of (count - 1), so 2 for two, 3 for 3-4, ..."""
    size = shape.shard_slots

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, dtype=np.uint32)
        for once, more, counts in zip(pdf["once"], pdf["more"], pdf["counts"], strict=True):
            total[unpack_sorted(once)] += np.uint32(1)
            total[unpack_sorted(more)] += np.frombuffer(counts, dtype="<u2").astype(np.uint32)
        code = np.ones(size, dtype=np.uint8)
        step, least = 2, 2
        while True:
            over = total >= least
            if not over.any():
                break
            code[over] = step
            step, least = step + 1, 2 * least - 1
        out = []
        for once, more in zip(pdf["once"], pdf["more"], strict=True):
            out.append(code[np.sort(np.concatenate([unpack_sorted(once), unpack_sorted(more)]))].tobytes())
        return pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "codes": out})

    return partials.groupBy("shard").applyInPandas(merge, MERGED)
