"""Blocks of documents that ask shards of a key space for corpus-wide figures.

``stored_blocks`` turns documents into one row per block (some megabytes of
consecutive texts) without a shuffle.  A block sends its distinct 64-bit keys,
sorted, with integer columns: one row per shard that it meets (:meth:`Shards.send`).
A shard is a range of hashed keys, so its size does not depend on any key's
frequency: a key that every document holds costs one entry per block.
:func:`merge_shards` adds the columns up per key and sends the sums back to the
blocks, in the order of the keys they sent.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _A, mix64, store
from .sketch import pack_sorted

#: bytes of text that a block aims at
BLOCK_BYTES = 6 << 20
#: entries that a shard aims at
SHARD_ENTRIES = 1 << 20

MESSAGE = "shard int, block bigint, high binary, low binary, cols binary"
ANSWER = "block bigint, shard int, own binary, cols binary, stats array<bigint>"
_KINDS = ("<u1", "<u2", "<u4", "<u8")

_M1 = np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
_M2 = np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))


def squeeze(raw: bytes) -> bytes:
    """``raw`` compressed (entropy coding: frequent small numbers have no repeats for a plain matcher)."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def unsqueeze(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True) if raw else b""


def unmix64(h: np.ndarray) -> np.ndarray:
    """Inverse of ``mix64``."""
    h = (h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))) * _M2
    h = (h ^ (h >> np.uint64(27)) ^ (h >> np.uint64(54))) * _M1
    return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


# ---------------------------------------------------------------- integers as bytes

def pack_columns(cols: list[np.ndarray]) -> bytes:
    """Unsigned integer columns of one length, each in its narrowest type."""
    out = []
    for c in cols:
        top = int(c.max()) if len(c) else 0
        kind = _KINDS[0 if top < 1 << 8 else 1 if top < 1 << 16 else 2 if top < 1 << 32 else 3]
        out.append(kind[2].encode() + c.astype(kind).tobytes())
    return b"".join(out)


def unpack_columns(raw: bytes, n_cols: int, rows: int | list[int]) -> list[np.ndarray]:
    """``n_cols`` columns of ``rows`` entries (a list: of each column)."""
    out, at = [], 0
    for n in [rows] * n_cols if isinstance(rows, int) else rows:
        kind = "<u" + chr(raw[at])
        out.append(np.frombuffer(raw, dtype=kind, count=n, offset=at + 1))
        at += 1 + n * int(kind[2])
    return out


def _sorted_part(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, dtype=np.uint64)
    return np.cumsum(np.frombuffer(raw, dtype="<u" + chr(raw[0]), offset=1).astype(np.uint64), dtype=np.uint64)


def keys_of(high: bytes, low: bytes) -> np.ndarray:
    """Keys of one message, without the bits that name its shard."""
    return (_sorted_part(unsqueeze(high)) << np.uint64(24)) | from_three_bytes(np.frombuffer(low, dtype=np.uint8))


def three_bytes(a: np.ndarray) -> np.ndarray:
    """The lowest 24 bits of each integer, one after another: they have no pattern to compress."""
    return a.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].ravel()


def from_three_bytes(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 3, 8), dtype=np.uint8)
    out[:, :3] = raw.reshape(-1, 3)
    return out.ravel().view("<u8")


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct ``keys``, a place of each, and which of them each place holds."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    which = np.empty(len(keys), dtype=np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return ordered[first], order[first], which


# ---------------------------------------------------------------- blocks

def table_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def table_of(raw: bytes) -> pa.Table:
    """The documents of a block of :func:`stored_blocks`."""
    return pa.ipc.open_stream(unsqueeze(raw)).read_all()


def stored_blocks(docs: DataFrame, columns: dict, text_col: str, encode: Callable[[pa.Table], dict],
                  binaries: list[str], counts: list[str], name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of ``docs``: ``block``, ``docs`` (the Arrow table of the
    block's documents that ``encode`` returns under that name), and the
    ``binaries`` and ``counts`` it returns beside.

    ``columns`` (new name -> column of ``docs``) and ``_raw``, the text as
    bytes, are what ``encode`` sees.  A text is never divided, so a longer one
    is a block of its own.  Written once, so later passes see the same blocks.
    """
    rows = docs.select(*[F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in columns.items()],
                       F.col(text_col).cast("string").cast("binary").alias("_raw"))
    schema = pa.schema([("block", pa.int64()), ("docs", pa.binary()), *((b, pa.binary()) for b in binaries),
                        *((c, pa.int64()) for c in counts)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def done() -> pa.RecordBatch:
            nonlocal number, held, size
            row = encode(pa.Table.from_batches(held).combine_chunks())
            row |= {"block": number, "docs": squeeze(table_bytes(row["docs"]))}
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("_raw")), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths, dtype=np.int64) + np.arange(1, len(lengths) + 1) * 16
            at = before = 0
            while at < len(lengths):
                to = max(at + 1, int(np.searchsorted(ends, before + block_bytes - size, side="right")))
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at, before = to, int(ends[to - 1])
                if size >= block_bytes or at < len(lengths):
                    yield done()
        if held:
            yield done()

    ddl = ", ".join(["block bigint, docs binary", *(f"{b} binary" for b in binaries), *(f"{c} bigint" for c in counts)])
    return store(rows.mapInArrow(cut, ddl), name)


# ---------------------------------------------------------------- shards

class Shards:
    """Ranges of 64-bit keys: 2**j of them, about ``SHARD_ENTRIES`` of ``entries`` each.

    ``bits``: how many bits of a key count beside those that name its shard (so
    two of a shard's n different keys are taken for one with odds n / 2**bits,
    whatever the size of the corpus); ``None``: all of them.
    """

    def __init__(self, entries: int, bits: int | None = None):
        self.j = max(0, math.ceil(math.log2(max(1, entries) / SHARD_ENTRIES)))
        self.drop = 0 if bits is None else max(0, 64 - self.j - bits)
        self.n = 1 << self.j

    def key(self, h: np.ndarray) -> np.ndarray:
        """The part of a hash that counts; equal and sorted as the keys are."""
        return h >> np.uint64(self.drop) if self.drop else h

    def cuts(self, keys: np.ndarray) -> np.ndarray:
        """Start of each shard among sorted ``keys``, and their end."""
        if not self.j:
            return np.array([0, len(keys)])
        first = np.arange(1, self.n, dtype=np.uint64) << np.uint64(64 - self.j - self.drop)
        return np.concatenate([[0], np.searchsorted(keys, first), [len(keys)]])

    def send(self, block: int, keys: np.ndarray, cols: list[np.ndarray]) -> list[tuple]:
        """Rows of ``MESSAGE`` for sorted distinct ``keys`` and their columns."""
        at, out = self.cuts(keys), []
        rest = keys & np.uint64((1 << (64 - self.j - self.drop)) - 1)
        for k in np.flatnonzero(np.diff(at)):
            mine = slice(at[k], at[k + 1])
            out.append((int(k), block, squeeze(pack_sorted(rest[mine] >> np.uint64(24))), three_bytes(rest[mine]).tobytes(),
                        squeeze(pack_columns([c[mine] for c in cols]))))
        return out


def message_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in MESSAGE.split(", ")])


def answer_columns(answers: pd.DataFrame, n_cols: int, own: bool = False) -> list[np.ndarray]:
    """Columns that a block's answers hold, in the order of its keys (and which it owns)."""
    answers = answers.sort_values("shard", kind="stable")
    parts: list[list[np.ndarray]] = [[] for _ in range(n_cols)]
    flags = []
    for raw, mine in zip(answers["cols"], answers["own"], strict=True):
        mine = unsqueeze(mine)
        rows, kinds, bits = int.from_bytes(mine[:4], "little"), int.from_bytes(mine[4:8], "little"), mine[8:]
        code, *table = unpack_columns(unsqueeze(raw), 1 + n_cols, [rows] + [kinds] * n_cols)
        for p, c in zip(parts, table, strict=True):
            p.append(c.astype(np.int64)[code])
        if own:
            flags.append(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=rows).astype(bool))
    out = [np.concatenate(p) if p else np.empty(0, dtype=np.int64) for p in parts]
    return [*out, np.concatenate(flags) if flags else np.empty(0, dtype=bool)] if own else out


def coded(cols: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(code per row, columns of the different rows); frequent rows get small codes."""
    tag = np.zeros(len(cols[0]), dtype=np.uint64)
    for c in cols:
        tag = mix64(tag * _A + c.astype(np.uint64))
    _, first, which = distinct(tag)
    rank = np.empty(len(first), dtype=np.int64)
    by = np.argsort(-np.bincount(which, minlength=len(first)), kind="stable")
    rank[by] = np.arange(len(first))
    return rank[which], [c[first[by]] for c in cols]


def answer_row(block: int, shard: int, code: np.ndarray, table: list[np.ndarray], own: np.ndarray | None = None) -> tuple:
    """One row of ``ANSWER``: each key's code, and the rows of ``table`` that some key has."""
    seen, _, mine = distinct(code)
    head = len(code).to_bytes(4, "little") + len(seen).to_bytes(4, "little")
    return (block, shard, squeeze(head + (np.packbits(own).tobytes() if own is not None else b"")),
            squeeze(pack_columns([mine, *(c[seen] for c in table)])), None)


def answer_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])


def merge_shards(messages: DataFrame, n_cols: int,
                 finish: Callable[[int, np.ndarray, list[np.ndarray]], tuple[list[np.ndarray], list[int]]]) -> DataFrame:
    """``ANSWER`` rows: per block and shard the figures of each key it sent.

    ``finish(shard, keys, sums)`` sees a shard's distinct keys with the sums of
    their columns and returns the columns to send back and the shard's figures
    (``stats``, on a row of its own whose block is null).  Of the blocks that
    sent a key, exactly one owns it.
    """
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")
        shard = int(pdf["shard"].iloc[0])
        parts = [keys_of(h, lo) for h, lo in zip(pdf["high"], pdf["low"], strict=True)]
        sizes = [len(p) for p in parts]
        keys = np.concatenate(parts)
        del parts
        keys, one, which = distinct(keys)
        unpacked = [unpack_columns(unsqueeze(raw), n_cols, n) for raw, n in zip(pdf["cols"], sizes, strict=True)]
        # sums of integers, exact as floats up to 2**53
        sums = [np.bincount(which, np.concatenate([u[c] for u in unpacked]), len(keys)).astype(np.int64) for c in range(n_cols)]
        back, stats = finish(shard, keys, sums)
        own = np.zeros(len(which), dtype=bool)
        own[one] = True
        out, at = [(None, shard, None, None, stats)], 0
        code, table = coded(back)
        for block, n in zip(pdf["block"], sizes, strict=True):
            out.append(answer_row(int(block), shard, code[which[at:at + n]], table, own[at:at + n]))
            at += n
        return answer_frame(out)

    return messages.groupBy("shard").applyInPandas(merge, ANSWER)


def sum_stats(answers: DataFrame, n: int) -> list[int]:
    """The shards' figures added up in Spark: one row."""
    row = answers.where("block IS NULL").agg(*[F.sum(F.get("stats", F.lit(k))).alias(f"s{k}") for k in range(n)]).first()
    return [int(v or 0) for v in row]


__all__ = ["stored_blocks", "Shards", "merge_shards", "answer_columns", "answer_row", "answer_frame", "message_frame", "distinct", "coded",
           "keys_of", "pack_columns", "unpack_columns", "sum_stats", "table_of", "table_bytes", "squeeze", "unsqueeze", "three_bytes", "from_three_bytes", "unmix64", "mix64",
           "MESSAGE", "ANSWER"]
