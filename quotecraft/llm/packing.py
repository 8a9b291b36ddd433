"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only the number of pieces of each length matters to the plan, and lengths run
from 1 to the capacity, so the plan is made over that histogram (at most
``capacity`` rows, whatever the corpus): bin completion fills the bin of the
largest piece left, trying undominated fillings, pruning by the waste that the
best plan so far (best-fit decreasing) leaves room for.  A filling is used as
often as its pieces last.  The plan is a table of intervals of ranks per length;
pieces are ranked inside their length by Spark and look up their place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import from_text, number_rows, store, to_text

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"
#: documents, and bytes of ids, that a task holds before it passes pieces on
HOLD = (256, 4 << 20)
#: documents of one plan where the order of documents counts
SEGMENT = 16_384

Pattern = tuple[tuple[int, int], ...]      # ((length, how many), ...)
Plan = list[tuple[Pattern, int]]           # (pattern, how many bins)


class PieceIds:
    """Token ids of a text as little-endian bytes.

    ``tiktoken`` reads the same vocabulary as ranks and gives the same ids; a text that may
    hold a special token's string goes to the tokenizer itself.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import base64

        import public_tokenizers as known
        import tiktoken

        with open(known.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding(vocabulary, pat_str=known.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._file, self._whole = known.path(f"{vocabulary}.json"), None

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            if self._whole is None:
                from tokenizers import Tokenizer
                self._whole = Tokenizer.from_file(self._file)
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self._fast.encode_ordinary(text), dtype="<u4").tobytes()


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 vocabulary: str = VOCABULARY, keep_ids: bool = False, order_col: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``, ``order_col``) of every piece.

    A document is its token ids and a closing 0.  Longer ones are cut into
    pieces of ``capacity``; the first piece takes the remainder.
    """
    counts = ["piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = PieceIds(vocabulary)
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                rows: list[tuple] = []
                of: list[int] = []
                parts: list[bytes] = []
                size, first = 0, at
                while at < whole.num_rows and at - first < HOLD[0] and size < HOLD[1]:
                    text = whole.column("_text")[at].as_py()
                    ids = (book.encode(text) if text else b"") + b"\0\0\0\0"
                    n, start, piece = len(ids) // 4, 0, 0
                    while start < n:
                        length = (n - start) % capacity or capacity
                        part = ids[4 * start:4 * (start + length)]
                        rows.append((piece, start, length, zlib.crc32(part)))
                        piece += 1
                        of.append(at)
                        if keep_ids:
                            parts.append(part)
                        start += length
                    size += len(ids)
                    at += 1
                columns = [whole.column("doc_id").take(pa.array(of))]
                columns += [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                if keep_ids:
                    ends = np.cumsum([0, *(r[2] for r in rows)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))))
                if order_col:
                    columns.append(whole.column(order_col).take(pa.array(of)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", *counts] + ["ids"] * keep_ids + [order_col] * bool(order_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"),
                       *([F.col(order_col).cast("long").alias(order_col)] if order_col else []))
    schema = (f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
              + ", ids array<int>" * keep_ids + f", `{order_col}` bigint" * bool(order_col))
    return rows.mapInArrow(cut, schema)


# ---------------------------------------------------------------- the plan

def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram; equal bins are handled together."""
    open_bins: dict[int, list[list]] = {}      # room left -> [pattern as dict, how many bins]
    rooms: list[int] = []

    def put(room: int, pattern: dict, times: int) -> None:
        if times:
            if room not in open_bins:
                insort(rooms, room)
                open_bins[room] = []
            open_bins[room].append([pattern, times])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = min(left, capacity // length)
                bins = left // each
                put(capacity - each * length, {length: each}, bins)
                left -= bins * each
                continue
            room = rooms[at]
            group = open_bins[room]
            pattern, times = group.pop()
            if not group:
                del open_bins[room]
                rooms.pop(at)
            each = min(left, room // length)
            bins = min(times, left // each)
            put(room, pattern, times - bins)
            put(room - each * length, pattern | {length: pattern.get(length, 0) + each}, bins)
            left -= bins * each
    return [(tuple(sorted(p.items(), reverse=True)), t) for g in open_bins.values() for p, t in g]


def fillings(lengths: list[int], counts: dict[int, int], room: int, effort: int) -> list[list[int]]:
    """Undominated fillings of ``room`` from the pieces left, least waste first.

    ``lengths`` ascending.  Pieces are tried largest first and sets are kept
    only if no piece left still fits; of two sets with the same waste, the one
    found later replaces a larger piece by smaller ones and is dominated.
    """
    found: dict[int, list[int]] = {}
    steps = 0

    def grow(chosen: list[int], left: int, top: int) -> bool:
        nonlocal steps
        steps += 1
        at = bisect_right(lengths, min(left, top)) - 1
        fits = False
        while at >= 0 and steps < effort:
            x = lengths[at]
            if counts[x] - chosen.count(x) > 0:
                fits = True
                # no set of pieces up to x can use more than all of this room: stop when one is perfect
                if grow([*chosen, x], left - x, x):
                    return True
            at -= 1
            if fits and x * 8 < left and found:
                break
        if not fits:
            found.setdefault(left, chosen)
            return left == 0
        return False

    grow([], room, room)
    return [found[w] for w in sorted(found)][:4] or [[]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins needed at least: the volume, or the pieces of which no two share a
    bin plus the volume of the rest that does not fit beside them."""
    volume = -(-sum(k * n for k, n in counts.items()) // capacity)
    return max(volume, sum(n for k, n in counts.items() if 2 * k > capacity))


def bin_completion(counts: dict[int, int], capacity: int, effort: int = 400, nodes: int = 12_000) -> Plan:
    """Branch and bound over the histogram ``counts`` (length -> pieces).

    Depth first: the bin of the largest piece left is completed by each of its
    undominated fillings, least waste first; a branch ends when its waste
    exceeds what a plan one bin shorter than the incumbent may waste.  The
    search stops at the lower bound or after ``nodes`` completions, and then
    returns the incumbent, which starts as best-fit decreasing.
    """
    counts = {k: n for k, n in counts.items() if n > 0}
    best = best_fit(counts, capacity)
    total, bins = sum(k * n for k, n in counts.items()), sum(t for _, t in best)
    floor = lower_bound(counts, capacity)
    left, lengths = dict(counts), sorted(counts)
    path: list[tuple[Pattern, int]] = []
    stack: list[tuple[int, int, list[list[int]], int, int]] = []   # (largest, depth, fillings left, waste, bins)
    waste = used = 0

    def take(pattern: Pattern, times: int) -> None:
        for k, n in pattern:
            left[k] -= n * times
            if not left[k]:
                lengths.pop(bisect_left(lengths, k))

    def undo(pattern: Pattern, times: int) -> None:
        for k, n in pattern:
            if not left[k]:
                insort(lengths, k)
            left[k] += n * times

    def options() -> list[list[int]]:
        top = lengths[-1]
        left[top] -= 1
        got = fillings(lengths if left[top] else lengths[:-1], left, capacity - top, effort)
        left[top] += 1
        return got

    opts = options() if lengths and bins > floor else []
    while bins > floor and nodes > 0:
        if opts:
            nodes -= 1
            pieces, rest = opts[0], opts[1:]
            top = lengths[-1]
            need: dict[int, int] = {top: 1}
            for x in pieces:
                need[x] = need.get(x, 0) + 1
            pattern = tuple(sorted(need.items(), reverse=True))
            times = min(left[k] // n for k, n in pattern)
            lost = times * (capacity - top - sum(pieces))
            if waste + lost > (bins - 1) * capacity - total:
                # this bin alone, once, may still be within the bound
                times, lost = 1, capacity - top - sum(pieces)
            if waste + lost <= (bins - 1) * capacity - total:
                stack.append((top, len(path), rest, waste, used))
                take(pattern, times)
                path.append((pattern, times))
                waste, used = waste + lost, used + times
                if not lengths:
                    best, bins = list(path), used
                    opts = []
                else:
                    opts = options()
                continue
            opts = rest
            continue
        if not stack:
            break
        _, _, opts, waste, used = stack.pop()
        undo(*path.pop())
    return best


def intervals(plan: Plan) -> pd.DataFrame:
    """The plan as rows (length, first, sequence, offset, each): pieces of
    ``length`` ranked from ``first`` on go ``each`` to a sequence, in order."""
    at, seen, rows = 0, {}, []
    for pattern, times in plan:
        offset = 0
        for length, each in pattern:
            first = seen.get(length, 0)
            rows.append((length, first, at, offset, each))
            seen[length] = first + each * times
            offset += each * length
        at += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset", "each"], dtype="int64")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, ...) with
    ``sequence_id`` and ``offset``.

    Lengths over ``capacity`` are an error.  Ties and repeated rows are
    interchangeable; an empty table gives an empty result.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if histogram and max(histogram) > capacity:
        raise ValueError("a piece is longer than a sequence")
    table = intervals(bin_completion(histogram, capacity)).sort_values(["length", "first"], kind="stable")
    rows = sum(histogram.values())
    # at most one row per pattern and length: bounded by the capacity, not by the corpus
    start = np.searchsorted(table["length"].to_numpy(), np.arange(capacity + 2))
    first, seq, off, each = (table[c].to_numpy() for c in ("first", "sequence", "offset", "each"))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf.pop("_rank").to_numpy()
            at = np.empty(len(pdf), dtype="int64")
            for x in np.unique(length):
                mine = length == x
                a, b = start[x], start[x + 1]
                at[mine] = a + np.searchsorted(first[a:b], rank[mine], side="right") - 1
            k = rank - first[at]
            yield pdf.assign(sequence_id=seq[at] + k // each[at], offset=off[at] + (k % each[at]) * length)

    ranked = number_rows(pieces.withColumn("_order", F.struct("doc_id", "piece", "start", "ids_crc32")),
                         "length", "_order", "_rank", rows).drop("_order")
    ranked = to_text(ranked, ["doc_id"])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank"),
                        "sequence_id bigint", "offset bigint"])
    return from_text(ranked.mapInPandas(look_up, schema), pieces, ["doc_id"])


def place_in_order(pieces: DataFrame, order_col: str, capacity: int = CAPACITY) -> DataFrame:
    """:func:`place` along an order: ``order_col`` numbers the documents from 0.

    Every ``SEGMENT`` documents that follow each other have a plan of their
    own, and their sequences follow those of the segment before, so the order
    holds from segment to segment whatever lengths a source has.  Inside a
    segment the pieces of a length are taken in order and sequences go by the
    mean place of their tokens, ties to the earlier sequence of the plan.  ``order_col`` must not
    be null (``stored_order`` numbers every row); repeated rows have numbers of their own; an
    empty table gives an empty result.
    """
    segment = SEGMENT

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order_col, "piece"], kind="stable").reset_index(drop=True)
        length = pdf["length"].to_numpy()
        if length.max() > capacity:
            raise ValueError("a piece is longer than a sequence")
        table = intervals(bin_completion({int(k): int(n) for k, n in pdf["length"].value_counts().sort_index().items()}, capacity))
        rank = pdf.groupby("length").cumcount().to_numpy()
        seq, offset = np.empty(len(pdf), dtype="int64"), np.empty(len(pdf), dtype="int64")
        for x, mine in table.groupby("length"):
            mine = mine.sort_values("first", kind="stable")
            at = np.flatnonzero(length == x)
            row = np.searchsorted(mine["first"].to_numpy(), rank[at], side="right") - 1
            k, each = rank[at] - mine["first"].to_numpy()[row], mine["each"].to_numpy()[row]
            seq[at] = mine["sequence"].to_numpy()[row] + k // each
            offset[at] = mine["offset"].to_numpy()[row] + k % each * x
        n = seq.max() + 1
        mean = (np.bincount(seq, length * (pdf[order_col].to_numpy() % segment), n) / np.bincount(seq, length, n))
        number = np.empty(n, dtype="int64")
        number[np.argsort(mean, kind="stable")] = np.arange(n)
        return pd.DataFrame({"_segment": pdf["_segment"], order_col: pdf[order_col], "piece": pdf["piece"],
                             "_number": number[seq], "offset": offset})

    # ids and texts stay out of the groups: a piece is known by its document's number and its own
    narrow = pieces.select(F.expr(f"`{order_col}` div {segment}").alias("_segment"), order_col, "piece", "length")
    placed = store(narrow.groupBy("_segment").applyInPandas(
        plan, f"_segment bigint, `{order_col}` bigint, piece int, _number bigint, offset bigint"), "placed")
    # one row per segment
    sizes = placed.groupBy("_segment").agg((F.max("_number") + 1).alias("_n"))
    before = Window.orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_segment", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    placed = placed.join(shift, "_segment").select(
        order_col, "piece", (F.col("_shift") + F.col("_number")).alias("sequence_id"), "offset")
    return pieces.join(placed, [order_col, "piece"]).select(*pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         vocabulary: str = VOCABULARY, keep_ids: bool = False, order_col: str | None = None) -> DataFrame:
    """Pack all documents; one row per piece with its place.

    ``order_col``: see :func:`place_in_order`; it stays in the result.  A null or empty text is its closing 0 alone; repeated rows are packed
    each; an empty table gives an empty result.
    """
    pieces = store(token_pieces(docs, id_col, text_col, capacity, vocabulary, keep_ids, order_col), "pieces")
    return place_in_order(pieces, order_col, capacity) if order_col else place(pieces, capacity)
