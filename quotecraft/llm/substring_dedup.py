"""Substring dedup: remove words inside windows that occur more than once.

Pass 1 makes a count-min sketch of all windows of ``width`` words (partial
sketches per block of documents, merged by shard).  A sketch never counts too
low, so a window estimated once is unique.  Pass 2 groups only the windows
estimated repeated, by 96-bit hashes of their word sequences, and pass 3 cuts
the words covered by windows that group says repeat.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, block_key, from_text, store, to_text, window_hashes, word_hashes, words_of
from .sketch import MERGED, PARTIAL, Shape, merge_partials

WIDTH = 35
DEPTH = 2
SLOTS_PER_WINDOW = 4
#: windows of one group of the exact pass, about
GROUP_WINDOWS = 2_000_000


class BlockWindows:
    """Windows of one block's documents: hash halves and first words."""

    def __init__(self, raws, width: int):
        hashes, sizes = [], []
        for raw in raws:
            words = words_of(raw)
            sizes.append(len(words))
            if words:
                hashes.append(word_hashes(words))
        self.sizes = np.array(sizes, dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        both = np.concatenate(hashes) if hashes else np.empty((0, 2), dtype=np.uint64)
        n = len(both) - width + 1
        if n > 0:
            inside = np.arange(n) + width <= np.repeat(self.ends, self.sizes)[:n]
            self.first = np.flatnonzero(inside)
            self.h0 = window_hashes(both[:, 0], width)[self.first]
            self.h1 = window_hashes(both[:, 1], width)[self.first]
        else:
            self.first = np.empty(0, dtype=np.int64)
            self.h0 = self.h1 = np.empty(0, dtype=np.uint64)

    def repeated_maybe(self, shape: Shape, merged: dict[int, bytes]) -> np.ndarray:
        """True for windows that every row of the sketch counts twice or more."""
        out = np.ones(len(self.h0), dtype=bool)
        for r, slots in enumerate(shape.rows(self.h0, self.h1)):
            uniq, inverse = np.unique(slots, return_inverse=True)
            out &= (shape.codes(merged, r, uniq) > 1)[inverse]
        return out

    def exact_keys(self, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (64-bit, 32-bit) keys in order, their counts, and each window's key."""
        a, b = self.h0[maybe], (self.h1[maybe] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        which = np.empty(len(a), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        return a[at], b[at], np.diff(np.append(at, len(a))), which


def _group_of(a: np.ndarray, groups: int) -> np.ndarray:
    return ((a >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   keep: dict[str, str] | None = None, untouched_as_is: bool = False) -> DataFrame:
    """Per row: ``keep`` columns (default doc_id), n_words, n_removed, kept_text.

    Words are runs of characters other than 0x20 and 0x09-0x0D.  A word goes
    if a window covers it whose word sequence also starts elsewhere, in the
    same or another row; windows are judged on the input.  ``kept_text`` joins
    the words left by one space (``untouched_as_is``: a text that loses no word
    keeps its own spacing).  Null and empty texts have no words and an
    empty ``kept_text``; a repeated row repeats all its windows; an empty
    table gives an empty result.
    """
    keep = keep or {"doc_id": id_col}
    n_blocks, n_bytes = block_count(docs, text_col)
    # a word and its blank take two bytes at least; prose has about six
    shape = Shape(n_bytes // 6 + 1, DEPTH, SLOTS_PER_WINDOW)
    groups = max(1, n_bytes // 6 // GROUP_WINDOWS)
    rows = docs.select(*[F.col(c).alias(n) for n, c in keep.items()],
                       F.col(text_col).cast("string").cast("binary").alias("_raw"))
    rows = rows.withColumn("_block", block_key(n_blocks, *keep, "_raw"))
    names, plain = list(keep), rows
    rows = to_text(rows, names)
    texts = rows.select("_block", "_raw")

    def sketch(pdf: pd.DataFrame) -> pd.DataFrame:
        block, w, out = int(pdf["_block"].iloc[0]), BlockWindows(pdf["_raw"], width), []
        for r, slots in enumerate(shape.rows(w.h0, w.h1)):
            out += shape.partial(block, r, *np.unique(slots, return_counts=True))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PARTIAL.split(", ")])

    estimates = store(merge_partials(texts.groupBy("_block").applyInPandas(sketch, PARTIAL), shape), "window-sketch")

    def of(merged: pd.DataFrame) -> dict[int, bytes]:
        return dict(zip(merged["shard"], merged["codes"], strict=True))

    def candidates(pdf: pd.DataFrame, merged: pd.DataFrame) -> pd.DataFrame:
        cols = ["grp", "block", "a", "b", "twice"]
        if not len(pdf):
            return pd.DataFrame(columns=cols)
        block, w = int(pdf["_block"].iloc[0]), BlockWindows(pdf["_raw"], width)
        a, b, n, _ = w.exact_keys(w.repeated_maybe(shape, of(merged)))
        cut = np.searchsorted(_group_of(a, groups), np.arange(groups + 1))
        out = [(g, block, a[x:y].tobytes(), b[x:y].tobytes(), np.packbits(n[x:y] > 1).tobytes())
               for g, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if x < y]
        return pd.DataFrame(out, columns=cols)

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(x) // 8 for x in pdf["a"]]
        a = np.frombuffer(b"".join(pdf["a"]), dtype=np.uint64)
        b = np.frombuffer(b"".join(pdf["b"]), dtype=np.uint32)
        n = np.concatenate([np.unpackbits(np.frombuffer(t, dtype=np.uint8), count=k)
                            for t, k in zip(pdf["twice"], sizes, strict=True)]).astype(np.int64) + 1
        order = np.lexsort((b, a))
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        key = np.cumsum(new) - 1
        total = np.bincount(key, n[order])
        again = np.empty(len(a), dtype=bool)
        again[order] = total[key] > 1
        ends = np.cumsum(sizes)
        return pd.DataFrame({"block": pdf["block"], "shard": -1 - pdf["grp"],
                             "codes": [np.packbits(again[e - k:e]).tobytes() for e, k in zip(ends, sizes, strict=True)]})

    found = texts.groupBy("_block").cogroup(estimates.groupBy("block")).applyInPandas(
        candidates, "grp int, block int, a binary, b binary, twice binary")
    verdicts = store(found.groupBy("grp").applyInPandas(exact, MERGED), "window-repeats")

    def cut_words(pdf: pd.DataFrame, merged: pd.DataFrame) -> pd.DataFrame:
        head = pdf.drop(columns=["_raw", "_block"])
        if not len(pdf):
            return head.assign(n_words=0, n_removed=0, kept_text="")
        w, codes = BlockWindows(pdf["_raw"], width), of(merged)
        maybe = w.repeated_maybe(shape, codes)
        a, _, _, which = w.exact_keys(maybe)
        cut = np.searchsorted(_group_of(a, groups), np.arange(groups + 1))
        again = [np.unpackbits(np.frombuffer(codes[-1 - g], dtype=np.uint8), count=int(y - x))
                 for g, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if x < y]
        steps = np.zeros(int(w.sizes.sum()) + 1, dtype=np.int32)
        if again:
            first = w.first[maybe][np.concatenate(again).astype(bool)[which]]
            steps[first] += 1
            np.subtract.at(steps, first + width, 1)
        stays = np.cumsum(steps[:-1]) == 0
        kept, removed, at = [], [], 0
        for raw, n in zip(pdf["_raw"], w.sizes, strict=True):
            mine = stays[at:at + n]
            gone = int(n - mine.sum())
            left = raw or b"" if untouched_as_is and not gone else b" ".join(compress(words_of(raw), mine))
            kept.append(left.decode("utf-8", "replace"))
            removed.append(gone)
            at += n
        return head.assign(n_words=w.sizes, n_removed=removed, kept_text=kept)

    both = estimates.unionByName(verdicts)
    schema = ", ".join([*(f"`{c}` string" for c in names), "n_words bigint", "n_removed bigint", "kept_text string"])
    done = rows.groupBy("_block").cogroup(both.groupBy("block")).applyInPandas(cut_words, schema)
    return from_text(done, plain, names)
