"""Source divergence audit: how far each source's terms are from the other sources of its language.

Terms are counted by sorting pointers.  A data shard (some megabytes of texts) is
one run of bytes in an Arrow buffer; a pointer is the place where a term starts.
The pointers are sorted by the bytes they point at with a multikey quicksort whose
characters are eight bytes wide: a slice of pointers with equal characters so far is
sorted by its next character, and only slices still equal go on.  Equal runs give a
term's documents and its occurrences per source, which Spark then adds up.

Smoothed shares and divergences are integers throughout.  Pairs of sources are compared on
the terms that both hold; terms that one or none of them holds enter by counts, so
nothing is made for a term that a source lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: bytes of text sorted at once
SLICE_BYTES = 8 << 20
LEAST_DOCUMENTS = 3
#: ranks of the part ``term``
RANKS = 200
SCALE = 1_000_000_000

#: True for bytes of terms: ASCII letters, and every byte of a character beyond ASCII
_TERM = np.zeros(256, dtype=bool)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_COUNTS = "lang string, source string, term string, docs bigint, n bigint"


def term_starts(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of every term in ``text``, bytes of texts that end at ``ends``."""
    inside = np.zeros(len(text) + 2, dtype=np.int8)
    inside[1:-1] = _TERM[text]
    step = np.diff(inside)
    start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a run of bytes that goes on into the next text is cut there
    cut = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(text))]
    cut = np.unique(cut[inside[cut].astype(bool) & inside[cut + 1].astype(bool)])
    if len(cut):
        start, stop = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([stop, cut]))
    return start, stop - start


def sort_pointers(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): pointers in the order of their terms, and where a term differs from the one before.

    Multikey quicksort with eight-byte characters; a term's missing bytes count as
    zeros, which no term holds.
    """
    order = np.arange(len(start))
    new = np.zeros(len(start), dtype=bool)
    if not len(start):
        return order, new
    new[0] = True
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    wide = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
    at, depth = np.arange(len(start)), 0            # places in ``order`` whose slices are still equal
    slices = np.zeros(len(start), dtype=np.int64)   # and the slice of each
    while len(at):
        p = order[at]
        left = length[p] - depth
        char = wide[np.minimum(start[p] + depth, len(wide) - 1)].astype(np.uint64)
        missing = np.maximum(8 - left, 0).astype(np.uint64)    # below 8: a pointer goes on with bytes left
        char &= ~np.uint64(0) << missing * np.uint64(8)
        longer = left > 8                           # a term that ends here stands before those that go on
        by = np.lexsort((longer, char, slices))
        p, char, slices, longer = p[by], char[by], slices[by], longer[by]
        order[at] = p
        differs = np.ones(len(at), dtype=bool)
        differs[1:] = (char[1:] != char[:-1]) | (slices[1:] != slices[:-1]) | (longer[1:] != longer[:-1])
        new[at] |= differs
        # slices of one pointer are done, and so are those whose terms end here
        run = np.cumsum(differs) - 1
        on = (np.bincount(run)[run] > 1) & longer
        at, slices, depth = at[on], run[on], depth + 8
    return order, new


def _slice_counts(table: pa.Table) -> pa.RecordBatch:
    """Documents and occurrences of each term per (lang, source) of some documents."""
    raw = pc.fill_null(table.column("_raw"), b"").combine_chunks()
    raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset:raw.offset + len(raw) + 1].astype(np.int64)
    data = raw.buffers()[2]
    text = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    text, ends = _LOWER[text], offsets[1:] - offsets[0]
    groups = pc.dictionary_encode(pc.binary_join_element_wise(pc.cast(table.column("lang"), pa.binary()),
                                                              pc.cast(table.column("source"), pa.binary()), b"\xff")).combine_chunks()
    groups = groups.chunk(0) if isinstance(groups, pa.ChunkedArray) else groups
    code, names = groups.indices.to_numpy(), [g.split(b"\xff") for g in groups.dictionary.to_pylist()]
    start, length = term_starts(text, ends)
    order, new = sort_pointers(text, start, length)
    doc = np.searchsorted(ends, start[order], side="right")
    run = np.cumsum(new) - 1
    group = code[doc].astype(np.int64) if len(doc) else np.empty(0, np.int64)
    # inside a run the pointers are brought together by group and document
    by = np.lexsort((doc, group, run))
    run, group, doc = run[by], group[by], doc[by]
    head = np.ones(len(run), dtype=bool)
    head[1:] = (run[1:] != run[:-1]) | (group[1:] != group[:-1])
    other = head.copy()
    other[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(head)
    n = np.diff(np.append(first, len(run)))
    docs = np.add.reduceat(other.astype(np.int64), first) if len(first) else n
    p = order[np.flatnonzero(new)][run[first]] if len(first) else first
    # the terms' bytes, one after another
    size = length[p]
    to = np.cumsum(size)
    take = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(start[p] - (to - size), size)
    terms = pa.Array.from_buffers(pa.string(), len(p), [None, pa.py_buffer(np.append(0, to).astype(np.int32).tobytes()),
                                                        pa.py_buffer(text[take].tobytes())])
    lang, source = (pa.array([g[k].decode() for g in names], pa.string()) for k in (0, 1))
    of = pa.array(group[first], pa.int32())
    return pa.RecordBatch.from_arrays([lang.take(of), source.take(of), terms, pa.array(docs, pa.int64()), pa.array(n, pa.int64())],
                                      names=[c.split()[0] for c in _COUNTS.split(", ")])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, docs, n: in how many documents (rows) of a source a term is, and how often."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                       F.col(text_col).cast("string").cast("binary").alias("_raw"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_raw")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = before = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES - size, side="right")))
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at, before = to, int(ends[to - 1])
                if size >= SLICE_BYTES or at < len(ends):
                    yield _slice_counts(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield _slice_counts(pa.Table.from_batches(held))

    return rows.mapInArrow(count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact."""
    wide = (n + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + terms).cast("decimal(20,0)")).cast("long") + 1


def _far(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exact: shares are at most SCALE + 1, their squares fit a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of ``docs``.

    ``pair``: the divergence from each other source of the language, over all kept terms
    (those in ``least`` documents of the language or more; 0 without any).  ``term``: the terms that
    raise the source most over its whole language, to rank ``ranks``.  Nulls in text, lang and
    source are ''; repeated rows are documents each; ties go by the term's or source's
    bytes; an empty table gives an empty result.
    """
    counts = store(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    over = Window.partitionBy("lang", "term")
    kept = store(counts.withColumns({"all_docs": F.sum("docs").over(over), "all_n": F.sum("n").over(over)})
                 .where(F.col("all_docs") >= least).select("lang", "source", "term", "n", "all_n"), "kept-terms")
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                         F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    # one row per language, and one per language and source
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_distinct("term").alias("terms"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own_terms"))
    zero = F.lit(0).cast("long")
    g = (groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
         .fillna(0, ["total", "own_terms", "terms", "lang_total"]))
    g = store(g.withColumn("p0", F.when(F.col("terms") > 0, _share(zero, F.col("total"), F.col("terms")))), "source-groups")
    shares = store(kept.join(g.select("lang", "source", "total", "terms", "lang_total", "p0"), ["lang", "source"]).select(
        "lang", "source", "term", "p0", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("all_n"), F.col("lang_total"), F.col("terms")).alias("q")), "term-shares")

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    up = (shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                       _far(F.col("p"), F.col("q")).alias("value"))
          .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks))

    # terms of both sources: their divergence, and what the sums over one source's terms hold too much
    a = shares.select("lang", "term", "source", F.col("p").alias("pa"), F.col("p0").alias("za"))
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("pb"), F.col("p0").alias("zb"))
    both = a.join(b, ["lang", "term"]).where("source <> item").groupBy("lang", "source", "item").agg(
        F.count(F.lit(1)).alias("common"),
        F.sum(_far(F.col("pa"), F.col("pb")) - _far(F.col("pa"), F.col("zb")) - _far(F.col("za"), F.col("pb"))).alias("extra"))
    # terms of one source against the other's share of an absent term: shares repeat, so by their counts
    seen = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    pairs = g.select("lang", "source", "p0", "terms", "own_terms").join(
        g.select("lang", F.col("source").alias("item"), F.col("p0").alias("z"), F.col("own_terms").alias("item_terms")), "lang").where("source <> item")
    one = seen.join(pairs.select("lang", "source", "item", "z"), ["lang", "source"]).groupBy("lang", "source", "item").agg(
        F.sum(F.col("k") * _far(F.col("p"), F.col("z"))).alias("mine"))
    other = seen.withColumnRenamed("source", "item").join(pairs.select("lang", "source", "item", "p0"), ["lang", "item"]).groupBy(
        "lang", "source", "item").agg(F.sum(F.col("k") * _far(F.col("p0"), F.col("p"))).alias("theirs"))
    key = ["lang", "source", "item"]
    summed = (pairs.join(one, key, "left").join(other, key, "left").join(both, key, "left")
              .fillna(0, ["mine", "theirs", "common", "extra"]))
    absent = F.col("terms") - F.col("own_terms") - F.col("item_terms") + F.col("common")
    value = F.col("mine") + F.col("theirs") + F.col("extra") + F.coalesce(absent * _far(F.col("p0"), F.col("z")), zero)
    far = summed.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn(
        "rank", F.row_number().over(best))
    return far.unionByName(up)


__all__ = ["audit", "term_counts", "sort_pointers", "term_starts"]
