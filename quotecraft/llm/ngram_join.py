"""N-gram Jaccard join by vertical partitioning, to components of linked texts.

The distinct word n-grams of all texts get one global order: rarest first by a
count-min estimate of their document frequency over the whole corpus, then by
hash.  The order is cut into fragments.  Partial overlaps of a pair of texts
are counted fragment by fragment and summed per pair.

Pairs come from the ends of the order where similar texts must meet (prefix,
size and position bounds).  First each text meets one central text per n-gram,
linearly many pairs, whose links give most of each group of copies its
component.  Then, round by round, texts meet some other texts per n-gram where those
lie in other components, linearly many pairs again, until a round joins few components.
Then every pair that the bounds leave and that still lies in two components is counted,
so no link between components is lost while a group of near copies is never expanded
into all its pairs.  Texts with equal n-gram sets are one class from the start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import block_count, from_text, store, to_text, window_hashes, word_hashes, words_of
from .sketch import PARTIAL, Shape, merge_partials

N = 5
#: similarity in hundredths
PERCENT = 80
#: cuts of the global order (count code, hash) into fragments: most n-grams that
#: are shared at all are held by two texts, so their code is cut by hash
PIVOTS = ((2, 1 << 62), (2, 2 << 62), (2, 3 << 62), (3, 0), (3, 1 << 63), (4, 0), (6, 0))
SLOTS_PER_NGRAM = 8
#: size classes grow by this factor
SIZE_STEP = 1.02
#: texts per n-gram and size class that the others meet in a round
CENTRES = 8
#: rounds go on while one joins at least this share of the components that still share an n-gram
WORTH = 0.1

_SET = "_block int, key bigint, n int, weight double, tokens array<bigint>, places array<int>, fragments array<binary>"


def ngram_set(raw: bytes | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, A-Z
    lower-cased; a shorter text is one n-gram as a whole; no words, no n-gram."""
    words = words_of(raw.lower()) if raw else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words)[:, 0]
    return np.unique(window_hashes(h, min(n, len(h))) + np.uint64(min(n, len(h))))


def least_overlap(a: np.ndarray | int, percent: int = PERCENT):
    """Smallest overlap with which a set of size ``a`` can reach the similarity."""
    return -(-a * percent // 100)


def _digest(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64).tolist())


def members_of(rows: DataFrame, n: int) -> DataFrame:
    """doc_id, key, n, d0, d1: set size and 128-bit digest of each row's n-gram set."""
    def digest(batches):
        for pdf in batches:
            out = []
            for raw in pdf.pop("_raw"):
                s = ngram_set(raw, n)
                out.append((len(s), *_digest(s)))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=["n", "d0", "d1"], dtype="int64")], axis=1)

    done = to_text(rows, ["doc_id"]).mapInPandas(digest, "doc_id string, key bigint, n bigint, d0 bigint, d1 bigint")
    return from_text(done, rows, ["doc_id"])


class _BlockSets:
    """n-gram sets of the chosen documents of one block, as one run of entries."""

    def __init__(self, pdf: pd.DataFrame, chosen: pd.DataFrame, n: int):
        wanted = set(chosen["rep"])
        self.keys, sets = [], []
        for key, raw in zip(pdf["key"], pdf["_raw"], strict=True):
            if key in wanted:
                wanted.discard(key)          # repeated rows count once
                self.keys.append(key)
                sets.append(ngram_set(raw, n))
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.all = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)


def ordered_sets(rows: DataFrame, reps: DataFrame, n_blocks: int, entries: int, n: int, percent: int,
                 pivots: tuple = PIVOTS) -> DataFrame:
    """One row per class: size, the shared n-grams of its prefix with their
    places in the global order, and its shared n-grams cut into fragments.

    n-grams that the sketch counts once are in no other class: they count in
    places and sizes only.
    """
    shape = Shape(entries, 1, SLOTS_PER_NGRAM)
    block = lambda key: F.pmod(F.col(key), F.lit(n_blocks)).cast("int")
    texts = rows.select(block("key").alias("_block"), "key", "_raw")
    chosen = reps.select(block("rep").alias("_b"), "rep")

    def sketch(pdf: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(chosen):
            sets = _BlockSets(pdf, chosen, n)
            out = shape.partial(int(pdf["_block"].iloc[0]), 0,
                                *np.unique(shape.rows(sets.all)[0], return_counts=True))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PARTIAL.split(", ")])

    partials = texts.groupBy("_block").cogroup(chosen.groupBy("_b")).applyInPandas(sketch, PARTIAL)
    merged = store(merge_partials(partials, shape), "ngram-sketch")
    # both kinds of rows that a block needs, side by side
    aside = merged.select(F.col("block").alias("_b"), F.lit(0).cast("long").alias("rep"), "shard", "codes").unionByName(
        chosen.select("_b", "rep", F.lit(-1).alias("shard"), F.lit(None).cast("binary").alias("codes")))

    def order(pdf: pd.DataFrame, aside: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(aside):
            known = aside["shard"] >= 0
            sets = _BlockSets(pdf, aside[~known], n)
            codes = {int(s): c for s, c in zip(aside.loc[known, "shard"], aside.loc[known, "codes"], strict=True)}
            slots = shape.rows(sets.all)[0]
            uniq, inverse = np.unique(slots, return_inverse=True)
            code = shape.codes(codes, 0, uniq)[inverse]
            at = 0
            for key, size in zip(sets.keys, sets.sizes, strict=True):
                h, c = sets.all[at:at + size], code[at:at + size]
                at += size
                by = np.lexsort((h, c))
                h, c = h[by], c[by]
                alone = int((c == 1).sum())
                prefix = int(size - least_overlap(size, percent) + 1)
                if alone >= prefix:
                    continue                     # no n-gram of its prefix is in any other class
                h, c = h[alone:], c[alone:]
                frag = np.zeros(len(h), dtype=np.int64)
                for pc, ph in pivots:
                    frag += (c > pc) | ((c == pc) & (h >= np.uint64(ph)))
                out.append((int(pdf["_block"].iloc[0]), key, size, float(c.sum()) / size,
                            h[:prefix - alone].astype(np.int64), np.arange(alone, prefix, dtype=np.int32),
                            [np.sort(h[frag == f]).tobytes() for f in range(len(pivots) + 1)]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _SET.split(", ")])

    return texts.groupBy("_block").cogroup(aside.groupBy("_b")).applyInPandas(order, _SET)


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")


def meeting_points(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(larger, smaller): rows (token, cls, key, n, rest, weight) where the
    larger text of a similar pair and the smaller one must meet.

    ``rest`` is what the set holds from that n-gram on in the global order, so
    a pair whose first common n-gram it is overlaps in ``rest`` at most, which
    bounds the sizes that can reach the similarity.
    """
    p = sets.select("key", "n", "weight", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select(
        F.col("t.tokens").alias("token"), "key", "n", "weight", (F.col("n") - F.col("t.places")).alias("rest"))
    # similarity >= t and overlap <= rest:  n' <= rest * (1 + t) / t - n
    most = F.floor(F.col("rest") * (100 + percent) / F.lit(percent) - F.col("n") + 1e-9)
    able = p.withColumn("_most", F.least(most, F.col("n"))).withColumn("_least", F.ceil(F.col("n") * percent / 100))
    larger = (able.where(F.col("_most") >= F.col("_least"))
              .withColumn("cls", F.explode(F.sequence(size_class(F.greatest(F.col("_least"), F.lit(1))),
                                                      size_class(F.col("_most")))))
              .drop("_most", "_least"))
    smaller = p.where(most >= F.col("n")).withColumn("cls", size_class(F.col("n")))
    return larger, smaller


def _possible(percent: int) -> Column:
    """The pair (a, n, rest) with (b, bn, brest) passes the size and position bounds."""
    return ((F.col("bn") <= F.col("n")) & (100 * F.col("bn") >= percent * F.col("n"))
            & ((100 + percent) * F.least("rest", "brest") >= percent * (F.col("n") + F.col("bn"))))


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n, bn) whose fragments' overlaps sum up to the similarity."""
    frag = sets.select("key", F.posexplode("fragments").alias("f", "grams")).where(F.length("grams") > 0)
    left = frag.select(F.col("key").alias("a"), "f", F.col("grams").alias("ga"))
    right = frag.select(F.col("key").alias("b"), "f", F.col("grams").alias("gb"))

    def overlap(batches):
        for pdf in batches:
            yield pd.DataFrame({
                "a": pdf["a"], "b": pdf["b"], "n": pdf["n"], "bn": pdf["bn"],
                "part": [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                         for x, y in zip(pdf["ga"], pdf["gb"], strict=True)]})

    parts = (pairs.join(left, "a").join(right, ["b", "f"])
             .mapInPandas(overlap, "a bigint, b bigint, n int, bn int, part bigint"))
    summed = parts.groupBy("a", "b", "n", "bn").agg(F.sum("part").alias("both"))
    return summed.where(100 * F.col("both") >= percent * (F.col("n") + F.col("bn") - F.col("both"))).select("a", "b")


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node it reaches.

    Alternating large and small stars; each round is written to the shared
    folder and ends the lineage.  Minima are partial aggregates, so a node
    with any number of links is no hot spot.
    """
    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are stored: a join of two plain exchanges is one that AQE splits at a hot node
        low = store(both.groupBy("a").agg(F.min("b").alias("m"))
                    .select(F.col("a").alias("u"), F.least("a", "m").alias("m")), name)
        large = both.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, F.col("a") == F.col("u"))
        new = (small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        e = store(new, name)
        now = mark(e)
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def merge_components(comp: DataFrame, found: DataFrame) -> DataFrame:
    """(key, comp) after joining the components that the links ``found`` (a, b) connect; a component
    goes by the smallest key in it."""
    edges = found.join(comp.select(F.col("key").alias("a"), F.col("comp").alias("ca")), "a").join(
        comp.select(F.col("key").alias("b"), F.col("comp").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = components(edges, "ngram-components")
    return store(comp.join(roots, F.col("comp") == F.col("node"), "left").select(
        "key", F.coalesce("root", "comp").alias("comp")), "ngram-roots")


def _between_components(larger: DataFrame, smaller: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of n-grams and size classes that more than one component shares: (larger, smaller, their keys)."""
    x, y = larger.join(comp, "key"), smaller.join(comp, "key")
    lists = store(x.select("token", "cls", "comp").unionByName(y.select("token", "cls", "comp"))
                  .groupBy("token", "cls").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                  .where("lo <> hi").select("token", "cls"), "ngram-split")
    x = store(x.join(lists, ["token", "cls"], "left_semi"), "ngram-larger")
    y = store(y.join(lists, ["token", "cls"], "left_semi").select(
        "token", "cls", F.col("key").alias("b"), F.col("n").alias("bn"), F.col("rest").alias("brest"),
        F.col("comp").alias("bcomp")), "ngram-smaller")
    return x, y, x.select("key", "comp").unionByName(y.select(F.col("b").alias("key"), F.col("bcomp").alias("comp")))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
                     percent: int = PERCENT) -> DataFrame:
    """doc_id, key, n_shingles, component_id, root of every row.

    Two rows link when 100 * common n-grams >= ``percent`` * united n-grams.
    ``component_id`` is the smallest doc_id that links reach, the row's own
    included; null ids are passed over (null where a component has no other).
    ``root`` names the component itself: two components differ in it even where
    they share a doc_id or have none (null for texts without words).
    ``key`` is the hash of (doc_id, text).  Null and empty texts link with
    nothing; rows repeated link with each other; an empty table gives an
    empty result.
    """
    n_blocks, n_bytes = block_count(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("_raw"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "_raw").alias("key"), "_raw")
    members = store(members_of(rows, n), "ngram-members")
    classes = store(members.where("n > 0").groupBy("d0", "d1").agg(
        F.min("key").alias("rep"), F.min("doc_id").alias("first_id")), "ngram-classes")
    sets = store(ordered_sets(rows, classes, n_blocks, n_bytes // 6 + 1, n, percent), "ngram-sets")

    larger, smaller = meeting_points(sets, percent)
    # round 1: one central text per n-gram and size class
    # (stored, as below: two plain exchanges make a join that AQE splits at a hot n-gram)
    centre = store(smaller.groupBy("token", "cls").agg(F.max(F.struct("weight", "key", "n", "rest")).alias("c")).select(
        "token", "cls", F.col("c.key").alias("b"), F.col("c.n").alias("bn"), F.col("c.rest").alias("brest")), "ngram-centres")
    first = (larger.join(centre, ["token", "cls"]).where((F.col("key") != F.col("b")) & _possible(percent))
             .select(F.col("key").alias("a"), "b", "n", "bn").distinct())
    found = store(links(first, sets, percent), "ngram-links")
    comp = merge_components(sets.select("key", F.col("key").alias("comp")), found)

    # rounds of some centres per n-gram and size class, drawn anew each time
    turn = 0
    while True:
        x, y, split = _between_components(larger, smaller, comp)
        # lists that one component fills stay filled: the next round looks at the others only
        larger, smaller = x.drop("comp"), y.select("token", "cls", F.col("b").alias("key"), F.col("bn").alias("n"), F.col("brest").alias("rest"))
        turn += 1
        drawn = Window.partitionBy("token", "cls").orderBy(F.xxhash64("b", F.lit(turn)), "b")
        some = store(y.withColumn("_place", F.row_number().over(drawn)).where(F.col("_place") <= CENTRES).drop("_place"), "ngram-centres")
        pairs = (x.join(some, ["token", "cls"]).where((F.col("comp") != F.col("bcomp")) & _possible(percent))
                 .select(F.col("key").alias("a"), "b", "n", "bn").distinct())
        found = store(links(pairs, sets, percent), "ngram-links")
        before = split.select("comp").distinct().count()
        if not before or found.isEmpty():
            break
        comp = merge_components(comp, found)
        now = split.select("key").distinct().join(comp, "key").select("comp").distinct().count()
        if before - now < WORTH * before:
            x, y, _ = _between_components(larger, smaller, comp)
            break

    # all other possible pairs between two components
    once = (F.col("n") > F.col("bn")) | (F.col("key") < F.col("b"))
    rest = (x.join(y, ["token", "cls"]).where((F.col("comp") != F.col("bcomp")) & once & _possible(percent))
            .select(F.col("key").alias("a"), "b", "n", "bn").distinct())
    final = merge_components(comp, store(links(rest, sets, percent), "ngram-links"))

    # classes to components, components to their smallest document
    named = store(classes.join(final, F.col("rep") == F.col("key"), "left").select(
        "d0", "d1", "first_id", F.coalesce("comp", "rep").alias("root")), "ngram-named")
    least = store(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "ngram-least")
    named = named.join(least, "root").select("d0", "d1", "component_id", "root")
    own = members.join(named, ["d0", "d1"], "left")
    return own.select("doc_id", "key", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      F.when(F.col("n") > 0, F.col("root")).alias("root"))
