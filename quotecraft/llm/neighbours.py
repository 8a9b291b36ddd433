"""Approximate nearest neighbours by inner product: NN-descent and greedy search.

The index is a neighbour graph.  A few random-projection trees, fitted on a
bounded sample, deal all vectors into leaves that give each vector its first
neighbours; NN-descent then improves them by joining neighbours of neighbours
until few lists change.  A query walks the graph: it scores the neighbours of
the best nodes it knows until none of its best nodes is left to open.

Equal vectors are one node (they would only point at each other); a node keeps
the smallest ids of its copies.  For the graph, vectors of different length
are lifted to one length by a further component, so that the nearest by angle
are the nearest by inner product; queries score original vectors in double
precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: vectors on which the trees are fitted, at most (all vectors are indexed)
SAMPLE = 32_768
TREES = 8
LEAF = 400
#: neighbours kept per node, and edges into a node that take part in a round
K = 32
REVERSE = 32
#: best others that one local join reports per node
REPORT = 12
ROUNDS = 6
#: a round that changes less than this share of all list entries is the last
STILL = 0.02
#: best known nodes that a query opens, and that it remembers
BEAM = 160
POOL = 320
SEED = 20240229


def usable(vec: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    number = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & number & F.exists(vec, lambda x: x != 0), F.lit(False))


def as_matrix(raws) -> np.ndarray:
    return np.frombuffer(b"".join(raws), dtype="<f4").reshape(len(raws), -1)


# ------------------------------------------------------------------ first lists

def grow_tree(x: np.ndarray, leaf: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions, thresholds, children) of a tree of median cuts along the
    line between two random points; child -1 - k is leaf k."""
    dirs, cuts, kids, leaves = [], [], [], 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            a, b = rng.choice(rows, 2, replace=False)
            d = x[a] - x[b]
            at = x[rows] @ d
            cut = float(np.median(at))
            low = at <= cut
            if low.any() and not low.all():
                me = len(dirs)
                dirs.append(d)
                cuts.append(cut)
                kids.append([0, 0])
                kids[me] = [grow(rows[low]), grow(rows[~low])]
                return me
        leaves += 1
        return -leaves

    grow(np.arange(len(x)))
    return (np.array(dirs, dtype=np.float32).reshape(-1, x.shape[1]), np.array(cuts, dtype=np.float32),
            np.array(kids, dtype=np.int32).reshape(-1, 2))


def leaf_of(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    dirs, cuts, kids = tree
    at = np.zeros(len(x), dtype=np.int64) if len(dirs) else np.full(len(x), -1, dtype=np.int64)
    while (inner := np.flatnonzero(at >= 0)).size:
        node = at[inner]
        right = np.einsum("ij,ij->i", x[inner], dirs[node]) > cuts[node]
        at[inner] = kids[node, right.astype(np.int64)]
    return -1 - at


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """The ``k`` best distinct ids (ties to the smaller id), packed."""
    order = np.lexsort((ids, -sims))
    ids, sims = ids[order], sims[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first].astype("<i8").tobytes(), sims[first].astype("<f4").tobytes()


_LISTS = "node bigint, ids binary, sims binary"


def _leaf_lists(pdf: pd.DataFrame) -> pd.DataFrame:
    """All pairs inside one leaf (its size is set by ``LEAF``, not by the data)."""
    ids, x = pdf["node"].to_numpy(), as_matrix(pdf["code"])
    out = []
    for a in range(0, len(ids), 512):
        sims = x[a:a + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -np.inf
        k = min(K, len(ids) - 1)
        if k > 0:
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            for i in range(len(sims)):
                out.append((ids[a + i], *_top(ids[best[i]], sims[i, best[i]], K)))
    return pd.DataFrame(out, columns=["node", "ids", "sims"])


def merge_lists(lists: DataFrame) -> DataFrame:
    """One list of the ``K`` best per node.  A node has a bounded number of
    lists: one per tree, or one per local join that it takes part in."""
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(n, *_top(np.frombuffer(b"".join(i), "<i8"), np.frombuffer(b"".join(s), "<f4"), K))
                   for n, i, s in zip(pdf["node"], pdf["ids"], pdf["sims"], strict=True)]
            yield pd.DataFrame(out, columns=["node", "ids", "sims"])

    return lists.groupBy("node").agg(F.collect_list("ids").alias("ids"), F.collect_list("sims").alias("sims")).mapInPandas(
        merge, _LISTS)


def first_lists(codes: DataFrame, n_nodes: int) -> DataFrame:
    sample = codes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toPandas()
    x, rng = as_matrix(sample["code"]), np.random.default_rng(SEED)
    per_leaf = max(4, int(LEAF * len(x) / n_nodes))
    trees = [grow_tree(x, per_leaf, rng) for _ in range(TREES)]
    # beyond SAMPLE x LEAF / 4 vectors a leaf holds more than LEAF: it is dealt into chunks
    chunks = max(1, round(per_leaf * n_nodes / len(x) / (2 * LEAF)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = as_matrix(pdf["code"])
            for t, tree in enumerate(trees):
                yield pdf.assign(tree=t, leaf=leaf_of(x, tree))

    dealt = codes.mapInPandas(deal, "node bigint, code binary, tree int, leaf bigint").withColumn(
        "chunk", F.pmod(F.xxhash64("node", "tree"), F.lit(chunks)))
    return merge_lists(dealt.groupBy("tree", "leaf", "chunk").applyInPandas(_leaf_lists, _LISTS))


# ------------------------------------------------------------------ NN-descent

def edges_of(lists: DataFrame) -> DataFrame:
    """(v, u): one row per entry of each node's list."""
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = [len(i) // 8 for i in pdf["ids"]]
            yield pd.DataFrame({"v": np.repeat(pdf["node"].to_numpy(), sizes),
                                "u": np.frombuffer(b"".join(pdf["ids"]), "<i8"),
                                "place": np.concatenate([np.arange(n) for n in sizes] or [np.empty(0)]).astype("int32")})

    return lists.mapInPandas(unpack, "v bigint, u bigint, place int")


def both_ways(lists: DataFrame, salt: int | None = None) -> DataFrame:
    """Neighbours of each node along its list and against the lists it is in.

    A node takes at most ``REVERSE`` edges against their direction, the
    nearest, or by a hash that changes with ``salt``: a hub that is on
    everyone's list stays bounded.
    """
    edges = edges_of(lists)
    order = [F.col("place"), F.col("v")] if salt is None else [F.xxhash64("v", "u", F.lit(salt)), F.col("v")]
    near = edges.withColumn("_r", F.row_number().over(Window.partitionBy("u").orderBy(*order))).where(F.col("_r") <= REVERSE)
    back = near.select(F.col("u").alias("v"), F.col("v").alias("u"))
    ahead = edges if salt is None else near
    return ahead.select("v", "u").unionByName(back).distinct()


def _local_join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbours of one node are compared with each other."""
    for pdf in batches:
        out = []
        for ids, codes in zip(pdf["ids"], pdf["codes"], strict=True):
            if len(ids) < 2:
                continue
            ids, x = np.asarray(ids), as_matrix(list(codes))
            sims = x @ x.T
            np.fill_diagonal(sims, -np.inf)
            k = min(REPORT, len(ids) - 1)
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(sims, best, axis=1).astype("<f4")
            others = ids[best].astype("<i8")
            out += [(ids[i], others[i].tobytes(), near[i].tobytes()) for i in range(len(ids))]
        yield pd.DataFrame(out, columns=["node", "ids", "sims"])


def improve(lists: DataFrame, codes: DataFrame, salt: int) -> DataFrame:
    """One round: neighbours of neighbours meet, and every node keeps its best."""
    near = both_ways(lists, salt).join(codes, F.col("u") == F.col("node")).groupBy("v").agg(
        F.collect_list("u").alias("ids"), F.collect_list("code").alias("codes"))
    found = near.mapInPandas(_local_join, _LISTS)
    return merge_lists(lists.unionByName(found))


def changed(old: DataFrame, new: DataFrame) -> int:
    """List entries of ``new`` that ``old`` did not have."""
    a, b = edges_of(new).select("v", "u"), edges_of(old).select("v", "u")
    return a.join(b, ["v", "u"], "left_anti").count()


# ------------------------------------------------------------------ the index

class Index:
    """Neighbour graph over the distinct usable vectors of a table.

    ``nodes``: node (smallest id of the equal vectors), vec (packed floats),
    copies (up to ``keep`` smallest ids); ``members``: vec_id, node;
    ``adjacent``: node, ids.
    """

    def __init__(self, table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: int = 21):
        rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("vec"))
        rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
        groups = rows.groupBy("vec").agg(F.min("vec_id").alias("node"))

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"node": pdf["node"], "vec": [np.asarray(v, "<f4").tobytes() for v in pdf["vec"]]})

        # an id given twice belongs to its smaller node
        self.members = store(rows.join(store(groups, "vector-groups"), "vec").groupBy("vec_id")
                             .agg(F.min("node").alias("node")), "vector-members")
        self.nodes = store(groups.mapInPandas(packed, "node bigint, vec binary").dropDuplicates(["node"]), "vector-nodes")
        first = Window.partitionBy("node").orderBy("vec_id")
        self.copies = store(self.members.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= keep)
                            .groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("copies")), "vector-copies")
        self.n = self.nodes.count()
        self.adjacent = self._graph() if self.n else None

    def _graph(self) -> DataFrame:
        def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = as_matrix(pdf["vec"]).astype(float)
                yield pd.DataFrame({"sq": np.einsum("ij,ij->i", x, x)})

        top = self.nodes.select("vec").mapInPandas(lengths, "sq double").agg(F.max("sq")).first()[0]

        def lift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = as_matrix(pdf["vec"]).astype(float)
                more = np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0.0))
                code = (np.column_stack([x, more]) / math.sqrt(top)).astype("<f4")
                yield pd.DataFrame({"node": pdf["node"], "code": [c.tobytes() for c in code]})

        codes = store(self.nodes.mapInPandas(lift, "node bigint, code binary"), "vector-codes")
        lists = store(first_lists(codes, self.n), "neighbour-lists")
        for r in range(ROUNDS):
            better = store(improve(lists, codes, r), "neighbour-lists")
            moved = changed(lists, better)
            lists = better
            if moved < STILL * K * self.n:
                break
        return store(both_ways(lists).groupBy("v").agg(F.collect_list("u").alias("ids"))
                     .withColumnRenamed("v", "node"), "neighbour-graph")

    # -------------------------------------------------------------- search

    def search(self, starts: DataFrame) -> DataFrame:
        """``starts`` (node): walk from each node towards its own vector.
        Returns (q, ids, scores): the best ``POOL`` nodes found, best first."""
        nodes = self.nodes
        qs = starts.select(F.col("node").alias("q")).join(nodes, F.col("q") == F.col("node")).select("q", F.col("vec").alias("qvec"))
        qs = store(qs, "queries")
        todo = qs.select("q", "qvec", F.array("q").alias("cands"))
        pools = None
        while True:
            pools, before = store(self._step(todo, pools), "pools"), pools
            if not pools.where(F.size("open") > 0).limit(1).count():
                return pools.select("q", "ids", "scores")
            open_ = pools.where(F.size("open") > 0).select("q", F.explode("open").alias("node"))
            near = open_.join(self.adjacent, "node").groupBy("q").agg(
                F.array_distinct(F.flatten(F.collect_list("ids"))).alias("near"))
            known = pools.select("q", "ids")
            todo = near.join(known, "q").select("q", F.array_except("near", "ids").alias("cands")).join(qs, "q")

    def _step(self, todo: DataFrame, pools: DataFrame | None) -> DataFrame:
        """Score the candidates of each query, merge them into its pool, and
        mark the nodes to open next (``open``) and those opened (``opened``)."""
        pairs = todo.select("q", "qvec", F.explode("cands").alias("c"))
        joined = pairs.join(self.nodes.select(F.col("node").alias("c"), F.col("vec").alias("cvec")), "c")

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x, y = as_matrix(pdf["qvec"]).astype(float), as_matrix(pdf["cvec"]).astype(float)
                    yield pd.DataFrame({"q": pdf["q"], "c": pdf["c"], "s": np.einsum("ij,ij->i", x, y)})

        new = joined.mapInPandas(score, "q bigint, c bigint, s double").groupBy("q").agg(
            F.collect_list("c").alias("c"), F.collect_list("s").alias("s"))
        if pools is None:
            rows = new.select("q", "c", "s", F.array().cast("array<bigint>").alias("ids"),
                              F.array().cast("array<double>").alias("scores"), F.array().cast("array<bigint>").alias("opened"))
        else:
            rows = pools.select("q", "ids", "scores", "opened").join(new, "q", "left").select(
                "q", F.coalesce("c", F.array().cast("array<bigint>")).alias("c"),
                F.coalesce("s", F.array().cast("array<double>")).alias("s"), "ids", "scores", "opened")

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for q, c, s, ids, scores, opened in zip(*(pdf[k] for k in ("q", "c", "s", "ids", "scores", "opened")), strict=True):
                    ids, scores = np.concatenate([ids, c]).astype("int64"), np.concatenate([scores, s])
                    order = np.lexsort((ids, -scores))[:POOL]
                    ids, scores = ids[order], scores[order]
                    done = set(np.asarray(opened).tolist())
                    fresh = [i for i in ids[:BEAM].tolist() if i not in done]
                    out.append((q, ids, scores, [*done, *fresh], fresh))
                yield pd.DataFrame(out, columns=["q", "ids", "scores", "opened", "open"])

        return rows.mapInPandas(merge, "q bigint, ids array<bigint>, scores array<double>, opened array<bigint>, open array<bigint>")


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each id of
    ``queries`` (ids of ``table``) among all other rows of ``table``.

    Nearest: largest inner product in double precision, ties to the smaller
    id.  Vectors that are null, zero or hold null or non-finite components
    take no part, as query or candidate; nor do rows without id.  All vectors
    have one dimension.  An id given twice counts with one of its vectors; an
    empty table gives an empty result.
    """
    index = Index(table, id_col, vec_col, k + 1)
    spark = table.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not index.n:
        return spark.createDataFrame([], schema)
    asked = store(queries.select(F.col(id_col).cast("long").alias("query_id")).distinct()
                  .join(index.members, F.col("query_id") == F.col("vec_id")).select("query_id", "node"), "asked")
    pools = index.search(asked.select("node").distinct())
    # the k + 1 best ids: at most k + 1 copies of each of the k + 1 best nodes
    best = (pools.select("q", F.explode(F.slice(F.arrays_zip("ids", "scores"), 1, k + 1)).alias("p"))
            .select("q", F.col("p.ids").alias("node"), F.col("p.scores").alias("score"))
            .join(index.copies, "node").select("q", "score", F.explode("copies").alias("vec_id")))
    ranked = best.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
    lists = store(ranked.where(F.col("_r") <= k + 1).groupBy("q").agg(
        F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("best")), "nearest")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return (asked.join(lists, F.col("node") == F.col("q")).select("query_id", F.posexplode(others).alias("at", "b"))
            .select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score"))
