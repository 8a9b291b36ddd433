"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks.  Block i of a source with weight w may
start at slot floor(i / w) and is due at slot ceil((i + 1) / w); at every slot
the released block due earliest is taken.  Any prefix of the mix then holds
less than one block more or less of each source than its weight asks for.

Weights are multiples of 1 / UNIT, so rounding shifts no block before some 10^12
of them, and every block is scheduled by itself.  When a source is used up its
weight is shared out among the others and the next phase begins, so every
document has a place: nothing is dropped or repeated.  The driver works out one
entry a block, a few numbers for ``BLOCK_ROWS`` documents.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import number_rows

BLOCK_ROWS = 32
#: rows of one numbering bucket, about: few, since they may carry whole documents,
#: and the same with and without, since buckets decide the order inside a source
NUMBERED = 2_000
#: weights are whole multiples of one part in so many
UNIT = 1 << 40
#: a null source is a source of its own under this name
NO_SOURCE = "\x00null"


def whole_weights(weights: dict[str, float], period: int) -> dict[str, int]:
    """Blocks per period of each source, at least one, adding up to ``period``
    (largest remainders; ties to the smaller name)."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    k = 0
    while (gap := period - sum(out.values())) != 0:
        s = order[k % len(order)] if gap > 0 else max(out, key=lambda t: (out[t], t))
        out[s] += 1 if gap > 0 else -1
        k += 1
    return out


def phases(sizes: dict[str, int], weights: dict[str, float]) -> dict[str, list]:
    """Columns of one row per block: source, block, phase, weight, release,
    deadline and slot, the last three counted over the whole mix.

    ``sizes``: blocks per source.  At every slot the released block due earliest
    is taken (ties to the smaller name); a phase lasts until its first source is
    used up.  A source's next block is due later, so one block each is waiting.
    """
    left, done, base, phase = {s: n for s, n in sizes.items() if n}, dict.fromkeys(sizes, 0), 0, 0
    out: dict[str, list] = {c: [] for c in ("_key", "block", "phase", "weight", "release", "deadline", "slot")}
    while left:
        per = whole_weights({s: weights[s] for s in left}, UNIT)
        taken, slot = dict.fromkeys(left, 0), 0
        ready = [(-(-UNIT // w), s) for s, w in per.items()]
        heapq.heapify(ready)
        waiting: list[tuple[int, int, str]] = []
        while True:
            while waiting and waiting[0][0] <= slot:
                heapq.heappush(ready, heapq.heappop(waiting)[1:])
            due, s = heapq.heappop(ready)
            i, w = taken[s], per[s]
            for c, v in zip(out, (s, done[s] + i, phase, w / UNIT, base + i * UNIT // w, base + due, base + slot), strict=True):
                out[c].append(v)
            taken[s], slot = i + 1, slot + 1
            if i + 1 == left[s]:
                break
            heapq.heappush(waiting, ((i + 1) * UNIT // w, -(-(i + 2) * UNIT // w), s))
        for s, n in taken.items():
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        base, phase = base + slot, phase + 1
    return out


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id",
             source_col: str = "source", block_rows: int = BLOCK_ROWS, power: float = 0.5,
             carry: bool = False) -> DataFrame:
    """doc_id, source, block, phase, weight, release, deadline, slot, place of every row.

    ``weights``: target weight per source (a null source under ``NO_SOURCE``);
    sources missing there, or all without it, weigh their row count to
    ``power``.  release and deadline count slots of the whole mix; ``place``
    is the row's place inside its block; ``carry`` adds the whole row as the
    struct ``doc``.  Repeated rows are rows of their own;
    ties are broken by the row's hash; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("_key"),
                       *([F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if carry else []))
    rows = rows.withColumn("_order", F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("id")))
    extra = ["doc"] if carry else []
    sizes = {r["_key"]: int(r["n"]) for r in rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).orderBy("_key").collect()}
    given = weights or {}
    target = {s: float(given.get(s, n ** power)) for s, n in sizes.items()}
    if any(w <= 0 for w in target.values()):
        raise ValueError("weights are positive")
    plan = phases({s: math.ceil(n / block_rows) for s, n in sizes.items()}, target)
    kinds = pa.schema([("_key", pa.string()), ("block", pa.int64()), ("phase", pa.int32()), ("weight", pa.float64()),
                       ("release", pa.int64()), ("deadline", pa.int64()), ("slot", pa.int64())])
    table = docs.sparkSession.createDataFrame(pa.table(plan, schema=kinds))
    numbered = number_rows(rows, "_key", "_order", "_n", sum(sizes.values()), NUMBERED).drop("_order")
    numbered = numbered.withColumn("block", (F.col("_n") / block_rows).cast("long"))
    # one row per block: the planner broadcasts a small table, and no key has more than block_rows rows
    return numbered.join(table, ["_key", "block"]).select(
        "doc_id", "source", "block", "phase", "weight", "release", "deadline", "slot",
        F.pmod(F.col("_n"), F.lit(block_rows)).cast("int").alias("place"), *extra)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id",
          source_col: str = "source", **more) -> DataFrame:
    """The rows of ``docs``, all columns, in the order of the mix."""
    placed = schedule(docs, weights, id_col, source_col, carry=True, **more)
    return placed.orderBy("slot", "place").select("doc.*")
