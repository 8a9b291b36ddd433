"""Language-model scoring: interpolated modified Kneser-Ney, counted in Spark.

A text is its lower-cased words and one end symbol, seen after one start symbol.
Counting goes from the highest order down.  Blocks of documents send their
distinct n-grams to hash shards, which add them up and tell every block the total
counts and which block owns an n-gram.  Owners add each n-gram once to the
continuation count of its ending and to the follower counts of its context, so
both leave with the next order's n-grams: no group of one word or one context is
ever formed.

A shard of an order is a file of sorted hash arrays in the shared folder.  To
score, blocks send the n-grams they hold to the shards; the task of a shard maps
that one file into memory, looks the n-grams up and answers.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_table_path
from ..sources.tables import drop
from .array_files import map_arrays, write_arrays
from .common import _A, mix64, store
from .exchange import (ANSWER, MESSAGE, Shards, answer_columns, answer_frame, answer_row, coded, distinct,
                       from_three_bytes, keys_of, merge_shards, message_frame, pack_columns, squeeze, stored_blocks,
                       sum_stats, table_bytes, table_of, three_bytes, unpack_columns, unsqueeze)

ORDER = 3
#: bits of an n-gram's hash that count inside its shard, from order 2 on (words keep all 64): an n-gram that
#: was never seen is taken for another one in about one of a million look-ups, at every size of the corpus
GRAM_BITS = 40
#: discounts where the counts of counts give none (fixed values)
FALLBACK = (0.5, 1.0, 1.5)
#: columns the operator makes; ``keep`` cannot use their names
MADE = {"held_out", "_words", "_raw", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"}
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def _file(path: str, order: int, shard: int) -> str:
    return f"{path}/order-{order}/{shard:08d}.arrays"


def shard_arrays(keys: np.ndarray, cols: list[np.ndarray], narrow: bool) -> dict[str, np.ndarray]:
    """Sorted hash array and, per hash, a row of a table of the different figures."""
    code, table = coded(cols)
    values = np.stack(table, axis=1).astype(np.int64)
    small = np.uint8 if len(values) < 1 << 8 else np.uint16 if len(values) < 1 << 16 else np.uint32
    if not narrow:
        return {"keys": keys, "code": code.astype(small), "values": values}
    # how many hashes have each leading part, and the other 24 bits of each
    lead = np.bincount((keys >> np.uint64(24)).astype(np.int64), minlength=1 << (GRAM_BITS - 24))
    return {"lead": lead.astype(np.uint8 if lead.max() < 1 << 8 else np.uint32), "low": three_bytes(keys),
            "code": code.astype(small), "values": values}


class ShardArrays:
    """A shard's arrays, mapped from its file; ``n_cols`` figures a hash."""

    def __init__(self, path: str, n_cols: int):
        try:
            arrays = map_arrays(path)
        except FileNotFoundError:                      # no training n-gram fell into this shard
            arrays = shard_arrays(np.empty(0, np.uint64), [np.empty(0, np.int64)] * n_cols, False)
        self.known, self.code = arrays.get("keys"), arrays["code"]
        if self.known is None:
            lead = np.repeat(np.arange(len(arrays["lead"]), dtype=np.uint64), arrays["lead"])
            self.known = (lead << np.uint64(24)) | from_three_bytes(arrays["low"])
        #: figures by code; the last row, zeros, is that of hashes the shard does not hold
        self.table = [np.append(c, 0) for c in arrays["values"].T]

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Code of each of ``keys``."""
        absent = len(self.table[0]) - 1
        if not len(self.known):
            return np.full(len(keys), absent)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, self.code[at].astype(np.int64), absent)


# ---------------------------------------------------------------- blocks

def text_blocks(docs: DataFrame, keep: dict[str, str] | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Documents as blocks: the block's distinct words' hashes and each word's place among them,
    in a file of the shared folder that every later pass maps, so no text is shuffled.

    ``keep``: result columns (new name -> column of ``docs``; default doc_id).
    A row is held out if crc32(id as text) mod 10 is 0; a null id is held out.
    Null texts are empty."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(True))
    keep = keep or {"doc_id": id_col}
    if clash := MADE & set(keep):
        raise ValueError(f"the operator makes columns of its own: {sorted(clash)}")

    def encode(table: pa.Table) -> dict:
        import xxhash

        # Arrow's ASCII functions: A-Z only, and the six blanks; bytes beyond ASCII pass as they are
        text = pc.fill_null(table.column("_raw"), b"").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        split = pc.ascii_split_whitespace(pc.ascii_lower(text.view(pa.string())))
        words, to = split.flatten(), split.offsets.to_numpy()
        real = pc.greater(pc.binary_length(words), 0)    # blanks at an end leave an empty word
        before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        sizes = np.diff(before[to - to[0]])
        coded_words = pc.dictionary_encode(words.filter(real))
        hashes = b"".join(xxhash.xxh3_64_digest(w)[::-1] for w in coded_words.dictionary.view(pa.binary()).to_pylist())
        docs_of = table.drop_columns(["_raw"]).append_column("_words", pa.array(sizes, pa.int64()))
        path = f"{folder}/{uuid.uuid4().hex}.arrays"      # a task that runs again writes files of its own
        write_arrays(path, {"hashes": np.frombuffer(hashes, dtype="<u8"),
                            "codes": np.frombuffer(squeeze(pack_columns([coded_words.indices.to_numpy()])), dtype=np.uint8),
                            "docs": np.frombuffer(squeeze(table_bytes(docs_of)), dtype=np.uint8)})
        return {"docs": docs_of.slice(0, 0), "path": path.encode(), "n_tokens": int(sizes.sum()) + len(sizes)}

    folder = new_table_path(docs.sparkSession, "lm-block-arrays")
    return stored_blocks(docs, keep | {"held_out": held}, text_col, encode, ["path"], ["n_tokens"], "lm-blocks")


class Block:
    """Positions of a block: per document the start symbol, its words, the end symbol."""

    def __init__(self, row, training: bool, order: int, shards: list[Shards]):
        arrays = map_arrays(row["path"].decode())
        self.docs = table_of(arrays["docs"].tobytes())
        self.sizes = self.docs.column("_words").to_numpy().astype(np.int64)
        words = np.concatenate([arrays["hashes"], [START, END]])
        codes = unpack_columns(unsqueeze(arrays["codes"].tobytes()), 1, int(self.sizes.sum()))[0]
        lengths = self.sizes + 2
        ends = np.cumsum(lengths)
        self.first = ends - lengths                    # the start symbol of each document
        place = np.full(int(ends[-1]) if len(ends) else 0, len(words) - 1, dtype=np.int64)
        place[self.first] = len(words) - 2
        inside = np.ones(len(place), dtype=bool)
        inside[self.first] = inside[ends - 1] = False
        place[inside] = codes
        self.is_end = np.zeros(len(place), dtype=bool)
        self.is_end[ends - 1] = True
        self.is_start = np.zeros(len(place), dtype=bool)
        self.is_start[self.first] = True
        self.shards = shards
        counted = np.ones(len(place), dtype=bool)
        if training:
            counted = np.repeat(~self.docs.column("held_out").to_numpy(zero_copy_only=False), lengths)
        word = words[place]
        self.grams = [word]
        self.at = [np.flatnonzero(counted)]
        for k in range(2, order + 1):
            g = self.grams[-1]
            self.grams.append(mix64(g[:-1] * _A + word[k - 1:]))
            p = self.at[-1]
            # an n-gram goes on unless its last symbol ends the text
            self.at.append(p[~self.is_end[p + k - 2]])

    def keys(self, k: int) -> np.ndarray:
        """Keys of the k-grams at their positions."""
        return self.shards[k - 1].key(self.grams[k - 1][self.at[k - 1]])

    def counted(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys of the k-grams and how often each occurs."""
        keys = np.sort(self.keys(k))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
        return keys[first], np.diff(np.append(first, len(keys)))

    def places(self, k: int) -> np.ndarray:
        """A position of each distinct key, in the order of the keys."""
        keys = self.keys(k)
        order = np.argsort(keys)
        keys = keys[order]
        return self.at[k - 1][order[np.append(True, keys[1:] != keys[:-1])[:len(keys)]]]


def _order_columns(k: int, order: int) -> int:
    """Figures of a k-gram: its count; as a context the sum of its followers' counts
    and how many have a count of one, two and more; of a word also its plain count."""
    return 1 + (4 if k < order else 0) + (1 if k == 1 else 0)


def order_counts(block: Block, k: int, order: int, above: pd.DataFrame | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """What a block adds to its k-grams: at the highest order their count; below it
    the continuation counts and followers that its own (k+1)-grams give."""
    if k == order > 1:
        uniq, plain = block.counted(k)
        return uniq, [plain]
    uniq, _, which = distinct(block.keys(k))
    m, at = len(uniq), block.at[k - 1]
    if k == order:
        cols = [np.bincount(which, minlength=m)]
    else:
        p = block.places(k + 1)
        total, own = answer_columns(above, 1, own=True)
        index = np.full(len(block.is_end), -1, dtype=np.int64)
        index[at] = which
        context, ending = index[p][own], index[p + 1][own]
        total = total[own]
        count = np.bincount(ending, minlength=m)
        if k > 1:                                    # nothing stands before the start symbol
            count += np.bincount(which[block.is_start[at]], minlength=m)
        # sums of integers, exact as floats up to 2**53
        cols = [count, np.bincount(context, total, minlength=m).astype(np.int64),
                *(np.bincount(context[some], minlength=m) for some in (total == 1, total == 2, total > 2))]
    if k == 1:
        cols.append(np.bincount(which[~block.is_start[at]], minlength=m))
        if order == 1:
            cols[0] = cols[-1]
    return uniq, cols


# ---------------------------------------------------------------- the model

@dataclass
class KneserNey:
    """Where the arrays lie, their shards, and a few numbers per order."""

    path: str
    order: int
    shards: list[Shards]
    discounts: list[tuple[float, float, float]] = field(default_factory=list)
    #: of the words: sum and number of continuation counts, those of 1, 2 and more
    base: tuple[int, int, int, int] = (0, 0, 0, 0)
    train_tokens: int = 0
    vocabulary: int = 0


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; ``FALLBACK`` where a
    count of counts is zero or a discount leaves its range."""
    if not (n1 and n2 and n3 and n4):
        return FALLBACK
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return d if all(0 <= x <= k for k, x in enumerate(d, 1)) else FALLBACK


def _rows(pdf: pd.DataFrame):
    return (row for _, row in pdf.iterrows())


def _spread(blocks: DataFrame) -> DataFrame:
    """Some blocks a task: the table itself is small, the files its rows name are not."""
    return blocks.repartition(max(1, -(-blocks.count() // 4)))


def _sender(k: int, order: int, shards: list[Shards]):
    """Block rows and the answers of the order above -> messages of order k."""
    def send(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in _rows(pdf):
            block = Block(row, True, order, shards)
            if len(block.at[0]):
                out += shards[k - 1].send(int(row["block"]), *order_counts(block, k, order, above))
        return message_frame(out)
    return send


def _finisher(k: int, path: str):
    """Stores a merged shard of order k; sends the counts back, and the counts of counts as figures."""
    def finish(shard: int, keys: np.ndarray, sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
        write_arrays(_file(path, k, shard), shard_arrays(keys, sums, k > 1))
        count = sums[0]
        stats = [int((count == c).sum()) for c in (1, 2, 3, 4)] + [int(count.sum()), int((count > 2).sum())]
        return [count], stats + [int(sums[-1].sum()), int((sums[-1] > 0).sum())]
    return finish


def train(blocks: DataFrame, order: int = ORDER) -> KneserNey:
    """Count all training rows of ``blocks`` (see :func:`text_blocks`) and store the model."""
    spark = blocks.sparkSession
    tokens = int(blocks.agg(F.sum("n_tokens")).first()[0] or 0)
    shards = [Shards(tokens // 4)] + [Shards(tokens, GRAM_BITS) for _ in range(order - 1)]
    model = KneserNey(new_table_path(spark, "lm-model"), order, shards)
    path, answers = model.path, None
    for k in range(order, 0, -1):
        send, finish = _sender(k, order, shards), _finisher(k, path)
        if answers is None:
            sent = _spread(blocks).mapInPandas(lambda batches, send=send: (
                send(pdf.iloc[n:n + 1], None) for pdf in batches for n in range(len(pdf))), MESSAGE)
        else:
            sent = blocks.groupBy("block").cogroup(answers.where("block IS NOT NULL").groupBy("block")).applyInPandas(send, MESSAGE)
        before, answers = answers, store(merge_shards(sent, _order_columns(k, order), finish), "lm-counts")
        stats = sum_stats(answers, 8)
        model.discounts.insert(0, discounts_of(*stats[:4]))
        if before is not None:
            drop(spark, path=before.inputFiles()[0].rsplit("/", 1)[0])
    model.base = (stats[4], stats[0], stats[1], stats[5])
    model.train_tokens, model.vocabulary = stats[6], stats[7]
    return model


def _discount(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


def answers_of(blocks: DataFrame, model: KneserNey, k: int) -> DataFrame:
    """Figures of every k-gram that a block holds, from the mapped shards of order k."""
    shards, path, order, n_cols = model.shards, model.path, model.order, _order_columns(k, model.order)

    def ask(batches):
        for pdf in batches:
            for row in _rows(pdf):
                keys, _ = Block(row, False, k, shards).counted(k)
                yield message_frame(shards[k - 1].send(int(row["block"]), keys, []))

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        arrays = ShardArrays(_file(path, k, shard), n_cols)
        return answer_frame([answer_row(int(b), shard, arrays.look_up(keys_of(h, lo)), arrays.table)
                             for b, h, lo in zip(pdf["block"], pdf["high"], pdf["low"], strict=True)])

    found = _spread(blocks).mapInPandas(ask, MESSAGE).groupBy("shard").applyInPandas(answer, ANSWER)
    return store(found.withColumn("order", F.lit(k)), f"lm-answers-{k}")


def score(blocks: DataFrame, model: KneserNey, drop_model: bool = False) -> DataFrame:
    """Per document of ``blocks``: its columns, held_out, n_tokens, n_known,
    train_tokens, base_score, score and perplexity (10 to the power of -score / n_tokens).

    ``drop_model``: the model's files go once all n-grams are looked up (their figures are stored).
    Without any training token all words are unknown and the model is uniform over one."""
    order, shards, discounts = model.order, model.shards, model.discounts
    total, n1, n2, n3 = model.base
    n_train, vocabulary = model.train_tokens, model.vocabulary
    answers = None
    for k in range(order, 0, -1):
        one = answers_of(blocks, model, k)
        answers = one if answers is None else answers.unionByName(one)
    if drop_model:
        drop(blocks.sparkSession, path=model.path)

    def texts(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, found = left.to_pandas(), right.to_pandas()
        out = []
        for row in _rows(rows):
            block = Block(row, False, order, shards)
            # figures are worked out per distinct n-gram, then taken to the positions
            scored = ~block.is_start
            uniform = 1.0 / (vocabulary + 1)
            p = back = share = None
            for k in range(1, order + 1):
                cols = answer_columns(found[found["order"] == k], _order_columns(k, order))
                _, _, which = distinct(block.keys(k))
                first, d = block.at[k - 1], discounts[k - 1]
                over = np.maximum(cols[0] - _discount(cols[0], d), 0)
                if k == 1:
                    rest = (d[0] * n1 + d[1] * n2 + d[2] * n3) / total if total else 1.0
                    p = ((over / total if total else over * 0.0) + rest * uniform)[which]
                    known = (cols[-1] > 0)[which]
                    base = np.log10((cols[-1] + 0.1) / (n_train + 0.1 * (vocabulary + 1)))[which]
                else:
                    # the context of an n-gram starts where it starts
                    last = first + k - 1
                    p[last] = over[which] * share[first] + back[first] * p[last]
                if k < order:
                    up = discounts[k]
                    seen = cols[1] > 0
                    sums = np.maximum(cols[1], 1)
                    back, share = np.ones(len(p)), np.zeros(len(p))
                    back[first] = np.where(seen, (up[0] * cols[2] + up[1] * cols[3] + up[2] * cols[4]) / sums, 1.0)[which]
                    share[first] = np.where(seen, 1.0 / sums, 0.0)[which]
            p[block.is_start] = 1.0
            docs, n = block.docs, block.sizes + 1
            add = lambda v: np.add.reduceat(np.where(scored, v, 0), block.first)
            scores = add(np.log10(p))
            new = {"n_tokens": n, "n_known": add(known), "train_tokens": np.full(len(n), n_train),
                   "base_score": add(base), "score": scores, "perplexity": 10.0 ** (-scores / n)}
            docs = docs.drop_columns(["_words"])
            for name, v in new.items():
                docs = docs.append_column(name, pa.array(v, pa.float64() if v.dtype.kind == "f" else pa.int64()))
            out.append(docs)
        return pa.concat_tables(out) if out else empty

    kept = _kept_schema(blocks)
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
                           *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "perplexity"))])
    from pyspark.sql.pandas.types import to_arrow_schema
    empty = to_arrow_schema(schema).empty_table()
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(texts, schema)


def _kept_schema(blocks: DataFrame) -> list[T.StructField]:
    """Columns of the documents inside ``blocks``, from any one block."""
    from pyspark.sql.pandas.types import from_arrow_schema

    row = blocks.select("docs").first()
    if row is None:
        return [T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType())]
    return [f for f in from_arrow_schema(table_of(row["docs"]).schema).fields if f.name != "_words"]


def score_documents(docs: DataFrame, order: int = ORDER, keep: dict[str, str] | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows that are not held out and score every row (see :func:`score`).

    The model is this call's own and goes after use; :func:`train` and :func:`score` keep one.

    Null and empty texts are the end symbol alone.  Repeated rows are learned and
    scored each.  An empty table gives an empty result.  Texts are read whole.
    """
    blocks = text_blocks(docs, keep, id_col, text_col)
    return score(blocks, train(blocks, order), drop_model=True)
