"""Cross-tokenizer alignment: groups and links between the tokens of two tokenizers.

Both token sequences of a text cut the same bytes.  All tokens of a slice of
documents are sorted by start; where a start reaches the running maximum of the
ends before it, both sequences end a token and a group ends.  Inside the groups
each token of A meets the tokens of B whose byte ranges overlap its own.

How many documents hold an id pair linked is a figure of the whole corpus: blocks
send their distinct pairs to hash shards and get the counts back, so no table of
all pairs is ever in one place.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, store
from .exchange import (MESSAGE, Shards, answer_columns, merge_shards, message_frame, pack_columns, squeeze,
                       stored_blocks, table_of, unmix64, unpack_columns, unsqueeze)

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k", "piece_bpe_32k"
#: bytes of text whose tokens are held as arrays at once
SLICE_BYTES = 1 << 20


class TokenizerA:
    """Byte-level BPE; ids and the bytes of each id."""

    def __init__(self, vocabulary: str = VOCABULARY_A):
        import base64

        import public_tokenizers as known
        import tiktoken

        with open(known.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding(vocabulary, pat_str=known.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, n in ranks.items():
            self.bytes_of[n] = token
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(" " + text)


class TokenizerB:
    """Sentence pieces, which put the space before the text themselves."""

    def __init__(self, vocabulary: str = VOCABULARY_B):
        import public_tokenizers as known
        import sentencepiece

        self._pieces = sentencepiece.SentencePieceProcessor(model_file=known.path(f"{vocabulary}.model"))
        n = self._pieces.get_piece_size()
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self._pieces.is_byte(i) else p.replace("▁", " ").encode()
                         for i, p in ((i, self._pieces.id_to_piece(i)) for i in range(n))]
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

    def encode(self, text: str) -> list[int]:
        return self._pieces.encode(text)


@lru_cache(maxsize=2)
def _tokenizers(a: str, b: str):
    """Tokenizers of this worker and the texts of their ids with each separator."""
    first, second = TokenizerA(a), TokenizerB(b)
    n = max(len(first.bytes_of), len(second.bytes_of))
    return first, second, [b"%d" % i + s for s in (b",", b"|", b";") for i in range(n)], n


def align(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray):
    """(order, group of each ordered token, A and B place of each link).

    ``order`` lists A's tokens and then B's (numbered on) by start, A before B at a tie.
    """
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    side = np.zeros(len(start), dtype=np.int8)
    side[len(a_start):] = 1
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order]) if len(order) else end
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = start[order][1:] >= reach[:-1]
    group = np.cumsum(opens) - 1
    # B's tokens that end after A's starts and start before it ends, which lie in its group
    lo = np.searchsorted(b_end, a_start, side="right")
    n = np.searchsorted(b_start, a_end, side="left") - lo
    link_a = np.repeat(np.arange(len(a_start)), n)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return order, group, link_a, link_b


class _Slice:
    """Aligned tokens of some documents: figures per document, its distinct pairs and how often each."""

    def __init__(self, texts: list[bytes | None], vocabularies: tuple[str, str]):
        first, second, written, n_ids = _tokenizers(*vocabularies)
        a_ids: list[int] = []
        b_ids: list[int] = []
        n_a, n_b = [], []
        for raw in texts:
            a: list[int] = []
            b: list[int] = []
            if raw:
                text = raw.decode("utf-8", "replace")
                a, b = first.encode(text), second.encode(text)
                whole = b" " + raw
                if b"".join(map(first.bytes_of.__getitem__, a)) != whole or b"".join(map(second.bytes_of.__getitem__, b)) != whole:
                    a = b = []
            a_ids += a
            b_ids += b
            n_a.append(len(a))
            n_b.append(len(b))
        self.n_a, self.n_b = np.array(n_a, dtype=np.int64), np.array(n_b, dtype=np.int64)
        m = len(texts)
        a, b = np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)
        a_end, b_end = np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b])
        order, group, link_a, link_b = align(a_end - first.lengths[a], a_end, b_end - second.lengths[b], b_end)
        doc_a, doc_b = np.repeat(np.arange(m), self.n_a), np.repeat(np.arange(m), self.n_b)
        doc = np.concatenate([doc_a, doc_b])[order]
        heads = np.ones(len(order), dtype=bool)
        heads[1:] = group[1:] != group[:-1]
        self.n_groups = np.bincount(doc[heads], minlength=m)
        self.n_links = np.bincount(doc_a[link_a], minlength=m)
        # texts of the groups: A's tokens before B's inside a group
        by = np.lexsort((order >= len(a), group))
        ids = np.concatenate([a, b])[order][by]
        g, from_b = group[by], (order >= len(a))[by]
        mark = np.zeros(len(ids), dtype=np.int64)
        mark[:-1][(from_b[1:] != from_b[:-1])] = 1
        mark[:-1][g[1:] != g[:-1]] = 2
        mark[-1:] = 2
        codes, at, self.sha = (ids + mark * n_ids).tolist(), 0, []
        for k in (self.n_a + self.n_b).tolist():
            line = b"".join(map(written.__getitem__, codes[at:at + k]))
            self.sha.append(hashlib.sha256(line[:-1]).hexdigest() if k else "")
            at += k
        # pairs of a document, and how many links each has
        pair = (a[link_a].astype(np.uint64) << np.uint64(32)) | b[link_b].astype(np.uint64)
        self.pairs, code = np.unique(mix64(pair), return_inverse=True)
        held, self.times = np.unique((doc_a[link_a] << 32) | code, return_counts=True)
        self.doc, self.code = held >> 32, held & 0xFFFFFFFF


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None,
              vocabularies: tuple[str, str] = (VOCABULARY_A, VOCABULARY_B)) -> DataFrame:
    """Per row: ``keep`` columns (default doc_id), n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level vocabulary that encodes a space and the text, B a vocabulary of
    pieces that puts the space itself.  Strings of special tokens are plain text.  Null and
    empty texts, and texts whose tokens do not give back the space and the text, have no
    tokens: zeros and ''.  Repeated rows are documents each; an empty table gives an empty
    result.  Texts are read whole.
    """
    keep = keep or {"doc_id": id_col}
    made = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "_pairs", "_raw"]
    if set(made) & set(keep):
        raise ValueError(f"the operator makes columns of its own: {sorted(set(made) & set(keep))}")

    def encode(table: pa.Table) -> dict:
        texts = table.column("_raw").to_pylist()
        slices, held, size = [], [], 0
        for n, raw in enumerate(texts):
            held.append(raw)
            size += len(raw) if raw else 0
            if size >= SLICE_BYTES or n + 1 == len(texts):
                slices.append(_Slice(held, vocabularies))
                held, size = [], 0
        pairs = np.unique(np.concatenate([s.pairs for s in slices]))
        docs_of, codes, n_pairs = np.zeros(len(pairs), dtype=np.int64), [], []
        for s in slices:
            code = np.searchsorted(pairs, s.pairs)[s.code]
            docs_of += np.bincount(code, minlength=len(pairs))
            codes.append(code)
            n_pairs.append(np.bincount(s.doc, minlength=len(s.n_a)))
        out = table.drop_columns(["_raw"])
        for name, parts in (("n_a", [s.n_a for s in slices]), ("n_b", [s.n_b for s in slices]),
                            ("n_groups", [s.n_groups for s in slices]), ("n_links", [s.n_links for s in slices]),
                            ("_pairs", n_pairs)):
            out = out.append_column(name, pa.array(np.concatenate(parts), pa.int64()))
        out = out.append_column("groups_sha256", pa.array([h for s in slices for h in s.sha], pa.string()))
        return {"docs": out, "pairs": pairs.astype("<u8").tobytes(), "counts": squeeze(pack_columns([docs_of])),
                "held": squeeze(pack_columns([np.concatenate(codes), np.concatenate([s.times for s in slices])])),
                "n_pairs": len(pairs), "n_held": sum(len(c) for c in codes)}

    blocks = stored_blocks(docs, keep, text_col, encode, ["pairs", "counts", "held"], ["n_pairs", "n_held"], "alignment-blocks")
    shards = Shards(int(blocks.agg(F.sum("n_pairs")).first()[0] or 0))

    def send(batches):
        for pdf in batches:
            for block, pairs, counts in zip(pdf["block"], pdf["pairs"], pdf["counts"], strict=True):
                keys = np.frombuffer(pairs, dtype="<u8")
                yield message_frame(shards.send(int(block), keys, unpack_columns(unsqueeze(counts), 1, len(keys))))

    def first_ids(keys: np.ndarray, shard: int) -> np.ndarray:
        whole = keys | (np.uint64(shard) << np.uint64(64 - shards.j)) if shards.j else keys
        return (unmix64(whole) >> np.uint64(32)).astype(np.int64)

    def finish(shard: int, keys: np.ndarray, sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
        # the shard's highest count of each A id: id and count by turns
        a = first_ids(keys, shard)
        ids, which = np.unique(a, return_inverse=True)
        top = np.zeros(len(ids), dtype=np.int64)
        np.maximum.at(top, which, sums[0])
        return sums, np.column_stack([ids, top]).ravel().tolist()

    answers = store(merge_shards(blocks.select("block", "pairs", "counts").mapInPandas(send, MESSAGE), 1, finish), "alignment-counts")
    each = answers.where("block IS NULL AND size(stats) > 0").select(
        "stats", F.explode(F.expr("sequence(0, cast(size(stats) div 2 as int) - 1)")).alias("k")).select(
        F.element_at("stats", 2 * F.col("k") + 1).alias("a"), F.element_at("stats", 2 * F.col("k") + 2).alias("n"))
    # one number per id of A's vocabulary: bounded by the vocabulary
    best = np.zeros(len(_tokenizers(*vocabularies)[0].bytes_of), dtype=np.int64)
    for row in each.groupBy("a").agg(F.max("n").alias("n")).toLocalIterator():
        best[row["a"]] = row["n"]

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        found, out = right.to_pandas(), []
        for row in left.to_pylist():
            table = table_of(row["docs"])
            count = answer_columns(found, 1)[0]
            a = (unmix64(np.frombuffer(row["pairs"], dtype="<u8")) >> np.uint64(32)).astype(np.int64)
            code, times = unpack_columns(unsqueeze(row["held"]), 2, row["n_held"])
            times = times.astype(np.int64)
            n = table.column("_pairs").to_numpy()
            of = np.repeat(np.arange(len(n)), n)
            figures = {"n_best": times * (count == best[a])[code], "count_sum": times * count[code]}
            table = table.drop_columns(["_pairs"])
            for name, v in figures.items():
                sums = np.zeros(len(n), dtype=np.int64)
                np.add.at(sums, of, v)
                table = table.append_column(name, pa.array(sums, pa.int64()))
            out.append(table.select(names))
        return pa.concat_tables(out) if out else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    kept = docs.select(*[F.col(c).alias(n) for n, c in keep.items()]).schema.fields
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
                           T.StructField("groups_sha256", T.StringType())])
    names, empty = schema.names, to_arrow_schema(schema).empty_table()
    kept_blocks = blocks.select("block", "docs", "pairs", "held", "n_held")
    return kept_blocks.groupBy("block").cogroup(answers.where("block IS NOT NULL").groupBy("block")).applyInArrow(total, schema)


__all__ = ["alignment", "align", "TokenizerA", "TokenizerB"]
