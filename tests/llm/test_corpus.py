"""Language model, token alignment and source audit against plain-Python versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quotecraft.llm import array_files, exchange, lm_scoring, source_divergence, token_alignment
from quotecraft.llm.common import mix64


def rows_of(df, *cols):
    key = lambda t: tuple((x is None, x) for x in t)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


def near(a, b):
    return len(a) == len(b) and all(
        all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) else x == y for x, y in zip(p, q, strict=True))
        for p, q in zip(a, b, strict=True))


# ---------------------------------------------------------------- language model

def tokens(text):
    return [bytes(w).lower() for w in (text or "").encode().split()] + ["</s>"]


def plain_kneser_ney(train, n):
    """Counts as dictionaries of tuples: p(word | context tuple)."""
    grams = {n: collections.Counter()}
    for t in train:
        s = ["<s>", *t]
        for k in range(len(s) - n + 1):
            grams[n][tuple(s[k:k + n])] += 1
    shorter = collections.Counter(tuple(["<s>", *t][:k]) for t in train for k in range(2, n) if len(t) >= k - 1)
    for k in range(n - 1, 0, -1):
        lefts = collections.defaultdict(set)
        every = {tuple(["<s>", *t][i:i + k + 1]) for t in train for i in range(len(t) + 1 - k)}
        for g in every:
            lefts[g[1:]].add(g[0])
        grams[k] = collections.Counter({g: len(v) for g, v in lefts.items()})
        grams[k].update({g: c for g, c in shorter.items() if len(g) == k and k > 1})
    if n == 1:
        grams[1].pop(("<s>",), None)
    vocabulary = len({w for t in train for w in t})
    discounts, followers = {}, {}
    for k, c in grams.items():
        discounts[k] = lm_scoring.discounts_of(*(sum(v == x for v in c.values()) for x in (1, 2, 3, 4)))
        followers[k] = collections.defaultdict(list)
        for g, v in c.items():
            followers[k][g[:-1]].append(v)

    def p(word, context):
        k = len(context) + 1
        if k == 1:
            lower = 1 / (vocabulary + 1)
        else:
            lower = p(word, context[1:])
        d, seen = discounts[k], followers[k].get(context, [])
        if not seen:
            return lower
        cut = lambda c: d[min(c, 3) - 1] if c else 0
        c = grams[k].get((*context, word), 0)
        return (c - cut(c)) / sum(seen) + sum(map(cut, seen)) / sum(seen) * lower

    return p


def held(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 10 == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_plain_kneser_ney(spark, tricky, order, monkeypatch):
    monkeypatch.setattr(exchange, "SHARD_ENTRIES", 4000)
    docs = tricky.where("doc_id IS NULL OR doc_id NOT IN (300)").select("doc_id", "text", "shard", "score").withColumnsRenamed(
        {"score": "base", "shard": "order"})
    docs = docs if order != 3 else tricky.select("doc_id", "text")
    plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    train = [tokens(t) for d, t in plain if not held(d)]
    p = plain_kneser_ney(train, order)
    count = collections.Counter(w for t in train for w in t)
    total, v = sum(count.values()), len(count)
    want = []
    for d, text in plain:
        t = tokens(text)
        s = ["<s>", *t]
        score = sum(math.log10(p(s[i], tuple(s[max(0, i - order + 1):i]))) for i in range(1, len(s)))
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (v + 1))) for w in t)
        want.append((d, held(d), len(t), sum(count[w] > 0 for w in t), total, base, score))
    keep = {"doc_id": "doc_id"} | ({c: c for c in ("order", "base") if c in docs.columns})
    got = lm_scoring.score_documents(docs, order, keep)
    assert set(keep) <= set(got.columns)
    cols = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert near(rows_of(got, *cols), sorted(want, key=lambda t: tuple((x is None, x) for x in t)))


def test_probabilities_add_up_to_one():
    rng = random.Random(3)
    train = [[f"w{int(rng.paretovariate(0.8)) % 30}" for _ in range(rng.randrange(1, 30))] + ["</s>"] for _ in range(200)]
    p = plain_kneser_ney(train, 3)
    words = sorted({w for t in train for w in t}) + ["never seen"]
    for context in [(), ("w1",), ("w1", "w2"), ("<s>",), ("<s>", "w1"), ("new", "w1"), ("new", "new")]:
        assert math.isclose(sum(p(w, context) for w in words), 1, rel_tol=1e-9)


def test_model_files_are_mapped_and_rewritten_whole(tmp_path):
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    cols = [rng.integers(0, 400, len(keys)), rng.integers(0, 1 << 40, len(keys))]
    path = f"file:{tmp_path}/model/order-2/00000000.arrays"
    for _ in range(2):                                       # a task that runs again
        array_files.write_arrays(path, lm_scoring.shard_arrays(keys, cols, True))
    arrays = array_files.map_arrays(path)
    assert isinstance(arrays["low"].base, np.memmap) or isinstance(arrays["low"], np.memmap)
    ask = np.unique(np.concatenate([keys[::3], rng.integers(0, 1 << 40, 100, dtype=np.uint64)]))
    at = {int(k): i for i, k in enumerate(keys)}
    shard = lm_scoring.ShardArrays(path, 2)
    for c, found in zip(cols, [t[shard.look_up(ask)] for t in shard.table], strict=True):
        assert found.tolist() == [int(c[at[int(k)]]) if int(k) in at else 0 for k in ask]
    assert len(list(tmp_path.glob("model/order-2/*"))) == 1


def test_held_out_texts_and_empty_tables(spark, no_docs):
    assert lm_scoring.score_documents(no_docs).count() == 0
    out = [d for d in range(400) if held(d)][:3]
    docs = spark.createDataFrame([(d, "a b") for d in out], "doc_id bigint, text string")
    got = lm_scoring.score_documents(docs).collect()         # nothing to learn from
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 and r.n_tokens == 3 for r in got)
    with pytest.raises(ValueError):
        lm_scoring.text_blocks(docs, {"held_out": "doc_id"})
    with pytest.raises(ValueError):
        lm_scoring.score_documents(docs, keep={"score": "doc_id"})


def test_learned_order_beats_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = {n: lm_scoring.score_documents(docs, n).where("held_out").agg(F.sum("score")).first()[0] for n in (1, 2, 3)}
    assert by[3] > by[2] > by[1]


# ---------------------------------------------------------------- exchange

def test_hash_is_inverted_and_columns_come_back():
    h = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (exchange.unmix64(mix64(h)) == h).all()
    cols = [np.array([0, 1, 255]), np.array([3, 1 << 33, 0]), np.array([0, 0, 0])]
    assert [c.tolist() for c in exchange.unpack_columns(exchange.pack_columns(cols), 3, 3)] == [c.tolist() for c in cols]


def test_shards_add_up_what_blocks_send(spark):
    entries = 20 * exchange.SHARD_ENTRIES                    # many shards, few entries
    shards = exchange.Shards(entries, 40)
    rng = np.random.default_rng(2)
    pool = shards.key(rng.integers(0, 1 << 64, 600, dtype=np.uint64))
    sent, rows = {}, []
    for b in range(5):
        keys = np.unique(rng.choice(pool, 300))
        sent[b] = (keys, rng.integers(0, 1000, len(keys)))
        rows += shards.send(b, keys, [sent[b][1]])
    messages = spark.createDataFrame(exchange.message_frame(rows), exchange.MESSAGE)
    merged = exchange.merge_shards(messages, 1, lambda s, k, sums: (sums, [len(k)])).toPandas()
    total, owners = collections.Counter(), collections.Counter()
    for keys, n in sent.values():
        total.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    for b, (keys, _) in sent.items():
        n, own = exchange.answer_columns(merged[merged["block"] == b], 1, own=True)
        assert n.tolist() == [total[k] for k in keys.tolist()]
        owners.update(keys[own].tolist())
    assert set(owners.values()) == {1} and len(owners) == len(total)


# ---------------------------------------------------------------- token alignment

def plain_alignment(texts):
    """Groups and links by sets of byte positions; A's ids by the tokenizers library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    a_of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_of.encode_special_tokens = True
    first, second = token_alignment.TokenizerA(), token_alignment.TokenizerB()
    aligned = []
    for text in texts:
        if not text:
            aligned.append(([], [], [], []))
            continue
        a, b, raw = a_of.encode(" " + text, add_special_tokens=False).ids, second.encode(text), b" " + text.encode()
        if b"".join(first.bytes_of[i] for i in a) != raw or b"".join(second.bytes_of[i] for i in b) != raw:
            aligned.append(([], [], [], []))
            continue
        spans = []
        for ids, of in ((a, first), (b, second)):
            at, mine = 0, []
            for i in ids:
                mine.append((at, at + len(of.bytes_of[i]), i))
                at += len(of.bytes_of[i])
            spans.append(mine)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, lo = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for s, t, i in side if lo <= s and t <= e) for side in spans))
            lo = e
        links = [(i, j) for s, t, i in spans[0] for u, v, j in spans[1] if s < v and u < t]
        aligned.append((a, b, groups, links))
    count = collections.Counter(p for *_, links in aligned for p in set(links))
    best = collections.defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(len(a), len(b), len(g), len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, x in aligned]


def test_alignment_equals_plain_version(spark, tricky, no_docs, monkeypatch):
    monkeypatch.setattr(token_alignment, "SLICE_BYTES", 3000)
    odd = ["a▁b", " two  blanks ", "tab\tand\r\nline", "naïve café — “x” 日本語 🙂🙂", "<s> </s> <|endoftext|> <0x41>",
           "x" * 300, "\u0000nul", "ＡＢ ﬁ ①", "   ", "\n\n\n", "é ‍"]
    docs = tricky.where("doc_id IS NULL OR doc_id <> 300").select("doc_id", "text", "shard").unionByName(
        spark.createDataFrame([(900 + k, t, None) for k, t in enumerate(odd)], "doc_id bigint, text string, shard string")).repartition(3)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(d, *x) for (d, _), x in zip(plain, plain_alignment([t for _, t in plain]), strict=True)]
    got = token_alignment.alignment(docs, keep={"doc_id": "doc_id", "shard": "shard"})
    assert rows_of(got, *cols) == sorted(want, key=lambda t: tuple((x is None, x) for x in t))
    assert rows_of(got.where("doc_id = 900"), *cols[1:]) == [(0, 0, 0, 0, 0, 0, "")]
    assert token_alignment.alignment(no_docs).count() == 0
    with pytest.raises(ValueError):
        token_alignment.alignment(docs, keep={"n_a": "doc_id"})


def test_a_very_long_text_is_aligned_whole(spark, tricky):
    docs = tricky.where("doc_id = 300")
    r = token_alignment.alignment(docs).first()
    text = docs.first().text
    assert (r.n_a, r.n_b, r.n_groups, r.n_links) == plain_lengths(text)


def plain_lengths(text):
    a, b = token_alignment.TokenizerA(), token_alignment.TokenizerB()
    ends = [set(np.cumsum([len(t.bytes_of[i]) for i in t.encode(text)]).tolist()) for t in (a, b)]
    # each token but a group's last pair adds one link: tokens of both sides less the common ends
    return len(ends[0]), len(ends[1]), len(ends[0] & ends[1]), len(ends[0]) + len(ends[1]) - len(ends[0] & ends[1])


# ---------------------------------------------------------------- source audit

def plain_audit(rows):
    docs = [(la or "", s or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in
                                 re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, la, s in rows]
    out = []
    for lang in sorted({d[0] for d in docs}):
        mine = [d for d in docs if d[0] == lang]
        in_docs = collections.Counter(t for *_, ts in mine for t in set(ts))
        kept = [t for t, n in in_docs.items() if n >= 3]
        v = len(kept)
        count = {s: collections.Counter(t for _, x, ts in mine if x == s for t in ts if in_docs[t] >= 3) for s in {d[1] for d in mine}}
        whole = sum(count.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            parts = {"pair": [(t, sum(f(p[s][x], p[t][x]) for x in kept)) for t in p if t != s],
                     "term": [(x, f(p[s][x], q[x])) for x in kept if count[s][x] > 0 and p[s][x] > q[x]]}
            for part, items in parts.items():
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, i, value, k) for k, (i, value) in enumerate(items, 1) if part == "pair" or k <= 200]
    return sorted(out)


def test_audit_equals_plain_version(spark, tricky, no_docs, monkeypatch):
    odd = [("Ünïcode ÄB ab Ab-aB x1y2 日本 日本語", None, "a"), ("ab ab日 日本\u007fx", "", None), ("AB", "", ""), (None, "zz", "only"),
           ("...", "yy", "s"), ("eightlet eightletters eightlet", "yy", "t"), ("eightletters eightlet", "yy", "s"), ("Eightletters eightlet abc", "yy", "u")]
    docs = tricky.select("text", "lang", "source", F.col("n_words").alias("term"), F.col("score").alias("rank")).unionByName(
        spark.createDataFrame(odd, "text string, lang string, source string").selectExpr("*", "1 AS term", "0.5D AS rank"))
    want = plain_audit([(r.text, r.lang, r.source) for r in docs.collect()])
    for size in (source_divergence.SLICE_BYTES, 2000):
        monkeypatch.setattr(source_divergence, "SLICE_BYTES", size)
        got = source_divergence.audit(docs.repartition(3))
        assert sorted(tuple(r) for r in got.collect()) == want
    assert source_divergence.audit(no_docs).count() == 0


def test_pointers_are_sorted_by_their_terms():
    rng = random.Random(11)
    terms = ["".join(rng.choice("abÿ日") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    terms += [t + "tail" for t in terms[:500]] + ["a" * 8, "a" * 16, "a" * 17] * 3
    texts = [" ".join(terms[k:k + 50]).encode() for k in range(0, len(terms), 50)]
    text, ends = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts])
    start, length = source_divergence.term_starts(text, ends)
    whole = text.tobytes()
    found = [whole[s:s + n] for s, n in zip(start, length, strict=True)]
    assert found == [t.encode() for t in terms]                 # terms end with their text
    order, new = source_divergence.sort_pointers(text, start, length)
    ordered = [found[k] for k in order]
    assert ordered == sorted(found)
    assert new.tolist() == [k == 0 or ordered[k] != ordered[k - 1] for k in range(len(ordered))]


def test_block_table_round_trip():
    t = pa.table({"x": pa.array([1, None]), "y": ["a", None]})
    assert exchange.table_of(exchange.squeeze(exchange.table_bytes(t))).equals(t)
    assert exchange.unsqueeze(exchange.squeeze(b"")) == b""
