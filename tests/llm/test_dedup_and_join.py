import hashlib
from collections import Counter

import brute
import numpy as np

from quotecraft.llm import ngram_join, substring_dedup
from quotecraft.llm.common import window_hashes
from quotecraft.llm.sketch import Shape, pack_sorted, scaled, unpack_sorted


def test_substring_dedup_equals_brute_force(tricky):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    want = Counter((d, *x) for (d, _), x in zip(rows, brute.cut_repeats([t for _, t in rows]), strict=True))
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(tricky).collect())
    assert got == want


def test_a_full_sketch_loses_no_window(tricky, monkeypatch):
    """With far too few slots every estimate is too high and the exact pass decides."""
    monkeypatch.setattr(substring_dedup, "SLOTS_PER_WINDOW", 1)
    monkeypatch.setattr(substring_dedup, "DEPTH", 1)
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    want = Counter((d, x[1]) for (d, _), x in zip(rows, brute.cut_repeats([t for _, t in rows]), strict=True))
    assert Counter((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(tricky).collect()) == want


def test_ngram_components_equal_brute_force(tricky):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    want = Counter((d, *x) for (d, _), x in zip(rows, brute.components(rows), strict=True))
    # documents without words are linked with nothing: their component is their own id
    want = Counter({(d, n, c if n else d): k for (d, n, c), k in want.items()})
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(tricky).collect())
    assert got == want


def test_links_chain_to_the_smallest_id(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 50), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in ngram_join.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 50: 50, 100: 50}


def test_empty_tables(no_docs):
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    assert ngram_join.ngram_components(no_docs).count() == 0


def test_digest_query(spark):
    from quotecraft.llm.queries import queries
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {d.doc_id: (n, g, hashlib.sha256(k.encode()).hexdigest())
            for d, (n, g, k) in zip(docs, brute.cut_repeats([d.text for d in docs]), strict=True)}
    got = queries()["op2_substring_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_window_hashes_and_sketch_codes():
    h = np.random.default_rng(1).integers(0, 1 << 62, 500).astype(np.uint64)
    h[200:240] = h[100:140]
    w = window_hashes(h, 35)
    assert len(w) == 466 and len(np.unique(w)) == 466 - 6
    a = np.unique(h % np.uint64(100_000)).astype(np.int64)
    assert (unpack_sorted(pack_sorted(a)) == a).all()
    shape = Shape(10_000_000, 2, 4)
    for slots in shape.rows(h, h):
        assert slots.min() >= 0 and slots.max() < shape.slots


def test_every_slot_can_be_reached():
    """Whole 64-bit hashes are scaled: more slots than 2**32 do not share them."""
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    for slots in (1 << 12, 1 << 21, (1 << 32) - 5, 1 << 32, 1 << 33, 3_000_000_000_000):
        assert scaled(h, slots).tolist() == [int(x) * slots >> 64 for x in h]
    near = (np.uint64(7) << np.uint64(32)) + np.arange(4096, dtype=np.uint64) * np.uint64(1 << 20)   # equal high halves
    assert len(np.unique(scaled(near, 1 << 44))) == 4096


def test_components_of_a_family_that_one_centre_does_not_join(spark):
    """Chains of versions of a text: each is similar to its neighbours only, so rounds must go on."""
    rng = __import__("random").Random(13)
    rows = []
    for family in range(4):
        text = [f"f{family}w{k}" for k in range(60)]
        for k in range(40):
            rows.append((1000 * family + k, " ".join(text)))
            text = list(text)
            text[rng.randrange(60)] = f"f{family}n{k}"
    want = Counter((d, *x) for (d, _), x in zip(rows, brute.components(rows), strict=True))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect())
    assert got == want and len({c for _, _, c in want}) == 4
