from collections import Counter

import brute

import corpus_pipeline as pipeline
from quotecraft.llm import mixing, packing, quality_gam
from quotecraft.llm.common import load

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = load(spark, SF, "documents")
    scores = {r.doc_id: r.predicted for r in
              quality_gam.score_documents(docs, quality_gam.train(docs, load(spark, SF, "labels"))).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    good = [(d, r.text) for d, r in rows.items() if scores[d] == 1]
    roots = brute.components(good)
    one = [(d, t) for (d, t), (n, c) in zip(good, roots, strict=True) if not n or c == d]
    cut = {d: (t if not gone else kept) for (d, t), (n, gone, kept) in
           zip(one, brute.cut_repeats([t for _, t in one]), strict=True) if not gone or gone < n}

    out = docs
    seen = []
    for _, stage in pipeline.STAGES[:-1]:
        out = pipeline.store(stage(spark, out, SF), "stage")
        assert out.columns == pipeline.COLUMNS
        seen.append({r.doc_id: r.text for r in out.collect()})
    assert seen[0] == dict(good) and seen[1] == dict(one) and seen[2] == cut and seen[3] == cut
    packed = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(cut)
    assert max(Counter(r.sequence_id for r in packed for _ in range(1)).values()) >= 1
    room = Counter()
    for r in packed:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048


def test_stages_on_tricky_rows(spark, tricky):
    out = tricky
    for _, stage in pipeline.STAGES:
        out = pipeline.store(stage(spark, out, SF), "stage")
    assert out.count() > 0


def test_stages_on_an_empty_table(spark, no_docs):
    out = no_docs
    for _, stage in pipeline.STAGES:
        out = pipeline.store(stage(spark, out, SF), "stage")
    assert out.count() == 0


def test_near_duplicates_keep_unrelated_texts(spark):
    """Several null ids, and one id on two different texts: none of them is a copy."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)),
            (8, text(6)), (9, text(6)), (None, text(2))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted([(None, text(1)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (8, text(6))], key=str)


def test_the_mix_reaches_the_sequences(spark, monkeypatch):
    """Other weights give other sequences; the heavy source comes first; ids are there."""
    text = lambda k: " ".join(f"w{(7 * k + j * j) % 997}" for j in range(20 + k % 50))
    docs = pipeline.store(spark.createDataFrame([(k, text(k), "en", "ab"[k % 2], len(text(k))) for k in range(2000)],
                                                "doc_id bigint, text string, lang string, source string, n_chars bigint"), "in")

    monkeypatch.setattr(packing, "SEGMENT", 250)

    def run(weights):
        monkeypatch.setattr(pipeline, "WEIGHTS", weights)
        mixed = pipeline.store(pipeline.mix(spark, docs, SF), "mix")
        rows = pipeline.pack(spark, mixed, SF).collect()
        assert sorted({r.mix_place for r in rows}) == list(range(2000)) and len({r.doc_id for r in rows}) == 2000
        last = max(r.sequence_id for r in rows)
        assert {r.sequence_id for r in rows} == set(range(last + 1))
        assert all(len(r.ids) == r.length for r in rows)
        for seq in range(last + 1):
            at = 0
            for offset, length in sorted((r.offset, r.length) for r in rows if r.sequence_id == seq):
                assert offset == at
                at += length
            assert at <= packing.CAPACITY
        place = {r.doc_id: r.mix_place for r in rows}
        want = {r.doc_id: (r.slot, r.place) for r in mixing.schedule(docs, weights).collect()}
        assert sorted(place, key=place.get) == sorted(want, key=want.get)
        early = [r for r in rows if r.sequence_id <= last // 3]
        share = sum(r.length for r in early if r.doc_id % 2 == 0) / sum(r.length for r in early)
        return share, {r.doc_id: r.sequence_id for r in rows}

    heavy_a, first = run({"a": 9.0, "b": 1.0})
    heavy_b, second = run({"a": 1.0, "b": 9.0})
    assert heavy_a > 0.7 and heavy_b < 0.3 and first != second
