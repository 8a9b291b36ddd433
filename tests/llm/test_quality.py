import zlib

import numpy as np

from quotecraft.llm import quality_gam, quality_rules
from quotecraft.llm.queries import queries
from quotecraft.llm.text_metrics import COUNTS, count_text

SF = "/root/testdata/sf0.01"


def test_counts_of_one_text():
    c = dict(zip(COUNTS, count_text("a b c # \n\na b c #\nx é%é ".encode()), strict=True))
    assert (c["n_words"], c["word_chars"], c["n_symbols"]) == (10, 12, 3)
    assert c["n_dup_lines"] == 0 and c["n_lines"] == 3
    assert c["n_repeat_words"] == 8               # "a b c #" twice: both windows of it
    assert dict(zip(COUNTS, count_text(b"x y\n \nx y\n \nx y"), strict=True))["n_dup_lines"] == 2
    assert count_text(None) == count_text(b"") == count_text(b" \n\t") == (0,) * len(COUNTS)


def test_rules_judge_every_row(tricky, no_docs):
    got = quality_rules.judge(tricky).collect()
    assert len(got) == tricky.count() and all(r.kept is not None and r.base_failed is not None for r in got)
    assert all(r.base_failed for r in got if r.n_words < 50)
    assert quality_rules.judge(no_docs).count() == 0


def test_thresholds_match_sorted_values(spark):
    """The sketch's fences against the same quantiles of all values."""
    m = quality_rules.text_metrics(spark.read.parquet(f"{SF}/documents.parquet"), "text",
                                   {"doc_id": "doc_id", "lang": "lang", "source": "source"})
    m = m.withColumns({k: quality_rules.share(n, d) for k, (n, d, _) in quality_rules.MEASURES.items()}).cache()
    got = {r.measure: (r.total, r.fence) for r in
           quality_rules.fences(quality_rules.merge(quality_rules.sketches(m, ["lang"]), []), []).collect()}
    rows = m.collect()
    for k, (_, _, least) in quality_rules.MEASURES.items():
        v = sorted(r[k] // quality_rules.WIDTH for r in rows)
        q = [(v[-(-len(v) * p // 4) - 1] + 1) * quality_rules.WIDTH for p in (2, 3)]
        assert got[k] == (len(v), max(least, q[1] + quality_rules.FENCE * (q[1] - q[0])))


def test_rules_keep_good_and_drop_bad(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [(labels[r.doc_id], r.base_failed, r.kept) for r in queries()["op10_quality_rules"](spark, SF).collect() if r.doc_id in labels]
    good = [k for q, b, k in got if q == 1 and not b]
    assert np.mean(good) > 0.97 and np.mean([k for q, _, k in got if q == 0]) < 0.1


def test_classifier_on_the_held_out_fold(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = queries()["op7_quality_gam"](spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    fold = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == q for p, q in fold]) > 0.97
    assert np.mean([p for p, q in fold if q == 1]) > 0.99


def test_classifier_edges(spark, tricky, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality_gam.train(tricky, none)
    assert {r.score for r in quality_gam.score_documents(tricky, model).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1), (10, None), (11, 1), (11, 1), (12, 1)], "doc_id bigint, quality int")
    got = quality_gam.score_documents(tricky, quality_gam.train(tricky, odd)).collect()
    assert len(got) == tricky.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_gam.score_documents(no_docs, model).count() == 0


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert (1, 0) in model.pairs and np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.85


def test_a_bad_source_does_not_lift_its_own_fence(spark):
    """One source with 60 % junk that holds most rows, beside three clean ones
    of its language and a language that has this source only."""
    rng = np.random.default_rng(5)
    rows, junk = [], set()
    for lang, source, n, bad in (("en", "s1", 60, 0), ("en", "s2", 60, 0), ("en", "s3", 60, 0),
                                 ("en", "hot", 400, 60), ("de", "hot", 100, 30)):
        for k in range(n):
            words = [f"w{x}x" for x in rng.integers(0, 5000, 80)]
            if 100 * k < bad * n:
                words = [w + "#" if i % 2 else w for i, w in enumerate(words)]
                junk.add(len(rows))
            rows.append((len(rows), " ".join(words), lang, source))
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert len(got) == len(rows) and not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if not r.kept} == junk
