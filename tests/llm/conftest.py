import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def tricky(spark):
    """Documents with nulls in every column, empty and very long texts, exact
    and near copies, shared passages and repeated rows, beside columns whose
    names clash with those that the operators make."""
    rng = random.Random(7)
    base, passage = prose(rng, 160), prose(rng, 60, 5000)
    rows = [(0, None, "en", "a"), (1, "", "en", "a"), (2, " \n\t ", None, "a"), (None, base, "en", None),
            (3, "one two", "en", "a"), (4, "One TWO", "en", "a"), (5, "solo", "de", None), (7, "É é\x1f x", "fr", "b")]
    rows += [(10 + k, base, "en", "hot") for k in range(12)]
    for k in range(30):                       # near copies: a few words changed
        w = base.split()
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"new{k}"
        rows.append((100 + k, " ".join(w), "en", "hot"))
    rows += [(200 + k, prose(rng, 70, 9000) + "\n" + passage + "\n" + prose(rng, 50, 9000), "de", f"s{k % 3}") for k in range(8)]
    rows += [(300, prose(rng, 30_000, 20_000), "en", "b"), (301, "lorem " * 400, "en", "b"), (302, "z" * 5000, "en", "b")]
    rows += [(400 + k, prose(rng, 40 + k, 9000), "en", f"s{k % 4}") for k in range(40)]
    rows += [(400, rows[-40][1], "en", "s0")] * 2          # repeated rows
    rows += [(500, "Some text. Released under the MIT License.\nAll rights reserved.", "en", "b"),
             (501, "<|endoftext|> it's 12  3\n\n x", "en", "b")]
    full = [(d, t, la, s, None if t is None else len(t), "x", 9, 0.5) for d, t, la, s in rows]
    return spark.createDataFrame(full, DOCS + ", shard string, n_words int, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
