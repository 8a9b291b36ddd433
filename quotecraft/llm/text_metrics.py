"""Per-document measures of whole texts, read by the quality operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import from_text, to_text, window_hashes, word_hashes, words_of

#: counts of one text, all long
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
          "n_digits", "n_stops", "n_marks", "n_distinct", "n_runs", "n_short"]

_SPACE = np.array([9, 10, 11, 12, 13, 32])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_STOPS = np.frombuffer(b".,", dtype=np.uint8)
_MARKS = np.frombuffer(b"!?;:", dtype=np.uint8)


def count_text(raw: bytes | None) -> tuple[int, ...]:
    """``COUNTS`` of one UTF-8 text; null and empty texts give zeros.

    word_chars: code points in words; n_symbols: characters of ``#*$%&|<>``;
    n_dup_lines: lines (split at \\n) with a word that equal an earlier line;
    n_repeat_words: words in a 3-word window that occurs twice or more in the
    text, its first occurrence included; n_lines: lines with a word;
    n_upper, n_digits: ASCII capitals and digits; n_stops: ``.`` and ``,``;
    n_marks: ``!?;:``; n_distinct: different words; n_runs: words equal to the
    word before; n_short: words of one or two bytes.
    """
    words = words_of(raw)
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    of = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    chars = len(raw) - int(of[0x80:0xC0].sum()) - int(of[_SPACE].sum())
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    h = word_hashes(words)[:, 0]
    repeated = 0
    if n >= 4:
        _, inverse, counts = np.unique(window_hashes(h, 3), return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        if again.any():
            covered = np.zeros(n, dtype=bool)
            for k in range(3):
                covered[k:n - 2 + k] |= again
            repeated = int(covered.sum())
    return (n, chars, int(of[_SYMBOLS].sum()), dup, repeated, lines, int(of[65:91].sum()),
            int(of[48:58].sum()), int(of[_STOPS].sum()), int(of[_MARKS].sum()), len(set(words)),
            int((h[1:] == h[:-1]).sum()), sum(len(w) < 3 for w in words))


def text_metrics(docs: DataFrame, text_col: str = "text", keep: dict[str, str] | None = None,
                 derive: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
                 derived: str = ", ".join(f"`{c}` bigint" for c in COUNTS)) -> DataFrame:
    """``COUNTS`` of every row's whole text, beside the columns ``keep``
    (new name -> column of ``docs``).  One narrow pass, no shuffle.

    ``derive`` turns the counts of a batch into the columns ``derived``
    instead, in the same pass.
    """
    keep = keep or {"doc_id": "doc_id"}
    names = list(keep)
    cols = docs.select(*[F.col(c).alias(new) for new, c in keep.items()],
                       F.col(text_col).cast("string").cast("binary").alias("_raw"))

    def count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = pd.DataFrame([count_text(t) for t in pdf["_raw"]], columns=COUNTS, dtype="int64")
            yield pd.concat([pdf[names].reset_index(drop=True), derive(counts) if derive else counts], axis=1)

    schema = ", ".join([*(f"`{c}` string" for c in names), derived])
    return from_text(to_text(cols, names).mapInPandas(count_batches, schema), cols, names)
