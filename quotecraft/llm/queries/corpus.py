"""Queries of the language model, the token alignment and the source audit."""

from __future__ import annotations

from .. import lm_scoring, source_divergence, token_alignment
from ..common import load
from . import query


@query("op11_lm_scoring")
def op11(spark, sf_dir):
    return lm_scoring.score_documents(load(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


@query("op12_token_alignment")
def op12(spark, sf_dir):
    return token_alignment.alignment(load(spark, sf_dir, "documents"))


@query("op13_source_divergence", """
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      coalesce(text, '') AS text FROM documents),
    t AS (SELECT row, lang, source, unnest(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
    groups AS (SELECT DISTINCT lang, source FROM d),
    cnt AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
    cells AS (SELECT g.lang, g.source, k.term, coalesce(cnt.n, 0) AS n, k.c,
                     sum(coalesce(cnt.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
                     count(*) OVER (PARTITION BY g.lang, g.source) AS v
              FROM groups g JOIN kept k ON k.lang = g.lang
              LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = k.term),
    whole AS (SELECT lang, sum(c) AS total FROM kept GROUP BY lang),
    p AS (SELECT cells.lang, source, term, n,
                 1 + (1000000000::HUGEINT * (n + 1)) // (cells.total::HUGEINT + v) AS p,
                 1 + (1000000000::HUGEINT * (c + 1)) // (whole.total::HUGEINT + v) AS q
          FROM cells JOIN whole ON whole.lang = cells.lang),
    pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
             FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
             LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
             LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
             GROUP BY a.lang, a.source, b.source),
    term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
    both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pair
                   UNION ALL SELECT lang, source, 'term', item, value FROM term),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
    FROM ranked WHERE part = 'pair' OR rank <= 200""")
def op13(spark, sf_dir):
    return source_divergence.audit(load(spark, sf_dir, "documents"))
