"""Queries of the classifier, URL and quality-rule operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import quality_gam, quality_rules, url_rules
from ..common import load
from . import query


@query("op7_quality_gam")
def op7(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    model = quality_gam.train(docs, load(spark, sf_dir, "labels"))
    scored = quality_gam.score_documents(docs, model)
    return scored.select("doc_id", quality_gam.held_out().alias("held_out"), "score", "predicted")


#: the rules every url is judged by
URL_RULES = [
    url_rules.host_rule("org", "/", "allow"),
    url_rules.host_rule("example.org", "/es/", "block"),
    url_rules.host_rule("example.org", "/en/1", "block"),
    url_rules.host_rule("com", "/fr/", "allow"),
    url_rules.host_rule("com", "/de/", "block"),
]

_RULE = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_CASES = " ".join(f"WHEN {_RULE.format(h=h, p=p)} THEN '{h}{p}'" for h, p in (
    ("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/fr/"), ("com", "/de/"), ("org", "/")))


@query("op9_url_rules", f"""
    WITH cut AS (SELECT page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    r AS (SELECT *, CASE {_CASES} END AS rule FROM cut)
    SELECT page_id, host, path, rule,
        CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
             WHEN host = '' THEN 'block' ELSE 'allow' END AS verdict
    FROM r""")
def op9(spark, sf_dir):
    return url_rules.judge_urls(load(spark, sf_dir, "pages"), URL_RULES)


@query("op10_quality_rules")
def op10(spark, sf_dir):
    judged = quality_rules.judge(load(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         F.col("base_failed"), F.col("kept"), *quality_rules.MEASURES)
