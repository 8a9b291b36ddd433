"""URL filters: pattern rules found through their rarest literal token.

Every rule is a regular expression over ``host + path`` and lists the literal
tokens that any matching URL must hold.  A rule is indexed under the one of
its tokens that the corpus shows least often; a URL's tokens fetch candidate
rules, and only those run their expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import from_text, to_text

#: most rules one job takes; they travel to every task
MAX_RULES = 200_000
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    name: str               # e.g. "example.org/es/"
    verdict: str            # allow or block
    regex: str              # over host + path
    tokens: tuple[str, ...]  # literals that every match holds as whole tokens
    rank: int               # the longest fitting rule wins


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for ``host`` and its subdomains whose path starts with ``path``.

    Tokens of the path's last segment count only where the segment is closed
    by a slash, since a longer segment would hold another token.
    """
    host = host.lower()
    closed = path[:path.rfind("/") + 1].lower()
    return Rule(host + path, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}",
                tuple(dict.fromkeys(re.findall(TOKEN, host) + re.findall(TOKEN, closed))), len(host + path))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_index(rules: list[Rule], pages: DataFrame, url_col: str = "url") -> dict[str, list[Rule]]:
    """token -> rules, each rule under its token that fewest URLs of ``pages`` hold.

    The count covers every row; only tokens that some rule names are counted,
    so its result is bounded by the rules.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} travel to the tasks")
    named = sorted({t for r in rules for t in r.tokens})
    spark = pages.sparkSession
    wanted = spark.createDataFrame([(t,) for t in named], "token string")
    key = F.lower(F.concat(host_of(F.col(url_col)), path_of(F.col(url_col))))
    found = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(key, F.lit(f"({TOKEN})"), F.lit(1)))).alias("token"))
    seen = {r["token"]: r["n"] for r in found.join(F.broadcast(wanted), "token").groupBy("token")
            .agg(F.count(F.lit(1)).alias("n")).collect()}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.name!r} has no literal token to index")
        index.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), t)), []).append(r)
    return index


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", without_host: str = "block") -> DataFrame:
    """Per row: id, host, path, the winning rule (or null) and the verdict.

    The longest fitting rule wins, ties to the smaller name.  Without a rule
    the verdict is ``default``, or ``without_host`` where the URL is null or
    has no host.  Repeated rows are judged each; an empty table gives an
    empty result.
    """
    index = rule_index(rules, pages, url_col)
    compiled = {t: [(re.compile(r.regex, re.DOTALL), r.rank, r.name, r.verdict) for r in rs] for t, rs in index.items()}

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, verdicts = [], []
            for host, path in zip(pdf["host"], pdf["path"], strict=True):
                key, best = host + path, None
                for token in dict.fromkeys(re.findall(TOKEN, key.lower())):
                    for regex, rank, name, verdict in compiled.get(token, ()):
                        if (best is None or (-rank, name) < best[:2]) and regex.match(key):
                            best = (-rank, name, verdict)
                names.append(best[1] if best else None)
                verdicts.append(best[2] if best else default if host else without_host)
            yield pdf.assign(rule=pd.Series(names, dtype=object, index=pdf.index), verdict=verdicts)

    cut = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                       path_of(F.col(url_col)).alias("path"))
    judged = to_text(cut, ["page_id"]).mapInPandas(
        match, "page_id string, host string, path string, rule string, verdict string")
    return from_text(judged, cut, ["page_id"])
