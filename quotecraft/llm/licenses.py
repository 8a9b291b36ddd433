"""License scan by sentence-rule recognition, in DataFrame functions only.

A text is cut into sentences, each sentence is normalised (ASCII letters and
digits in lower case, all else one space) and mapped to the identifier of the
known licence sentence it equals; the identifiers of a text, in order, are
matched against licence rules, which are ordered runs of identifiers.

Licence texts are wrapped and often stand in comments.  A line end inside a
sentence joins the two lines (comment marks are no letters and go with the
normalising); blank lines, list items and sentence ends cut.  Single lines are
looked up as well, so a notice of one line needs no full stop around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: identifier -> normalised sentence (fixed values: public licence wording)
SENTENCES = {
    "S01": "licensed under the apache license version 2 0",
    "S02": "licensed under the apache license version 2 0 the license",
    "S03": "you may not use this file except in compliance with the license",
    "S04": "you may obtain a copy of the license at",
    "S05": "released under the mit license",
    "S06": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
           "associated documentation files the software to deal in the software without restriction",
    "S07": "the software is provided as is without warranty of any kind express or implied",
    "S08": "this work is licensed under the gnu general public license version 3",
    "S09": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
           "general public license as published by the free software foundation",
    "S10": "this program is distributed in the hope that it will be useful but without any warranty",
    "S11": "licensed under cc by nc 4 0",
    "S12": "licensed under cc by 4 0",
    "S13": "licensed under cc by sa 4 0",
    "S14": "redistribution and use in source and binary forms with or without modification are permitted",
    "S15": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
           "promote products derived from this software without specific prior written permission",
    "S16": "this work is in the public domain",
    "S17": "all rights reserved",
}
#: licence -> run of identifiers, most specific rule first
RULES = [
    ("apache-2.0-header", ["S02", "S03", "S04"]),
    ("bsd-3-clause", ["S14", "S15"]),
    ("gpl-3.0-header", ["S09", "S10"]),
    ("mit-text", ["S06", "S07"]),
    ("apache-2.0", ["S01"]),
    ("apache-2.0", ["S02"]),
    ("mit", ["S05"]),
    ("gpl-3.0", ["S08"]),
    ("cc-by-nc-4.0", ["S11"]),
    ("cc-by-sa-4.0", ["S13"]),
    ("cc-by-4.0", ["S12"]),
    ("bsd-2-clause", ["S14"]),
    ("public-domain", ["S16"]),
    ("all-rights-reserved", ["S17"]),
]
#: whole sentences of the licence texts: (identifier, normalised sentence); an
#: identifier may have several wordings
TEXTS = [
    ("T01", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
            "of the software and to permit persons to whom the software is furnished to do so subject to the "
            "following conditions"),
    ("T02", "the above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the software"),
    ("T02", "the above copyright notice and this permission notice including the next paragraph shall be included in "
            "all copies or substantial portions of the software"),
    ("T03", "the software is provided as is without warranty of any kind express or implied including but not limited "
            "to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("T04", "in no event shall the authors or copyright holders be liable for any claim damages or other liability "
            "whether in an action of contract tort or otherwise arising from out of or in connection with the software "
            "or the use or other dealings in the software"),
    ("T05", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("T06", "redistributions of source code must retain the above copyright notice this list of conditions and the "
            "following disclaimer"),
    ("T07", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
            "following disclaimer in the documentation and or other materials provided with the distribution"),
    *[("T08", f"this software is provided by the copyright {who} as is and any express or implied warranties "
              "including but not limited to the implied warranties of merchantability and fitness for a particular "
              "purpose are disclaimed") for who in ("holders and contributors", "holder and contributors")],
    *[("T09", f"in no event shall the copyright {who} or contributors be liable for any direct indirect incidental "
              "special exemplary or consequential damages including but not limited to procurement of substitute goods "
              "or services loss of use data or profits or business interruption however caused and on any theory of "
              "liability whether in contract strict liability or tort including negligence or otherwise arising in any "
              "way out of the use of this software even if advised of the possibility of such damage")
      for who in ("holder", "holders", "owner")],
    ("T10", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation either version 3 of the license or at your "
            "option any later version"),
    ("T11", "this program is distributed in the hope that it will be useful but without any warranty without even the "
            "implied warranty of merchantability or fitness for a particular purpose"),
    ("T12", "see the gnu general public license for more details"),
    ("T13", "you should have received a copy of the gnu general public license along with this program"),
    *[("T14", f"if not see {scheme} www gnu org licenses") for scheme in ("http", "https")],
    ("T15", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
            "with the license"),
    *[("S04", f"you may obtain a copy of the license at {scheme} www apache org licenses license 2 0")
      for scheme in ("http", "https")],
    ("T16", "unless required by applicable law or agreed to in writing software distributed under the license is "
            "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("T17", "see the license for the specific language governing permissions and limitations under the license"),
]
#: licence text -> run of identifiers, most specific rule first; they go before RULES
TEXT_RULES = [
    ("apache-2.0-header", ["T15", "S04", "T16", "T17"]),
    ("bsd-3-clause", ["T05", "T06", "T07", "S15", "T08", "T09"]),
    ("bsd-2-clause", ["T05", "T06", "T07", "T08", "T09"]),
    ("gpl-3.0-header", ["T10", "T11", "T12", "T13"]),
    ("mit-text", ["T01", "T02", "T03", "T04"]),
]
SENTENCE_END = r"[.!?]+[ \t\r]+|[\r\n]+"
NOT_WORD = r"[^A-Za-z0-9\n]+"


def sentences(text: Column) -> Column:
    """Array of the normalised, non-empty sentences of ``text``, in order."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), SENTENCE_END, "\n")
    plain = F.lower(F.regexp_replace(cut, NOT_WORD, " "))
    return F.filter(F.transform(F.split(plain, "\n"), lambda s: F.trim(s)), lambda s: s != "")


#: a list marker: "1. ", "2) ", "(a) "
_ITEM = r"[(]?(?:[0-9]{1,2}|[A-Za-z])[.)][ \t]"
#: ends of whole sentences: a sentence end; a colon or a list item at a line end; blank lines, also with comment marks
_WHOLE_END = (r"[.!?]+(?:[ \t]+|[\"')\]*/ \t]*\n)|:[^A-Za-z0-9\n]*\n|\n(?:[^A-Za-z0-9\n]*\n)+"
              rf"|\n(?=[^A-Za-z0-9\n(]*{_ITEM})")
#: ends inside a line that SENTENCE_END does not know: a list item after a colon, and the marker of an item
_INLINE_END = rf":[ \t]+(?={_ITEM})|\)(?<=[\x01\x02][ \t(]{{0,8}}[0-9A-Za-z]{{1,2}}\))[ \t]+"


def whole_sentences(text: Column) -> tuple[Column, Column]:
    """(sentences, number of pieces that :func:`sentences` cuts): the first an
    array of (text, lines), the normalised sentence over its line ends and the
    normalised lines it was joined from, with a newline between."""
    raw = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x01\x02]", " "), r"\r\n?", "\n")
    # \x01 ends a sentence and a piece, \x02 a sentence only, a newline left a piece only
    cut = F.regexp_replace(F.regexp_replace(raw, _WHOLE_END, "\x01"), _INLINE_END, "\x02")
    lines = F.lower(F.regexp_replace(cut, r"[^A-Za-z0-9\n\x01\x02]+", " "))
    pieces = F.filter(F.split(F.translate(lines, "\x02", " "), r"[\n\x01]"), lambda s: F.trim(s) != "")
    whole = F.transform(F.split(lines, r"[\x01\x02]"), lambda s: F.struct(
        F.trim(F.regexp_replace(s, r"[ \n]+", " ")).alias("text"), s.alias("lines")))
    return F.filter(whole, lambda s: s["text"] != ""), F.size(pieces)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         catalogue: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Per row: doc_id, n_sentences, hits (array of (sentence index, identifier)),
    licenses (names of all matching rules, in rule order, without repeats) and
    license (the first of them, or null).

    A sentence is looked up whole, over its line ends, and by its single lines;
    ``at`` counts whole sentences, ``n_sentences`` the pieces of :func:`sentences`.
    A rule matches a run of whole sentences or a run of single pieces.  The
    licence texts (``TEXTS``) are known besides a ``catalogue`` only where none
    is given.  Null and empty texts have no sentence and no licence; repeated
    rows are scanned each; an empty table gives an empty result.  One narrow pass.
    """
    texts = [] if catalogue else TEXTS
    rules = rules or ([] if catalogue else TEXT_RULES) + RULES
    short = [(s, k) for k, s in (catalogue or SENTENCES).items()]
    both = short + [(s, k) for k, s in texts]
    ids = F.create_map(*[F.lit(x) for pair in both for x in pair])
    whole, pieces = whole_sentences(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole.alias("_s"), pieces.cast("long").alias("n_sentences"))

    def known(s: Column, i: Column) -> Column:
        one = lambda t, is_whole, is_line: F.struct(
            i.alias("at"), F.element_at(ids, t).alias("id"), is_whole.alias("whole"), is_line.alias("line"))
        lines = F.filter(F.transform(F.split(s["lines"], "\n"), lambda t: F.trim(t)), lambda t: t.isin([t for t, _ in short]))
        single = F.size(lines) == 1
        by_line = F.transform(lines, lambda t: one(t, t == s["text"], F.lit(True)))
        # a sentence of one line is found by its line already
        seen = single & F.array_contains(lines, s["text"])
        joined = F.when(s["text"].isin([t for t, _ in both]) & ~seen, F.array(one(s["text"], F.lit(True), F.lit(False))))
        return F.concat(by_line, F.coalesce(joined, F.filter(by_line, lambda t: F.lit(False))))

    found = rows.select("doc_id", "n_sentences", F.flatten(F.transform("_s", known)).alias("_h"))
    run = lambda kind: F.concat(F.lit("|"), F.array_join(F.transform(
        F.filter("_h", lambda h: h[kind]), lambda h: h["id"]), "||"), F.lit("|"))
    names = [F.when(F.col("_whole").contains(seq) | F.col("_line").contains(seq), F.lit(name))
             for name, seq in ((name, "|" + "||".join(seq) + "|") for name, seq in rules)]
    matched = (found.withColumns({"_whole": run("whole"), "_line": run("line")})
               .withColumn("licenses", F.array_distinct(F.array_compact(F.array(*names)))))
    hits = F.transform("_h", lambda h: F.struct(h["at"].alias("at"), h["id"].alias("id")))
    return matched.select("doc_id", "n_sentences", hits.alias("hits"), "licenses",
                          F.when(F.size("licenses") > 0, F.element_at("licenses", 1)).alias("license"))


def oracle() -> str:
    """The scan in DuckDB SQL, digest columns of the checked query: the
    single pieces only, without ``TEXTS`` and sentences over several lines."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(q(s) for s in SENTENCES.values())
    case = " ".join(f"WHEN {q(s)} THEN {q(k)}" for k, s in SENTENCES.items())
    hit = lambda seq: f"contains(run, {q('|' + '||'.join(seq) + '|')})"
    by_name: dict[str, list[str]] = {}
    for name, seq in RULES:
        by_name.setdefault(name, []).append(hit(seq))
    tests = ", ".join(f"CASE WHEN {' OR '.join(c)} THEN {q(n)} END" for n, c in by_name.items())
    return f"""
    WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(lower(regexp_replace(regexp_replace(
             coalesce(text, ''), '[.!?]+[ \\t\\r]+|[\\r\\n]+', chr(10), 'g'), '[^A-Za-z0-9\\n]+', ' ', 'g')), chr(10)),
             lambda x: trim(x)), lambda x: x <> '') AS sents FROM documents),
    h AS (SELECT doc_id, len(sents) AS n_sentences,
             list_transform(list_filter(sents, lambda x: x IN ({known})), lambda x: CASE x {case} END) AS ids FROM s),
    r AS (SELECT doc_id, n_sentences, ids, '|' || coalesce(array_to_string(ids, '||'), '') || '|' AS run FROM h)
    SELECT doc_id, n_sentences, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ' '), '') AS sentence_ids,
           coalesce(array_to_string(list_filter([{tests}], lambda x: x IS NOT NULL), ','), '') AS licenses,
           list_filter([{tests}], lambda x: x IS NOT NULL)[1] AS license
    FROM r"""
