import re
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from quotecraft.llm import licenses, url_rules
from quotecraft.llm.queries import oracle_sql, queries
from quotecraft.llm.queries.filters import URL_RULES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracles(spark, name):
    got = queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(oracle_sql()[name]).df()[list(got.columns)]
    key = list(got.columns)[0]
    rows = lambda f: [tuple(None if x != x else x for x in r) for r in f.sort_values(key).itertuples(index=False)]
    assert rows(got) == rows(want)


def test_url_verdicts(spark):
    urls = {None: ("", "", None, "block"), "x.org/a": ("", "", None, "block"), "": ("", "", None, "block"),
            "http://A.Example.ORG/es/1?q=/en/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
            "http://example.org/en/19#x": ("example.org", "/en/19", "example.org/en/1", "block"),
            "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
            "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
            "http://example.org": ("example.org", "", None, "allow"),
            "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
            "http://x.com/DE/": ("x.com", "/DE/", None, "allow"),
            "http://xcom/fr/": ("xcom", "/fr/", None, "allow"),
            "http://a/?u=http://b.org/": ("a", "/", None, "allow")}
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*urls, *urls])] + [(None, "http://q.org/", "y")],
                                  "page_id bigint, url string, verdict string")
    got = url_rules.judge_urls(pages, URL_RULES).collect()
    assert len(got) == 2 * len(urls) + 1
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == urls[[*urls, *urls][r.page_id]]
    assert url_rules.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_a_rule_sits_under_its_rarest_token(spark):
    pages = spark.createDataFrame([(k, f"http://x.org/es/{k}") for k in range(9)] + [(9, "http://example.org/en/1")],
                                  "page_id bigint, url string")
    index = url_rules.rule_index(URL_RULES, pages)
    assert {r.name for r in index["example"]} >= {"example.org/es/"} and {r.name for r in index["org"]} == {"org/"}


def test_license_sequences(spark, tricky, no_docs):
    text = ("Intro.\nRedistribution and use in source and binary forms, with or without modification, are permitted. "
            "Something else! Neither the name of the copyright holder nor the names of its contributors may be used to "
            "endorse or promote products derived from this software without specific prior written permission.")
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "ALL RIGHTS RESERVED")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[1].licenses == ["bsd-3-clause", "bsd-2-clause"] and got[1].license == "bsd-3-clause"
    assert [h.id for h in got[1].hits] == ["S14", "S15"] and [h.at for h in got[1].hits] == [1, 3]
    assert got[2].licenses == got[3].licenses == [] and got[2].license is None and got[4].license == "all-rights-reserved"
    rows = {r.doc_id: r for r in licenses.scan(tricky).collect()}
    assert rows[500].licenses == ["mit", "all-rights-reserved"]
    assert licenses.scan(no_docs).count() == 0


MIT = """MIT License

Copyright (c) 2019 Some Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_3 = """Copyright (c) 2019, Some Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
GPL_3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
APACHE_2 = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD_2 = BSD_3[:BSD_3.index("3. Neither")] + BSD_3[BSD_3.index("THIS SOFTWARE"):]


def test_wrapped_licence_texts(spark):
    texts = {"mit-text": MIT, "bsd-3-clause": BSD_3, "bsd-2-clause": BSD_2, "gpl-3.0-header": GPL_3,
             "apache-2.0-header": APACHE_2}
    forms = {
        "plain": lambda t: t,
        "crlf": lambda t: t.replace("\n", "\r\n"),
        "hash": lambda t: "".join(f"# {x}".rstrip() + "\n" for x in t.splitlines()) + "import os\n",
        "block": lambda t: "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in t.splitlines()) + " */\nint main() {}\n",
        "narrow": lambda t: "\n\n".join(textwrap.fill(p, 40) for p in t.split("\n\n")),
        "one line": lambda t: " ".join(t.split()) if t is not APACHE_2 else t,
        "brackets": lambda t: re.sub(r"(?m)^(\d)\. ", r"(\1) ", t),
    }
    rows = [(f"{n}/{f}", make(t)) for n, t in texts.items() for f, make in forms.items()]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    # run together, MIT's title and BSD's copyright line belong to their first sentence
    loose = {"mit-text/one line", "bsd-3-clause/one line", "bsd-2-clause/one line"}
    assert {d: r.license for d, r in got.items() if d not in loose} == {d: d.split("/")[0] for d in got if d not in loose}
    pieces = spark.createDataFrame(rows, "doc_id string, text string").select(
        "doc_id", F.size(licenses.sentences(F.col("text"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == {d: r.n_sentences for d, r in got.items()}
