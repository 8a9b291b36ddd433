"""Query of the license scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import licenses
from ..common import load
from . import query


@query("op5_license_scan", licenses.oracle())
def op5(spark, sf_dir):
    found = licenses.scan(load(spark, sf_dir, "documents"))
    ids = F.transform("hits", lambda h: h["id"])
    return found.select("doc_id", "n_sentences", F.size("hits").cast("long").alias("n_known"),
                        F.array_join(ids, " ").alias("sentence_ids"),
                        F.array_join("licenses", ",").alias("licenses"), "license")
