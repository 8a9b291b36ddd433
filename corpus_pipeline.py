"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage to the shared folder and reads it
back, so a lost executor costs a stage's tasks and never its predecessors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotecraft.llm import mixing, ngram_join, packing, quality_gam, substring_dedup
from quotecraft.llm.common import load, store, stored_order

#: target weight per source; None: the square root of its rows
WEIGHTS: dict[str, float] | None = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model does not reject (score of 0.3 or more).

    Null and empty texts are scored as texts without words; repeated rows are judged each, alike;
    other columns pass as they are, nulls included; an empty table stays empty."""
    model = quality_gam.train(docs, load(spark, sf_dir, "labels"))
    scored = quality_gam.score_documents(docs, model, keep={c: c for c in COLUMNS})
    return scored.where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts: the smallest id, ties
    to the smaller hash.  Texts without words are in no component and stay;
    of rows repeated whole one stays."""
    found = store(ngram_join.ngram_components(docs), "near-duplicates")
    winners = (found.where("n_shingles > 0").groupBy("root")
               .agg(F.min(F.struct("doc_id", "key")).alias("w")).select(F.col("w.key").alias("_key")))
    stay = winners.unionByName(found.where("n_shingles = 0").select(F.col("key").alias("_key")))
    keyed = docs.select(*COLUMNS).withColumn("_key", F.xxhash64("doc_id", F.col("text").cast("binary")))
    return keyed.join(stay, "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated windows; documents left without any word go."""
    keep = {c: c for c in ("doc_id", "lang", "source")}
    cut = substring_dedup.remove_repeats(docs, keep=keep, untouched_as_is=True)
    return (cut.where("n_removed = 0 OR n_removed < n_words")
            .select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                    F.length("kept_text").cast("long").alias("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the source mix (weight: square root of a source's rows).

    A null source is a source of its own; repeated rows, null and empty texts keep a place each;
    an empty table stays empty."""
    return mixing.mixed(docs.select(*COLUMNS), WEIGHTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with token ids and the document's place in the
    mix, and their place in the packed sequences.  The mix is the order in which
    the stage before stored its rows; sequences are made and numbered along it.  A null or empty
    text is its closing token alone; repeated rows are packed each; no rows, no pieces."""
    return packing.pack(stored_order(docs, "mix_place"), keep_ids=True, order_col="mix_place")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("source mixing", mix),
    ("best-fit packing", pack),
]

#: learning, similarity components and packing are beyond SQL; the tests hold a
#: brute-force version of the stages against ``run``
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read back.  Columns besides
    those of ``documents`` go in the first stage; an empty table passes through all of them."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
