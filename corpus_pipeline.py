"""From raw documents to packed sequences in five stages, each on all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloft.llm.classifier import good_documents
from keyloft.llm.common import Scratch, table, tokenizer_path
from keyloft.llm.decontamination import contamination, text_key
from keyloft.llm.minhash import near_duplicates
from keyloft.llm.packing import pack
from keyloft.llm.quality_rules import quality_rules
from keyloft.operators.chunking import running_sum
from keyloft.scratch import released


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more, learned from those of them that have a label and are not held out."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the histogram rules; the references come from this stage's own input."""
    return quality_rules(docs, whole=True).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest doc_id, of each group of near-duplicate texts (5-word shingles, 0.8).

    Rows that repeat a doc_id are judged each by its own text: those of near-duplicate texts go but for one, unrelated texts
    under one doc_id all stay. Texts without words are equal under one doc_id and differ between two. Rows without a doc_id
    stay.
    """
    scratch = Scratch(spark, "near-dedup")  # ids that go are written first, so that the join below knows their size
    gone_of = lambda df: scratch.save(near_duplicates(df).filter("not kept").select("doc_id").distinct(), "gone")
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    repeated = scratch.save(repeated, "repeated")
    if repeated.isEmpty():
        return docs.join(gone_of(docs), "doc_id", "left_anti").select(docs.columns)
    # each text of a doc_id gets a number of its own, in the order of doc_id
    text = F.col("text").cast("string")
    keyed = docs.withColumn("_text", F.when(text.rlike("[^ \\t-\\r]"), F.sha2(text, 256)).otherwise(F.lit("")))
    texts = scratch.save(keyed.filter("doc_id is not null").select("doc_id", "_text").distinct(), "ids-and-texts")
    nodes = scratch.save(running_sum(texts, ["doc_id", "_text"], F.lit(1), "_node"), "nodes")
    rows = scratch.save(keyed.join(nodes, ["doc_id", "_text"]), "numbered")
    gone = gone_of(rows.select(F.col("_node").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_node")
    left = rows.join(gone, "_node", "left_anti")
    once = left.join(repeated, "doc_id", "left_anti")
    # of rows with one id and one text the first by their other columns stays
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = left.join(repeated, "doc_id", "left_semi").groupBy("_node").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return once.select(docs.columns).unionByName(several).unionByName(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, however long they are."""
    scratch = Scratch(spark, "contaminated")
    bad = scratch.save(contamination(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select("text_key").distinct(), "texts")
    return docs.join(bad, text_key(F.col("text")) == bad.text_key, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of 4096 tokens."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A fitted classifier and packing are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, with a table in the shared folder between two stages.

    What a stage wrote for itself goes once its result is written, the result once the next one is.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with released(spark):
            kept = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
