"""From raw documents to packed token sequences: five operators, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import common, exact, mixing, near, packing, quality, queries


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs of their language.

    Null and empty texts have too few words and go.  A null language is a language; without labels no cutoff is proven
    and the base rules alone decide; copies of a labelled text count once.  Rows are judged one by one, so repeated
    ones stay or go together, and an empty table stays empty.  Texts are read whole; all columns are kept.
    """
    told = docs.select("doc_id", "lang", "text", F.md5(F.coalesce("text", F.lit(""))).alias("same"))
    metrics = common.materialise(quality.with_metrics(told).drop("text"), "metrics")
    cutoffs = quality.learn(metrics, spark.read.parquet(f"{sf_dir}/labels.parquet"), "lang", text_key="same")
    judged = quality.judge(quality.with_metrics(common.wrapped(docs, "lang", "text", row="doc")), cutoffs, "lang")
    return judged.where("kept").select(*common.fields(judged, "doc"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id, and one of several with that id.

    Null counts as the empty text, null ids as the smallest; an empty table stays empty; all columns are kept.
    """
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id.

    Texts without words are linked with nothing and stay; repeated rows are one document and stay or go together (the
    stage before this one leaves none).  Null ids are the largest; an empty table stays empty; all columns are kept.
    """
    return near.drop_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, the last time if at least half of it is taken.

    A null source is a source; documents without words are taken never; equal rows are separate documents.  Ties in
    the seeded order take the same; an empty table stays empty; all columns are kept.
    """
    sized = common.wrapped(docs, "doc_id", "source", row="doc").withColumn("size", common.count_words(F.col("doc").getField("text")))
    repeated = mixing.repeat_rows(mixing.mix(sized, queries.MIX_WEIGHTS, queries.MIX_EPOCHS))
    return repeated.select(*common.fields(repeated, "doc"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their tokens and a checksum of these.

    A null text is an empty one, which has its end token; every row is a document of its own, repeated ones too; texts
    of any length are cut into windows; an empty table has no pieces.
    """
    pieces = packing.pack(docs.select("doc_id", "text"), queries.tokenizer_path(), queries.PACK_WINDOW, queries.PACK_END)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", quality_rules), ("exact", exact_dedup), ("near", near_dedup), ("mix", mix_sources), ("pack", pack_sequences)]

#: Sketches, the seeded mix and tokenization are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
