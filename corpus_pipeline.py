"""A corpus from raw documents to packed sequences: each stage is one operator of terrane.llm, working on all that the stage
before it kept.  All but the last return the columns of documents.

Null and empty texts: language ID rejects them (they have no letter).  Repeated rows: the join keeps one row of each group,
the one with the least doc_id (of equal ids the one whose text has the least hash).  Texts of any length are worked on whole.
Columns of any name stay as they are.  Empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import common as C
from terrane.llm import decontam, jaccard, langid, packing, suffix
from terrane.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what has a language: a text that is `und` goes."""
    model = langid.fit(docs, train=F.pmod(C.id_crc(F.col("doc_id")), F.lit(3)) != 1)
    own = {c: f"__{i}" for i, c in enumerate(docs.columns)}  # a column of docs may have a name that predictions use
    told = langid.predict(docs.withColumnsRenamed(own), model, text_col=own["text"]).where("lang_pred <> 'und'")
    return told.select(*(F.col(v).alias(c) for c, v in own.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts linked by a Jaccard similarity of 0.8 or more stays."""
    return jaccard.deduplicate(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every string of 400 bytes or more, or of over 50 words, that also starts anywhere else; texts of which nothing is
    left go."""
    cut = suffix.remove(docs, words=51).where("text is null or text <> ''")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_strings), ("decontamination", decontaminate), ("packing", pack)]

#: Code lengths and byte-pair merges are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = C.Table(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
