"""From raw documents to packed training sequences: each stage is one operator on all that the stage before it kept."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpline.llm import decontaminate, linededup, ngramjoin, pack, quality
from chirpline.llm.frames import table, written


def sized(docs: DataFrame) -> DataFrame:
    """Documents with the length of their present text, where they carry one."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are alike earlier ones; those of which nothing is left go."""
    found = linededup.dedup_lines(docs, linededup.ANY_WORDS, removed_col="_gone_lines")
    emptied = (F.size("_gone_lines") > 0) & (F.trim(F.regexp_replace("text", r"\s+", "")) == "")
    return sized(found.filter(~emptied).drop("_gone_lines"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that shingle sets link, the one with the smallest id."""
    found = ngramjoin.near_duplicates(docs)
    others = written(found.filter("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    others = F.broadcast(others) if others.count() <= ngramjoin.BROADCAST_ROWS else others
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go."""
    return sized(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return pack.pack(written(pack.token_pieces(docs), "pieces"))


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("decontamination", cut_benchmarks),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
