"""A text corpus from raw documents to token ids: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table
from quillon.llm.line_dedup import drop_repeated_runs
from quillon.llm.mixing import mixed
from quillon.llm.ngram_join import jaccard_classes
from quillon.llm.pieces import with_pieces
from quillon.llm.toxicity import REJECT_AT, with_score
from quillon.operators.joins import lookup_join
from quillon.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit, with a classifier learned from all labels of the documents there are.

    No fold is held out here: what a label says is to be used, and ``op7`` measures what is learned on a fold it has not seen. A null or empty text has
    the score of no n-grams and stays; without labels of both kinds every text has one score, which is below the limit unless all labels are toxic.
    """
    return with_score(docs, table(spark, sf_dir, "labels"), every_label=True).where(F.col("score") < REJECT_AT).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines. A document of which no line with words is left goes; ``n_chars`` follows the text.

    A null, empty or wordless text stays as it is."""
    rows = drop_repeated_runs(docs)
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))
    length = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.where(~emptied).withColumn("n_chars", length).select(*docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: of those with the smallest id, the one whose text has the smallest hash, once.

    Rows are told apart by id and text, so a row that shares only its id with a copy is judged by its own text. Texts without
    words and rows without an id are in no class and stay, as often as they are there.
    """
    rows = stored(jaccard_classes(docs, by_text=True).where("class_id IS NOT NULL").select("doc_id", "text_hash", "class_id"), "rows")
    each = F.struct("doc_id", "text_hash")
    firsts = rows.groupBy("class_id").agg(F.min(each).alias("first"))
    pairs = rows.groupBy("doc_id", "text_hash", "class_id").agg(F.count(F.lit(1)).alias("n")).join(firsts, "class_id")
    pairs = stored(pairs.select("doc_id", "text_hash", "n", (each == F.col("first")).alias("is_first")), "pairs")
    hashed = docs.withColumn("text_hash", F.xxhash64(F.col("text").cast("string")))
    kept = lookup_join(hashed, pairs.where("NOT is_first").select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_anti")
    repeated = pairs.where("is_first AND n > 1").select("doc_id", "text_hash")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = lookup_join(kept, repeated, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return lookup_join(kept, repeated, ["doc_id", "text_hash"], "left_anti").unionByName(once).select(*docs.columns)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A text without words takes its turn like any other and counts nothing."""
    return mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the best segmentation of each text, its score and those of the next best. A null text gives nulls, an empty one no ids."""
    rows = with_pieces(docs.select("doc_id", "source", "text"))
    scores = F.transform("n_best", lambda x: x["score"]).alias("n_best_scores")
    return rows.select("doc_id", "source", "ids", "score", scores)


#: Name and function of each stage, in order. All but the last return the columns of documents.
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", one_of_each_class),
    ("source_mixing", mixed_to_weights),
    ("sentencepiece", encoded),
]

#: A learned score and a search over segmentations are not expressible in SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
