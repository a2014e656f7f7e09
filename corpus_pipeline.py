"""The corpus pipeline: documents in, encoded clean documents out. Each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import decontaminate, pieces, pii, quality, similar
from marketlens.llm.common import keyed, model_path, of_ids, small_batches, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects.

    Each row is scored by its own text; a null text as one without words. Rows that repeat, and rows without an id, are
    judged alike. Without labels the score is 0.5 and all stay. An empty table stays empty. Columns beside those of
    documents are left out.
    """
    small_batches(spark)
    docs = docs.select(COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where(F.col("score") >= quality.THRESHOLD).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: those whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    The first row of a group stays: the smallest id (null last), then the least text. Rows count one by one, whether or not
    their id is null or another's too; texts without words (null ones too) are one group. An empty table stays empty.
    Columns beside those of documents are left out.
    """
    docs = docs.select(COLUMNS)
    return similar.one_of_each(docs).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs.

    Each row goes or stays by its own text, whatever its id; a null text has no words and stays. With an empty benchmark all
    stay. An empty table stays empty. Columns beside those of documents are left out.
    """
    docs = docs.select(COLUMNS)
    own = keyed(docs)
    # By row, as ids may be null or shared: the row's key goes in as its id.
    found = decontaminate.contamination(own.select(F.col("uid").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return of_ids(own, found.where("n_hit > 0").select(F.col("doc_id").alias("uid")), "left_anti").select(COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in angle brackets; n_chars is the new text's.

    All rows stay, repeated ones and those without an id too; a null text stays null, with a null n_chars. An empty table
    stays empty. Columns beside those of documents are left out.
    """
    docs = docs.select(COLUMNS)
    found = pii.find(docs)
    text = F.when(F.col("text").isNotNull(), pii.redacted(F.col("text"), F.col("spans")))
    return found.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids, and the text they decode to.

    Every row is encoded, repeated ones and those without an id too; a null text has no ids and decodes to an empty one. An
    empty table stays empty. Columns beside those of documents are left out.
    """
    model = pieces.Pieces.load(model_path("piece_bpe_32k.model"))
    return pieces.encoded(docs, model, decode=True).select("doc_id", "n_tokens", "ids", F.col("decoded").alias("text"))


STAGES = [
    ("quality classifier", keep_quality),
    ("word-shingle near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact),
    ("SentencePiece encoding", encode),
]

#: A classifier, a similarity search and a lattice aren't SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
