"""From raw documents to packed training sequences, one stage after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the docs of the next one. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.llm import langid, mixing, neardup, packing, secretscan
from medialake.llm.queries import tokenizer_path
from medialake.llm.texts import PART, keeping
from medialake.operators.ordered import stage

SURE = 0.5
SLICE = 1 << 19  # bytes of text at once: the stages share their executors' memory
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session gives Python steps at most ``PART`` rows at once, or as few as it did.

    Spark's 10,000 rows are a whole split of documents, which the executor and its
    Python workers then hold several times over. Results do not depend on it. A stage
    is planned when its result is written, so the setting has to stay.
    """
    rows = int(spark.conf.get(ROWS))
    if not 0 < rows <= PART:
        spark.conf.set(ROWS, str(PART))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without one, or with less than ``SURE`` of their words credibly in any learned languages, go. ``lang`` is filled where it is null.

    Null and empty texts and texts without a letter go; repeated rows are judged alike;
    an empty table gives an empty one; columns with clashing names are kept.
    """
    small_batches(spark)
    model = langid.learn(docs)

    def step(rows: DataFrame) -> DataFrame:
        found = langid.identify(rows, model, chunk=SLICE).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("learned") >= SURE))
        return found.withColumn("lang", F.coalesce("lang", "lang_pred"))

    return keeping(docs, langid.OUT.fieldNames(), step)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8.

    Documents without words, and rows without an id, stay; rows that repeat an id that goes go too.
    """
    small_batches(spark)
    return neardup.drop_duplicates(docs, size=5, percent=80).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced; ``n_chars`` counts the new text. Null texts stay null, with null ``n_chars``."""
    small_batches(spark)
    return secretscan.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate takes it. A null source is a source of its own; texts without words are taken by their source's rate too; repeated rows share a draw."""
    return keeping(docs, mixing.OUT, lambda rows: mixing.emit(mixing.mix(rows)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place, for every copy that the mix took. Null and empty texts are one piece of the end token; an empty table gives an empty one."""
    small_batches(spark)
    return packing.pack_texts(docs.select("doc_id", "text", "lang", "source"), tokenizer_path()).select("doc_id", "lang", "source", "piece", "start", "length", "ids", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned languages, guess costs and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
