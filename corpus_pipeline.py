"""A corpus pipeline of four stages; each works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import jaccard, langid, mixing, packing
from spanloom.llm.common import release, scratch_mark, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: An ambiguous language is a reason to reject only from this many characters on.
AMBIGUOUS_CHARS = 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language, which becomes their ``lang``.

    Rejected are texts that are null or hold no letter, and texts of 50 characters
    or more whose language stays ambiguous. Rows keep their other columns as they are.
    """
    model = langid.fit(docs.where(~langid.held_out()), "doc_id", "text", "lang")
    made = langid.predict(docs.select(*COLUMNS), model)
    unsure = F.col("ambiguous") & (F.length("text") >= AMBIGUOUS_CHARS)
    return made.where((F.col("lang_pred") != langid.UNKNOWN) & ~unsure).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest id, of each class of near copies.

    Each row is judged by its own text, whatever other rows share its id; of a class's
    rows with the same id one stays. Rows with a null id come last in their class.
    """
    rows = written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = jaccard.jaccard_join(rows.select("row", "text"), id_col="row").select("row", "class_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = rows.select("row", "doc_id").join(found, "row").groupBy("class_id").agg(F.min_by("row", order).alias("row")).select("row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents by their source's weight, as many tokens as there are; a repeated document has several rows."""
    return mixing.mix(docs, max_repeat=mixing.MAX_REPEAT, keep=COLUMNS).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mixture into sequences of at most 2048 ids: one row a piece, with a checksum of its ids."""
    return packing.pack(docs, packing.tokenizer_path(), shown=packing.DIGEST)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mixing", mixed_sources),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written and read again before the next; a stage's scratch goes when it is written."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The language stage learns a classifier and the last stage tokenizes: SQL can express neither.
ORACLE_SQL = None
