"""A corpus pipeline of five stages, each an operator of ``cloakframe.llm``.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. All but the last return the
columns of ``documents`` and no others, whatever else a table has beside them, so no name can clash with a stage's own; a
text that a stage changes has its ``n_chars`` counted anew. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import linededup, minhash, packing, toxicity, weakpii
from cloakframe.llm.common import documents, release, written, written_alone

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts toxic go.

    Each row is judged by its text alone, a null one as empty; repeated rows fare alike, a score of exactly 0.5 goes. Without
    labels of both kinds nothing is learned, and no document of a corpus without toxic labels goes.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where("score < 0.5").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of keys that three documents or more hold stay in the one of the largest doc_id alone.

    No row goes. A null text stays null; an empty one, or one that loses all lines, is empty. Rows of one doc_id count as
    one document and are treated alike; rows without doc_id keep all lines and are not counted.
    """
    whole = docs.select(*COLUMNS, F.col("text").isNull().alias("__null"))
    out = linededup.dedup_lines(whole)
    text = F.when(~F.col("row.__null"), F.col("kept"))
    return out.select("row.doc_id", text.alias("text"), "row.lang", "row.source", F.when(F.col("n_dropped") > 0, F.length("kept")).otherwise(F.col("row.n_chars")).cast("long").alias("n_chars"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with five-word shingles of similarity 0.8 or more one row stays: that of the smallest doc_id.

    Rows are told apart by themselves, not by doc_id: of repeated rows one stays, and rows of one doc_id with different
    texts are compared like any others. Rows without doc_id take part and come last. Texts without words are no copies
    of each other and all stay.
    """
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")))
    found = minhash.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), words=5, percent=80)
    found = found.select(F.col("doc_id").alias("__row"), "component_id").join(rows.select("__row", "doc_id"), "__row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    first = found.groupBy("component_id").agg(F.min_by("__row", order).alias("__row"))
    gone = found.select("__row").join(first.select("__row"), "__row", "left_anti")
    return rows.join(gone, "__row", "left_anti").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets, and ``n_chars`` counted anew; no row goes.

    Null and empty texts stay as they are; repeated rows are treated alike; spans that overlap become one mark of the
    first one's kind.
    """
    out = weakpii.masked(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents left, dealt to sequences: columns of ``packing.PIECE``.

    A null or empty text is its end token; repeated rows are packed each; ties in length go by the order read.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", keep_one_of_near_copies),
    ("personal data", mask_personal_data),
    ("packing", pack),
]
#: A learned classifier and a tokenizer are among the stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it; what a stage alone needed is deleted then."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        before, docs = docs, written_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
