"""A corpus pipeline of five of the text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents.

Cases, beside those of each stage's operator: a null or empty text has no words, so the classifier rejects it; a null
doc_id is kept as any other and is a copy of nothing; ties between copies go to the smallest doc_id, and of rows that
are equal in doc_id and text one stays; very long texts are handled whole; further columns of documents, whatever their
names, pass through all stages but the last; empty tables give an empty result; without ratings every document with
words passes the classifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm import bpe, linededup, mixing, neardup, quality
from tilewright.llm.common import fresh, materialize, quoted, ready


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the rated documents among docs."""
    return quality.select(docs, ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their first document alone; a document whose lines all go stays, with an empty text."""
    lines, drops = fresh(docs, "lines"), fresh(docs, "drops")
    found = linededup.dedup_lines(docs, lines, drops)
    text = linededup.kept_text(lines, drops)
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return found.select(*[new[c].alias(c) if c in new else quoted(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that shares four fifths of its five-word shingles; documents without words stay."""
    of, least, n, number = (fresh(docs, c) for c in ("group_id", "group_kept", "group_rows", "row_number"))
    groups = materialize(neardup.near_groups(docs, words=5, percent=80).where("doc_id is not null").select("doc_id", "kept"), "near-groups")
    judged = groups.groupBy(F.col("doc_id").alias(of)).agg(F.min("kept").alias(least), F.count("*").alias(n))
    left = docs.join(judged.hint("merge"), F.col("doc_id") == F.col(of), "left").where(F.coalesce(F.col(least), F.lit(True)))
    if not judged.where(F.col(n) > 1).isEmpty():
        # An id that several rows have is one document to the operator: of its rows, equal texts stay once.
        same = Window.partitionBy("doc_id", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).orderBy("doc_id")
        left = left.withColumn(number, F.row_number().over(same)).where(F.col(of).isNull() | (F.col(number) == 1))
    return left.select(*[quoted(c) for c in docs.columns])


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) in place of the text, and the hash of the bytes that they decode to."""
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))
    digests = (F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "decoded"))
    return coded.select("doc_id", "lang", "source", bpe.n_tokens().alias("n_tokens"), "ids", *digests)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("byte-level BPE encoding and decoding", bpe_stage),
]

#: The classifier, the hashes of near-dedup and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
