"""A corpus from documents to token ids: quality, line dedup, near-duplicate documents, mixing of sources, BPE.

``run`` writes what each stage keeps as Parquet in the folder of ``spark.checkpoint.dir`` and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard, lines, mixing, quality
from tidemark.llm.common import Scratch
from tidemark.llm.queries import table, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good (score of CUT or more). Where the labels name fewer than two classes, nothing is rejected."""
    model = quality.fit_quality(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    if not model.parts:
        return docs
    score = "score"
    while score in map(str.lower, docs.columns):  # a column of that name stays what it is
        score += "_"
    return quality.score_quality(docs, model, score).where(F.col(score) >= quality.CUT).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated and nearly repeated lines; a document all of whose printed lines were repeats goes."""
    # The rows travel as one column, so that columns named like the operator's keep their values.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = lines.dedup_lines(docs.select("doc_id", "text", row)).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("text").cast("long")) if "n_chars" in docs.columns else None}
    return out.select(*[(F.col(f"row.`{c}`") if new.get(c) is None else new[c]).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word shingles, Jaccard 0.8 or more. Rows with a null id stay."""
    kept = jaccard.similar_sets(docs, n=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").union(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number and digests."""
    return bpe.bpe_encode(docs, tokenizer_path()).drop("decoded")


STAGES = [("quality", keep_quality), ("line dedup", drop_lines), ("n-gram Jaccard join", one_of_each), ("mixing", mix), ("bpe", encode)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
