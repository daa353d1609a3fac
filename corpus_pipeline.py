"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of
documents.  Whatever the columns are called, a stage passes all of them on; it reads
doc_id, text and, in the first stage, lang.  Inside a stage the other columns go by their
place, so no name of theirs meets one of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, decontaminate, jaccard, language, secrets
from leafmill.llm.common import held_out, narrow, table, written
from leafmill.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; null texts and texts without a letter go."""
    model = language.train(docs.where(~held_out(F.col("doc_id"))))
    names, docs = docs.columns, _by_place(docs)
    found = language.predict(docs, model, "text", *(F.col(c) for c in docs.columns if c != "text"), keep_text=True)
    return found.where("lang_pred != 'und'").select(*docs.columns).toDF(*names)


def _by_place(docs: DataFrame) -> DataFrame:
    """The rows with all columns but doc_id and text called by their place."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, the smallest id; rows without an id stay.

    Rows with one id are one document, of which one row stays.
    """
    names, docs = docs.columns, _by_place(docs)
    groups = written(jaccard.groups(docs), "groups")
    rows, ids = groups.agg(F.count("*"), F.countDistinct("doc_id")).head()
    gone = written(groups.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(narrow(gone), "doc_id", "left_anti").select(*docs.columns)
    if rows != ids:
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
    return kept.toDF(*names)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, exact or edited; rows without an id are told apart by their text."""
    names, docs = docs.columns, _by_place(docs)
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    hits = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="_key").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(narrow(written(hits, "contaminated")), "_key", "left_anti").select(*docs.columns).toDF(*names)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in the text replaced by a mark; n_chars follows the text."""
    names, docs = docs.columns, _by_place(docs)
    found = secrets.find_secrets(docs, keep=tuple(c for c in docs.columns if c not in ("doc_id", "text")), mark="[secret]")
    kinds = dict(docs.dtypes)
    out = {"doc_id": F.col("doc_id").cast(kinds["doc_id"])}
    if "n_chars" in names:
        same = f"c{names.index('n_chars')}"
        out[same] = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col(same)).cast(kinds[same])
    return found.select(*(out.get(c, F.col(c)) for c in docs.columns)).toDF(*names)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the hash of the decoded text."""
    coded = bpe.encode_decode(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secret_scan", secret_scan),
    ("token_ids", token_ids),
]

#: No SQL: language proportions, alignment and BPE are beyond it; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
