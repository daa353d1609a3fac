"""The queries of this subpackage: name -> callable(spark, sf_dir), and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, codes, decontaminate, divergence, embeddings, jaccard, language, oracles, secrets, sitetree, substrings, token_files, toxicity, urls
from leafmill.llm.common import fresh_path, held_out, table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~held_out(F.col("doc_id"))))
    found = language.predict(docs, model, "text", F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"))))
    found = toxicity.score(docs, machine, "text", F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op4_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.deduplicate(table(spark, sf_dir, "documents")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op8_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "token-ids")
    token_files.write_ids(table(spark, sf_dir, "documents"), out, vocabulary("word_bpe_49k.json"))
    return token_files.digests(token_files.read_ids(spark, out))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.train(urls.labelled(spark)))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_mixture": op1_language_mixture,
    "op2_toxicity_fm": op2_toxicity_fm,
    "op3_secret_scan": op3_secret_scan,
    "op4_site_style_tree": op4_site_style_tree,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_bpe_roundtrip": op7_bpe_roundtrip,
    "op8_embedding_graph": op8_embedding_graph,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_files": op10_token_files,
    "op11_url_filter": op11_url_filter,
    "op12_source_divergence": op12_source_divergence,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": oracles.SUBSTRINGS,
    "op6_ngram_jaccard": oracles.JACCARD,
    "op8_embedding_graph": oracles.VECTORS,
    "op12_source_divergence": oracles.DIVERGENCE,
    "op13_vector_codes": oracles.CODES,
}
