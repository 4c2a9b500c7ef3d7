"""Registered queries of the training-text operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.llm import (chat, decontaminate, merkle, minhash, ngram_join, packing, prefix_trie, quality,
                         queries_sql, shards, token_files, toxicity, url_filter, whitening)
from askgrid.sources.tables import Tables


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, and whether it counts as contaminated."""
    tables = Tables(spark, sf_dir)
    found = decontaminate.find_hits(tables.documents, tables.benchmark)
    listed = F.array_join(F.array_sort(F.transform("item_ids", lambda item: item.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by host and path rules, then by patterns, else allow."""
    judged = url_filter.filter_urls(Tables(spark, sf_dir).pages)
    return judged.select("page_id", "host", "path",
                         F.when(F.col("priority") == 1, F.col("matched")).alias("rule"), "verdict")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document as read back from Huffman-coded files."""
    files = token_files.write_token_files(Tables(spark, sf_dir).documents)
    return token_files.read_token_files(*files).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, as read back from the written shards."""
    written = shards.write_shards(Tables(spark, sf_dir).documents.select("doc_id", "text"))
    return written.select(
        "doc_id", shards.record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(Tables(spark, sf_dir).documents).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of each conversation against a swapped last reply."""
    pairs = chat.swapped_reply_pairs(Tables(spark, sf_dir).conversations)

    def listed(name):
        return F.array_join(F.transform(name, lambda item: F.concat(
            item["begin"].cast("string"), F.lit("-"), item["end"].cast("string"))), ",")

    return chat.format_preferences(pairs).select(
        F.col("pair_id").alias("conv_id"), "prompt_turns", "prompt", "chosen",
        listed("chosen_ranges").alias("chosen_ranges"), "rejected",
        listed("rejected_ranges").alias("rejected_ranges"))


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, their likeness and the changed branches."""
    return merkle.fingerprint_edits(Tables(spark, sf_dir).documents).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", "near_edited", "near_next", "changed_branches")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicate documents of every document."""
    return minhash.near_duplicates(Tables(spark, sf_dir).documents)


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each toxicity category, and the verdict by the last one."""
    tables = Tables(spark, sf_dir)
    chain = toxicity.train(tables.documents, tables.labels)
    scored = toxicity.with_toxicity(tables.documents.select("doc_id", "text"), chain)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "p_insult", "p_abuse",
                         F.col("p_toxic").alias("score"),
                         (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a factorisation machine."""
    tables = Tables(spark, sf_dir)
    machine = quality.train(tables.documents, tables.labels)
    scored = quality.with_quality(tables.documents.select("doc_id", "text"), machine)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of documents linked by nearly equal sets of three-word runs."""
    return ngram_join.similar_documents(Tables(spark, sf_dir).documents)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector."""
    return whitening.whiten(Tables(spark, sf_dir).embeddings)


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations with their subtree totals."""
    return prefix_trie.prefix_nodes(Tables(spark, sf_dir).conversations)


QUERIES = {build.__name__: build for build in (
    op1_benchmark_decontamination, op2_url_filters, op3_token_files, op4_sharding, op5_packing,
    op6_preference_formatting, op7_merkle_fingerprints, op8_minhash_near_dedup, op9_toxicity_chain,
    op10_quality_classifier, op11_ngram_jaccard_join, op12_embedding_whitening, op13_conversation_prefix_trie)}
ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": queries_sql.DECONTAMINATION,
    "op2_url_filters": queries_sql.URLS,
    "op6_preference_formatting": queries_sql.PREFERENCES,
    "op8_minhash_near_dedup": queries_sql.NEAR_DUPLICATES,
    "op11_ngram_jaccard_join": queries_sql.NGRAM_JOIN,
    "op13_conversation_prefix_trie": queries_sql.PREFIX_TRIE,
}
