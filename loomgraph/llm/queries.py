"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.oracle import SQL
from loomgraph.storage import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.ngram_jaccard import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"), shingle_words=4, percent=85)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomgraph.llm.token_output import token_digest, write_tokens

    folder = new_path(spark, "token-files")
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        write_tokens(table(spark, sf_dir, "documents"), folder, f.read(), end_id=2)
    return token_digest(spark, folder)


def op3_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.mixing import pivotal_mix

    return pivotal_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.substring_dedup import substring_dedup

    found = substring_dedup(table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.html_text import main_text

    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.pii import personal_data

    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.quality import quality

    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.decontaminate import benchmark_leaks

    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.nearest import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), query_every=50, nearest=5)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.line_dedup import lowered
    from loomgraph.llm.merkle import folded_roots, leaf_of, merkle_manifest

    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaves = table(spark, sf_dir, "documents").select("doc_id", "lang", leaf_of(fields).alias("leaf"), F.when(altered, leaf_of([*fields[:-1], lowered(fields[-1])])).alias("altered"))
    manifest = merkle_manifest(leaves, "lang", ["doc_id"]).withColumn("now", F.coalesce("altered", "leaf"))
    proved = folded_roots(manifest, "now")
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.line_dedup import line_dedup

    found = line_dedup(table(spark, sf_dir, "documents"), least_docs=10, least_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.prefix_trie import prefix_trie, numbered_turns, with_shared_heads

    turns = with_shared_heads(numbered_turns(table(spark, sf_dir, "conversations")), every=20, most=4)
    return prefix_trie(turns)


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of op3: what each source has and should have."""
    from loomgraph.llm.mixing import source_targets, with_size

    sizes = with_size(table(spark, sf_dir, "documents").select("source", "text"), "text", "size").drop("text")
    return source_targets(sizes).select("source", "source_size", F.round("target", 6).alias("target"))


def personal_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of op7: base spans."""
    return op7_personal_data(spark, sf_dir).drop("spans")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k in ("mixing_targets", "personal_base") or k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
