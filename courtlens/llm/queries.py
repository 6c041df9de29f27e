"""The registered queries of this folder, with production parameters on their whole tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from courtlens.llm import checks, covertree, katz, language, licenses, mixing, packing, phrases, pii, sharding, simhash, topk, urls, variants
from courtlens.llm.common import read, remainder

RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Checking SQL of those that SQL can express: no classifier, tokenizer, XXH64, rewriting or step-by-step plan.
SQL: dict[str, str] = {
    "op2_exact_top_k": checks.top_k("vec_id % 100 = 0"),
    "op3_cosine_near_duplicates": checks.cosine_groups(),
    "op10_license_scan": checks.license_labels(),
    "op11_spelling_variants": checks.spelling_variants(),
    "op13_collocations": checks.collocations(),
}


def query(name: str):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        RUNS[name] = run
        return run

    return register


def vocabulary() -> str:
    """Path of the vocabulary that packing uses, where the tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_personal_data")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(read(spark, folder, "documents"))


@query("op2_exact_top_k")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op3_cosine_near_duplicates")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.near_duplicates(read(spark, folder, "embeddings"))


@query("op4_language")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    held = remainder("doc_id", 4) == 2
    return language.predict(docs, language.train(docs.where(~held)), {"doc_id": F.col("doc_id"), "held_out": held})


@query("op5_url_verdicts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    return urls.judge(pages, urls.labelled_by_rules(pages))


@query("op6_language_model_scores")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score(read(spark, folder, "documents"), remainder("doc_id", 5) == 1)


@query("op7_mixing_rates")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.rates(read(spark, folder, "documents"), quality_labels(spark, folder))


def quality_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, domain) of the labels table."""
    return read(spark, folder, "labels").select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))


@query("op8_simhash_groups")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


@query("op9_packed_sequences")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read(spark, folder, "documents"), vocabulary())


@query("op10_license_scan")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.annotate(read(spark, folder, "documents"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(read(spark, folder, "documents"))


@query("op12_slot_shards")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The law is that of equal bytes, so no grown shard; ``next_shard`` is the map's second version."""
    rows = sharding.shard(read(spark, folder, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard")


@query("op13_collocations")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine(read(spark, folder, "documents"))
