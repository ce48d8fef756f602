"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, ctph, decontamination, extraction, langid, packing, repeats, scoring, secrets, simhash
from ._shared import ensure_checkpoint_dir, spread
from .oracles import ORACLE_SQL  # noqa: F401  SQL for DuckDB with the same rows, where SQL can express a query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("at")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(~langid.held_out(5)))
    return langid.predict(docs, profiles).select("doc_id", langid.held_out(5).alias("held_out"), "lang_pred", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", ok), (-7, 1, "assistant", ok)], rows.schema)
    out = chat.format_chats(chat.linear(rows.unionByName(extra)))
    turns, loss = chat.read_back(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("mask"))
    out = out.select("tree", "formatted", turns.alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.get_json_object("tree", "$.conv_id").cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A ledger of this run's own, empty at first: every blob is scanned into it, and all findings are read from it.
    ledger = secrets.Ledger(spark, f"{ensure_checkpoint_dir(spark)}/ledgers/{uuid.uuid4().hex}")
    found = ledger.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    names = [r.kind for r in secrets.RULES]
    text = secrets.spans_text(F.col("spans"))
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(names)], F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"), ~langid.held_out(10))


def op10_fuzzy_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compare(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_decontamination, op3_language_id, op4_simhash, op5_chat_formatting, op6_packing, op7_secret_scans, op8_html_extraction, op9_lm_scoring, op10_fuzzy_hash)}
