"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, decontaminate, extraction, language, linededup, packing, quality, rules, secrets, sharding, simhash, spelling, substring
from tidemark.llm.sql import SQL


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.ledger(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[f"m.{n}" for n in names], (~rules.passes("base-1")).alias("base_failed"), rules.passes("prose-1").alias("kept"), "fail_bits")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    model = language.fit(docs, ~out)
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents"))
    place = F.array(*[F.lit(k) for k in secrets.KINDS])

    def joined(spans):
        order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), F.array_position(place, s["kind"]).alias("k"), s["end"].alias("e"), s["kind"].alias("name"))))
        return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["name"], s["s"], s["e"])), ",")

    def number(kind):
        return F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("strong")), 256).alias("base_sha256"), joined(F.concat("strong", "linked")).alias("spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_matches(docs, _read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op8_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.posteriors(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.withColumn("kept", (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5))


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.delete_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    removed = F.aggregate("removed_runs", F.lit(0), lambda n, r: n + r["end"] - r["start"] + 1)
    return out.select("doc_id", lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), F.size("removed_runs").cast("long").alias("n_runs"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = alignment.align(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = alignment.stored_score(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "block", "pairs", "times"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_substring, op3_rules, op4_language, op5_simhash, op6_secrets, op7_decontamination, op8_rendezvous, op9_quality, op10_line_runs, op11_spelling, op12_alignment, op13_extraction)}

__all__ = ["QUERIES", "SQL"]
