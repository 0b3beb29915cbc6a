"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm import bpe, chat, decontaminate, filter_audit, language_id, line_dedup, lm_score, near_dedup, periodic, quality, token_counts, token_files, toxicity
from sparquill.llm.columns import documents, fold


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, as the module that describes them gives it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold 2 of 4 is held out of training; language, source and id are no inputs of a prediction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = fold(F.col("doc_id"), 4)
    model = language_id.fit(docs, remainder != 2)
    return language_id.identify(docs.withColumn("held_out", remainder == 2), model, "held_out")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold 2 of 7 is held out of training."""
    return lm_score.scores(documents(table(spark, sf_dir, "documents")), fold(F.col("doc_id"), 7) != 2)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles at 80 percent."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.withColumn("dropped", F.array_join("dropped", ","))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain goes from low quality to toxic, the two categories that the labels have."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = toxicity.fit(docs, labels, {"low_quality": "quality = 0", "toxic": "toxic = 1"})
    return toxicity.toxicity(docs, chain)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    out = bpe.encoded(table(spark, sf_dir, "documents"), path or vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path or vocabulary("piece_bpe_32k.model"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ";")
    return out.withColumn("spans", spans)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which a tenth get a periodic tail; the runs as digests, and the one of greatest exponent."""
    out = periodic.periodic_runs(periodic.planted(table(spark, sf_dir, "documents")))
    most = out.withColumn("most", periodic.strongest(F.col("runs")))
    return most.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "most.start",
        "most.length",
        "most.period",
        F.floor(F.lit(1000) * F.col("most.length") / F.col("most.period")).cast("long").alias("exponent_milli"),
        F.sha2(periodic.run_lines(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_token_files(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    """Written with end id 2, and read back from the files."""
    path = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary_path or vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_files.read_checksums(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_lm_score": op2_lm_score,
        "op3_near_dedup": op3_near_dedup,
        "op4_line_dedup": op4_line_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_decontaminate": op6_decontaminate,
        "op7_bpe": op7_bpe,
        "op8_quality_rules": op8_quality_rules,
        "op9_token_counts": op9_token_counts,
        "op10_chat_format": op10_chat_format,
        "op11_filter_audit": op11_filter_audit,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_token_files": op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dedup": near_dedup.oracle(4, 80), "op6_decontaminate": decontaminate.oracle(), "op10_chat_format": chat.SQL, "op11_filter_audit": filter_audit.SQL}
