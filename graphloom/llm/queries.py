"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat, decontamination, languages, licenses, near, packing, quality, secrets, toxicity, transport
from graphloom.llm.common import persisted, remainder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labels = labels.where(F.col("toxic").isNotNull() & (remainder("doc_id", 5) != 0)).select("doc_id", "toxic")
    model = toxicity.learned(docs.select("doc_id", "text").join(labels, "doc_id").select("text", "toxic"), total=labels.count())
    out = toxicity.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, quality.learned(docs))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near.joined(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(table(spark, sf_dir, "conversations"), chat.SCHEMAS)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest")


def _vocabulary() -> dict[str, str]:
    import public_tokenizers

    return {"json_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), **_vocabulary())


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = languages.learned(docs.where(remainder("doc_id", 3) != 1).select("text", "lang"))
    out = languages.identified(docs, model, keep=["doc_id"])
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A source is an owner; its documents in one language are a repository.
    return secrets.scanned(table(spark, sf_dir, "documents"), repo=F.concat_ws("/", "source", "lang"))


def op9_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.stored(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "access_points")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scanned(table(spark, sf_dir, "documents"))
    added = F.filter(F.transform("notices", lambda x: x["label"]), lambda x: x.isNotNull())
    base = F.when(F.col("base_labels") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("base_labels", ","))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(F.array_sort(F.array_distinct(F.concat(base, added))), ",").alias("labels"), "score", "notices")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay as they are. Null texts, those without letters and rejected ones go; repeated rows and
    null ids are judged like others. All rows with a language are learned from: rows fall in three folds by crc32 of the id, and each is
    judged by the model of all rows of the other two, as a text that a model has learned is hardly ever rejected by it."""
    fold, folds = remainder("doc_id", 3), [0, 2, 1]
    models = languages.learned_apart(docs, fold, folds)
    parts = [languages.judged(docs.where(fold == k), model, docs.columns) for k, model in zip(folds, models, strict=True)]
    return reduce(DataFrame.unionAll, parts).where("not rejected").select("kept.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: see near.deduplicated."""
    return near.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are little else go. See decontamination.decontaminated."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets become a mask; every document stays. Repositories are as in op8_secrets."""
    return secrets.redacted(docs, repo=F.concat_ws("/", "source", "lang"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence: see packing.packed. Null texts are the end token alone."""
    return packing.packed(docs, **_vocabulary())


STAGES = [("language", language_stage), ("near", near_stage), ("decontamination", decontamination_stage), ("secrets", secrets_stage), ("packing", packing_stage)]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of documents; each result is cut off from its lineage before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = persisted(docs)
    return docs


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_quality, op3_jaccard, op4_chat, op5_decontamination, op6_packing, op7_language, op8_secrets, op9_transport, op10_licenses)}

#: Only what SQL can say on whole tables; the others are tested against brute force in tests/llm.
SQL: dict[str, str] = {}
