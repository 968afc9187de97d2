"""One query per operator, over the whole of its table, and the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import alignment, audio, chat, contamination, exact, lexical, licenses, mixing, pii, quality, simhash, tokens, warc
from strandline.llm.common import documents
from strandline.operators.skew import lookup_join
from strandline.session import materialise, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; then toxic ones are deleted, and of low-quality ones the white space is squeezed.

    Both batches are committed twice, as after a retry.
    """
    docs = documents(spark, sf_dir)
    ledger = tokens.TokenLedger(spark, scratch_path(spark, "token-ledger"))
    inserts = tokens.counted(docs).withColumns({"op": F.lit("insert"), "seq": F.lit(0)})
    marks = (
        table(spark, sf_dir, "labels")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
        .where("toxic = 1 OR quality = 0")
        .select("doc_id", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    )
    hit = lookup_join(docs.select("doc_id", "text", "source", "lang"), marks, ["doc_id"], "inner")
    squeezed = F.when(~F.col("toxic"), F.trim(F.regexp_replace("text", r"[\x09-\x0D\x20]+", " ")))
    changes = tokens.counted(hit.withColumn("text", squeezed), keep=("doc_id", "source", "lang", "toxic")).select(
        F.when(F.col("toxic"), "delete").otherwise("revise").alias("op"), F.lit(0).alias("seq"), *tokens.STATE
    )
    for _ in range(2):
        ledger.commit("0001", inserts)
        ledger.commit("0002", changes)
    return ledger.totals()


@query
def op2_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(simhash.fingerprints(documents(spark, sf_dir), width=3), max_bits=3)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s.kind == F.lit(kind))).cast("long")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans")
    )


@query
def op4_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(audio.encode(documents(spark, sf_dir), "doc_id", "text"), "audio", **audio.PACKED)
    digests = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    sounds = materialise(audio.decode(stored, ("doc_id", "n_bytes"), pairs=True), "pcm", **audio.PACKED)
    return audio.features(sounds, ("doc_id", "n_bytes", *digests, "codec"), residue_col="residue")


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


ORACLE["op5_license_scan"] = licenses.scan_sql()


@query
def op6_mix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select(
        "doc_id", "source", "lang", mixing.topic_of(F.col("text")).alias("topic"), mixing.token_count(F.col("text")).alias("n_tokens")
    )
    # narrow rows of two passes: the cells, and the documents that meet them
    rows = materialise(rows, "mix-rows")
    dimensions = {n: F.col(n) for n in mixing.DIMENSIONS}
    found = mixing.with_weights(rows, mixing.to_budget(mixing.mix(rows, dimensions, F.col("n_tokens"))), dimensions)
    return found.select(
        "doc_id",
        *[mixing.level(F.col(n)).alias(n) for n in mixing.DIMENSIONS],
        "n_tokens",
        F.round("_weight", 6).alias("weight"),
        F.round("_probability", 6).alias("probability"),
        (mixing.draw(F.col("doc_id")) < F.col("_probability")).alias("kept"),
        F.col("_converged").alias("converged"),
    )


ORACLE["op6_mix_weights"] = mixing.mix_sql()


@query
def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_records(warc.write_chunks(table(spark, sf_dir, "pages")))


ORACLE["op7_warc_chunks"] = warc.pages_sql()


@query
def op8_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, ("doc_id",)).select(
        "doc_id",
        quality.held_out("doc_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


@query
def op9_benchmark_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op10_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


@query
def op11_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.copies(documents(spark, sf_dir), digests=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE["op11_exact_copies"] = exact.copies_sql()


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scored(documents(spark, sf_dir))


@query
def op13_lexical_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


ORACLE["op13_lexical_ranks"] = lexical.ranked_sql()
