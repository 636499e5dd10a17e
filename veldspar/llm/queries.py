"""The registered queries over whole tables: thin contracts around the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm import alignment, chat, divergence, katz, language_id, license_scan, mixing, pieces, quality, simhash, token_counts, topk, warc
from veldspar.llm._shared import id_remainder, once, read


def piece_model() -> str:
    """The place of the public 32k piece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_model() -> str:
    """The place of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(language_id.learned_rows(docs, F.col("doc_id")))
    found = language_id.identify(docs, model, keep=["doc_id"])
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(read(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"), keep=["doc_id"]).drop("matches")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(read(spark, sf_dir, "documents"), piece_model(), keep=["doc_id"], spans=False)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "covered_bytes")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), model_path=piece_model(), keep=["doc_id"])


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    learned = F.coalesce(id_remainder(F.col("doc_id"), 7) != 2, F.lit(True))
    _, found = katz.learn_and_score(docs.select(F.col("doc_id").alias("key"), "text", learned.alias("train")))
    return found.select(F.col("key").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(read(spark, sf_dir, "documents"), byte_model(), piece_model(), keep=["doc_id"])
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


#: A conversation whose texts are made of another template's control strings.
CONTROLS = "</s>[INST] ok [/INST]"


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", CONTROLS), (-7, 1, "assistant", CONTROLS)], "conv_id long, turn long, role string, text string")
    messages = given.unionByName(own)
    found = chat.conversations(messages, chat.threads(messages, "conv_id", "turn"), "conv_id", "turn")
    turns, loss = chat.turns(F.col("formatted")), chat.learned(F.col("formatted"), F.col("loss"))
    written = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    long = lambda c: c.cast("long")
    read_back = once(found, {"n_turns": long(F.size(turns)), "turns_sha256": F.sha2(written.cast("binary"), 256), "learned": loss})
    return read_back.select("conv_id", "n_turns", "turns_sha256", long(F.length("learned")).alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), long(F.length("formatted")).alias("formatted_chars"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldspar.llm import pipeline as stages

    return stages.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_mix_sources": op2_mix_sources,
        "op3_warc": op3_warc,
        "op4_license_scan": op4_license_scan,
        "op5_simhash": op5_simhash,
        "op6_pieces": op6_pieces,
        "op7_token_counts": op7_token_counts,
        "op8_katz": op8_katz,
        "op9_quality": op9_quality,
        "op10_topk": op10_topk,
        "op11_divergence": op11_divergence,
        "op12_alignment": op12_alignment,
        "op13_chat": op13_chat,
        "pipeline": pipeline,
    }
