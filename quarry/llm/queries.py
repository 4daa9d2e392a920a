"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .byte_bpe import bpe_encode
from .decontaminate import contaminated_words
from .language_id import identify, learn
from .line_dedup import dedup_lines
from .nbest import encode
from .ngram_join import ngram_join
from .quality_rules import cascade
from .spelling_variants import variant_groups, word_counts
from .suffix_dedup import repeated_bytes
from .token_alignment import Alignment
from .token_output import read_tokens, write_tokens
from .tool_calls import link_tool_calls
from .warc import read_warc, write_warc

TOOLS = {
    "system": {"type": "object", "required": ["text", "turn"], "properties": {"text": {"type": "string", "maxLength": 200}, "turn": {"const": 0}, "context": False}},
    "user": {"type": "object", "required": ["text", "turn"], "properties": {"text": {"type": "string", "minLength": 20}, "turn": {"type": "integer", "minimum": 0}, "context": {"type": "object"}}, "additionalProperties": False},
}


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark, sf_dir):
    manifest = write_tokens(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)
    return read_tokens(manifest)


def op2_ngram_jaccard_join(spark, sf_dir):
    return ngram_join(_table(spark, sf_dir, "documents")).components()


def op3_chat_formatting(spark, sf_dir):
    """User and system turns are calls, and the assistant's next turn is the result; later turns refer to the first, and to the call two turns before, so that they form chains."""
    c = _table(spark, sf_dir, "conversations")
    number = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    ref = lambda t: F.struct(number(t).alias("$ref"))
    context = F.when(F.col("turn") > 0, F.struct(F.when(F.col("turn") > 1, ref(F.col("turn") - 2)).alias("before"), ref(F.lit(0)).alias("root")))
    calls = c.filter(F.col("role").isin("user", "system")).select("conv_id", "turn", number(F.col("turn")).alias("call_id"), F.col("role").alias("name"), F.to_json(F.struct("text", "turn", context.alias("context"))).alias("arguments"))
    results = c.filter(F.col("role") == "assistant").select("conv_id", "turn", number(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    tools = spark.createDataFrame([(k, json.dumps(x)) for k, x in TOOLS.items()], "name string, schema string")
    rows = link_tool_calls(calls, results, tools)
    return rows.select("conv_id", "call_id", "turn", "result_turn", "level", "status", (F.size("errors") == 0).alias("valid"), F.sha2("json", 256).alias("json_sha256"))


def op4_line_dedup(spark, sf_dir):
    rows = dedup_lines(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_sentencepiece_nbest(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    rows = encode(docs, tokenizer("piece_bpe_32k.model"), n=4, all_ids=True)
    sizes = F.array_join(F.transform("n_best", lambda ids: F.size(ids).cast("string")), ",")
    hashes = F.array_join(F.transform("n_best", lambda ids: F.xxhash64(ids).cast("string")), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"), F.get("scores", F.lit(0)).alias("best_score"), F.array_join(F.transform("scores", lambda s: (F.get("scores", F.lit(0)) - s).cast("long")), ",").alias("losses"), F.sha2("decoded", 256).alias("decoded_sha256"), sizes.alias("n_best_pieces"), hashes.alias("n_best_xxhash64"))


def op6_benchmark_decontamination(spark, sf_dir):
    rows = contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1)
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return rows.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def op7_quality_rules(spark, sf_dir):
    return cascade(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = tokenizer("piece_bpe_32k.model")
    fitted = learn(docs, model, allowed=~F.coalesce(held_out, F.lit(False)))
    return identify(docs.select("doc_id", "text"), model, fitted).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_suffix_array_dedup(spark, sf_dir):
    rows = repeated_bytes(_table(spark, sf_dir, "documents"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])
    return rows.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_warc(spark, sf_dir):
    path = write_warc(_table(spark, sf_dir, "pages"))
    return read_warc(spark, path).select("page_id", F.col("payload_bytes").cast("long"), "payload_digest", "record_type", "refers_to")


def op11_spelling_variants(spark, sf_dir):
    return variant_groups(word_counts(_table(spark, sf_dir, "documents")))


def op12_token_alignment(spark, sf_dir):
    return Alignment(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")).scored()


def op13_byte_bpe(spark, sf_dir):
    import public_tokenizers

    rows = bpe_encode(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_output, op2_ngram_jaccard_join, op3_chat_formatting, op4_line_dedup, op5_sentencepiece_nbest, op6_benchmark_decontamination, op7_quality_rules, op8_language_id, op9_suffix_array_dedup, op10_warc, op11_spelling_variants, op12_token_alignment, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": oracles.OP2, "op3_chat_formatting": oracles.OP3, "op4_line_dedup": oracles.OP4, "op6_benchmark_decontamination": oracles.OP6, "op7_quality_rules": oracles.OP7, "op10_warc": oracles.OP10, "op11_spelling_variants": oracles.OP11}
