"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from . import bpe, conversations, decontaminate, grammar, infill, language, media, minhash, quality, simhash, substring, suffixes, toxicity
from .common import read_table


def op1_media_columns(spark, sf_dir):
    return media.media_digest(read_table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op4_repeated_passages(spark, sf_dir):
    return suffixes.repeated_passages(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark")).drop("text", "spans")


def op6_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs)).drop("text")


def op7_token_shards(spark, sf_dir):
    manifest = grammar.write_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return grammar.read_shards(manifest)


def op8_byte_bpe(spark, sf_dir):
    return bpe.token_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_substring_dedup(spark, sf_dir):
    return substring.substring_dedup(read_table(spark, sf_dir, "documents")).drop("spans")


def op10_language_id(spark, sf_dir):
    return language.identify(read_table(spark, sf_dir, "documents"))


def op11_minhash(spark, sf_dir):
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark, sf_dir):
    return conversations.damaged_and_repaired(read_table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark, sf_dir):
    return infill.infill_digest(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_simhash, op3_toxicity, op4_repeated_passages, op5_decontamination, op6_quality, op7_token_shards, op8_byte_bpe, op9_substring_dedup, op10_language_id, op11_minhash, op12_conversation_repair, op13_fill_in_middle)}
ORACLE_SQL: dict[str, str] = {"op13_fill_in_middle": infill.SQL}
