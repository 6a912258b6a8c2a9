"""Registered queries of the corpus operators; each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barleaf.llm import bpe, collocations, lines, packing, pages, partitions, quality, secrets, simhash, token_files, unigram, variants, warc
from barleaf.llm.common import fresh, stored, table
from barleaf.llm.sql import COLLOCATIONS, SPELLING, WARC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2


def query(name: str):
    def add(build):
        QUERIES[name] = build
        return build

    return add


@query("op1_simhash_pivots")
def simhash_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op2_token_files")
def token_file_rows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    written = token_files.write(docs, WORD_VOCABULARY, END_ID)
    return token_files.checksums(token_files.keys_of(docs), written)


@query("op3_unigram_counts")
def unigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return unigram.token_counts(table(spark, folder, "documents"), PIECE_VOCABULARY)


@query("op4_host_suffixes")
def host_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return pages.main_text(table(spark, folder, "pages"))


@query("op5_hierarchical_packing")
def hierarchical_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), BYTE_VOCABULARY, 0)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")


@query("op6_secret_forest")
def secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "word_index", "nth", "form", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


@query("op7_prefix_bpe")
def prefix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), WORD_VOCABULARY)


@query("op8_subword_embeddings")
def subword_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_line_rules")
def line_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = lines.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_learned_partitions")
def learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    return partitions.search(table(spark, folder, "embeddings"), lambda i: i % 20 == 0)


@query("op11_gram_variants")
def gram_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.groups(table(spark, folder, "documents"))


ORACLES["op11_gram_variants"] = SPELLING


@query("op12_trie_collocations")
def trie_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


ORACLES["op12_trie_collocations"] = COLLOCATIONS


@query("op13_warc_segments")
def warc_segments(spark: SparkSession, folder: str) -> DataFrame:
    archives = fresh(spark, "warc")
    warc.write(table(spark, folder, "pages"), archives)
    found = warc.inventory(stored(warc.read(spark, archives, keep_payload=False).drop("payload", "fields"), "records"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op13_warc_segments"] = WARC
