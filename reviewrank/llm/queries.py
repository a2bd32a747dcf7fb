"""The text operators applied to whole tables, and the SQL they agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewrank.llm import (
    elias_fano, forced_bpe, jump_sharding, license_scan, simhash_vptree, source_mixing, spaced_seeds, spelling, token_alignment,
    tool_calls, toxicity, winnowing, wordpiece_counts,
)
from reviewrank.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark, sf_dir):
    """Licence notices and texts in all documents."""
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


@query
def op2_winnowing(spark, sf_dir):
    """Winnowed fingerprints of all documents and of their edited texts."""
    return winnowing.edit_likeness(read(spark, sf_dir, "documents"))


@query
def op3_simhash_vptree(spark, sf_dir):
    """SimHash fingerprints of all documents and their components at two or fewer differing bits."""
    return simhash_vptree.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op4_jump_shards(spark, sf_dir):
    """All documents in 24 shards by jump consistent hashing of their ids."""
    return jump_sharding.shard_documents(read(spark, sf_dir, "documents"))


@query
def op5_elias_fano(spark, sf_dir):
    """All documents as token segments with Elias-Fano boundaries, read back."""
    return elias_fano.token_boundaries(read(spark, sf_dir, "documents"))


@query
def op6_forced_bpe(spark, sf_dir):
    """All documents encoded with forced-boundary BPE and decoded again."""
    return forced_bpe.round_trip(read(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark, sf_dir):
    """A toxicity score of every document, learned from the labelled ones outside the held-out fold."""
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op8_spaced_seeds(spark, sf_dir):
    """Every document and benchmark item that share a run of tokens, substitutions allowed."""
    return spaced_seeds.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op9_token_counts(spark, sf_dir):
    """Greedy word-piece counts of all documents."""
    return wordpiece_counts.token_counts(read(spark, sf_dir, "documents"))


@query
def op10_tool_calls(spark, sf_dir):
    """All conversations as tool calls linked with their results, ordered, validated and serialised."""
    return tool_calls.tool_conversations(read(spark, sf_dir, "conversations"))


ORACLES["op10_tool_calls"] = tool_calls.ORACLE_SQL


@query
def op11_spelling_variants(spark, sf_dir):
    """Words of all documents with their neighbours one edit apart, forms and roots."""
    return spelling.variants(read(spark, sf_dir, "documents"))


@query
def op12_token_alignment(spark, sf_dir):
    """All documents with the tokens of two tokenizers aligned, and corpus counts of the id pairs linked in them."""
    return token_alignment.aligned_documents(read(spark, sf_dir, "documents"))


@query
def op13_source_mixing(spark, sf_dir):
    """Words a mix of all sources takes from each document."""
    return source_mixing.taken_words(read(spark, sf_dir, "documents"))


ORACLES["op13_source_mixing"] = source_mixing.ORACLE_SQL
