"""The corpus pipeline: language ID, near-duplicates, mixing, tokens; each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import language, minhash, mixing, pieces
from sieveline.llm.common import as_rows, drop_tables, materialize, once_each, table
from sieveline.llm.queries import piece_model


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language go on, with the language found as lang; the others, and those without text, go.

    Repeated rows and null ids are rows like others; no row gives none.
    """
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles the one with the smallest id stays.

    Rows that repeat an id and its text are one document; null ids are linked with nothing and stay.
    """
    found = minhash.near_duplicates(docs, width=5, num=80, den=100)
    gone = materialize(found.where("not kept").select("doc_id").distinct(), "pipeline-copies")
    if gone.count() <= 1_000_000:  # 8 MB; beyond it both sides are shuffled
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti")
    return kept.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their targets: a row for each pass that takes a document, in the order of the mix.

    The pass at the cut, which takes a document in part, is a whole row if it takes at least half and none otherwise.
    Documents of no words are in no pass.  Null ids and sources are values of their own; each of several equal rows has
    passes of its own.  Empty table: no rows.
    """
    _, entries = mixing.mix_entries(docs)
    entries = materialize(entries.where("2 * taken >= size").select("k1", "k2", "begin"), "pipeline-passes")
    repeated = entries.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    rows = once_each(as_rows(docs), materialize(repeated, "pipeline-repeated"))
    out = rows.join(entries, ["k1", "k2"])
    files = max(1, entries.count() // 10_000)
    out = out.repartitionByRange(files, "begin").sortWithinPartitions("begin")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix; null text is empty, null ids and repeated rows stay, no row gives none."""
    return pieces.encode_documents(docs, piece_model(), cache_size=60_000, batch_bytes=512 << 10)  # earlier stages have left executors little room


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The language model, the order of the mix and the tokenizer cannot be written in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    first = drop_tables(spark, keep=10**9)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_tables(spark, first, keep=1)  # a written stage needs nothing that came before it
    return STAGES[-1][1](spark, docs, sf_dir)
