"""Language identification by fusing evidence: text, declared language, address suffix and host."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_worker, materialize

BUCKETS = 1 << 14
#: Expected number of labelled rows that the text model is fitted on, at least so many of each language as there are, and
#: how many labelled rows make a language (fewer do if they are one in a thousand).
FIT_ROWS, FIT_EACH, LEAST_ROWS = 20_000, 500, 20
#: How much of a text's log likelihood counts: neighbouring trigrams are far from independent.
TEMPER = 0.15
#: Rows that a parent's opinion counts for, against rows seen: suffix under all, host under suffix.
SUFFIX_ROWS, HOST_ROWS = 50.0, 20.0
#: Prior of "no known language", and the least posterior that is believed.
UNKNOWN, LEAST = 1e-3, 0.5


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of a text's byte trigrams, A-Z lower-cased, digits alike, runs of white space as one space."""
    raw = b" ".join((text or "").encode().lower().split())
    if not raw:
        return np.empty(0, np.int64)
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    b = np.where((b >= 48) & (b <= 57), np.uint32(48), b)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    logp: np.ndarray  # buckets by languages, the last column an unknown language: all trigrams alike

    def log_likelihoods(self, text: str | None) -> np.ndarray | None:
        t = trigrams(text)
        if not len(t):
            return None
        return TEMPER * (np.bincount(t, minlength=BUCKETS) @ self.logp if len(t) > BUCKETS else self.logp[t].sum(axis=0))


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> TextModel:
    """Trigram frequencies of each language from labelled rows (text, declared), chosen by hash.

    Every label of at least ``LEAST_ROWS`` rows, or of one row in a thousand, is a language.  About ``fit_rows`` rows are
    taken in proportion, and more of the languages that get fewer than their equal part, or than ``FIT_EACH``.
    Whole texts are counted on the executors; the driver gets one vector of fixed size a language.
    """
    labelled = rows.where("declared is not null and text is not null")
    per_label = materialize(labelled.groupBy("declared").agg(F.count("*").alias("n")), "language-labels")
    total = per_label.agg(F.sum("n")).first()[0] or 0
    counts = per_label.where((F.col("n") >= LEAST_ROWS) | (F.col("n") * 1000 >= total)).collect()
    languages = sorted(r["declared"] for r in counts)
    each = max(FIT_EACH, fit_rows / max(len(languages), 1))
    shares = [(r["declared"], math.ceil(1_000_000 * min(1.0, max(fit_rows / total, each / r["n"])))) for r in counts]
    shares = rows.sparkSession.createDataFrame(shares, "declared string, share int")
    chosen = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1_000_000)) < F.col("share")
    sample = labelled.join(F.broadcast(shares), "declared").where(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held[lang] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, c in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * BUCKETS), pa.array(np.arange(BUCKETS), pa.int32()), pa.array(c)], names=["declared", "bucket", "n"])

    parts = sample.select("declared", "text").mapInArrow(in_worker(run, "language"), "declared string, bucket int, n long").where("n > 0")
    found = parts.groupBy("declared", "bucket").agg(F.sum("n").alias("n")).toPandas()
    c = np.zeros((BUCKETS, len(languages)))
    at = {lang: i for i, lang in enumerate(languages)}
    for lang, part in found.groupby("declared"):
        c[part["bucket"].to_numpy(), at[lang]] = part["n"].to_numpy()
    logp = np.log((c + 0.1) / (c.sum(axis=0) + 0.1 * BUCKETS))
    return TextModel(languages, np.column_stack([logp, np.full(BUCKETS, -np.log(BUCKETS))]))


def with_text_evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """id, text_hash, declared, suffix, host, ll (null without text): one pass over the texts."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            ll = [None if (x := m.log_likelihoods(t.as_py())) is None else x.tolist() for t in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(ll, pa.list_(pa.float64()))], names=["id", "text_hash", "declared", "suffix", "host", "ll"])

    cols = rows.select("id", F.xxhash64("text").alias("text_hash"), "declared", "suffix", "host", "text")
    return cols.mapInArrow(in_worker(run, "language"), "id long, text_hash long, declared string, suffix string, host string, ll array<double>")


def identify(rows: DataFrame, model: TextModel | None = None, least: float = LEAST) -> DataFrame:
    """id, text_hash, declared, language, confidence, kept for rows (id, text, declared, suffix, host).

    log P(language | evidence) is the sum of the tempered text likelihood, the chance that a document of the
    language declares what this one does, and a prior from the host, smoothed towards its address suffix and
    that towards all documents.  The tables behind chance and prior are grouped sums of the best languages by
    text; they have a row a declaration, suffix or host, and a document's own vote is left out of its host's.
    language is null where "no known language" wins, the best one's posterior is under ``least``, or there
    is no text; such documents are not kept.

    A text whose declaration is a label too rare to fit cannot be judged by the model: its declaration is trusted, and it
    is kept.  So is one without a declaration if over half of its host's declarations are one such label.  Their
    confidence is null.

    Of languages of equal score the first by code point wins, known ones before "no known language"; a host's two labels never
    both have over half.  Whole texts count, however long.

    No labelled row to fit on: nothing is known, no document is kept.  Null declared, suffix or host: no evidence of that kind.  Null ids and repeated rows are rows like others.
    Empty table: no rows.
    """
    model = model or fit(rows)
    langs = model.languages
    n_lang = len(langs)
    if not langs:
        none = [F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("kept")]
        return rows.select("id", F.xxhash64("text").alias("text_hash"), "declared", *none)
    light = with_text_evidence(rows, model)
    best = F.array_position(F.col("ll"), F.array_max("ll")).cast("int") - 1
    light = materialize(light.withColumn("best", F.when(F.col("ll").isNotNull(), best)), "language-evidence")

    votes = [F.sum(F.when(F.col("best") == i, 1).otherwise(0)).cast("double") for i in range(n_lang)]
    total = light.agg(*[v.alias(f"v{i}") for i, v in enumerate(votes)]).first()
    total = np.array([total[i] or 0.0 for i in range(n_lang)])
    overall = [float(x) for x in (total + 1) / (total.sum() + n_lang)]
    doubles = lambda values: F.array(*[F.lit(float(v)) for v in values])
    sums = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    said = light.where("declared is not null").groupBy("declared").agg(F.array(*votes).alias("v"))
    n_said = said.count()
    said = said.select(
        "declared", F.zip_with("v", doubles(total), lambda v, t: F.log((v + 1) / (t + 1 + n_said))).alias("chance")
    )
    suffixes = light.where("suffix is not null").groupBy("suffix").agg(F.array(*votes).alias("v"))
    suffixes = suffixes.select(
        "suffix",
        F.zip_with("v", doubles(overall), lambda v, o: v + o * SUFFIX_ROWS).alias("v"),
    ).select("suffix", F.transform("v", lambda x: x / sums(F.col("v"))).alias("by_suffix"))
    hosts = light.where("host is not null").groupBy("host").agg(F.array(*votes).alias("by_host"))

    d = light.join(said, "declared", "left").join(suffixes, "suffix", "left").join(hosts, "host", "left")
    parent = F.coalesce("by_suffix", doubles(overall))
    own = F.transform(
        F.coalesce("by_host", doubles([0.0] * n_lang)),
        lambda v, i: v - F.when(F.col("by_host").isNotNull() & (i == F.col("best")), 1.0).otherwise(0.0),
    )
    d = d.withColumn("seen", own).withColumn("parent", parent)
    prior = F.zip_with("seen", "parent", lambda v, p: F.log((v + p * HOST_ROWS) / (sums(F.col("seen")) + HOST_ROWS) * (1 - UNKNOWN)))
    prior = F.zip_with(prior, F.coalesce("chance", doubles([0.0] * n_lang)), lambda a, b: a + b)
    # what is declared says nothing of documents in no known language: the mean chance
    none = F.lit(float(np.log(UNKNOWN))) + F.coalesce(sums(F.col("chance")) / n_lang, F.lit(0.0))
    d = d.withColumn("score", F.zip_with(F.concat(prior, F.array(none)), "ll", lambda a, b: a + b))
    top = F.array_max("score")
    at = F.array_position("score", top).cast("int")
    d = d.withColumn("at", at).withColumn(
        "confidence", F.when(F.col("ll").isNotNull(), 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    )
    name = F.element_at(F.array(*[F.lit(x) for x in langs], F.lit(None).cast("string")), F.col("at"))
    # labels without a model: what is declared, or what most of the host declares
    rare = F.col("declared").isNotNull() & ~F.col("declared").isin(langs)
    per_host = light.where("host is not null and declared is not null").groupBy("host", "declared").agg(F.count("*").alias("n"))
    per_host = per_host.groupBy("host").agg(F.max(F.struct("n", "declared")).alias("most"), F.sum("n").alias("all"))
    per_host = per_host.where((F.col("most.n") * 2 > F.col("all")) & ~F.col("most.declared").isin(langs))
    d = d.join(per_host.select("host", F.col("most.declared").alias("of_host")), "host", "left")
    trusted = F.when(F.col("ll").isNotNull(), F.when(rare, F.col("declared")).when(F.col("declared").isNull(), F.col("of_host")))
    d = d.withColumn("trusted", trusted).withColumn("confidence", F.when(F.col("trusted").isNull(), F.col("confidence")))
    language = F.coalesce("trusted", F.when(F.col("ll").isNotNull() & (F.col("confidence") >= least), name))
    return d.select("id", "text_hash", "declared", language.alias("language"), "confidence", language.isNotNull().alias("kept"))


def of_documents(docs: DataFrame) -> DataFrame:
    """Evidence of documents: lang is declared, source is the host; they have no address."""
    return docs.select(
        F.col("doc_id").cast("long").alias("id"), "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host")
    )


def of_pages(pages: DataFrame) -> DataFrame:
    """Evidence of raw pages: the html element's lang, the address's last label, its host; text without markup."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*+>", " ")
    blank = lambda c: F.when(c != "", c)
    return pages.select(
        F.col("page_id").cast("long").alias("id"), text.alias("text"), blank(declared).alias("declared"),
        blank(F.regexp_extract(host, r"\.([a-z]+)$", 1)).alias("suffix"), blank(host).alias("host"),
    )


def keep_identified(docs: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` without the documents that are rejected; lang is the language found.  All columns stay.

    Decisions meet the rows on id and text hash.  Rejected ones are broadcast where they are at most
    ``broadcast_rows`` (12 MB) and their other columns need no change; otherwise both sides are shuffled.
    """
    found = materialize(identify(of_documents(docs)), "language-found")
    odd = found.where("not kept or not (declared <=> language)").select("id", "text_hash", "kept", "language").distinct()
    odd = materialize(odd, "language-odd")
    odd = (F.broadcast(odd) if odd.count() <= broadcast_rows else odd).alias("o")
    # a row travels as one value, so its columns may have any names
    given = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash")).alias("g")
    on = F.col("g.id").eqNullSafe(F.col("o.id")) & (F.col("g.text_hash") == F.col("o.text_hash"))
    out = given.join(odd, on, "left").where("o.kept is null or o.kept")
    lang = F.when(F.col("o.kept").isNull(), F.col("row.lang")).otherwise(F.col("o.language"))
    return out.select(*[(lang if c == "lang" else F.col("row")[c]).alias(c) for c in docs.columns])
