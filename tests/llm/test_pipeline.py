import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sieveline.llm import language, minhash, queries

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import assert_same  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_all_operators_are_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_queries_answer_for_every_row(spark, name):
    rows = queries.queries()[name](spark, SF).collect()
    source = "pages" if name.endswith("pages") else "documents"
    assert len(rows) == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_stages_follow_on_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    one = corpus_pipeline.identify_language(spark, docs, SF).cache()
    assert one.columns == columns and one.count() >= 0.98 * docs.count()
    two = corpus_pipeline.drop_near_duplicates(spark, one, SF).cache()
    found = minhash.near_duplicates(one, 5, 80, 100)
    assert two.columns == columns and {r.doc_id for r in two.collect()} == {r.doc_id for r in found.where("kept").collect()}
    three = corpus_pipeline.mix_sources(spark, two, SF).cache()
    times = {r.doc_id: r["count"] for r in three.groupBy("doc_id").count().collect()}
    assert three.columns == columns and set(times) <= {r.doc_id for r in two.collect()} and max(times.values()) <= 3
    four = corpus_pipeline.encode_pieces(spark, three, SF)
    assert four.count() == three.count() and four.where("not agrees").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in df.collect())
    assert key(whole) == key(four)


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, passes int, _hash string"
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).withColumn("passes", F.lit(1)).withColumn("_hash", F.lit("clash"))
    odd = spark.createDataFrame([(None, None, None, None, None, 1, ""), (1, "", "en", None, 0, 1, ""), (None, "the and of that", "en", None, 9, 1, "")], schema)
    for given in (odd.limit(0), odd, docs.unionByName(odd).unionByName(docs)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, SF)
            assert out.columns == given.columns, name
            out.collect()
        assert corpus_pipeline.encode_pieces(spark, given, SF).where("agrees").count() == given.count()
    assert language.identify(language.of_documents(odd)).count() == 3


def test_the_mix_gives_its_amounts_for_repeated_rows(spark):
    """Repeated rows and null ids with texts of one crc32: a row a pass, no text or column lost."""
    from collections import Counter

    rows = [(1, "w " * 20, "en", "a", 5)] * 60 + [(2, "v " * 10, "en", "b", 5), (2, "v " * 10, "de", "b", 5)] * 20
    rows += [(None, "plumless", "en", "c", 1), (None, "buckeroo", "en", "c", 1), (3, None, "en", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    _, entries = corpus_pipeline.mixing.mix_entries(docs)
    out = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    assert len(out) == entries.where("2 * taken >= size").count()
    words = Counter()
    for r in out:
        words[r.source] += len(r.text.split())
    # 1602 words by weights 1, 2, 3, but c stops at 3 * 2
    want = {"a": (1602 - 6) / 3, "b": (1602 - 6) * 2 / 3, "c": 6}
    assert all(abs(words[s] - want[s]) <= 20 for s in want)
    assert {r.text for r in out if r.source == "c"} == {"plumless", "buckeroo"} and {r.lang for r in out if r.source == "b"} == {"en", "de"}


def test_against_a_plain_version(spark):
    """Brute-force near-duplicates, repeated dealing of the budget, and the library's tokens."""
    import collections
    import hashlib

    import sentencepiece
    from test_minhash import components
    from test_mixing_sharding import water

    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    languages = {r.doc_id for r in corpus_pipeline.identify_language(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert len(languages) >= 0.98 * len(rows)
    own = components([(i, rows[i].text) for i in sorted(languages)], 5, 80, 100)
    kept = {i for i, (_, c) in own.items() if i == c}
    out = collections.Counter()
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    got = corpus_pipeline.run(spark, SF).collect()
    for r in got:
        ids = library.encode(rows[r.doc_id].text) + [2]
        assert r.doc_id in kept and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        out[r.doc_id] += 1
    size = {i: len(rows[i].text.split()) for i in kept}
    sizes, taken, most = collections.Counter(), collections.Counter(), collections.Counter()
    for i in kept:
        s = rows[i].source
        sizes[s] += size[i]
        taken[s] += out[i] * size[i]
        most[s] = max(most[s], size[i])
    want = water(sizes)
    assert all(abs(taken[s] - want[s]) <= 2 * max(most.values()) for s in sizes) and max(out.values()) <= 3
