import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sieveline.llm import fingerprints as fp

random.seed(8)


def paragraphs(text):
    return set(re.findall(r"(?:[^\s]+[^\S\n]*){1,32}", text, re.A))


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def line():
    return " ".join(random.choices(["alpha", "beta", "gamma", "delta", "é", "𝄞"], k=random.randrange(1, 90)))


def corpus():
    rows = [(i * 3, "\n".join(line() for _ in range(random.randrange(1, 12)))) for i in range(150)]
    rows += [(1000 + i, "the same text\nin two lines") for i in range(20)] + [(2000, "\n".join(f"line {i}" for i in range(3000)))]
    rows += [(2001, "\n".join(f"line {i}" for i in range(0, 3000, 2))), (2002, None), (2003, ""), (2004, "\n \t\n"), (10**12, "far away"), (-5, "below zero")]
    return rows


@pytest.mark.parametrize("per_bucket", [1024, 5])
def test_against_plain_python(spark, monkeypatch, per_bucket):
    rows = corpus()
    whole = fp.next_document
    monkeypatch.setattr(fp, "next_document", lambda docs: whole(docs, per_bucket))
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, bucket int, key string")
    got = {r.doc_id: r for r in fp.compare_with_edits(df).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    prints = {}
    for n, (i, t) in enumerate(order):
        other = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(likeness(paragraphs(t), paragraphs(edited)))
        assert r.near_next == pytest.approx(likeness(paragraphs(t), paragraphs(other)))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint


def test_small_sketches_peel_or_fail_but_never_lie(spark):
    rows = [(list(range(a)), list(range(a - b, a + b))) for a, b in ((5, 1), (9, 2), (30, 4), (40, 20), (0, 0), (3, 0), (60, 60))]
    keys = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    df = spark.createDataFrame(rows, "a array<int>, b array<int>").withColumn("ka", keys(F.col("a"))).withColumn("kb", keys(F.col("b")))
    out = df.select(
        "a", "b",
        fp.peel(fp.subtract(fp.sketch(F.col("ka"), 4, 1), fp.sketch(F.col("kb"), 4, 1)), 4, 1).alias("d"),
        fp.in_groups(F.col("ka"), F.col("kb")).alias("g"),
    ).collect()
    want = [len(set(r.a) ^ set(r.b)) for r in out]
    assert [r.g for r in out] == want and all(r.d in (None, w) for r, w in zip(out, want))
    assert out[0].d == want[0] and out[4].d == 0 and any(r.d is None for r in out)


def test_large_sketches(spark):
    pairs = [(b, n, [random.getrandbits(63) for _ in range(n)]) for b in range(3) for n in (0, 1, 7, 60, 900)]
    df = spark.createDataFrame([(b, n, k, k[: n // 2] + [random.getrandbits(63) for _ in range(n // 3)]) for b, n, k in pairs], "bucket long, pid long, a array<long>, b array<long>")
    got = {(r.bucket, r.pid): r.diff for r in fp.peeled(df.repartition("bucket")).collect()}
    assert set(got) == {(b, n) for b, n, _ in pairs}
    assert all(d in (None, n - n // 2 + n // 3) for (_, n), d in got.items()) and sum(d is not None for d in got.values()) >= 12


@pytest.mark.parametrize("rows", [[], [(1, "alone")], [(1, None)], [(None, "a\nb"), (None, "c")], [(4, "x"), (4, "y"), (4, "y")]])
def test_little(spark, rows):
    got = fp.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(0 <= r.near_next <= 1 and r.n_chars is not None for r in got)


def test_ranges_are_even(spark):
    far = [(i, f"text {i % 7}") for i in range(5000)] + [(10**12, "far"), (-(2**63), "low"), (2**63 - 1, "high")]
    hot = [(5, f"one id, text {i}") for i in range(3000)] + [(i, "t") for i in range(3000)] + [(None, f"null {i}") for i in range(3000)]
    for rows in (far, hot):
        d = fp.next_document(spark.createDataFrame(rows, "doc_id long, text string"), 500)
        got = d.select("bucket", "doc_id", "text", "next_text").collect()
        held = {}
        for r in got:
            held[r.bucket] = held.get(r.bucket, 0) + 1
        assert len(got) == len(rows) and max(held.values()) <= 1000
        # one cycle through all texts
        import collections

        assert collections.Counter(r.text for r in got) == collections.Counter(r.next_text for r in got)
