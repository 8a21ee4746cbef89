import math

import pytest
import xxhash

from sieveline.operators import filters, fpr
from sieveline.plans.config import CODEC_SEEDS, FilterSpec


def model_indices(item, spec):
    h = lambda seed: xxhash.xxh64_intdigest(item, seed=int(seed))
    if spec.kind == "standard":
        return [h(i) % spec.m for i in range(int(spec.k))]
    s1, s2, sa = spec.seeds or (0, 1, math.ceil(spec.k))
    whole = int(spec.k)
    n = whole + (h(sa) / (2**64 - 1) < spec.k - whole)
    return [(h(s1) + i * h(s2)) % spec.m for i in range(n)]


SPECS = [
    FilterSpec("s", "standard", 500, 3),
    FilterSpec("s0", "standard", 100, 0.4),
    FilterSpec("r", "rational", 700, 2.6),
    FilterSpec("low", "rational", 300, 0.35),
    FilterSpec("int", "rational", 640, 4.0),
    FilterSpec("codec", "rational", 999, 1.7, CODEC_SEEDS["stream"]),
    FilterSpec("mask", "rational", 4097, 3.2, CODEC_SEEDS["frames"]),
]
MEMBERS, OTHERS = [str(i) for i in range(120)], [str(i) for i in range(1000, 1400)]


@pytest.fixture(scope="module")
def built(spark):
    items = spark.createDataFrame([(s.filter_id, w) for s in SPECS for w in MEMBERS], "filter_id string, item string")
    f = filters.params(spark, SPECS)
    return f, filters.build(items, f).cache()


def test_bits_equal_the_model(spark, built):
    got = {}
    for r in filters.set_bits(built[1]).collect():
        got.setdefault(r.filter_id, set()).add(r.idx)
    for s in SPECS:
        assert got.get(s.filter_id, set()) == {i for w in MEMBERS for i in model_indices(w, s)}
    counts = {r.filter_id: r.bits_set for r in filters.bit_counts(*built).collect()}
    assert counts == {s.filter_id: len(got.get(s.filter_id, ())) for s in SPECS}


@pytest.mark.parametrize("bits", [0, filters.BROADCAST_BITS + 1])
def test_probe_equals_the_model_on_both_paths(spark, built, bits):
    items = spark.createDataFrame([(s.filter_id, w) for s in SPECS for w in MEMBERS + OTHERS], "filter_id string, item string")
    got = {(r.filter_id, r.item): r.passes for r in filters.probe(items, *built, bits=bits).collect()}
    assert len(got) == len(SPECS) * (len(MEMBERS) + len(OTHERS))
    for s in SPECS:
        on = {i for w in MEMBERS for i in model_indices(w, s)}
        for w in MEMBERS + OTHERS:
            assert got[s.filter_id, w] == all(i in on for i in model_indices(w, s))
        assert all(got[s.filter_id, w] for w in MEMBERS)


def test_merging_is_adding(spark, built):
    one = SPECS[2]
    f = filters.params(spark, [one])
    half = lambda ws: filters.build(spark.createDataFrame([("r", w) for w in ws], "filter_id string, item string"), f)
    both = filters.merge_words(half(MEMBERS[:50]).union(half(MEMBERS[50:])))
    assert {tuple(r) for r in both.collect()} == {tuple(r) for r in built[1].where("filter_id = 'r'").collect()}


def test_too_many_hashes_are_refused():
    with pytest.raises(ValueError):
        filters.params_row(FilterSpec("x", "standard", 10, 65))


def test_rates(spark):
    a = spark.createDataFrame([(w,) for w in MEMBERS], "item string")
    t = spark.createDataFrame([(w,) for w in MEMBERS + OTHERS], "item string")
    spec = FilterSpec("r", "rational", 700, 2.6)
    r = fpr.measure(a, t, [spec], spark).first()
    on = {i for w in MEMBERS for i in model_indices(w, spec)}
    assert r.false_positives == sum(all(i in on for i in model_indices(w, spec)) for w in OTHERS)
    assert r.tested == len(MEMBERS + OTHERS)
    k = fpr.sweep_hashes(a, t, 700, [0.4, 2.5], spark).collect()
    assert {(x.kind, x.k) for x in k} == {(a, b) for a in ("standard", "rational") for b in (0.4, 2.5)}
    zero = next(x for x in k if x.kind == "standard" and x.k == 0.4)
    assert zero.bits_set == 0 and zero.rate == len(OTHERS) / len(MEMBERS + OTHERS)
    c = fpr.compare(a, t, 700, 120, spark).first()
    assert c.standard >= 0 and c.rational >= 0
    best = 1 - math.exp(-3 * 120 / 700)
    trials = fpr.trials(fpr.sweep_sizes(a, t, [700, 900], 120, spark).where("kind = 'standard'"), best**3).first()
    assert trials.trials == 2


def broadcast_rows(node):
    """Rows of each broadcast of a plan that has run."""
    name = node.getClass().getSimpleName()
    found = [node.metrics().apply("numOutputRows").value()] if name == "BroadcastExchangeExec" else []
    below = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
    kids = node.children()
    return found + [n for k in below + [kids.apply(i) for i in range(kids.size())] for n in broadcast_rows(k)]


def test_sweeps_broadcast_nothing_that_grows_with_the_items(spark, tmp_path):
    spark.range(3000).selectExpr("cast(id as string) item").write.parquet(f"{tmp_path}/a")
    spark.range(2000, 5000).selectExpr("cast(id as string) item").write.parquet(f"{tmp_path}/t")
    r = fpr.sweep_hashes(spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/t"), 12_000, [0.4, 2.5], spark)
    got = {(x.kind, x.k): x for x in r.collect()}
    rows = broadcast_rows(r._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 4
    members, tests = [str(i) for i in range(3000)], [str(i) for i in range(2000, 5000)]
    for kind, k in (("standard", 0.4), ("rational", 0.4), ("standard", 2.5), ("rational", 2.5)):
        spec = FilterSpec("x", kind, 12_000, round(k) if kind == "standard" else k)
        on = {i for w in members for i in model_indices(w, spec)}
        false = sum(all(i in on for i in model_indices(w, spec)) for w in tests[1000:])
        assert (got[kind, k].bits_set, got[kind, k].rate) == (len(on), false / len(tests))


def test_large_filters_broadcast_their_parameters_only(spark, tmp_path):
    spark.range(3000).selectExpr("'r' filter_id", "cast(id as string) item").write.parquet(f"{tmp_path}/a")
    spark.range(2000, 5000).selectExpr("'r' filter_id", "cast(id as string) item").write.parquet(f"{tmp_path}/t")
    spec = FilterSpec("r", "rational", 12_000, 2.5)
    f = filters.params(spark, [spec])
    words = filters.build(spark.read.parquet(f"{tmp_path}/a"), f, n_filters=1)
    r = filters.probe(spark.read.parquet(f"{tmp_path}/t"), f, words, bits=filters.BROADCAST_BITS + 1, n_filters=1)
    got = {x.item: x.passes for x in r.collect()}
    rows = broadcast_rows(r._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 1
    on = {i for w in range(3000) for i in model_indices(str(w), spec)}
    assert got == {w: all(i in on for i in model_indices(w, spec)) for w in map(str, range(2000, 5000))}


def test_repeated_and_null_tests_count_each_time(spark):
    a = spark.createDataFrame([("1",), ("1",), (None,)], "item string")
    t = spark.createDataFrame([("1",), ("1",), ("2",), ("2",), ("2",), (None,), (None,)], "item string")
    r = fpr.measure(a, t, [FilterSpec("all", "standard", 64, 0)], spark).first()
    assert (r.false_positives, r.tested, r.rate) == (5, 7, 5 / 7)
