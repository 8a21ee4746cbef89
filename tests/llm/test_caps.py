import numpy as np
import pytest

from sieveline.llm import caps

RNG = np.random.default_rng(9)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(ids, vectors, cosine):
    u = unit(np.array(vectors, np.float64))
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    root = np.array(ids)
    while True:
        low = np.minimum(root, np.where(near, root[None, :], 10**9).min(axis=1))
        if (low == root).all():
            return {i: (int(n), int(r)) for i, n, r in zip(ids, near.sum(axis=1), root)}
        root = low


def table(spark, rows):
    return spark.createDataFrame([(i, v, 3, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, n int")


@pytest.mark.parametrize("block", [512, 16])
def test_links_equal_brute_force(spark, block):
    base = unit(RNG.standard_normal((300, 64)))
    center = unit(RNG.standard_normal((1, 64)))
    group = unit(center + 0.02 * RNG.standard_normal((120, 64)))
    copies = np.repeat(base[:1], 30, axis=0)
    scaled = base[1:4] * 7
    v = np.concatenate([base, group, copies, scaled]).astype(np.float32)
    ids = list(range(len(v)))
    got = caps.near_duplicates(table(spark, [(i, x.tolist()) for i, x in zip(ids, v)]), block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(ids, v, 0.9)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_at_the_threshold(spark):
    n = 1500
    a = unit(RNG.standard_normal((n, 64)))
    side = RNG.standard_normal((n, 64))
    side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = a * 0.901 + side * np.sqrt(1 - 0.901**2)
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([a, b]))]
    got = caps.near_duplicates(table(spark, rows)).collect()
    want = brute(list(range(2 * n)), np.array([r[1] for r in rows], np.float32), 0.9)
    found = sum(r.n_links for r in got)
    assert found <= sum(w[0] for w in want.values()) and found >= 0.97 * sum(w[0] for w in want.values())


def test_odd_vectors(spark):
    good = [1.0, 2.0, 3.0]
    rows = [(1, good), (2, None), (3, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, [None, 1.0, 1.0]), (7, []), (8, good), (9, [1.0, 2.0]),
            (None, good), (10, [-0.0, 0.0, 0.0]), (11, [2.0, 4.0, 6.0]), (8, good)]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in caps.near_duplicates(table(spark, rows)).collect()), key=repr)
    assert [g for g in got if g[0] in (1, 8, 11)] == sorted([(1, 3, 1, True), (8, 3, 1, False), (8, 3, 1, False), (11, 3, 1, False)], key=repr)
    assert all(g[1:] == (0, g[0], True) for g in got if g[0] not in (0, 1, 8, 11))
    assert caps.near_duplicates(table(spark, [])).count() == 0


def test_decoding_finds_all_caps():
    plan = caps.Plan(3000, 48, 0.9)
    book = plan.books()[0]
    x = unit(RNG.standard_normal((20, 48)))
    for v in x:
        products = [v[plan.cuts[i] : plan.cuts[i + 1]] @ book[i].T for i in range(plan.blocks)]
        total = products[0]
        for p in products[1:]:
            total = (total[:, None] + p[None, :]).ravel()
        want = np.flatnonzero(total / np.sqrt(plan.blocks) >= plan.least)
        assert sorted(plan.decode(products)) == want.tolist()


def partners(kind, n):
    """Pairs at cosine 0.901 of vectors of a kind."""
    rows, other = RNG.standard_normal((n, 64)), RNG.standard_normal((n, 64))
    weight = {"padded": np.arange(64) < 32, "decaying": np.exp(-np.arange(64) / 6), "sparse": RNG.random((n, 64)).argsort(axis=1) < 4}[kind]
    a, other = unit(rows * weight), other * weight
    other = unit(other - (other * a).sum(axis=1, keepdims=True) * a)
    return np.concatenate([a, a * 0.901 + other * np.sqrt(1 - 0.901**2)]).astype(np.float32)


@pytest.mark.parametrize("kind", ["padded", "decaying", "sparse"])
def test_recall_whatever_the_kind(spark, kind):
    v = partners(kind, 400)
    got = caps.near_duplicates(table(spark, list(enumerate(v.tolist())))).collect()
    want = brute(list(range(len(v))), v, 0.9)
    found, all_ = sum(r.n_links for r in got), sum(w[0] for w in want.values())
    assert 0.99 * all_ <= found <= all_


def test_vectors_of_few_caps_are_compared_with_all(spark, monkeypatch):
    v = np.concatenate([partners("padded", 60), unit(unit(RNG.standard_normal((1, 64))) + 0.02 * RNG.standard_normal((50, 64)))]).astype(np.float32)
    v = np.concatenate([v, v[:9]])
    few = caps.Plan.__init__

    def many(self, *args, **options):
        few(self, *args, **options)
        self.few = 30  # about half of all

    monkeypatch.setattr(caps.Plan, "__init__", many)
    got = caps.near_duplicates(table(spark, list(enumerate(v.tolist())))).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(list(range(len(v))), v, 0.9)
