import random

import pytest

from sieveline.llm import minhash

SCHEMA = "doc_id long, text string, n long, value string, component string"
random.seed(5)
WORDS = [f"w{i}" for i in range(4000)]


def shingles(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def components(rows, width, num, den):
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(text, edits):
    words = text.split()
    for _ in range(edits):
        words[random.randrange(len(words))] = random.choice(WORDS)
    return " ".join(words)


def corpus():
    text = lambda n: " ".join(random.choices(WORDS, k=n))
    rows = [(i, text(random.randrange(1, 400))) for i in range(60)]
    base, common = text(200), text(120)
    rows += [(100 + i, edited(base, random.randrange(0, 14))) for i in range(90)]  # a family around the threshold
    rows += [(200 + i, common + " " + text(80)) for i in range(60)]  # a passage that many share
    rows += [(300 + i, common + " " + text(6)) for i in range(40)]  # documents made of little else
    rows += [(400 + i, "Exact COPY of a\ttext " * 9) for i in range(50)] + [(460, "exact copy of a text " * 9)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "one"), (504, "ONE"), (505, "one two"), (506, "one two"), (507, "É one"), (508, "é one"), (None, "no id"), (None, "no id")]
    big = text(6000)
    rows += [(600, big), (601, edited(big, 100)), (602, edited(big, 900))]
    return rows


@pytest.mark.parametrize("width, num, den, options", [
    (3, 85, 100, {}), (5, 80, 100, {}), (3, 85, 100, {"star_rounds": 0, "short_list": 2}), (3, 85, 100, {"star_rounds": 1, "short_list": 10_000, "list_part": 3})])
def test_components_equal_brute_force(spark, width, num, den, options):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "clash", "clash") for i, t in rows], SCHEMA)
    got = minhash.near_duplicates(df, width, num, den, **options).collect()
    assert len(got) == len(rows)
    want = components(rows, width, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and all(r.component_id is None for r in got if r.doc_id is None)


def test_little(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, "a b c", 1, "", ""), (1, "a b c", 1, "", "")], SCHEMA)
    assert [(r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()] == [(1, True)] * 2


def test_ids_beyond_the_broadcast_bound(spark):
    rows = [(i, f"the same {i % 3} words in all of these texts again and again") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(0, 3), (0, 1), (1, 4)], "a long, b long")
    got = {tuple(r) for r in minhash.verified(pairs, docs, 3, 85, 100, broadcast_ids=0).collect()}
    assert got == {(0, 3), (1, 4)}


@pytest.mark.parametrize("width, num", [(3, 85), (5, 80)])
def test_sets_as_large_as_a_sketch_at_the_threshold(spark, width, num):
    rows = []
    for n in range(55, 66):
        lost = max(m for m in range(n) if 100 * (n - m) >= num * (n + m))
        for _ in range(8):
            words = random.sample(WORDS, n + width - 1)  # n shingles, of which the other text lacks ``lost``
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: len(words) - lost] + [f"x{i}" for i in range(lost)]))]
    want = components(rows, width, num, 100)
    assert len({c for _, c in want.values()}) == len(rows) // 2
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
