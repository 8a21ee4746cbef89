import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import gru, language, pieces, queries
from sieveline.llm.queries import piece_model

random.seed(3)


# --- language model ---------------------------------------------------------------------------------------


def tiny():
    n = gru.VOCABULARY
    counts = np.arange(n, 0, -1)
    return gru.Corpus(np.arange(n), counts, np.zeros(n, np.int32), int(counts.sum()), n, 10, np.full(gru.KINDS, 5.0), n)


def test_gradients_are_right():
    net = gru.Network.start(tiny())
    rng = np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids = rng.integers(0, gru.VOCABULARY + gru.KINDS + 1, (6, 3))
    fresh = np.zeros((6, 3), bool)
    fresh[0, 0] = fresh[3, 1] = True
    used = np.ones((6, 3), bool)
    used[5, 2] = False
    h = rng.standard_normal((3, gru.STATE)) * 0.3

    def loss():
        before, _, _ = net.window(ids, fresh, h, False)
        at = np.flatnonzero(used.ravel())
        return -net.scores(before.reshape(-1, gru.STATE).astype(np.float64)[at], ids.ravel()[at]).sum()

    grads, n, _ = net.gradients(ids, fresh, used, h)
    assert n == 17
    for name in net.names:
        flat = np.argsort(-np.abs(grads[name]).ravel())[[0, 3, 9]]
        for at in flat:
            p = net.p[name].reshape(-1)
            old = p[at]
            p[at] = old + 1e-3
            up = loss()
            p[at] = old - 1e-3
            down = loss()
            p[at] = old
            assert grads[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=2e-3)


def test_probabilities_sum_to_one():
    net = gru.Network.start(tiny())
    rng = np.random.default_rng(2)
    n = gru.VOCABULARY + gru.KINDS + 1
    h = np.repeat(rng.uniform(-1, 1, (1, gru.STATE)).astype(np.float32), n, axis=0)
    assert np.exp(net.scores(h, np.arange(n))).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried_whatever_the_window():
    net = gru.Network.start(tiny())
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, gru.VOCABULARY, n) for n in (1, 5, 700, 64, 65, 3)]
    plain = [plain_score(net, d) for d in docs]
    for lanes, steps in ((1, 7), (2, 64), (256, 64), (3, 10_000)):
        got = {doc[0]: p for doc, p in gru.scored(net, enumerate(docs), lanes, steps)}
        assert [got[i] for i in range(len(docs))] == pytest.approx(plain, rel=1e-4)


def plain_score(net, ids):
    """Log probability of one text, token by token in double precision."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    s, h, out = gru.STATE, np.zeros(gru.STATE), 0.0
    soft = lambda a: a - a.max() - np.log(np.exp(a - a.max()).sum())
    for i in ids:
        c = i // gru.PER_CLASS if i < gru.VOCABULARY else i - gru.VOCABULARY + net.classes
        out += soft(h @ p["wc"] + p["bc"])[c]
        if i < gru.VOCABULARY:
            out += soft(h @ p["ww"][c] + p["bw"][c])[i % gru.PER_CLASS]
        x, u = p["x"][i], h @ p["u"]
        z, r = 1 / (1 + np.exp(-(x[:s] + u[:s]))), 1 / (1 + np.exp(-(x[s : 2 * s] + u[s : 2 * s])))
        n = np.tanh(x[2 * s :] + r * u[2 * s :])
        h = (1 - z) * n + z * h
    return out


def test_memory_follows_the_lanes_not_the_longest_text():
    import tracemalloc

    net = gru.Network.start(tiny())
    docs = [np.zeros(300_000, np.int64), *[np.zeros(50, np.int64)] * 255]
    tracemalloc.start()
    assert len(list(gru.scored(net, ((d,) for d in docs)))) == 256
    gru.train_on(net, ((d[:100_000],) for d in docs), {}, 0.02)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def model_text(i):
    a, b = (["red", "sun", "over"], ["hill", "wind"]) if i % 2 else (["rot", "und", "der"], ["berg", "das"])
    return " ".join(random.choice(a) + " " + random.choice(b) for _ in range(30)) + f" rare{i} Rare{i % 50}"


def test_scores(spark):
    rows = [(i, model_text(i)) for i in range(400)] + [(900, None), (901, ""), (902, " \n"), (None, "no id"), (903, "zzz qqq unseen"), (7, "again again")]
    rows += [(904, "sun " * 20_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = {(r.doc_id, r.n_tokens, r.held_out): r for r in gru.score(df).collect()}
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: (t or "").lower().split()
    c, ends = collections.Counter(), 0
    for i, t in rows:
        if not out(i):
            c.update(words(t))
            ends += 1
    big_n, big_v = sum(c.values()) + ends, len(c) + 1
    assert len(got) == len({(i, len(words(t)) + 1) for i, t in rows})
    gain = tokens = 0
    for i, t in rows:
        r = got[i, len(words(t)) + 1, out(i)]
        base = sum(math.log10((c[w] + 1) / (big_n + big_v + 1)) for w in words(t)) + math.log10((ends + 1) / (big_n + big_v + 1))
        assert r.base_score == pytest.approx(base) and r.train_tokens == big_n
        assert r.n_known == 1 + sum(c[w] > 0 for w in words(t)) and r.score < 0
        if r.held_out and i < 400:
            gain, tokens = gain + r.score - base, tokens + r.n_tokens
    assert gain / tokens > 0.05


def test_scores_equal_a_plain_loop(spark, monkeypatch):
    kept = {}

    def started(docs, corpus, shares):
        kept["net"], kept["corpus"] = gru.Network.start(corpus), corpus
        return kept["net"]

    monkeypatch.setattr(gru, "train", started)
    rows = [(i, model_text(i)) for i in range(2500)] + [(9000, "Zzz zzz 12 unseen,"), (9001, None)]
    got = {r.doc_id: r.score for r in gru.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    c = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in gru.words(t))
    net, corpus = kept["net"], kept["corpus"]
    named = {k: i for i, k in enumerate(corpus.keys[: corpus.named].tolist())}
    mass = np.ones(gru.KINDS)
    for w, n in c.items():
        if gru.word_key(w) not in named:
            mass[gru.kind(w)] += n + 1
    assert len(c) > gru.VOCABULARY == corpus.named and mass == pytest.approx(corpus.kind_mass)
    for i, t in [*rows[:20], *rows[-2:]]:
        ids = [named.get(gru.word_key(w), gru.VOCABULARY + gru.kind(w)) for w in gru.words(t)]
        inner = sum(math.log10((c[w] + 1) / mass[gru.kind(w)]) for w in gru.words(t) if gru.word_key(w) not in named)
        assert got[i] == pytest.approx(plain_score(net, [*ids, corpus.end]) / math.log(10) + inner, rel=1e-4)


def test_every_learned_document_trains_the_network(spark):
    start = gru.Network.start(tiny())
    assert sum(gru.SHARES) == gru.PARTS
    for part in range(gru.PARTS):
        ids = np.arange(20, dtype=np.int16).tobytes()
        docs = spark.createDataFrame([(part, bytearray(ids))], "part int, ids binary")
        assert (gru.train(docs, tiny()).p["u"] != start.p["u"]).any()
    read = gru.tokens(spark.range(400).selectExpr("id AS doc_id", "'red sun' AS text"), tiny())
    assert {r.part for r in read.select("part").distinct().collect()} == set(range(gru.PARTS))


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string"
    assert gru.score(spark.createDataFrame([], schema)).count() == 0
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = gru.score(spark.createDataFrame([(i, "a b")], schema)).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.score < 0


# --- pieces -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return pieces.PieceModel(piece_model(), cache_size=50), sentencepiece.SentencePieceProcessor(model_file=piece_model())


ALPHABET = st.one_of(st.sampled_from(" ▁\n\tabethin<0xA>é€𝄞\x00.,"), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=500, deadline=None)
@given(st.text(ALPHABET, max_size=60))
def test_pieces_equal_the_library(both, text):
    model, library = both
    ids = library.encode(text) + [model.end_id]
    own = model.encode_batch([text, "", text])
    assert [i.tolist() for i in own] == [ids[:-1], [], ids[:-1]]
    assert library.decode(ids) == model.decode(ids) == model.text_of(ids[:-1])


def test_agendas_in_rows_equal_the_heap(both):
    model, _ = both
    parts = ["".join(random.choices("▁abethinsor'.,éx", k=random.randrange(1, 39))) for _ in range(3000)] + ["▁", "a", "▁Verachst", "▁é𝄞"]
    for found, part in zip(model.agenda_rows(parts), parts):
        assert found is None or np.frombuffer(found, np.int32).tolist() == model.part_ids(part)
    assert None in model.agenda_rows(["▁\U0001f9ff", "▁the"]) and model.agenda_rows(["▁the"]) != [None]


@pytest.mark.parametrize("check", [True, False])
def test_documents(spark, both, check):
    model, library = both
    texts = [None, "", " ", "a", "  two  spaces ", "tabs\tand\nlines\n\n", "long " * 30_000, "x" * 5000, "▁raw mark", "𝄞€é", "same", "same", "w " * 3_000_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "null id", 1)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in pieces.encode_documents(df, piece_model(), check, ids=True).collect()}
    assert len(got) == len(texts) + 1
    for i, t in [*enumerate(texts), (None, "null id")]:
        ids = library.encode(t or "") + [2]
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].agrees
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode_documents(df.limit(0), piece_model()).count() == 0


def test_the_library_wins_where_it_differs(spark, tmp_path):
    # worker modules cannot be patched from here: a library that errs stands first on their path
    (tmp_path / "odd.py").write_text("class SentencePieceProcessor:\n    def __init__(self, model_file): pass\n    def encode(self, t, num_threads, return_type): return [[5]] * len(t)\n    def decode(self, x, num_threads): return ['five'] * len(x)\n")
    import importlib.util
    import sys

    spec = importlib.util.spec_from_file_location("sentencepiece", tmp_path / "odd.py")
    odd = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(odd)
    held, sys.modules["sentencepiece"] = sys.modules.get("sentencepiece"), odd
    try:
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["abc"])], names=["doc_id", "text"])
        row = next(pieces.coded_batches(iter([batch]), piece_model(), True, True, 50)).to_pylist()[0]
    finally:
        sys.modules["sentencepiece"] = held
    assert row["ids"] == [5, 2] and not row["agrees"] and row["decoded_sha256"] == hashlib.sha256(b"five").hexdigest()


def test_whole_texts_are_checked_by_default():
    import inspect

    assert inspect.signature(pieces.encode_documents).parameters["check"].default is True


# --- language ---------------------------------------------------------------------------------------------

TEXTS = {"en": "the quick brown fox and the lazy dog went with that other one to", "de": "der schnelle braune fuchs und die faulen hunde gingen mit nach dem", "fr": "le renard brun et les chiens paresseux sont allés avec des autres à"}


def sentence(lang, n):
    return " ".join(random.choices(TEXTS[lang].split(), k=n))


def test_languages_are_found_on_held_out_rows(spark):
    rows = [(i, sentence(lang := random.choice(list(TEXTS)), random.randrange(3, 60)), lang, "com", f"h{i % 9}", lang) for i in range(600)]
    schema = "id long, text string, declared string, suffix string, host string, truth string"
    model = language.fit(spark.createDataFrame(rows[:300], schema))
    assert model.languages == ["de", "en", "fr"]
    wrong = [(r[0], r[1], "en" if r[0] % 10 == 0 else None, *r[3:]) for r in rows[300:]]
    got = {r.id: r for r in language.identify(spark.createDataFrame(wrong, schema), model).collect()}
    assert sum(got[r[0]].language == r[5] for r in rows[300:]) >= 0.97 * 300 and all(r.kept for r in got.values())


def test_host_and_suffix_decide_short_texts(spark):
    model = language.TextModel(["de", "en"], np.zeros((language.BUCKETS, 3)))
    rows = [(i, "de" if i < 50 else "en") for i in range(100)]
    base = np.full((language.BUCKETS, 3), -9.0)
    for t in language.trigrams("ganz deutsch"):
        base[t, 0] = -3.0
    for t in language.trigrams("wholly english"):
        base[t, 1] = -3.0
    model.logp = base
    data = [(i, "ganz deutsch" if lang == "de" else "wholly english", None, lang, f"host-{lang}") for i, lang in rows]
    data += [(200, "zq", None, "de", "new-host"), (201, "zq", None, "en", "new-host-2"), (202, "zq", None, "de", "host-en"), (203, "zq", None, None, None), (204, "", "en", None, None), (205, None, None, None, None)]
    df = spark.createDataFrame([(*d, 1) for d in data], "id long, text string, declared string, suffix string, host string, best int")
    got = {r.id: r for r in language.identify(df.drop("best"), model, least=0.6).collect()}
    assert got[200].language == "de" and got[201].language == "en" and got[202].language == "en"
    assert got[203].language is None and not got[203].kept
    assert got[204].language is None and got[205].confidence is None
    assert language.identify(df.drop("best").limit(0), model).count() == 0


def test_noise_is_rejected_and_other_columns_stay(spark):
    rows = [(i, sentence(lang := random.choice(list(TEXTS)), 30), lang, f"s{i % 3}", 5) for i in range(200)]
    rows += [(500, "#$%@ ^&*~ ]]{{ ;;== ++\\\\ ``||" * 9, None, "s1", 5), (501, None, "en", "s1", 5), (502, sentence("de", 40), "en", "s0", 5), (None, sentence("fr", 40), "fr", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for bound in (500_000, 0):
        got = {r.doc_id: r for r in language.keep_identified(docs, bound).collect()}
        assert set(got) == {r[0] for r in rows} - {500, 501}
        assert got[502].lang == "de" and got[None].lang == "fr" and got[1].n_chars == 5


def test_pages(spark):
    html = '<!DOCTYPE html><html lang="DE"><head><script>var the = "the and of";</script></head><body><p>der hund</p></body></html>'
    r = language.of_pages(spark.createDataFrame([(1, "https://www.a.example.org/x", html), (2, None, None)], "page_id long, url string, html string")).collect()
    assert (r[0].declared, r[0].suffix, r[0].host) == ("de", "org", "www.a.example.org") and "the" not in r[0].text and "der hund" in r[0].text
    assert (r[1].declared, r[1].suffix, r[1].host, r[1].text) == (None, None, None, None)


def test_every_declared_language_counts(spark):
    tongue = lambda k: [chr(97 + k % 26) + chr(97 + k // 26) + c * 2 for c in "aeioursl"]
    say = lambda k: " ".join(random.choices(tongue(k), k=25))
    rows = [(i, say(i % 40), f"l{i % 40}", None, "mixed") for i in range(1600)] + [(2000 + i, say(40), "small", None, "mixed") for i in range(25)]
    rare = [(3000, say(41), "rare", None, "h-rare"), (3001, say(41), "rare", None, "mixed"), (3002, say(41), None, None, "h-rare"), (3003, "", "rare", None, "h-rare")]
    schema = "id long, text string, declared string, suffix string, host string"
    given = spark.createDataFrame(rows + rare, schema)
    many = spark.range(28_000).selectExpr("id + 10000", "repeat('often said words ', 4)", "'often'", "null", "'mixed'").toDF("id", "text", "declared", "suffix", "host")
    assert set(language.fit(given.union(many)).languages) == {"often", "small", *(f"l{k}" for k in range(40))}
    got = {r.id: r for r in language.identify(given.union(many)).where("id < 10000").collect()}
    assert sum(got[r[0]].language == r[2] for r in rows) >= 0.99 * len(rows)
    assert [got[i].language for i in (3000, 3001, 3002, 3003)] == ["rare", "rare", "rare", None] and got[3001].kept and not got[3003].kept


def plain_languages(rows):
    """(id, declared, language, confidence, kept) of rows (id, text, declared, suffix, host), one at a time; fitted on all labelled ones."""

    def buckets(text):
        raw = b" ".join((text or "").encode().lower().split())
        raw = bytes(48 if 48 <= b <= 57 else b for b in b" " + raw + b" ") if raw else b""
        return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 18 for i in range(len(raw) - 2)]

    labelled = [r for r in rows if r[2] is not None and r[1] is not None]
    n = collections.Counter(r[2] for r in labelled)
    langs = sorted(x for x in n if n[x] >= language.LEAST_ROWS or n[x] * 1000 >= len(labelled))
    counts = {x: collections.Counter() for x in langs}
    for r in labelled:
        if r[2] in counts:
            counts[r[2]].update(buckets(r[1]))
    logp = [lambda b, c=c, all_=sum(c.values()): math.log((c[b] + 0.1) / (all_ + 0.1 * language.BUCKETS)) for c in counts.values()]
    logp.append(lambda b: -math.log(language.BUCKETS))
    ll = []
    for r in rows:
        found = collections.Counter(buckets(r[1]))
        ll.append([language.TEMPER * sum(k * f(b) for b, k in found.items()) for f in logp] if found else None)
    best = [x.index(max(x)) if x else None for x in ll]
    known = range(len(langs))
    votes = lambda use: [sum(b == i and use(r) for r, b in zip(rows, best)) for i in known]
    total = votes(lambda r: True)
    overall = [(t + 1) / (sum(total) + len(langs)) for t in total]
    labels = {r[2] for r in rows if r[2] is not None}
    chance = {x: [math.log((v + 1) / (t + 1 + len(labels))) for v, t in zip(votes(lambda r, x=x: r[2] == x), total)] for x in labels}
    by_suffix = {x: [v + o * 50 for v, o in zip(votes(lambda r, x=x: r[3] == x), overall)] for x in {r[3] for r in rows}}
    by_host = {x: votes(lambda r, x=x: r[4] == x) for x in {r[4] for r in rows}}
    said_at = {x: collections.Counter(r[2] for r in rows if r[4] == x and r[2] is not None) for x in by_host if x is not None}
    out = []
    for (i, _, declared, suffix, host), x, b in zip(rows, ll, best):
        if x is None:
            out.append((i, declared, None, None, False))
            continue
        most = said_at[host].most_common(1) if host is not None else []
        of_host = most[0][0] if most and most[0][1] * 2 > sum(said_at[host].values()) else None
        trusted = declared if declared is not None else of_host
        if trusted is not None and trusted not in langs:
            out.append((i, declared, trusted, None, True))
            continue
        parent = [v / sum(by_suffix[suffix]) for v in by_suffix[suffix]] if suffix is not None else overall
        seen = [v - (b == k) for k, v in enumerate(by_host[host])] if host is not None else [0] * len(langs)
        c = chance.get(declared, [0.0] * len(langs))
        score = [math.log((s + p * 20) / (sum(seen) + 20) * (1 - 1e-3)) + q for s, p, q in zip(seen, parent, c)]
        score = [s + y for s, y in zip([*score, math.log(1e-3) + sum(c) / len(langs)], x)]
        at = score.index(max(score))
        sure = 1 / sum(math.exp(s - max(score)) for s in score)
        name = langs[at] if at < len(langs) and sure >= 0.5 else None
        out.append((i, declared, name, sure, name is not None))
    return out


@pytest.mark.parametrize("name", ["op8_language", "language_id_pages"])
def test_language_queries_equal_a_plain_version(spark, tmp_path, name):
    kind = "documents" if name == "op8_language" else "pages"
    table = spark.read.parquet(f"/root/testdata/sf0.001/{kind}.parquet")
    if kind == "documents":
        rnd = random.Random(4)
        say = lambda lang, n: " ".join(rnd.choices(TEXTS[lang].split(), k=n))
        odd = [(10**6 + i, say(x := rnd.choice(["de", "fr"]), rnd.randrange(1, 30)), rnd.choice([x, x, None, "en"]), rnd.choice(["s1", "s2", None])) for i in range(120)]
        odd += [(None, say("de", 9), "de", None), (2 * 10**6, None, "de", "s1"), (2 * 10**6 + 1, "", None, "s1"), (2 * 10**6 + 2, " \t\n", "fr", "s2")]
        odd += [(2 * 10**6 + 3, say("fr", 200_000), None, "s1"), (2 * 10**6 + 4, "zz", "xx-rare", "s9"), (2 * 10**6 + 5, "zz 12", None, "s9")]
        odd += [odd[0]] * 3
        more = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string")
        table = table.unionByName(more, allowMissingColumns=True)
    table.write.parquet(str(tmp_path / f"{kind}.parquet"))
    rows = (language.of_documents if kind == "documents" else language.of_pages)(spark.read.parquet(str(tmp_path / f"{kind}.parquet")))
    want = plain_languages([(r.id, r.text, r.declared, r.suffix, r.host) for r in rows.collect()])
    got = [(r[0], r.declared, r.language, r.confidence, r.kept) for r in queries.queries()[name](spark, str(tmp_path)).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, str(r[1]), str(r[2]), r[3] is None, r[3] or 0)
    want, got = sorted(want, key=order), sorted(got, key=order)
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in want]
    assert all((a[3] is None) == (b[3] is None) and (a[3] is None or a[3] == pytest.approx(b[3], abs=1e-6)) for a, b in zip(got, want))
    assert len({r[2] for r in got}) > 1
    empty = tmp_path / "empty"
    table.limit(0).write.parquet(str(empty / f"{kind}.parquet"))
    assert queries.queries()[name](spark, str(empty)).count() == 0
