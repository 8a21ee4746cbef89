"""A gated recurrent language model in numpy with a class-factored softmax; scores of whole documents."""

from __future__ import annotations

import io
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_worker, materialize

#: Words the network knows by name, words a class, width of its state.
VOCABULARY, PER_CLASS, STATE = 2048, 64, 16
#: Words whose counts every worker holds; the others meet their counts in a join.
DICTIONARY = 1 << 18
#: Kinds of all other words: 29 first letters times whether the last one is a letter or digit.
KINDS = 58
#: Sixteenths of the learned documents that the rounds of training take, one after the other.
SHARES = (1, 1, 2, 4, 8)
PARTS = 16


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, runs of other bytes than space and x09-x0D."""
    return (text or "").encode().lower().split()


#: By a word's first byte: its letter, other alphabets, digits, the rest; by its last one whether it is a letter or digit.
_FIRST = [2 * (b - 97 if 97 <= b <= 122 else 26 if b >= 128 else 27 if 48 <= b <= 57 else 28) for b in range(256)]
_LAST = [int(b >= 128 or 97 <= b <= 122 or 48 <= b <= 57) for b in range(256)]


def kind(word: bytes) -> int:
    return _FIRST[word[0]] + _LAST[word[-1]]


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, 3) - 2**63


def held_out(doc_id) -> F.Column:
    """Documents that are not learned from: crc32 of the id as text leaves 2 when divided by 7; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_words(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """word, kind, n over all rows of ``docs`` (text); a task never holds more than ``most`` words and a text's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            ws = list(held)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([word_key(w) for w in ws], pa.int64()),
                    pa.array([kind(w) for w in ws], pa.int32()),
                    pa.array(list(held.values()), pa.int64()),
                ],
                names=["word", "kind", "n"],
            )
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                held.update(words(text.as_py()))
                if len(held) >= most:
                    yield flush()
        if held:
            yield flush()

    parts = docs.select("text").mapInArrow(in_worker(run, "gru"), "word long, kind int, n long")
    return parts.groupBy("word").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"))


@dataclass
class Corpus:
    """What all workers know of the corpus: bounded whatever its size."""

    keys: np.ndarray  # of the dictionary's words, most frequent first
    counts: np.ndarray
    kinds: np.ndarray
    total: int  # N
    distinct: int  # V
    ends: int
    kind_mass: np.ndarray  # of the words the network doesn't know by name: counts plus one each, plus one
    named: int

    @property
    def end(self) -> int:
        return VOCABULARY + KINDS

    def symbols(self) -> np.ndarray:
        """The network's symbol of each dictionary word."""
        s = VOCABULARY + self.kinds.astype(np.int64)
        s[: self.named] = np.arange(self.named)
        return s


def corpus_of(counts: DataFrame, n_docs: int) -> Corpus:
    """The dictionary is all words above a count that at most ``DICTIONARY`` words exceed, found by a histogram."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    held = counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).orderBy(F.col("step").desc()).collect()  # 1000 at most
    least, sum_ = None, 0
    for r in held:
        sum_ += r["v"]
        if sum_ > DICTIONARY:
            break
        least = r["step"]
    top = counts.where(step >= least if least is not None else F.lit(False)).toPandas()
    top = top.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    named = min(VOCABULARY, len(top))
    all_ = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    mass = np.ones(KINDS)
    for k, n, v in all_.itertuples(index=False):
        mass[k] += n + v
    np.subtract.at(mass, top["kind"].to_numpy()[:named], top["n"].to_numpy()[:named] + 1)
    return Corpus(
        top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["kind"].to_numpy(np.int32),
        int(all_["n"].sum()) + n_docs, int(all_["v"].sum()) + (n_docs > 0), n_docs, mass, named,
    )


class _Slots(dict):
    """word -> its place in the dictionary, or -1 - kind; bounded, hot words come back at once."""

    def __init__(self, corpus: Corpus, most: int = 1_000_000):
        super().__init__()
        self.of_key = dict(zip(corpus.keys.tolist(), range(len(corpus.keys))))
        self.most = most

    def __missing__(self, word: bytes) -> int:
        slot = self.of_key.get(word_key(word))
        if slot is None:
            slot = -1 - kind(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = slot
        return slot


class Network:
    """Parameters: input gates by symbol (x), recurrent gates (u), class and word outputs (wc, bc, ww, bw)."""

    classes = VOCABULARY // PER_CLASS
    names = ("x", "u", "wc", "bc", "ww", "bw")

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def start(cls, corpus: Corpus) -> Network:
        """Small random weights; biases that make the untrained network the corpus's unigram distribution."""
        rng = np.random.default_rng(11)
        n, h = VOCABULARY + KINDS + 1, STATE
        named = np.full(VOCABULARY, 1e-3)
        named[: corpus.named] = corpus.counts[: corpus.named] + 1
        groups = named.reshape(cls.classes, PER_CLASS)
        mass = np.concatenate([groups.sum(1), corpus.kind_mass, [corpus.ends + 1]])
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        x = small(n, 3 * h)
        x[:, :h] += 1.0  # update gates start mostly shut: states last
        return cls({
            "x": x, "u": small(h, 3 * h), "wc": small(h, len(mass)), "bc": np.log(mass / mass.sum()).astype(np.float32),
            "ww": small(cls.classes, h, PER_CLASS), "bw": np.log(groups / groups.sum(1, keepdims=True)).astype(np.float32),
        })

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def unpack(cls, blob: bytes) -> Network:
        with np.load(io.BytesIO(blob)) as f:
            return cls({k: f[k] for k in cls.names})

    def window(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
        """States before each token of a window (steps, lanes), after the last, and the gates if kept; ``fresh`` marks first tokens."""
        p, s = self.p, STATE
        gates = p["x"][ids]
        u = p["u"]
        steps = len(ids)
        before = np.empty((steps, *h.shape), np.float32)
        kept = np.empty((4, steps, *h.shape), np.float32) if keep else None
        some = fresh.any(axis=1).tolist()
        for t in range(steps):
            if some[t]:
                h = np.where(fresh[t][:, None], np.float32(0), h)
            before[t] = h
            g = gates[t]
            hu = h @ u
            zr = np.tanh((g[:, : 2 * s] + hu[:, : 2 * s]) * np.float32(0.5))
            zr *= np.float32(0.5)
            zr += np.float32(0.5)
            z, r = zr[:, :s], zr[:, s:]
            n = np.tanh(g[:, 2 * s :] + r * hu[:, 2 * s :])
            if keep:
                kept[0, t], kept[1, t], kept[2, t], kept[3, t] = z, r, n, hu[:, 2 * s :]
            h = n + z * (h - n)
        return before, h, kept

    def _small(self) -> bool:
        """Whether no output can overflow an exponential, states being between -1 and 1."""
        most = lambda w, b: float((np.abs(w).sum(axis=-2) + np.abs(b)).max())
        return max(most(self.p["wc"], self.p["bc"]), most(self.p["ww"], self.p["bw"])) < 80

    @staticmethod
    def _picked(a: np.ndarray, at: np.ndarray, small: bool) -> np.ndarray:
        """Log softmax of one entry a row; overwrites ``a``."""
        if not small:
            a -= a.max(axis=1, keepdims=True)
        chosen = a[np.arange(len(a)), at]
        return chosen - np.log(np.exp(a, out=a) @ np.ones(a.shape[1], a.dtype))

    def scores(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log probability of each symbol given the state before it."""
        p, small = self.p, self._small()
        named = ids < VOCABULARY
        cls = np.where(named, ids // PER_CLASS, ids - VOCABULARY + self.classes)
        out = np.empty(len(ids))
        for i in range(0, len(ids), 4096):  # what fits a core's cache
            a = h[i : i + 4096] @ p["wc"]
            a += p["bc"]
            out[i : i + 4096] = self._picked(a, cls[i : i + 4096], small)
        order = np.argsort(cls.astype(np.int16), kind="stable")
        ends = np.searchsorted(cls[order], np.arange(self.classes + 1))
        hs, ws = h[order], ids[order] % PER_CLASS
        for c in range(self.classes):
            w = slice(ends[c], ends[c + 1])
            if ends[c] < ends[c + 1]:
                a = hs[w] @ p["ww"][c]
                a += p["bw"][c]
                out[order[w]] += self._picked(a, ws[w], small)
        return out

    @staticmethod
    def _chances(h1: np.ndarray, w: np.ndarray, bias: np.ndarray, small: bool) -> np.ndarray:
        """Softmax of states that end with a one."""
        a = h1 @ np.concatenate([w, bias[None, :]])
        if not small:
            a -= a.max(axis=1, keepdims=True)
        np.exp(a, out=a)
        a *= 1 / (a @ np.ones((a.shape[1], 1), a.dtype))
        return a

    def outputs(self, h: np.ndarray, ids: np.ndarray, grads: dict):
        """Adds the outputs' gradients to ``grads``; returns that of the states."""
        p, small = self.p, self._small()
        named = ids < VOCABULARY
        cls = np.where(named, ids // PER_CLASS, ids - VOCABULARY + self.classes)
        h1 = np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)
        d = self._chances(h1, p["wc"], p["bc"], small)
        d[np.arange(len(ids)), cls] -= 1
        g = h1.T @ d
        grads["wc"] += g[:-1]
        grads["bc"] += g[-1]
        dh = d @ p["wc"].T
        known = np.flatnonzero(named)
        known = known[np.argsort(cls[known].astype(np.int16), kind="stable")]
        ends = np.searchsorted(cls[known], np.arange(self.classes + 1)).tolist()
        hs, ws = h1[known], ids[known] % PER_CLASS
        back = np.empty((len(known), STATE), h.dtype)
        for c in range(self.classes):
            if ends[c] < ends[c + 1]:
                w = slice(ends[c], ends[c + 1])
                d = self._chances(hs[w], p["ww"][c], p["bw"][c], small)
                d[np.arange(len(d)), ws[w]] -= 1
                g = hs[w].T @ d
                grads["ww"][c] += g[:-1]
                grads["bw"][c] += g[-1]
                back[w] = d @ p["ww"][c].T
        dh[known] += back
        return dh

    def gradients(self, ids: np.ndarray, fresh: np.ndarray, used: np.ndarray, h: np.ndarray, grads: dict | None = None):
        """Truncated backpropagation through one window, added to ``grads``; ``used`` marks tokens that count."""
        p, s = self.p, STATE
        before, after, (z, r, n, hu) = self.window(ids, fresh, h, True)
        grads = {k: np.zeros_like(v) for k, v in p.items()} if grads is None else grads
        at = np.flatnonzero(used.ravel())
        dout = np.zeros((ids.size, s), np.float32)
        dout[at] = self.outputs(before.reshape(-1, s)[at], ids.ravel()[at], grads)
        dout = dout.reshape(before.shape)
        # what a state's gradient is multiplied with on its way to the gates, for all steps at once
        to_n = (1 - z) * (1 - n * n)
        to_z = (before - n) * z * (1 - z)
        to_r = hu * r * (1 - r)
        dx = np.empty((*ids.shape, 3 * s), np.float32)
        back = np.empty((*ids.shape, 3 * s), np.float32)
        ut, some = p["u"].T, fresh.any(axis=1).tolist()
        dh = np.zeros_like(h)
        for t in range(len(ids) - 1, -1, -1):
            dan = dh * to_n[t]
            x, b = dx[t], back[t]
            np.multiply(dh, to_z[t], out=x[:, :s])
            np.multiply(dan, to_r[t], out=x[:, s : 2 * s])
            x[:, 2 * s :] = dan
            b[:, : 2 * s] = x[:, : 2 * s]
            np.multiply(dan, r[t], out=b[:, 2 * s :])
            dh = dh * z[t] + b @ ut + dout[t]
            if some[t]:
                dh[fresh[t]] = 0
        grads["u"] += before.reshape(-1, s).T @ back.reshape(-1, 3 * s)
        flat, dx = ids.ravel()[at], dx.reshape(-1, 3 * s)[at]
        if len(at):
            order = np.argsort(flat.astype(np.int16), kind="stable")
            sorted_ = flat[order]
            starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            grads["x"][sorted_[starts]] += np.add.reduceat(dx[order], starts)
        return grads, len(at), after


def windows(docs: Iterator[tuple], n_lanes: int, steps: int):
    """Documents, whose last field is their ids, side by side in lanes: a lane goes on to the next document where one ends.

    Yields lanes, ids, fresh, owner and pieces for one window after the other.  ``lanes`` are the lanes with any token left;
    ids, fresh and owner are (steps, lanes), owner the number of the piece or -1 for no token; a piece is (document,
    lane, whether it ends here).  Held are a window and the documents it touches, whatever their lengths.
    """
    source = iter(docs)
    now: list[tuple | None] = [None] * n_lanes
    live, dry = list(range(n_lanes)), False
    while live:
        ids, owner = np.zeros((len(live), steps), np.int64), np.full((len(live), steps), -1)
        fresh = np.zeros((len(live), steps), bool)
        pieces: list[tuple] = []
        left = []
        for row, k in enumerate(live):
            at = 0
            while at < steps:
                if now[k] is None:
                    doc = None if dry else next(source, None)
                    if doc is None:
                        dry = True
                        break
                    now[k] = (doc, 0)
                    fresh[row, at] = True
                doc, start = now[k]
                take = min(steps - at, len(doc[-1]) - start)
                ids[row, at : at + take] = doc[-1][start : start + take]
                owner[row, at : at + take] = len(pieces)
                ends = start + take == len(doc[-1])
                pieces.append((doc, k, ends))
                now[k] = None if ends else (doc, start + take)
                at += take
            if at:
                left.append(row)
        live = [live[row] for row in left]
        if live:
            yield np.array(live), *(np.ascontiguousarray(x[left].T) for x in (ids, fresh, owner)), pieces


def scored(net: Network, docs: Iterator[tuple], n_lanes: int = 256, steps: int = 64) -> Iterator[tuple[tuple, float]]:
    """Documents with their natural log probability, as they end; the state goes on from window to window."""
    h, sums = np.zeros((n_lanes, STATE), np.float32), [0.0] * n_lanes
    for lanes, ids, fresh, owner, pieces in windows(docs, n_lanes, steps):
        before, h[lanes], _ = net.window(ids, fresh, h[lanes], False)
        own = owner.ravel()
        real = np.flatnonzero(own >= 0)
        logp = net.scores(before.reshape(-1, STATE)[real], ids.ravel()[real])
        for (doc, k, ends), x in zip(pieces, np.bincount(own[real], logp, len(pieces)).tolist()):
            sums[k] += x
            if ends:
                yield doc, sums[k]
                sums[k] = 0.0


def train_on(net: Network, docs: Iterator[tuple], adam: dict, rate: float, n_lanes: int = 256, steps: int = 32, longest: int = 1024) -> int:
    """Adam steps on windows; those with few tokens left are gathered until they have half a full one's.

    Texts of over ``longest`` tokens are learned in pieces of so many, each from a fresh state, so that a long one does
    not leave the other lanes idle.
    """
    docs = ((d[-1][i : i + longest],) for d in docs for i in range(0, len(d[-1]), longest))
    h = np.zeros((n_lanes, STATE), np.float32)
    seen = held = 0
    grads = None

    def step(n: int) -> None:
        adam["t"] = adam.get("t", 0) + 1
        fix = np.sqrt(1 - 0.999 ** adam["t"]) / (1 - 0.9 ** adam["t"])
        for k, g in grads.items():
            g /= max(n, n_lanes * steps // 2)
            m, v = adam.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            # biases start at the corpus's frequencies and hardly need to move
            net.p[k] -= np.float32((rate / 10 if k[0] == "b" else rate) * fix) * m / (np.sqrt(v) + np.float32(1e-8))

    for lanes, ids, fresh, owner, _ in windows(docs, n_lanes, steps):
        grads, n, h[lanes] = net.gradients(ids, fresh, owner >= 0, h[lanes], grads)
        seen, held = seen + n, held + n
        if held * 2 >= n_lanes * steps:
            step(held)
            grads, held = None, 0
    if held:
        step(held)
    return seen


_slots: dict[str, _Slots] = {}


def release() -> None:
    """Drops this worker's dictionary; called by name, so that the worker's own one goes."""
    _slots.clear()


def _symbols(ws: list[bytes], slots: _Slots, symbols: np.ndarray, end: int):
    """The network's symbols of a text with its end, and the words' places in the dictionary."""
    places = np.fromiter(map(slots.__getitem__, ws), np.int64, len(ws))
    ids = np.empty(len(ws) + 1, np.int16)
    known = places >= 0
    ids[:-1][known] = symbols[places[known]]
    ids[:-1][~known] = VOCABULARY - 1 - places[~known]
    ids[-1] = end
    return ids, places


def tokens(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """row, doc_id, held_out, part, n_tokens, n_known, base, inner, rare, ids: every text read once for training and scoring.

    ids are the network's symbols (two bytes each), rare the keys of words beyond the dictionary.  base and inner are the
    sums over the words in it: log10 of add-one unigrams, and of a word's share within its kind where the network has no
    name for it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(corpus)
    tag = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        if tag not in _slots:
            _slots.clear()
            _slots[tag] = _Slots(known)
        slots, symbols = _slots[tag], known.symbols()
        log_count, log_mass = np.log10(known.counts + 1.0), np.log10(known.kind_mass)
        base_all = math.log10(known.total + known.distinct + 1)
        end_base = math.log10(known.ends + 1) - base_all
        names = ["doc_id", "held_out", "part", "n_tokens", "n_known", "base", "inner", "rare", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary()]

        def flush(rows: list[tuple], first: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*first, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=names)

        for whole in batches:
            start, held, rows = 0, 0, []
            for i, text in enumerate(whole.column(3)):
                ws = words(text.as_py())
                ids, places = _symbols(ws, slots, symbols, known.end)
                here = places[places >= 0]
                other = ids[:-1][ids[:-1] >= VOCABULARY] - VOCABULARY
                base = log_count[here].sum() - len(ws) * base_all + end_base
                inner = log_count[here[here >= known.named]].sum() - log_mass[other].sum()
                rare = [word_key(ws[k]) for k in np.flatnonzero(places < 0)]
                rows.append((len(ids), len(here) + (known.ends > 0), base, inner, rare, ids.tobytes()))
                held += len(ids)
                if held >= 400_000 or i == whole.num_rows - 1:
                    yield flush(rows, [c.slice(start, len(rows)) for c in whole.columns[:3]])
                    start, held, rows = i + 1, 0, []

    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PARTS)).cast("int").alias("part")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), part, "text")
    out = given.mapInArrow(
        in_worker(run, "gru", release),
        "doc_id long, held_out boolean, part int, n_tokens long, n_known long, base double, inner double, rare array<long>, ids binary",
    )
    return out.withColumn("row", F.monotonically_increasing_id())


def train(learned: DataFrame, corpus: Corpus, shares: tuple[int, ...] = SHARES, rate: float = 0.02) -> Network:
    """Rounds of local training and averaging on the rows of ``tokens`` to learn from.

    In a round the tasks train copies of the network on the documents whose part, of ``PARTS``, is among the round's;
    ``shares`` cover all parts, so each document is learned from once.  Rounds grow, as the network changes most at
    first.  The copies are averaged by tokens in grouped steps of about 32 on the executors, so the driver gets one network.
    """
    net = Network.start(corpus)
    spark = learned.sparkSession
    for i, share in enumerate(shares):
        blob = spark.sparkContext.broadcast(net.pack())

        def run(batches: Iterator[pa.RecordBatch], blob=blob) -> Iterator[pa.RecordBatch]:
            own = Network.unpack(blob.value)
            docs = ((np.frombuffer(x.as_buffer(), np.int16),) for batch in batches for x in batch.column(0))
            seen = train_on(own, docs, {}, rate)
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_64_intdigest(own.p["u"].tobytes()) % 2**31], pa.int32()), pa.array([seen], pa.int64()), pa.array([own.pack()])],
                    names=["g", "n", "net"],
                )

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = None, 0
            for batch in batches:
                for k, packed in zip(batch.column(1).to_pylist(), batch.column(2)):
                    one = Network.unpack(packed.as_py()).p
                    n += k
                    total = {a: v * k + (0 if total is None else total[a]) for a, v in one.items()}
            if n:
                out = Network({a: (v / n).astype(np.float32) for a, v in total.items()}).pack()
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(out) % 2**31], pa.int32()), pa.array([n], pa.int64()), pa.array([out])], names=["g", "n", "net"])

        sample = learned.where(F.col("part").between(sum(shares[:i]), sum(shares[: i + 1]) - 1)).select("ids")
        schema = "g int, n long, net binary"
        trained = sample.mapInArrow(in_worker(run, "gru"), schema)
        width = sample.rdd.getNumPartitions()
        while width > 32:  # a tree: about 32 copies meet in a task
            width = -(-width // 32)
            trained = trained.repartition(width, "g").mapInArrow(in_worker(mean, "gru"), schema)
        last = trained.repartition(1).mapInArrow(in_worker(mean, "gru"), schema).collect()
        blob.unpersist()
        if last:
            net = Network.unpack(bytes(last[0]["net"]))
    return net


def score(docs: DataFrame, shares: tuple[int, ...] = SHARES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of ``docs``.

    Counts cover every learned document.  The network predicts the next symbol: one of the most frequent words
    by class and word in it, or the kind of another word, whose share within its kind is its count plus one;
    the end is a class of its own.  So score is a log10 probability of the whole text over the same events as
    base_score (add-one unigram).  Counts of words beyond the bounded dictionary come by a join, for all rows.

    Memory of a task: a window of its lanes and the documents in them, whatever the longest one's length.

    Null or empty text: the end alone.  Null ids are learned from.  Repeated rows are rows like others.  No
    learned documents: the untrained network and N = 0.  Empty table: no rows.  Only doc_id and text are read.
    """
    docs = docs.select("doc_id", "text")
    learned = docs.where(~held_out(F.col("doc_id")))
    counts = materialize(count_words(learned), "lm-counts")
    corpus = corpus_of(counts, learned.count())
    read = materialize(tokens(docs, corpus), "lm-tokens")
    net = train(read.where("not held_out"), corpus, shares)
    sent = docs.sparkSession.sparkContext.broadcast(net.pack())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.unpack(sent.value)

        def longest_first():  # of each batch, so that no long text is left alone at the end
            for batch in batches:
                for i in np.argsort(-pc.binary_length(batch.column(1)).to_numpy(), kind="stable").tolist():
                    yield batch.column(0)[i].as_py(), np.frombuffer(batch.column(1)[i].as_buffer(), np.int16)

        ended: list[tuple[int, float]] = []

        def flush() -> pa.RecordBatch:
            rows, logp = zip(*ended)
            ended.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(logp, pa.float64())], names=["row", "model"])

        for doc, logp in scored(own, longest_first()):
            ended.append((doc[0], logp / math.log(10)))
            if len(ended) >= 10_000:
                yield flush()
        if ended:
            yield flush()

    model = read.select("row", "ids").mapInArrow(in_worker(run, "gru"), "row long, model double")
    rare = read.select("row", F.explode("rare").alias("word")).join(counts.select("word", "n"), "word", "left")
    log = F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1))
    rare = rare.groupBy("row").agg(F.count("n").alias("known"), log.alias("log"))
    out = read.drop("rare", "ids", "part").join(model, "row").join(rare, "row", "left")
    log = F.coalesce("log", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(corpus.total).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"),
        (F.col("inner") + F.col("model") + log).alias("score"),
    )
