"""SentencePiece encoding and decoding with a score-ordered agenda, checked against the library."""

from __future__ import annotations

import bisect
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import in_worker

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the model file


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = 8 if kind == 1 else 4 if kind == 5 else varint()
            yield tag >> 3, buf[at : at + n]
            at += n


class PieceModel:
    """A merge-type (BPE) SentencePiece vocabulary: encode, decode, and caches of bounded size."""

    def __init__(self, path: str, end_id: int = 2, cache_size: int = 700_000):
        self.path, self.end_id, self.cache_size = path, end_id, cache_size
        blob = open(path, "rb").read()  # noqa: SIM115
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        norm: dict[int, object] = {}
        model_type = 1
        for field, value in _fields(blob):
            if field == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif field == 2:
                model_type = dict(_fields(value)).get(3, 1)
            elif field == 3:
                norm = dict(_fields(value))
        if model_type != 2:
            raise ValueError("the vocabulary is not of merge type")
        if norm.get(2) or norm.get(4, 1) or not norm.get(3, 1):
            raise ValueError("only the identity normaliser with a dummy prefix is supported")
        if USER_DEFINED in self.types or UNUSED in self.types:
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.cost = {p: -self.scores[i] for p, i in self.ids.items()}.get
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self._tables()
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unk = self.types.index(UNKNOWN)
        alone = {NORMAL: lambda i: self.pieces[i].replace(SPACE, " "), UNKNOWN: lambda i: " ⁇ ", BYTE: lambda i: chr(self.byte_of[i]) if self.byte_of[i] < 128 else None}
        self.said = [alone.get(t, lambda i: "")(i) for i, t in enumerate(self.types)]
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        lines = any("\n" in p for p in self.ids)
        # a text falls into parts that no piece can join: before each run of space marks, around line feeds
        self.part = None if inner or lines else re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.line_feed = np.array(self.part_ids("\n"), np.int32).tobytes()
        self.cache = _Cache(self)

    def _tables(self) -> None:
        """Symbols are numbered (0: none, 1: a character of no piece): single characters and all pieces, and what two join to."""
        names = {c: None for p in self.ids for c in p} | dict.fromkeys(self.ids)
        number = {name: i + 2 for i, name in enumerate(names)}
        self.symbol_id = np.array([-1, -1, *[self.ids.get(n, -1) for n in names]], np.int32)
        cost = [-self.scores[self.ids[n]] if n in self.ids else np.inf for n in names]
        self.symbol_cost = np.array([np.inf, np.inf, *cost], np.float32)  # the model file's own precision
        self.symbol_of_point = np.ones(0x110000, np.int32)
        for n, i in number.items():
            if len(n) == 1:
                self.symbol_of_point[ord(n)] = i
        self.pairs = _Pairs({
            (number[p[:i]], number[p[i:]]): number[p]
            for p in self.ids for i in range(1, len(p)) if p[:i] in number and p[i:] in number
        })

    def merge(self, part: str) -> list[str]:
        """Pieces of ``part``: of all adjacent pairs that form a piece, the best score (then the leftmost) joins first."""
        symbols = list(part)
        n = len(symbols)
        if n == 1:
            return symbols
        cost, push, pop = self.cost, heapq.heappush, heapq.heappop
        agenda = [(c, i, i + 1, both) for i, both in enumerate(map(str.__add__, symbols, symbols[1:])) if (c := cost(both)) is not None]
        if not agenda:
            return symbols
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while agenda:
            _, left, right, both = pop(agenda)
            if not symbols[left] or not symbols[right] or symbols[left] + symbols[right] != both:
                continue  # one of the two has been joined to another since
            symbols[left], symbols[right] = both, ""
            after[left] = far = after[right]
            if far >= 0:
                before[far] = left
                joined = both + symbols[far]
                if (c := cost(joined)) is not None:
                    push(agenda, (c, left, far, joined))
            if (near := before[left]) >= 0:
                joined = symbols[near] + both
                if (c := cost(joined)) is not None:
                    push(agenda, (c, near, left, joined))
        return [s for s in symbols if s]

    def part_ids(self, part: str) -> list[int]:
        merged = self.merge(part)
        out = list(map(self.ids.get, merged))
        if None not in out:
            return out
        out = []
        for p in merged:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            else:
                out.append(self.unk)
        return out

    def parts(self, text: str) -> list[str]:
        """Keys of the parts of a text, which no piece joins: a word stands for itself after a space mark, a
        key that starts with a space mark for itself, one that starts with a line feed for that and what follows.
        """
        if not text:
            return []
        if self.part is None:
            return [SPACE + text.replace(" ", SPACE)]
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            if line[:1] != " " and line[-1:] != " " and "  " not in line and SPACE not in line:
                found = line.split(" ")
                if i:
                    found[0] = "\n" + found[0]
                elif not found[0]:
                    found[0] = SPACE
            else:
                marked = line.replace(" ", SPACE)
                found = self.part.findall(marked if i else SPACE + marked)
                if i:
                    found[:1] = ["\n", found[0]] if found[0][0] == SPACE else ["\n" + found[0]]
            out += found
        return out

    def agenda_rows(self, parts: list[str]) -> list[bytes | None]:
        """Ids (as bytes of int32) of many short parts at once, each with an agenda of its own: a row of its adjacent pairs' scores.

        In a round every part joins its best pair (the leftmost of equals), the row closes up, and the two new
        pairs are looked up; a part is done when none of its pairs forms a piece.  None: a character that is
        no piece by itself is left, ``part_ids`` spells it in bytes.
        """
        n, width = len(parts), max(1, *map(len, parts))
        size = np.fromiter(map(len, parts), np.int64, n)
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        s = np.zeros((n, width + 1), np.int32)  # a last column of nothing moves in as rows close up
        s[:, :width][np.arange(width) < size[:, None]] = self.symbol_of_point[points]
        joined = np.zeros((n, width + 1), np.int32)
        joined[:, :-1] = self.pairs.find(s[:, :-1], s[:, 1:])
        final, rows = np.zeros((n, width), np.int32), np.arange(n)
        place = np.minimum(np.arange(width + 1)[None, :] + np.tri(width + 1, width + 1, -1, np.int64).T, width)
        while len(rows):
            cost = self.symbol_cost[joined]
            best = cost.argmin(axis=1)
            at = np.arange(len(rows))
            go = cost[at, best] < np.inf
            if not go.all():
                final[rows[~go]] = s[~go, :width]
                rows, s, joined, best = rows[go], s[go], joined[go], best[go]
                at = np.arange(len(rows))
            new = joined[at, best]
            # the joined pair's right symbol goes, what follows moves up
            after = at[:, None] * (width + 1) + place[best]
            s, joined = s.ravel()[after], joined.ravel()[after]
            s[at, best] = new
            left = np.flatnonzero(best > 0)
            here = best[left] - 1
            found = self.pairs.find(
                np.concatenate([new, s[left, here]]), np.concatenate([s[at, np.minimum(best + 1, width)], new[left]])
            )
            joined[at, best], joined[left, here] = found[: len(at)], found[len(at) :]
        held = final > 0
        ids = self.symbol_id[final]
        spelt = ((ids < 0) & held).any(axis=1)
        flat = ids[held].tobytes()
        ends = (4 * np.cumsum(held.sum(axis=1))).tolist()
        return [None if bad else flat[a:b] for bad, a, b in zip(spelt.tolist(), [0, *ends], ends)]

    def key_ids(self, key: str) -> bytes:
        if key[0] == SPACE:
            found = self.part_ids(key)
        elif key[0] != "\n":
            found = self.part_ids(SPACE + key)
        else:
            found = self.part_ids("\n") + (self.part_ids(key[1:]) if len(key) > 1 else [])
        return np.array(found, np.int32).tobytes()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, without the end id.  What the cache lacks of their parts is encoded first, together."""
        keys = [self.parts(t) for t in texts]
        ids = self.cache.ready(set().union(*keys))
        return [np.frombuffer(b"".join(map(ids.__getitem__, k)), np.int32) for k in keys]

    def text_of(self, ids: list[int]) -> str:
        """As ``decode``, quick where no id needs its neighbours: bytes of other than ASCII characters do."""
        try:
            text = "".join(map(self.said.__getitem__, ids))
        except TypeError:
            return self.decode(ids)
        return text[1:] if text[:1] == " " else text

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control pieces are dropped, byte pieces decoded together, the dummy prefix removed."""
        out, raw = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if self.types[i] == NORMAL:
                out.append(self.pieces[i])
            elif self.types[i] == UNKNOWN:
                out.append(" ⁇ ")
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


class _Pairs:
    """Two symbols -> the symbol they join to, 0 for none: an open hash table in numpy arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.zeros(1 << self.bits, np.int32)
        left = np.fromiter((a for a, _ in pairs), np.int64, len(pairs))
        right = np.fromiter((b for _, b in pairs), np.int64, len(pairs))
        keys = (left << 32) | right
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(keys)
        while len(keys):
            free = self.key[at] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.key[at[put]], self.value[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & (len(self.key) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64).ravel() << 32) | right.ravel()
        at = self._slot(keys)
        held = self.key[at]
        hit = held == keys
        out = self.value[at] * hit
        todo = np.flatnonzero(~hit & (held >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.key) - 1)
            held = self.key[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.value[at[hit]]
            more = ~hit & (held >= 0)
            todo, at = todo[more], at[more]
        return out.reshape(left.shape)


class _Cache:
    """part -> its ids, in two generations of bounded size.

    When the young generation is full it becomes the old one; what is still used moves on.  Very long parts are
    not kept from batch to batch.
    """

    LONG, ROW = 64, 40

    def __init__(self, model: PieceModel):
        self.model = model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ready(self, keys: set[str]) -> dict[str, bytes]:
        """Ids of all ``keys``: those not held are encoded together, by agendas in rows where they are short."""
        if len(self.young) >= self.model.cache_size:
            self.old, self.young = self.young, {}
        young, line_feed = self.young, self.model.line_feed
        out = dict(zip(keys, map(young.get, keys)))
        new = [k for k, found in out.items() if found is None]
        if self.old:
            moved = {k: found for k, found in zip(new, map(self.old.get, new)) if found is not None}
            out.update(moved)
            young.update(moved)
            new = [k for k in new if k not in moved]
        new.sort(key=len)  # so that rows of a block are of like length
        short = bisect.bisect_left(new, self.ROW, key=len)
        for at in range(0, short, 4096):
            some = new[at : min(at + 4096, short)]
            parts = [SPACE + k if (c := k[0]) != SPACE and c != "\n" else k if c == SPACE else k[1:] for k in some]
            coded = self.model.agenda_rows(parts)
            coded = [self.model.key_ids(k) if ids is None else ids if k[0] != "\n" else line_feed + ids for k, ids in zip(some, coded)]
            more = dict(zip(some, coded))
            out.update(more)
            young.update(more)
        for k in new[short:]:
            out[k] = found = self.model.key_ids(k)
            if len(k) <= self.LONG:
                young[k] = found
        return out


_models: dict[str, PieceModel] = {}


def _model(path: str, cache_size: int) -> PieceModel:
    if path not in _models or _models[path].cache_size != cache_size:
        _models[path] = PieceModel(path, cache_size=cache_size)
    return _models[path]


def release() -> None:
    """Drops this worker's models and caches; called by name, so that the worker's own ones go."""
    _models.clear()


def bounded(batch: pa.RecordBatch, rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, and ``size`` bytes of text (column 1) but for single longer ones."""
    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and (held + n > size or i - start == rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"


def coded_batches(batches: Iterator[pa.RecordBatch], model_path: str, check: bool, with_ids: bool, cache_size: int, batch_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """What ``encode_documents`` returns for batches of doc_id and text."""
    model, library = _model(model_path, cache_size), None
    if check:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_path)
    names, end, no_ids = list(map(str, range(len(model.pieces)))), model.end_id, np.empty(0, np.int32)

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    for batch in batches:
        for piece in bounded(batch, size=batch_bytes):  # bounds what is held as Python objects
            texts = [t or "" for t in piece.column(1).to_pylist()]
            coded = model.encode_batch(texts)
            agrees = [True] * len(texts)
            if library is not None:
                theirs = [np.asarray(i) if len(i) else no_ids for i in library.encode(texts, num_threads=1, return_type="numpy")]
                agrees = list(map(np.array_equal, coded, theirs))
                coded = theirs
            lists = [i.tolist() for i in coded]
            plain = list(map(model.text_of, lists))
            if library is not None:
                back = library.decode(lists, num_threads=1)
                agrees = [a and x == y for a, x, y in zip(agrees, plain, back)]
                plain = back
            for i in lists:
                i.append(end)
            cols = [
                piece.column(0).cast(pa.int64()),
                pa.array(map(len, lists), pa.int64()),
                pa.array([sha(" ".join(map(names.__getitem__, i))) for i in lists]),
                pa.array(map(sha, plain)),
                pa.array(agrees),
            ]
            if with_ids:
                cols.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees", *["ids"] * with_ids])


def encode_documents(docs: DataFrame, model_path: str, check: bool = True, ids: bool = False, cache_size: int = 700_000, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agrees (and ids where asked): a row a document.

    Every text is encoded by the agenda, with an end id only, and its ids are decoded again.  With ``check`` the
    sentencepiece library encodes every whole text too, a batch at a time, and decodes its own ids; where either
    differs from ours the row has the library's, and ``agrees`` is false.
    ``model_path`` must exist on every worker.  Memory: a batch of up to ``batch_bytes`` or one longer text, about 30 times as its parts, and a
    cache of bounded size (two generations of ``cache_size`` parts and a batch's, about 200 bytes each).

    Null text is empty: the end id alone, decoded to an empty text.  Null ids and repeated rows stay as they
    are.  Empty table: no rows.  Only doc_id and text are read.
    """
    schema = SCHEMA + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from coded_batches(batches, model_path, check, ids, cache_size, batch_bytes)

    return docs.select("doc_id", "text").mapInArrow(in_worker(run, "pieces", release), schema)
