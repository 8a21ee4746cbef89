import base64
import gzip
import hashlib

import pytest
import xxhash

from sieveline.llm import chat, warc

TURNS = "conv_id long, turn long, role string, text string, prefix string, n int"


def logs(spark, convs):
    rows = [(c, t, r, x, "clash", 1) for c, turns in convs for t, r, x in turns]
    return spark.createDataFrame(rows, TURNS)


def plain(convs):
    by = {}
    for c, turns in convs:
        by.setdefault(c, set()).update(turns)
    order = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "", xxhash.xxh64_intdigest(x[2], 42) - 2**64 * (xxhash.xxh64_intdigest(x[2], 42) >> 63) if x[2] is not None else 42)
    seqs = {c: tuple(sorted(t, key=order)) for c, t in by.items()}
    kept = {}
    for c in sorted(seqs, key=lambda c: (c is not None, c or 0)):
        if not any(len(o) > len(seqs[c]) and o[: len(seqs[c])] == seqs[c] for o in seqs.values()):
            kept.setdefault(seqs[c], c)
    return {c: "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for _, r, x in s) for s, c in kept.items()}


BASE = tuple((i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(9))
CONVS = [
    (1, BASE[:3]), (2, BASE[:5]), (3, BASE), (4, BASE), (5, BASE[:2] + ((2, "user", "other"),)), (6, BASE[:1]), (7, ((0, None, "x"),)),
    (8, ((0, "x", None),)), (9, ((0, "", ""),)), (10, ((None, "user", "a"), (0, "user", "b"))), (11, ((None, "user", "a"),)), (None, ((0, "user", "null id"),)),
    (12, BASE[:3] + BASE[:3]), (13, ((0, "user", "y" * 200_000),)), (14, ((0, "a", "tie"), (0, "b", "tie"))), (15, ((0, "a", "tie"),)), (16, ((5, "user", "t0"),)),
]


def rendered(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: r.rendered for r in rows}


@pytest.mark.parametrize("block", [1024, 2, 1])
def test_snapshots_collapse(spark, block):
    assert rendered(chat.format_chats(logs(spark, CONVS), block)) == plain(CONVS)


def test_copies_and_lengths(spark):
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.format_chats(logs(spark, CONVS)).collect()}
    assert got[3] == (9, 2) and got[5] == (3, 1)


def test_no_conversation(spark):
    assert chat.format_chats(logs(spark, [])).count() == 0


PAGES = "page_id long, url string, html string, payload_digest string, kind int"
BIG = "é" * 700_000 + "\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "z" * 900_000
HTML = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two\r\n\r\nWARC/1.1\r\nx</p>"), (3, "http://a/3", "<p>one</p>"), (4, None, None), (5, "http://a/5", ""),
    (6, "http://a/ 6\n", "<p>one</p>"), (7, "u", BIG), (8, "u", BIG), (9, "u", "WARC/1.1\r\n"), (10, "u", "\r\n"), (11, "u", "\r\n\r\n"), (12, "u", "x\r\nWARC/1.1\r\nWARC/1.1\r\n"),
    (13, "u", "\x00\r\n"), (None, "u", "null id"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)


def expected(rows, least=0):
    raw = {p: (h or "").encode() for p, _, h in rows}
    top = {}
    for p, data in raw.items():
        top[data] = p if top.get(data) is None else max(top[data], p or 0)
    out = set()
    for p, data in raw.items():
        again = len(data) >= least and top[data] != p
        out.add((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top[data] if again else None))
    return out


@pytest.mark.parametrize("chunk", [warc.CHUNK, 7, 64])
@pytest.mark.parametrize("least", [0, 11])
def test_archives_come_back(spark, tmp_path, chunk, least):
    rows = HTML if chunk > 7 else [r for r in HTML if r[2] != BIG]
    if chunk == 64:
        rows = [(p, u, h[:690_000] + h[-100:] if h == BIG else h) for p, u, h in rows][:6] + [r for r in HTML if r[2] != BIG][6:]
    warc.write_archive(pages(spark, rows), str(tmp_path / "w"), least, chunk)
    got = warc.read_archive(spark, str(tmp_path / "w")).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected(rows, least)
    assert len(got) == len(rows)
    if chunk == warc.CHUNK:
        assert max(r.chunks for r in got) >= 3


def test_records_follow_the_format(spark, tmp_path):
    warc.write_archive(pages(spark, HTML[:3]).coalesce(1), str(tmp_path / "w"))
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("*.gz")))
    at = n = 0
    while at < len(raw):
        assert raw.startswith(b"WARC/1.1\r\n", at)
        end = raw.index(b"\r\n\r\n", at)
        head = dict(x.split(b": ", 1) for x in raw[at:end].split(b"\r\n")[1:])
        stop = end + 4 + int(head[b"Content-Length"])
        assert raw[stop : stop + 4] == b"\r\n\r\n" and head[b"WARC-Type"] in (b"response", b"revisit", b"continuation")
        at, n = stop + 4, n + 1
    assert n >= 3


def test_damage_is_found(spark, tmp_path):
    warc.write_archive(pages(spark, HTML[:1]).coalesce(1), str(tmp_path / "w"))
    (file,) = [f for f in (tmp_path / "w").glob("*.gz") if gzip.decompress(f.read_bytes())]
    raw = gzip.decompress(file.read_bytes()).replace(b"<p>one", b"<p>0ne")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.txt.gz").write_bytes(gzip.compress(raw))
    with pytest.raises(Exception, match="damaged block"):
        warc.read_archive(spark, str(tmp_path / "bad")).collect()


def test_chunks_are_rows(spark):
    rows = warc.chunk_rows(pages(spark, HTML), 1 << 16).collect()
    held = {}
    for r in rows:
        assert r.chunk_no == len(held.setdefault((r.record, r.page_id), [])) and len(r.data) <= 1 << 16
        held[r.record, r.page_id].append(bytes(r.data))
    assert sorted(b"".join(x) for x in held.values()) == sorted((h or "").encode() for _, _, h in HTML)


def test_repeated_rows(spark, tmp_path):
    rows = [(1, "u", "x" * 200)] * 3 + [(2, "u", "x" * 200)] * 2 + [(None, None, None)] * 2
    warc.write_archive(pages(spark, rows).coalesce(1), str(tmp_path / "w"), 0, 64)
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archive(spark, str(tmp_path / "w")).collect()]
    assert sorted(got, key=repr) == sorted([(1, 200, "revisit", 2)] * 3 + [(2, 200, "response", None)] * 2 + [(None, 0, "response", None)] * 2, key=repr)


def test_no_page(spark, tmp_path):
    warc.write_archive(pages(spark, []), str(tmp_path / "w"))
    assert warc.read_archive(spark, str(tmp_path / "w")).count() == 0


def test_cuts_lose_nothing():
    for data in (b"", b"abc", "é€".encode() * 9, b"WARC/1.1\r\n" * 4, b"\r\nWARC/1.1\r\n\r\nWARC/1.1\r\n", b"\xc3" * 20):
        for chunk in (1, 2, 5, 100):
            got = list(warc.cuts(data, chunk))
            assert b"".join(got) == data and all(warc.MARK[2:] not in p for p in got) and all(p for p in got[1:])
