import hashlib
import io

import zstandard as zstd
from fleetlens.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def run(llm, rows):
    df = llm.createDataFrame([(*r, "z") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in warc.archive_and_read(df).collect()), key=str)


def brute(rows):
    data = {i: (h or "").encode() for i, _, h in rows}
    last = {}
    for i, p in data.items():
        last[p] = max(last.get(p, i), i)
    out = {}
    for i, p in data.items():
        again = len(p) >= 1000 and last[p] != i
        out[i] = ("revisit" if again else "response", len(p), hashlib.sha1(p).hexdigest(), last[p] if again else None)
    return out


def test_round_trip(llm):
    big, small = "é<p>" * 400, "s" * 999
    rows = [(1, "http://a/é b\r\nX: y", big), (5, "http://b/", big), (3, None, big), (4, "http://c/", small), (6, "http://c/", small), (7, "", None), (8, "u", ""), (9, "u", "x" * 1000), (10, "u", "WARC/1.1\r\n" * 300_000)]
    got = {r[0]: r for r in run(llm, rows)}
    assert {i: tuple(r[1:5]) for i, r in got.items()} == brute(rows)
    assert all(r[6] for r in got.values()) and got[3][5] is None and got[1][5] == "http://a/%C3%A9%20b%0D%0AX:%20y"


def test_repeated_and_null_ids(llm):
    page = "p" * 2000
    got = run(llm, [(1, "u", page), (1, "u", page), (2, "u", page), (2, "u", page), (None, "u", page)])
    assert sorted((r[0], r[1], r[4]) for r in got if r[0]) == [(1, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None)]
    assert [(r[1], r[4]) for r in got if r[0] is None] == [("response", None)]
    assert run(llm, []) == []


def test_repeated_ids_with_different_payloads(llm):
    a, b = "a" * 1200, "b" * 1200
    got = run(llm, [(5, "u", a), (5, "u", b), (9, "u", a), (10, "u", b)])
    digest = {x: hashlib.sha1(x.encode()).hexdigest() for x in (a, b)}
    assert sorted((r[0], r[1], r[3], r[4]) for r in got) == sorted([(5, "revisit", digest[a], 9), (5, "revisit", digest[b], 10), (9, "response", digest[a], None), (10, "response", digest[b], None)])


def test_archive_is_plain_zstd_behind_the_dictionary():
    pages = [f"<html>{k} some words that come back {k % 7}</html>".encode() * 20 for k in range(200)]
    dictionary = warc.train_dictionary(pages)
    packer = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(dictionary))
    frames = [packer.compress(warc._record(k, "http://x/", p, None, "1970-01-01T00:00:00Z")) for k, p in enumerate(pages)]
    head = (0x184D2A5D).to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
    records = list(warc.read_records(io.BytesIO(head + b"".join(frames))))
    assert [b.partition(b"\r\n\r\n")[2] for _, b in records] == pages
    assert all(h["WARC-Type"] == "response" for h, _ in records)


def test_whole_table(llm, sf):
    from fleetlens.llm.queries import op1_warc

    rows = [(r["page_id"], r["url"], r["html"]) for r in llm.read.parquet(f"{sf}/pages.parquet").collect()]
    got = {r["page_id"]: (r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in op1_warc(llm, sf).collect()}
    assert got == brute(rows)
