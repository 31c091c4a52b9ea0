import base64
import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from fathom.llm import warc
from fathom.llm.shared import work_dir


def records(n, rng):
    return [warc.member(warc.record(f"<urn:x:{k}>", f"http://x/{k}", p := rng.randbytes(rng.randint(0, 3000)), hashlib.sha1(p).hexdigest(), None)) for k in range(n)]


def ids(buf):
    return [r["record_id"] for r, *_ in warc.salvage(buf) if r]


def test_salvage_recovers_what_is_whole():
    rng = random.Random(1)
    parts = records(12, rng)
    whole = b"".join(parts)
    starts = [sum(map(len, parts[:k])) for k in range(13)]
    assert ids(whole) == [f"<urn:x:{k}>" for k in range(12)]
    for _ in range(60):
        at = rng.randrange(len(whole))
        hit = max(k for k in range(12) if starts[k] <= at)
        for broken in (whole[:at] + bytes([whole[at] ^ 0x55]) + whole[at + 1 :], whole[:at] + rng.randbytes(37) + whole[at:]):
            got = ids(broken)
            others = [f"<urn:x:{k}>" for k in range(12) if k != hit]
            assert [x for x in got if x != f"<urn:x:{hit}>"] == others
            cover = sorted((a, z) for _, a, z, _ in warc.salvage(broken))
            assert cover[0][0] == 0 and cover[-1][1] == len(broken) and all(p[1] == q[0] or p == q for p, q in zip(cover, cover[1:], strict=False))
    cut = whole[: starts[11] + 20]
    got = list(warc.salvage(cut))
    assert [r["record_id"] for r, *_ in got if r] == [f"<urn:x:{k}>" for k in range(11)] and got[-1][0] is None and got[-1][1:3] == (starts[11], len(cut))


def test_salvage_of_plain_records_and_junk():
    raw = [warc.record(f"<urn:x:{k}>", None, b"<p>%d</p>" % k, hashlib.sha1(b"<p>%d</p>" % k).hexdigest(), None) for k in range(4)]
    assert ids(b"".join(raw)) == [f"<urn:x:{k}>" for k in range(4)]
    broken = raw[0] + raw[1].replace(b"<p>1</p>", b"<p>9</p>") + b"junk WARC/1.1\r\n junk" + raw[2] + raw[3]
    got = list(warc.salvage(broken))
    assert [r["record_id"] for r, *_ in got if r] == ["<urn:x:0>", "<urn:x:2>", "<urn:x:3>"]
    assert [(a, z) for r, a, z, _ in got if r is None] == [(len(raw[0]), len(raw[0]) + len(raw[1]) + 20)]
    assert list(warc.salvage(b"")) == [] and [g[0] for g in warc.salvage(b"nothing here")] == [None]


def plain(n, digests=True):
    rng = random.Random(7)
    raw = [warc.record(f"<urn:x:{k}>", f"http://x/{k}", p := rng.randbytes(2000), hashlib.sha1(p).hexdigest(), None) for k in range(n)]
    return raw if digests else [re.sub(rb"WARC-(Payload|Block)-Digest: [^\r]*\r\n", b"", r) for r in raw]


def names(*ks):
    return [f"<urn:x:{k}>" for k in ks]


def test_records_after_a_damaged_one_in_a_member():
    raw = plain(6)
    for hit in (0, 2, 5):
        parts = [r.replace(b"HTTP/1.1 200", b"HTTP/1.1 300") if k == hit else r for k, r in enumerate(raw)]
        whole = warc.member(b"".join(parts))
        got = list(warc.salvage(whole + warc.member(raw[1])))
        assert [r["record_id"] for r, *_ in got if r] == names(*[k for k in range(6) if k != hit], 1)
        start = sum(map(len, raw[:hit]))
        assert [g for g in got if g[0] is None] == [(None, 0, len(whole), f"block digest differs: inflated bytes {start} to {start + len(raw[hit])}")]
    bad = warc.member(raw[0][:-9])  # a sound member without a valid record
    assert [(r and r["record_id"], a, z) for r, a, z, _ in warc.salvage(bad + warc.member(raw[1]))] == [(None, 0, len(bad)), ("<urn:x:1>", len(bad), len(bad) + len(warc.member(raw[1])))]


def test_records_before_a_gzip_error():
    raw = plain(6)
    whole, after = warc.member(b"".join(raw)), warc.member(raw[1])
    broken = whole[:-8] + b"\0\0\0\0" + whole[-4:]
    got = list(warc.salvage(broken + after))
    assert [r["record_id"] for r, *_ in got if r] == names(*range(6), 1)
    assert [g[1:3] for g in got if g[0] is None] == [(0, len(broken))] and "gzip" in got[-2][3]
    cut = whole[: len(whole) * 2 // 3]
    assert ids(cut) == names(0, 1, 2) or ids(cut) == names(0, 1, 2, 3)
    assert ids(cut + after)[-1] == "<urn:x:1>" and list(warc.salvage(cut))[-1][1:3] == (0, len(cut))
    # Stored blocks hold the records as they are: none is given twice.
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = packer.compress(b"".join(raw)) + packer.flush()
    assert ids(stored[:-8] + bytes(8) + after) == names(*range(6), 1)
    flipped = stored.replace(raw[2][-500:-490], bytes(10))
    assert flipped != stored and ids(flipped + after) == names(0, 1, 3, 4, 5, 1)


def test_records_without_a_digest():
    raw = plain(4, digests=False)
    whole = warc.member(b"".join(raw))
    assert ids(whole) == names(*range(4))
    assert ids(whole[:-8] + bytes(8)) == []  # any of them may be the damaged one
    assert ids(whole[:-8]) == names(*range(4))


def test_headers_that_say_nonsense():
    revisit = warc.record("<urn:x:0>", None, b"", hashlib.sha1(b"").hexdigest(), "<urn:x:1>")
    ok = plain(1)[0]
    broken = re.sub(rb"(Payload-Digest: sha1:)[^\r]*", rb"\g<1>!?", revisit), re.sub(rb"\r\nContent-Length: [0-9]+\r\n\r\nHTTP", b"\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\nHTTP", ok)
    for b in broken:
        assert ids(b + ok) == ids(warc.member(b + ok)) == ["<urn:x:0>"]


def test_round_trip_of_odd_rows(spark):
    big = "<p>é😀</p>" * 400
    rows = [(1, "http://a b\n/c", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (9, "u", big), (None, "u", big), (7, "u", "y" * 2_000_000), (5, "u", "small")]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, record_type string")
    folder = work_dir(spark, "warc-test")
    files = warc.write_archives(df, folder)
    got = warc.read_archives(files, folder, payload=True)
    assert got.where("gap IS NOT NULL").count() == 0
    found = sorted(((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got.collect()), key=repr)
    name = lambda i: warc.ID.format("" if i is None else i)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        last = 9 if h == big else None
        revisit = last is not None and i != last
        want.append((name(i), "revisit" if revisit else "response", name(last) if revisit else None, len(p), hashlib.sha1(p).hexdigest()))
    assert found == sorted(want, key=repr)
    assert bytes(got.where("record_id = '<urn:fathom:page:9>'").first()["payload"]) == big.encode()


def test_empty(spark):
    folder = work_dir(spark, "warc-test")
    files = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert files.count() == 0 and warc.read_archives(files, folder).count() == 0


def test_archives_are_split_by_size(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    folder = work_dir(spark, "warc-test")
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html")).coalesce(1)
    raw = [warc.record("<x>", "u", b"a" * 50, hashlib.sha1(b"a" * 50).hexdigest(), None)]
    assert raw and warc.write_archives(pages, folder).agg(F.sum("records")).first()[0] == 300


def test_rows_that_repeat_an_id_keep_their_payloads(spark):
    a, b, c = (x * 2000 for x in "abc")
    for rows, want in (
        ([(5, a), (9, a), (5, c)], [(5, a, 9), (9, a, None), (5, c, None)]),
        ([(5, a), (9, a), (5, b), (8, b)], [(5, a, 9), (9, a, None), (5, b, 8), (8, b, None)]),
        ([(9, a), (9, a), (None, a), (None, c), (None, c)], [(9, a, None), (9, a, None), (None, a, 9), (None, c, None), (None, c, None)]),
    ):
        folder = work_dir(spark, "warc-test")
        files = warc.write_archives(spark.createDataFrame([(i, h, "x") for i, h in rows], "page_id long, html string, digest string").withColumn("url", F.lit("u")), folder)
        got = warc.read_archives(files, folder, payload=True).collect()
        name = lambda i: warc.ID.format("" if i is None else i)
        found = [(r["record_id"], r["payload_digest"], r["refers_to"], len(r["payload"])) for r in got]
        assert sorted(found, key=repr) == sorted(((name(i), hashlib.sha1(h.encode()).hexdigest(), name(last) if last else None, 0 if last else 2000) for i, h, last in want), key=repr)


def test_digests_of_other_writers():
    ok, revisit = plain(1)[0], warc.record("<urn:x:1>", None, b"", hashlib.sha1(b"p").hexdigest(), "<urn:x:0>")
    value = re.search(rb"Block-Digest: sha1:([A-Z2-7]+)", ok)[1]
    as_hex = base64.b32decode(value).hex().encode()
    for other in (value.lower(), as_hex, as_hex.upper()):
        assert ids(ok.replace(b"Block-Digest: sha1:" + value, b"Block-Digest: SHA1:" + other)) == ["<urn:x:0>"]
    assert ids(ok.replace(value, b"A" * 32) + revisit) == ["<urn:x:1>"]
    shown = re.sub(rb"Payload-Digest: sha1:[A-Z2-7]+", b"Payload-Digest: sha1:" + hashlib.sha1(b"p").hexdigest().upper().encode(), revisit)
    assert next(warc.salvage(shown))[0]["payload_digest"] == hashlib.sha1(b"p").hexdigest()


def test_archives_are_closed_at_their_size(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    folder = work_dir(spark, "warc-test")
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html")).coalesce(1)
    files = warc.write_archives(pages, folder).collect()
    assert len(files) > 10 and sum(f["records"] for f in files) == 300
    assert sorted(f["bytes"] >= 5000 for f in files)[1:] == [True] * (len(files) - 1) and max(f["bytes"] for f in files) < 6000
    assert warc.read_archives(spark.createDataFrame(files), folder).where("gap IS NULL").count() == 300
