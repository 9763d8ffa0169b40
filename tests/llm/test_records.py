"""URL rules, archives, media and the pipeline."""

import hashlib
import re
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import media, queries, url_filter, warc


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_its_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


URLS = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://Example.ORG/en/12?q"), (5, "http://a.example.org/es/"), (6, "http://a.example.org/es"), (7, "x://notexample.org/en/1"), (8, "http://com/de/x#y"), (8, "http://com/de/x#y"),
    (9, "http://?q"), (14, "http://" + "a." * 20_000 + "example.org/es/x"), (15, None), (16, "http://a..com/de/"), (17, "http://.com/de/"), (18, "http://com./de/"), (10, "http://x.com"), (11, "http://x.com/fr/" + "a" * 50_000), (12, "://.org/"), (13, "http://net"),
]


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([k for k in (path.find(c) for c in "?#") if k >= 0], default=len(path))]
    fit = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[2]) if fit else (host, path, None, "allow")


@pytest.mark.parametrize("rules", [queries.URL_RULES, [("block", "net", ""), ("allow", "net", ""), *queries.URL_RULES], []])
def test_urls(spark, rules):
    pages = spark.createDataFrame([(*u, "x", "y") for u in URLS], "page_id long, url string, host string, verdict string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    rows = url_filter.judge(pages, table).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in rows) == sorted((k, h, p, r or "", v) for k, u in URLS for h, p, r, v in [brute_verdict(u, rules)])
    assert url_filter.judge(pages.limit(0), table).count() == 0


def test_many_rules_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 1)
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "verdict string, host string, path string")
    rows = url_filter.judge(pages, rules).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in rows) == sorted((k, brute_verdict(u, queries.URL_RULES)[3]) for k, u in URLS)


def test_archives(spark, tmp_path):
    big, same_ = "é" * 300_000 + "\r\n\r\nWARC/1.1\r\n", "s" * 1000
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, None), (3, "u", ""), (4, "u", same_), (5, "u", same_), (6, "u", same_), (7, "v", same_[1:]), (8, "v", same_[1:]), (None, "w", "no id"), (9, "w", big), (10, "t", "r"), (10, "t", "r")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    path = str(tmp_path / "archive")
    warc.write(warc.revisits(pages), path, chunk=4096)
    archive = spark.read.parquet(path)
    assert archive.agg(F.max(F.octet_length("data"))).first()[0] <= 4096 + 1000
    found = warc.resolve(warc.read(archive)).collect()
    want = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        to = max((p for p, _, h in rows if p is not None and (h or "") == (html or "")), default=None) if len(payload) >= 1000 else None
        to = None if to == page_id else to
        want.append((page_id, "response" if to is None else "revisit", to, len(payload), hashlib.sha1(payload).hexdigest()))
    key = lambda t: tuple((x is None, x or 0) for x in t[:1] + t[3:4]) + (t[4],)
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in found), key=key) == sorted(want, key=key)
    urls = {r["page_id"]: r["url"] for r in found}
    assert urls[1] == "http://a/ b\r\nX: y" and warc.Reader() is not None
    heads = [r["data"].split(b"\r\n\r\n")[0].decode() for r in archive.filter("chunk = 0").collect()]
    named = {re.search("WARC-Record-ID: (.*)", h)[1].strip() for h in heads if "WARC-Type: response" in h}
    assert {m[1].strip() for h in heads if (m := re.search("WARC-Refers-To: (.*)", h))} <= named
    # all chunks in a row are a WARC file
    whole = b"".join(r["data"] for r in archive.orderBy("record_id", "chunk").collect())
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)
    warc.write(warc.revisits(pages.limit(0)), path + "-none")
    assert warc.read(spark.read.parquet(path + "-none")).count() == 0


def test_damage_is_noticed():
    head = warc._record(1, "u", hashlib.sha1(b"abc").hexdigest(), None, 3)
    reader = warc.Reader()
    for b in head + b"abd":
        reader.feed(bytes([b]))
    with pytest.raises(ValueError, match="damaged"):
        reader.row()
    reader = warc.Reader()
    reader.feed(head)
    with pytest.raises(ValueError, match="cut off"):
        reader.row()


def test_pictures_by_both_ways_of_reading(monkeypatch):
    rng = random.Random(6)
    for n in (576, 5760, 576 * 21):
        payload = bytes(rng.randrange(256) for _ in range(n))
        data = media.write_jpeg(payload, n - 5)
        fast = media.Picture(data)
        assert fast.payload() == (payload, n - 5)
        with monkeypatch.context() as m:
            m.setattr(media, "_constant", lambda *a: None)
            slow = media.Picture(data)
        assert all((a.coefficients == b.coefficients).all() for a, b in zip(fast.planes.values(), slow.planes.values(), strict=True))
        rgb = fast.rgb()
        assert rgb.shape == (fast.height, fast.width, 3) and (rgb == slow.rgb()).all()


def test_inverse_transform_by_its_definition():
    import numpy as np

    rng = np.random.default_rng(3)
    block = rng.integers(-60, 60, (8, 8)).astype(float)
    c = [np.sqrt(0.5)] + [1.0] * 7
    want = [[sum(c[u] * c[v] * block[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4 for y in range(8)] for x in range(8)]
    assert np.allclose(media.DCT.T @ block @ media.DCT, want, atol=1e-3)
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media.ZIGZAG) == list(range(64))


def test_media_columns(spark):
    rows = [(1, None), (2, ""), (3, "é" * 300), (4, "z" * 576), (5, "long " * 100_000), (6, "z" * 576)]
    docs = spark.createDataFrame([(*r, "m", 1) for r in rows], "doc_id long, text string, media string, n_bytes int")
    found = {r["doc_id"]: r for r in media.read(media.store(docs, keep=["doc_id"])).collect()}
    for key, text in rows:
        raw = (text or "").encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = found[key]
        assert (r["n_bytes"], r["payload_bytes"], r["payload"]) == (len(raw), len(full), full)
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert len(r["rgb"]) == 3 * r["width"] * r["height"]
    assert found[4]["media_sha256"] == found[6]["media_sha256"] and found[4]["feature"] == found[6]["feature"]
    assert media.store(docs.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = corpus_pipeline.read_table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        found = corpus_pipeline.materialise(stage(spark, docs, sf_dir), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == columns and 0 < found.count() <= docs.count()
            docs = found
    ids = {r[0] for r in docs.select("doc_id").collect()}
    assert {r[0] for r in found.select("doc_id").distinct().collect()} == ids
    assert corpus_pipeline.run(spark, sf_dir).count() == found.count()
