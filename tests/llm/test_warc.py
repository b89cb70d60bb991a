import gzip
import hashlib
import random

from delayrisk.llm import warc
from delayrisk.llm.common import scratch
from delayrisk.llm.queries import op2_warc_history


def brute(rows):
    big = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000:
            k = hashlib.sha1(b).hexdigest()
            big[k] = max(x for x in (big.get(k), i, -1) if x is not None)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        k = hashlib.sha1(b).hexdigest()
        kept = big.get(k, -1) if len(b) >= 1000 else -1
        again = kept != -1 and kept != i
        out.append((str(i), len(b), k, "revisit" if again else "response", str(kept if again else None)))
    return sorted(out)


def key(r):
    return (r.url_key, r.captured_at, r.id is not None, r.id or 0)


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = op2_warc_history(spark, sf).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], str(r[4])) for r in got) == brute(rows)


def odd_pages(spark):
    rng = random.Random(4)
    body = "".join(rng.choices("abc é\r\n", k=2000))
    traps = ["\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "x\r\n\r\n", "\r\n" * 700, "é" * 499, "é" * 500, "é" * 500]
    rows = [(1, "http://a.b/x?z=1&a=2", body), (2, "http://A.b:80/x?a=2&z=1", body), (3, None, body), (None, "http://q", body), (4, "not a url", None),
            (5, "http://[bad", ""), (6, "http://a.b/\r\nX-Evil: 1", "short"), (7, "http://a.b/", "short"), (2, "http://A.b:80/x?a=2&z=1", body),
            (8, "http://a.b/", "y" * 3_000_000), (None, None, None)]
    rows += [(20 + k, "http://t.org/é", t) for k, t in enumerate(traps)]
    docs = spark.createDataFrame([r + ("x", "y", "z") for r in rows], "page_id long, url string, html string, sha string, size string, id string")
    return rows, docs


def test_odd_rows(spark):
    rows, docs = odd_pages(spark)
    got = warc.archived(docs.repartition(4)).collect()
    assert sorted((str(r.id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == brute(rows)
    assert [key(r) for r in got] == sorted(key(r) for r in got)
    assert {r.url_key for r in got if r.id in (1, 2)} == {"b,a)/x?a=2&z=1", "b,a:80)/x?a=2&z=1"}
    assert all("\n" not in (r.url or "") for r in got)


def test_offsets_find_the_records(spark):
    rows, docs = odd_pages(spark)
    folder = scratch(spark, "test-warc")
    warc.write(docs.repartition(2), folder)
    for r in warc.history(spark, folder).collect():
        with open(r.file.removeprefix("file:"), "rb") as f:
            record = gzip.decompress(f.read())[r.offset:r.offset + r.length]
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        if r.record_type == "response":
            assert hashlib.sha1(record[:-4].split(b"\r\n\r\n", 2)[2]).hexdigest() == r.payload_digest


def test_many_ranges_stay_in_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "PER_RANGE", 20)
    monkeypatch.setattr(warc, "PER_FILE", 7)
    rows = [(k, "http://hot.org/" if k % 3 else f"http://h{k % 11}.org/{k}", f"p{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = warc.archived(docs).collect()
    assert len(got) == 300 and [key(r) for r in got] == sorted(key(r) for r in got)


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(0, 12))) for _ in range(k)]
        order = list(warc.LoserTree(runs))
        assert [runs[r][p] for r, p in order] == sorted(x for r in runs for x in r)
        assert order == sorted(order, key=lambda x: (runs[x[0]][x[1]], x))


def test_damaged_archives_are_refused():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha1:0\r\nContent-Length: 5\r\n\r\nh\r\n\r\n\r\n\r\n"
    for bad in (gzip.compress(good[:-3]), gzip.compress(good), gzip.compress(b"WARC/1.1\r\nno end")):
        try:
            warc.captures("f", bad)
        except ValueError:
            continue
        raise AssertionError


def test_empty(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
