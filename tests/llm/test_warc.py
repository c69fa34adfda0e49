import hashlib
import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plantops.llm import warc


def brute(rows):
    keep = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= 1000:
            keep[b] = max(keep.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ref = keep[b] if i is not None and len(b) >= 1000 and keep[b] > i else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if ref is not None else "response", ref))
    return Counter(out)


def make_rows():
    rng = random.Random(4)
    rows = [(i, f"http://x/{i}", "<p>é" + "".join(rng.choice("abc <>\r\n") for _ in range(rng.randint(0, 3000)))) for i in range(120)]
    rows += [(200 + i, "http://x/same", "s" * 1500) for i in range(30)] + [(300 + i, None, "t" * 900) for i in range(3)]
    rows += [(229, "http://y", "s" * 1500), (None, "u", "s" * 1500), (400, "a b\r\nWARC-Type: x", None), (401, "", ""), (402, "big", "WARC/1.0\r\n\r\n" * 300_000)]
    return rows


def test_round_trip(spark):
    rows = make_rows()
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    archives = warc.write_pages(pages, warc.shared_path(spark, "warc-test"))
    assert archives.agg(F.sum("records")).first()[0] == len(rows)
    for split in (700, 64 << 10, 8 << 20):
        got = warc.read_pages(archives, split)
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == brute(rows)
    by_id = {r.page_id: r for r in got.collect()}
    assert by_id[5].payload == rows[5][2] and by_id[402].payload == rows[-1][2] and by_id[200].payload is None


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archive_round_trip(spark, pages).count() == 0


def test_damage_and_magic_inside_a_payload():
    recs = [warc.record(i, "u", bytes([0x1f, 0x8b, 8]) * 50 + bytes(random.Random(i).randbytes(500)), "00" * 20, None) for i in range(6)]
    starts = [sum(map(len, recs[:i])) for i in range(6)]
    good = b"".join(recs)
    for step in (1, 97, 500, 5000):
        got = [at for s in range(0, len(good), step) for at, _ in warc.records(io.BytesIO(good), s, s + step, len(good))]
        assert got == starts


def read_all(raw, step):
    return [at for s in range(0, len(raw), step) for at, _ in warc.records(io.BytesIO(raw), s, s + step, len(raw))]


def test_damage_raises_at_every_split_size():
    recs = [warc.record(i, "u", random.Random(i).randbytes(700), "00" * 20, None) for i in range(6)]
    whole = b"".join(recs)
    rng = random.Random(3)
    for member in range(6):
        lo = sum(map(len, recs[:member]))
        for place in (0, 1, 2, 12, 60, len(recs[member]) - 5, *(rng.randrange(12, len(recs[member]) - 8) for _ in range(3))):
            raw = bytearray(whole)
            raw[lo + place] ^= 0xFF
            for step in (97, 900, 5000, len(whole)):
                with pytest.raises(ValueError):
                    read_all(bytes(raw), step)
    for cut in (1, 9, len(recs[-1]) - 1):
        for step in (97, 900, len(whole)):
            with pytest.raises(ValueError):
                read_all(whole[:-cut], step)
    with pytest.raises(ValueError):
        read_all(recs[0] + b"junk" + recs[1], 5000)


def test_a_shortened_archive_raises(spark):
    pages = spark.createDataFrame([(i, "u", "x" * 2000 + str(i)) for i in range(5)], "page_id bigint, url string, html string").coalesce(1)
    archives = warc.write_pages(pages, warc.shared_path(spark, "warc-test"))
    longer = archives.withColumn("bytes", F.col("bytes") + 10)  # as if the last record had been lost whole
    with pytest.raises(Exception, match="bytes, not"):
        warc.read_pages(longer).collect()
