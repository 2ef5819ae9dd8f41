"""Operator 9: exact round trip, roles, and salvage of damaged archives."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from claimscope.llm import warc
from claimscope.llm.common import scratch


def pages(spark):
    data = [(i, f"<p>{'x' * (i % 7)} ü {i % 5}</p>\r\n\r\nWARC/1.1\r\n") for i in range(60)]
    data += [(100, None), (101, ""), (99, ""), (3, data[3][1]), (None, "only null"), (None, data[4][1]), (200, "b" * 2_000_000)]
    return spark.createDataFrame(data, "page_id long, html string").withColumn("value", F.lit(1)).withColumn("__first", F.lit(1))


def expect(rows, min_bytes=0):
    body = [(r.page_id, (r.html or "").encode()) for r in rows]
    first = {}
    for i, b in body:
        if i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, b in body:
        revisit = len(b) >= min_bytes and i != first.get(b)
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response",
                    first.get(b) if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 20])
def test_round_trip(spark, min_bytes):
    df = pages(spark)
    got = warc.records(warc.round_trip(df, min_bytes=min_bytes)).collect()
    assert sorted(map(tuple, got), key=str) == expect(df.collect(), min_bytes)


@pytest.mark.parametrize("hot", [4096, 4, 1])
def test_payloads_of_any_share(spark, monkeypatch, hot):
    """Broadcast and joined payloads give the same roles, and no row of a hot
    payload is shuffled with its body."""
    monkeypatch.setattr(warc, "HOT", hot)
    df = spark.createDataFrame([(i, "blank" if i % 3 else f"page {i // 6}") for i in range(5, 300)] + [(None, "blank"), (7, "blank")], "page_id long, html string")
    assert sorted(map(tuple, warc.records(warc.round_trip(df)).collect()), key=str) == expect(df.collect())


def test_plain_archives_keep_payloads(spark):
    path = scratch(spark, "warc-test")
    warc.write_archives(pages(spark), path, gzip=False)
    read = warc.read_archives(spark, path)
    assert read.where("kind = 'gap'").count() == 0
    assert bytes(read.where("page_id = 200").first().payload) == b"b" * 2_000_000


def test_empty_table(spark):
    assert warc.records(warc.round_trip(pages(spark).limit(0))).count() == 0


@pytest.mark.parametrize("gz", [True, False])
@pytest.mark.parametrize("seed", range(25))
def test_salvage_loses_only_what_is_damaged(gz, seed):
    rng = random.Random(seed)
    recs = [warc.build_record(i, bytes(rng.randrange(97, 122) for _ in range(rng.randint(0, 400))), None, False) for i in range(12)]
    parts = [warc._member(r + warc.RECORD_END) + warc.EMPTY_MEMBER if gz else r + warc.RECORD_END for r in recs]
    starts = [sum(map(len, parts[:i])) for i in range(13)]
    data = bytearray(b"".join(parts))
    hit = rng.sample(range(12), 3)
    for i in hit:  # flip payload or header bytes of three records
        at = starts[i] + rng.randrange(len(parts[i]) - (len(warc.EMPTY_MEMBER) if gz else 4))
        data[at] ^= 0x15
    events = list(warc.salvage(bytes(data)))
    got = [int(e[3]["warc-page-id"]) for e in events if e[0] == "record" and e[3].get("warc-page-id", "").isdigit()]
    assert set(range(12)) - set(hit) <= set(got) and got == sorted(got)
    at = 0
    for kind, start, end, what, _ in events:  # in order, and every byte of a gap is logged
        assert start >= at and end > start
        assert kind == "record" or what
        at = end
    covered = sum(e[2] - e[1] for e in events)
    assert covered + (len(warc.EMPTY_MEMBER) * 12 if gz else 0) >= len(data) - 4


def test_truncated_and_foreign_bytes():
    rec = warc.build_record(1, b"abc", None, False) + warc.RECORD_END
    assert [e[0] for e in warc.salvage(b"")] == []
    assert [e[:3] for e in warc.salvage(b"junk" + rec)] == [("gap", 0, 4), ("record", 4, 4 + len(rec))]
    assert [e[0] for e in warc.salvage(rec + rec[:-20])] == ["record", "gap"]
    assert [e[0] for e in warc.salvage(b"\x00" * 50)] == ["gap"]
