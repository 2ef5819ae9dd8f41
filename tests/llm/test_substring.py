"""Substring dedup (operator 13) against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from claimscope.llm import substring as S
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, length):
    first = {}
    for doc, text in rows:
        w = words_of(text)
        for i in range(len(w) - length + 1):
            if doc is not None:
                g = tuple(w[i:i + length])
                first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text in rows:
        w = words_of(text)
        gone = {i + k for i in range(len(w) - length + 1) if doc is not None and first[tuple(w[i:i + length])] < doc for k in range(length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)


def check(df, rows, length):
    got = sorted((tuple(r) for r in S.deduplicate(df, length=length, texts=True).collect()), key=key)
    want = sorted(brute(rows, length), key=key)
    assert got == want
    return sum(r[2] for r in want)


@pytest.mark.parametrize("period", range(1, 32))
def test_every_shift_has_an_aligned_pair(period):
    c = S.cover(period)
    assert {(a - b) % period for a in c for b in c} == set(range(period))


def corpus(seed, length, n=60):
    """Few words, so that windows of every alignment repeat; passages at
    random offsets, copies, near copies, repeats inside a document."""
    rng = random.Random(seed)
    word = lambda: rng.choice("a b c d é 漢 e f".split(" "))
    passages = [[word() for _ in range(rng.randrange(length - 2, 3 * length))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(2 * length))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        rows.append((rng.randrange(10_000), rng.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    rows += [(rng.randrange(10_000), t) for _, t in rng.sample(rows, 10)]          # copies
    rows += [(rng.randrange(10_000), t.replace("a", "b", 1)) for _, t in rng.sample(rows, 10)]
    return rows


@pytest.mark.parametrize("seed,length", [(1, 4), (2, 8), (3, 20), (4, 50)])
def test_equals_brute_force(spark, seed, length):
    rows = corpus(seed, length)
    assert check(spark.createDataFrame(rows, SCHEMA).repartition(5), rows, length) > 0


def test_whole_table_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert check(df, rows, S.LENGTH) > 0


def test_nulls_repeats_short_texts_and_clashing_columns(spark):
    p = " ".join(str(i) for i in range(30))
    rows = [(5, p), (None, p), (None, "x " + p), (3, "y " + p), (3, "z " + p), (3, "y " + p), (9, None), (8, ""), (7, " \t"), (6, "0 1 2"),
            (2, p[:60]), (1, "q"), (10, p + " " + p), (11, p + "\u0085" + p)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("key", "class", "n", "at", "h", "words", "rep")})
    assert check(df, rows, 10) > 0


def test_group_of_copies_and_a_hot_passage(spark):
    p = " ".join(f"w{i}" for i in range(25))
    rows = [(i, p) for i in range(0, 600, 2)] + [(i, f"{i} {p} {i}") for i in range(1, 600, 2)] + [(700, " ".join(["la"] * 5000)), (701, " ".join(["la"] * 300))]
    check(spark.createDataFrame(rows, SCHEMA).repartition(7), rows, 20)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    rows = corpus(9, 8)
    assert check(spark.createDataFrame(rows, SCHEMA), rows, 8) > 0


def test_very_long_text(spark):
    rng = random.Random(5)
    w = [str(rng.randrange(1000)) for _ in range(200_000)]
    rows = [(1, " ".join(w)), (2, " ".join(["x", *w[150_000:], "y"])), (3, " ".join(w[100:149]))]
    assert check(spark.createDataFrame(rows, SCHEMA), rows, 50) == 50_000


def test_empty(spark):
    out = S.deduplicate(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
