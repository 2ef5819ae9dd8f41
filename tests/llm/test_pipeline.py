"""The pipeline against plain Python, stage by stage."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimscope.llm import langid, packing, pii, quality
from claimscope.llm.common import table
from claimscope.llm.queries import WORD_BPE
from tests.conftest import SF_SMALL
from tests.llm.test_near_duplicates import plain_fingerprint, roots

EXTRA = [(900001, None, "en", "s", None), (900002, "", "en", None, 0), (None, "the of and " * 30 + "end.", None, "s", 3), (900003, "x", None, None, None)]


def documents(spark):
    d = table(spark, SF_SMALL, "documents").select(corpus_pipeline.COLUMNS)
    d = d.union(spark.createDataFrame(EXTRA, d.schema))
    return d.union(d.where("doc_id < 40")).union(spark.createDataFrame([(7, "other text. " * 60, "en", "s", 1)], d.schema))


def fails(line):
    n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
    seps = len(re.findall("[|›»•·]", line))
    return n > 0 and ((n >= 4 and not re.search(quality.CLOSING, line) and not re.search(quality.SENTENCE, line)) or line.count("!!") >= 3
                      or (seps >= 2 and n <= 3 * (seps + 1) + seps) or len(re.findall(r"[#*$%&|<>]", line)) > 0.2 * n + 1
                      or any(p in line.lower() for p in quality.BOILERPLATE))


def plain(rows, model):
    """All stages but the last on a list of (doc_id, text, lang, source, n_chars)."""
    p = langid.Predictor(model)
    rows = [r for r in rows if not p.judge(r[1])[2]]
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1])
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        seen = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g, c in __import__("collections").Counter(grams).items() if c > 1}
        cover = {j for i, g in enumerate(grams) if g in seen for j in (i, i + 1, i + 2)}
        lines = r[1].split("\n")
        bad = sum(len(x) for x in lines if fails(x))
        if len(w) >= 50 and 100 * len(cover) <= 50 * len(w) and bad <= 0.5 * sum(map(len, lines)):
            text = "\n".join(x for x in lines if not fails(x))
            out.append((r[0], text, r[2], r[3], r[4] if text == r[1] else len(text)))
    fps = np.array([plain_fingerprint(r[1]) for r in out], np.uint64)
    comp = roots(len(out), [(i, j) for i in range(len(out)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3).tolist() if i < j])
    keep = {}
    for k, c in enumerate(comp):
        order = (out[k][0] is None, out[k][0] or 0)
        if c not in keep or order < keep[c][0]:
            keep[c] = (order, k)
    return [out[k] for _, k in keep.values()]


def redact(text):
    spans, out, at, i = pii.reference_spans(text), "", 0, 0
    while i < len(spans):
        a, k, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][2])
            i += 1
        out, at = out + text[at:a] + f"[{pii.KINDS[k].upper()}]", b
    return out + text[at:]


def test_stages_against_plain_python(spark, tmp_path):
    first = documents(spark).withColumn("row", F.lit(1)).withColumn("key", F.lit(1)).withColumn("ids", F.lit(1))
    # the model is fitted on the input's rows that are not held out
    model = langid.train(first.where(~langid.held_out()))
    docs, sizes = first, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            sizes.append(docs.count())
    deduped = spark.read.parquet(f"{tmp_path}/2")
    want = sorted(plain([tuple(r) for r in documents(spark).collect()], model), key=str)
    assert sorted(map(tuple, deduped.collect()), key=str) == want and sizes[2] == sizes[3] < sizes[1] <= sizes[0]
    for r in spark.read.parquet(f"{tmp_path}/3").join(deduped.select("doc_id", F.col("text").alias("old")), "doc_id").collect():
        assert r.text == redact(r.old)
    enc = packing.encoder(WORD_BPE)
    texts = {r.doc_id: enc.encode(r.text) + (1).to_bytes(4, "little") for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    pieces = docs.collect()
    assert sum(p.length for p in pieces) == sum(len(t) // 4 for t in texts.values())
    for p in pieces:
        assert zlib.crc32(texts[p.doc_id][4 * p.start:4 * (p.start + p.length)]) == p.ids_crc32
    assert all(p.offset + p.length <= 2048 for p in pieces)


@pytest.mark.parametrize("step", range(5))
def test_empty_and_null_inputs(spark, step):
    docs = documents(spark)
    none = docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]).limit(3)
    stage = corpus_pipeline.STAGES[step][1]
    assert stage(spark, docs.limit(0), SF_SMALL).count() == 0
    got = stage(spark, none, SF_SMALL).count()
    assert got == {0: 0, 1: 0, 2: 1, 3: 3, 4: 3}[step]


def test_run(spark):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.count() > 0 and got.columns[:2] == ["doc_id", "start"]
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "simhash_near_dedup" and corpus_pipeline.ORACLE_SQL is None
