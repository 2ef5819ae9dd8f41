"""Operators 2 and 10 against the tokenizers library itself."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from claimscope.llm import bpe, packing
from claimscope.llm.queries import BYTE_BPE, WORD_BPE

POOL = "abcdefgh AB  \n\t'’\"0123é́ßñŒœÿİıΣς漢字😀.,!?<|endoftext|>-_  \x1c\x0b\x85~`$%&|àÀ×÷ſK"


def library(path):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return out + ["", " ", "x<|endoftext|> y<|startoftext|>z  <|endoftext|>", "don't we'Ll I'M", "a" * 3000,
                  "ab" * 2000 + "!" * 500, "a  b\n\n c", "\x00\x01  \x02", "zq" * 9 + "ÿþ"]


@pytest.mark.parametrize("path,make", [(WORD_BPE, packing.encoder), (BYTE_BPE, bpe.codec)])
def test_encoders_equal_the_library(path, make):
    lib, own = library(path), make(path)
    for t in texts():
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t
    assert own.encode(None) == b""


def test_decoder_equals_the_library_on_any_ids():
    lib, own, rng = library(BYTE_BPE), bpe.codec(BYTE_BPE), random.Random(4)
    for _ in range(500):  # random ids also give broken UTF-8
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids, skip_special_tokens=False)
    assert own.decode(None) == ""


def test_cuts_are_certain():
    own = bpe.codec(BYTE_BPE)
    for raw in own.raw[:50256]:
        assert all(raw[i:i + 2] in own.inside for i in range(len(raw) - 1))
    assert len(own.inside) < 65536 // 2  # most pairs are cuts


def rows(spark):
    data = [(i, t) for i, t in enumerate(texts()[:200])] + [(500, None), (501, ""), (7, "again"), (7, "again"), (None, "no id"),
                                                           (502, "word " * 30000)]
    return spark.createDataFrame(data, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("__part", F.lit("x"))


def test_round_trip_digests(spark):
    df, lib = rows(spark), library(BYTE_BPE)
    got = sorted(tuple(r) for r in bpe.digests(bpe.round_trip(df, BYTE_BPE)).na.fill(-1, ["doc_id"]).collect())
    want = []
    for r in df.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((-1 if r.doc_id is None else r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    coded = bpe.encode(df, BYTE_BPE)
    assert bpe.decode(coded, BYTE_BPE).where("doc_id = 502").first().decoded == "word " * 30000


@pytest.mark.parametrize("sequence", [64, 2048])
def test_packing_covers_every_id_once(spark, sequence):
    df, lib = rows(spark).repartition(5), library(WORD_BPE)
    pieces = packing.pack(df, WORD_BPE, sequence=sequence).toPandas()
    want = {}
    for r in df.collect():
        ids = np.array(lib.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want.setdefault(r.doc_id, []).append(ids)
    assert pieces.length.sum() == sum(len(x) for v in want.values() for x in v)
    assert (pieces.length > 0).all()
    for s, q in pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert q.offset.tolist() == [0, *q.length.cumsum().tolist()[:-1]]
        assert q.length.sum() == sequence or s == pieces.sequence_id.max()
    for p in pieces.itertuples():
        options = want[None if np.isnan(p.doc_id) else p.doc_id]
        assert any(len(x) == p.doc_tokens and x[p.start:p.start + p.length].tobytes() == p.ids for x in options)
    crc = packing.digests(packing.pack(df.where("doc_id = 501"), WORD_BPE)).first()
    assert crc.ids_crc32 == zlib.crc32((1).to_bytes(4, "little")) and crc.length == 1


def test_empty_tables(spark):
    none = rows(spark).limit(0)
    assert packing.pack(none, WORD_BPE).count() == 0
    assert bpe.round_trip(none, BYTE_BPE).count() == 0
