"""Packing documents into fixed-length sequences by concatenate and cut
(operator 2).

Method.  Pass 1 tokenises every document once and writes its ids with the
input partition and the running token offset inside that partition.  The
partition totals (one row for each task) are prefix-summed in two levels,
which gives every document its global offset.  Pass 2 cuts the one long
token stream at multiples of the sequence length: a document that crosses a
boundary gives one piece on either side.  Every sequence but the last is
full, so the padding is less than one sequence for the whole corpus.

Defined results.  Null text is the empty text, which is the end id alone.
Documents of any length are cut over as many sequences as they need; repeated
rows are packed once for each row.  An empty table gives no pieces.  The
order of documents in the stream is their order in the input partitions.
Only the id and text columns are read; null ids pass through.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimscope.llm.common import small, written
from claimscope.llm.merges import Memo, Merges

SEQUENCE = 2048
END_ID = 1
_BLOCK = 1024           # partition totals summed per block in the first level
_WORD = re.compile(r"[^ \t\n\r]+")
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#-&(-/:-@\\[-`{-~]*)")  # marks but " and '
_LOADED: dict[str, "WordEncoder"] = {}


class WordEncoder(Memo):
    """Text between white space -> ids as little-endian unsigned 32-bit
    bytes, memoised (bounded).

    The vocabulary's normalizer and pattern never join characters across a
    space, tab or line end, so encoding the parts and joining the ids equals
    encoding the whole text; checked at loading.  A run of Latin letters with
    ASCII marks after it is two pre-tokens whose merges are made directly;
    anything else goes through the whole library.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(vocabulary)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(vocabulary, encoding="utf-8") as f:
            self.merges = Merges(json.load(f), self.lib)
        for probe in ("a b's\tc1\r\n d  e!", "Thandble, über. Ção?! naïve... straße;"):
            if b"".join(self.make(w) for w in probe.split()) != self._library(probe):
                raise ValueError("this vocabulary joins text across white space or has other pre-tokens")

    def _library(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.lib.encode(text, add_special_tokens=False).ids)

    def make(self, word: str) -> bytes:
        simple = _SIMPLE.fullmatch(word)
        if not simple:
            return self._library(word)
        letters, marks = simple.groups()
        ids = self.merges.encode(letters.lower().encode())
        return ids + self.merges.encode(marks.encode()) if marks else ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, _WORD.findall(text))) if text else b""


def encoder(vocabulary: str) -> WordEncoder:
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = WordEncoder(vocabulary)
    return _LOADED[vocabulary]


def tokenise(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
             end_id: int = END_ID) -> DataFrame:
    """``(key, part, part_start, ids)``: ids (binary, unsigned 32-bit) with
    the end id, the task's partition and the tokens before it there."""
    schema = f"`{key}` {dict(df.dtypes)[key]}, __part int, __start long, __ids binary"
    end = end_id.to_bytes(4, "little")

    def run(batches):
        enc, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [enc.encode(v.as_py()) + end for v in batch.column(1)]
            starts = []
            for x in ids:
                starts.append(at)
                at += len(x) // 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(ids, pa.binary())], names=[key, "__part", "__start", "__ids"])

    return df.select(key, text).mapInArrow(run, schema)


def partition_offsets(tokens: DataFrame) -> tuple[DataFrame, int]:
    """``(__part, __base)``: tokens in all partitions before, by a two-level
    prefix sum over the partition totals; and the number of partitions."""
    totals = written(tokens.groupBy("__part").agg(
        F.max(F.col("__start") + F.octet_length("__ids") / 4).cast("long").alias("__n"))
        .withColumn("__block", F.floor(F.col("__part") / _BLOCK)), "pack-totals")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = totals.groupBy("__block").agg(F.sum("__n").alias("__bn"))
    blocks = blocks.select("__block", before(Window.orderBy("__block"), "__bn").alias("__b0"))
    inner = totals.withColumn("__p0", before(Window.partitionBy("__block").orderBy("__part"), "__n"))
    return inner.join(blocks, "__block").select("__part", (F.col("__b0") + F.col("__p0")).alias("__base")), totals.count()


def pack(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
         sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces ``(key, start, length, ids, doc_tokens, sequence_id, offset)``;
    ``ids`` is the piece's binary of unsigned 32-bit integers."""
    tokens = written(tokenise(df, vocabulary, key, text, end_id), "pack-tokens")
    bases, parts = partition_offsets(tokens)
    n = (F.octet_length("__ids") / 4).cast("long")
    placed = tokens.join(small(bases, parts), "__part").select(
        key, "__ids", n.alias("__n"), (F.col("__base") + F.col("__start")).alias("__at"))
    first, last = F.floor(F.col("__at") / sequence), F.floor((F.col("__at") + F.col("__n") - 1) / sequence)

    def piece(s):
        begin = F.greatest(s * sequence, F.col("__at"))
        length = F.least((s + 1) * sequence, F.col("__at") + F.col("__n")) - begin
        start = begin - F.col("__at")
        return F.struct(
            start.alias("start"), length.alias("length"),
            F.substring(F.col("__ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int")).alias("ids"),
            F.col("__n").alias("doc_tokens"), s.alias("sequence_id"), (begin - s * sequence).alias("offset"))

    # The array of slices is built once for a document and then exploded, so a
    # long document is not copied for each of its pieces.
    return placed.select(key, F.explode(F.transform(F.sequence(first, last), piece)).alias("__p")).select(key, "__p.*")


def digests(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    return pieces.select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
