"""BPE encoding and decoding by forced-boundary splitting (operator 10).

Method.  From the vocabulary we take every pair of neighbouring bytes that
occurs inside some token.  A pair that occurs inside none can never be
crossed by a merge, so the text may be cut there for certain.  Every such
fragment is encoded on its own by the vocabulary's merges and the ids are
concatenated.  Two kinds of certain cuts are used:

* between a non-space character and a space, tab, line feed or carriage
  return: the table marks these pairs (but for the tail byte of a no-break
  space), and the pre-tokenizer's pattern ends every match there anyway.  A
  text is first cut into such ``[space run] + [non-space run]`` fragments;
  they repeat a lot, and their ids are memoised per Python worker (bounded);
* inside each pre-token of such a fragment, at every uncrossable pair.  A
  100 MB text without a space thus becomes many short fragments.

Defined results.  Null text is the empty text: no ids.  Text and ids may be
of any length; a row is held by one task, fragments keep the work linear.
The special token's string in a text is that special token, as the library
has it.  Repeated rows give repeated results; an empty table gives an empty
one.  Only the id column and the text column are read, so further columns
with any name do no harm; null ids pass through.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.merges import Memo, Merges, byte_symbols

_FRAGMENT = re.compile(r"\s*\S+|\s+")
_OTHER_SPACE = re.compile(r"[^\S \t\n\r]")
_SIMPLE = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!#-&(-/:-;=-@\\[-`{-~]*)")  # marks but " ' and <
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")
_LOADED: dict[str, "ForcedBoundaryBpe"] = {}


class ForcedBoundaryBpe(Memo):
    """fragment -> ids as little-endian unsigned 32-bit bytes (the memo)."""

    def __init__(self, vocabulary: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if (model["type"], pre["type"], pre["use_regex"], pre["add_prefix_space"], spec["normalizer"]) != \
                ("BPE", "ByteLevel", True, False, None) or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("forced-boundary splitting needs a byte-level BPE vocabulary without normalizer")
        symbols = byte_symbols()
        self.back = back = {s: b for b, s in symbols.items()}
        raw = [bytes(map(back.__getitem__, t)) for t in model["vocab"]]
        self.inside = {t[i:i + 2] for t in raw for i in range(len(t) - 1)}
        self.merges = Merges(spec, self.lib)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        # Added tokens that hold or take up spaces forbid the cuts before spaces.
        self.cut_before_space = not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])
            for t in spec["added_tokens"])
        size = max([*model["vocab"].values(), *self.added.values()]) + 1
        self.raw = [b""] * size
        for t, i in model["vocab"].items():
            self.raw[i] = bytes(back[c] for c in t)
        for t, i in self.added.items():
            self.raw[i] = t.encode()

    def _forced(self, word: bytes) -> bytes:
        """Ids of one pre-token: cut at every uncrossable pair, each fragment
        encoded independently, concatenated."""
        cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in self.inside]
        if not cuts:
            return self.merges.encode(word)
        return b"".join(self.merges.encode(word[a:b]) for a, b in zip([0, *cuts], [*cuts, len(word)]))

    def make(self, fragment: str) -> bytes:
        simple = _SIMPLE.fullmatch(fragment)
        if simple:  # two pre-tokens at most: [space] letters, marks
            return b"".join(self._forced(g.encode()) for g in simple.groups() if g)
        out = []
        for part in self.added_split.split(fragment) if self.added_split else (fragment,):
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                for word, _ in self.lib.pre_tokenizer.pre_tokenize_str(part):
                    out.append(self._forced(bytes(map(self.back.__getitem__, word))))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cut_before_space:
            return self.make(text)
        parts = _CUT.split(text) if _OTHER_SPACE.search(text) else _FRAGMENT.findall(text)
        return b"".join(map(self.__getitem__, parts))

    def decode(self, ids: bytes | None) -> str:
        import numpy as np
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))
        return raw.decode("utf-8", "replace")


def codec(vocabulary: str) -> ForcedBoundaryBpe:
    """The codec of this Python worker, loaded once."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = ForcedBoundaryBpe(vocabulary)
    return _LOADED[vocabulary]


def _map(df: DataFrame, key: str, value: str, out: str, kind: pa.DataType, sql_type: str, make) -> DataFrame:
    schema = f"`{key}` {dict(df.dtypes)[key]}, `{out}` {sql_type}"

    def run(batches):
        fn = make()
        for batch in batches:
            col = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array((fn(v.as_py()) for v in col), kind, size=len(col))], names=[key, out])

    return df.select(key, value).mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)``: ids of each whole text as a binary of little-endian
    unsigned 32-bit integers."""
    return _map(df, key, text, "ids", pa.binary(), "binary", lambda: codec(vocabulary).encode)


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, decoded)``: the text of ids as ``encode`` returns them."""
    return _map(df, key, ids, "decoded", pa.string(), "string", lambda: codec(vocabulary).decode)


def round_trip(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids, decoded)``: encode each whole text, then decode its ids."""
    schema = f"`{key}` {dict(df.dtypes)[key]}, ids binary, decoded string"

    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            ids = [c.encode(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.string(), size=len(ids))],
                names=[key, "ids", "decoded"])

    return df.select(key, text).mapInArrow(run, schema)


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` of ``round_trip``."""
    return coded.select(
        key, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
