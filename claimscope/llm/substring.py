"""Substring dedup by difference-cover anchors (operator 13).

Method.  A window is ``length`` consecutive words of one document.  With a
difference cover D of the period p, any two positions have a shift below p
that puts both on D, so two equal windows hold equal anchors of
``length`` - p + 1 words that both start on a cover position of their own
document.  Therefore:

1. only windows of anchor length at cover positions are hashed (6 of 31
   positions for 50 words) and grouped; an anchor found in two different
   texts is shared;
2. only texts with shared anchors are read again.  They extend: every full
   window around a shared anchor is hashed (128 bits), and a window whose
   smallest document is not its own is a repeat;
3. the words under repeats go.

Texts with the same words are one class, told by the SHA-256 of the words, so
copies are compared once: with the smallest id of the class.  A hash counts
once a text, minima are combined before the shuffle, and the joins that bring
the answers back have a written, duplicate-free side, so that AQE can split a
crowded key; no pairs of documents are ever made.

Defined results.  Windows are judged on the input.  Null and wordless texts,
and texts shorter than a window, keep all they have.  A null id is never
smaller nor larger than another: such a text stays whole and removes nothing.
Rows with equal ids do not remove each other's words; equal rows get equal
results.  A window that repeats only inside its document stays.  Very long
texts are one row each, hashed in arrays.  Empty tables give empty results.
Only the id and text columns are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
import itertools
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import small, written
from claimscope.llm.merges import Memo

LENGTH = 50
BROADCAST_ROWS = 1_000_000   # 32-byte classes sent to the scan; beyond, a shuffle join
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so that they have inverses
_EMPTY = hashlib.sha256().digest()


# ------------------------------------------------------------- cover
def cover(period: int) -> list[int]:
    """Smallest set whose differences are all residues of ``period`` that a
    search finds: perfect difference sets where they exist."""
    size = next(k for k in itertools.count(1) if k * (k - 1) >= period - 1)
    for k in itertools.count(size):
        found = _extend([0], {0}, k, period, k * (k - 1) - (period - 1))
        if found:
            return found
    raise AssertionError


def _extend(chosen: list[int], seen: set[int], k: int, period: int, spare: int):
    """Depth-first search that may waste ``spare`` differences."""
    if len(chosen) == k:
        return chosen if len(seen) == period else None
    for x in range(chosen[-1] + 1, period):
        new = {(x - c) % period for c in chosen} | {(c - x) % period for c in chosen}
        waste = 2 * len(chosen) - len(new - seen)
        if waste <= spare:
            found = _extend([*chosen, x], seen | new, k, period, spare - waste)
            if found:
                return found
    return None


def period_of(length: int) -> int:
    """Largest q^2 + q + 1 (perfect sets, q up to 5) within 2/3 of a window."""
    return max([q * q + q + 1 for q in (1, 2, 3, 4, 5) if 3 * (q * q + q + 1) <= 2 * length], default=1)


# ------------------------------------------------------------- hashing
class _Words(Memo):
    def make(self, key):
        import xxhash
        return xxhash.xxh64_intdigest(key, 42)


class Rolling:
    """Hashes of word windows: sums of word hash times base^place modulo 2^64,
    from prefix sums."""

    def __init__(self):
        import numpy as np
        self.memo = _Words()
        self.powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in _BASES]

    def _upto(self, n: int):
        import numpy as np
        if len(self.powers[0][0]) <= n:
            size = max(1 << 14, 2 * n)
            self.powers = [tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(b))]), dtype=np.uint64)
                                 for b in (base, pow(base, -1, 1 << 64))) for base in _BASES]
        return self.powers

    def prefixes(self, words):
        import numpy as np
        n = len(words)
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, n)
        return [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)]) for power, _ in self._upto(n)]

    def windows(self, prefixes, at, length: int, which: int):
        c = prefixes[which]
        return (c[at + length] - c[at]) * self.powers[which][1][at]


def _class(words) -> tuple[bytes, int]:
    """Class of a text, and its first eight bytes as a long."""
    sha = hashlib.sha256(b" ".join(words)).digest()
    return sha, struct.unpack("<q", sha[:8])[0]


def _words(batch, i: int):
    for t in batch.column(i):
        t = t.as_py()
        yield t.split() if t else []  # bytes: ASCII white space only


def _batch(cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


# ------------------------------------------------------------- stages
def classes(docs: DataFrame, kind: str, texts: bool) -> DataFrame:
    """``(key, class, brief, n, words)``: ``words`` only with ``texts``."""
    def run(batches):
        for batch in batches:
            own = [(*_class(w), len(w), b" ".join(w) if texts else None) for w in _words(batch, 1)]
            yield _batch({"key": batch.column(0), "class": pa.array([o[0] for o in own], pa.binary()), "brief": pa.array([o[1] for o in own], pa.int64()),
                          "n": pa.array([o[2] for o in own], pa.int64()), "words": pa.array([o[3] for o in own], pa.binary())})

    return docs.mapInArrow(run, f"key {kind}, class binary, brief long, n long, words binary")


def anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(h, brief, at)``: anchors at cover positions, each hash once a text
    with its first position; a text once a task."""
    period = period_of(length)
    own, width = cover(period), length - period + 1

    def run(batches):
        import numpy as np
        roll, on, seen = Rolling(), np.zeros(period, bool), set()
        on[own] = True
        for batch in batches:
            hs, briefs, ats = [], [], []
            for words in _words(batch, 1):
                if len(words) < length:
                    continue
                brief = _class(words)[1]
                if brief in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(brief)
                at = np.flatnonzero(np.resize(on, len(words) - width + 1))
                h, first = np.unique(roll.windows(roll.prefixes(words), at, width, 0), return_index=True)
                hs.append(h.view(np.int64))
                briefs.append(np.full(len(h), brief))
                ats.append(at[first].astype(np.int32))
            if hs:
                yield _batch({"h": pa.array(np.concatenate(hs)), "brief": pa.array(np.concatenate(briefs)), "at": pa.array(np.concatenate(ats))})

    return docs.mapInArrow(run, "h long, brief long, at int")


def _around(roll: Rolling, prefixes, n: int, at, length: int):
    """Starts of the full windows that hold a shared anchor; ``at`` names the
    first place of each."""
    import numpy as np
    period = period_of(length)
    own, width = cover(period), length - period + 1
    on = np.zeros(period, bool)
    on[own] = True
    places = np.flatnonzero(np.resize(on, n - width + 1))
    h = roll.windows(prefixes, places, width, 0)
    shared = places[np.isin(h, roll.windows(prefixes, np.asarray(at), width, 0))]
    # a window [s, s + length) holds the anchor at a if a - period < s <= a
    step = np.zeros(n + 2, np.int32)
    np.add.at(step, np.maximum(shared - period + 1, 0), 1)
    np.add.at(step, np.minimum(shared, n - length) + 1, -1)
    return np.flatnonzero(np.cumsum(step)[:n - length + 1] > 0)


def windows(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(h1, h2, key, uid, at)`` of the full windows around shared anchors,
    each hash once a text with its first position."""
    def run(batches):
        import numpy as np
        roll = Rolling()
        for batch in batches:
            keys, uids = batch.column(0), np.asarray(batch.column(1))
            for i, words in enumerate(_words(batch, 2)):
                prefixes = roll.prefixes(words)
                at = _around(roll, prefixes, len(words), batch.column(3)[i].as_py(), length)
                h1, first = np.unique(roll.windows(prefixes, at, length, 0), return_index=True)
                at = at[first]
                for a in range(0, len(at), 1 << 20):
                    part = at[a:a + (1 << 20)]
                    yield _batch({"h1": pa.array(h1[a:a + (1 << 20)].view(np.int64)),
                                  "h2": pa.array(roll.windows(prefixes, part, length, 1).view(np.int64)),
                                  "key": keys.take(pa.array(np.full(len(part), i))), "uid": pa.array(np.full(len(part), uids[i])),
                                  "at": pa.array(part.astype(np.int32))})

    kind = dict(texts.dtypes)["key"]
    return texts.select("key", "uid", "words", "at").mapInArrow(run, f"h1 long, h2 long, key {kind}, uid long, at int")


def removed(texts: DataFrame, length: int, keep: bool) -> DataFrame:
    """``(class, n_removed, kept_class, kept)`` of texts with the first places
    of their repeated windows."""
    def run(batches):
        import numpy as np
        roll = Rolling()
        for batch in batches:
            out = []
            for i, words in enumerate(_words(batch, 1)):
                prefixes = roll.prefixes(words)
                all_ = np.arange(len(words) - length + 1)
                h = [roll.windows(prefixes, all_, length, k) for k in (0, 1)]
                first = np.asarray(batch.column(2)[i].as_py())
                hit = np.flatnonzero(np.isin(h[0], h[0][first]) & np.isin(h[1], h[1][first]))
                step = np.zeros(len(words) + 1, np.int32)
                np.add.at(step, hit, 1)
                np.add.at(step, hit + length, -1)
                gone = np.cumsum(step)[:-1] > 0
                kept = b" ".join(itertools.compress(words, ~gone))
                out.append((int(gone.sum()), hashlib.sha256(kept).digest(), kept if keep else None))
            yield _batch({"class": batch.column(0), "n_removed": pa.array([o[0] for o in out], pa.int64()),
                          "kept_class": pa.array([o[1] for o in out], pa.binary()), "kept": pa.array([o[2] for o in out], pa.binary())})

    return texts.select("class", "words", "at").mapInArrow(run, "class binary, n_removed long, kept_class binary, kept binary")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, texts: bool = False) -> DataFrame:
    """``(key, n_words, n_removed, kept_sha256)`` for each row, and with
    ``texts`` the kept words in a column ``kept``."""
    docs = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = dict(docs.dtypes)["key"]
    told = written(classes(docs, kind, texts), "substring-classes")
    reps = told.where((F.col("n") >= length) & F.col("key").isNotNull()).groupBy("class", "brief").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))

    marks = written(anchors(docs, length), "substring-marks")
    shared = written(marks.groupBy("h").agg(F.min("brief").alias("a"), F.max("brief").alias("b")).where("a <> b").select("h"), "substring-anchors")
    places = marks.join(shared, "h").groupBy("brief").agg(F.collect_set("at").alias("at"))
    asked = written(reps.join(places, "brief").select("class", F.col("rep").alias("key"), "at"), "substring-asked")

    only = small(asked.select("class"), asked.count(), BROADCAST_ROWS)
    again = classes(docs, kind, True).select("class", "words").join(only, "class", "left_semi").groupBy("class").agg(F.first("words").alias("words"))
    found = written(again.join(asked, "class").withColumn("uid", F.monotonically_increasing_id()), "substring-texts")

    grams = written(windows(found, length), "substring-windows")
    first = written(grams.groupBy("h1", "h2").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("h1", "h2", "a"), "substring-first")
    repeats = grams.join(first, ["h1", "h2"]).where("key > a").groupBy("uid").agg(F.collect_list("at").alias("at"))
    cut = removed(found.drop("at").join(repeats, "uid"), length, texts)

    verdict = written(reps.join(cut, "class", "left").where("copies > 1 or n_removed is not null").drop("brief", "copies"), "substring-verdict")
    later = F.col("key") > F.col("rep")
    own = (F.col("key") == F.col("rep")) & F.col("n_removed").isNotNull()
    out = told.join(verdict, "class", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_words"),
        F.when(later, F.col("n")).when(own, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(later, F.lit(_EMPTY)).when(own, F.col("kept_class")).otherwise(F.col("class")))).alias("kept_sha256"),
        F.when(later, F.lit(b"")).when(own, F.col("kept")).otherwise(F.col("words")).cast("string").alias("kept"))
    return out if texts else out.drop("kept")
