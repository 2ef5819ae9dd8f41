"""Hard-negative mining by Kronecker-packed products (operator 11).

Method.  A component x counts as floor(256 x); a row's score against an anchor
is the inner product of these integers.  In a task the rows of a block are
packed: for each component, every row's value, biased to be non-negative, gets
its own field of one wide integer.  The field is as wide as the largest sum
needs, so fields never carry into each other.  An anchor multiplies each of
its (biased) components with one wide integer and adds the products; the
fields of the sum, with the bias taken out, are the exact scores of the whole
block.

Anchors and rows are dealt by hash into blocks; a task takes one block of
anchors against one block of rows, so no label, vector or key can crowd a
task.  Two rounds: (1) within each task the rows of an anchor's own label
give their best few, which are merged to the anchor's positives; (2) the rows
of other labels are scored against the window of each positive, and each
task's best few are merged.  What leaves a task is a handful of rows an anchor.

Defined results.  Rows with a null label or vector, or a null or non-finite
component, take no part; a null id is never an anchor and comes last among
ties.  Vectors of different length are not compared; two empty vectors score 0.
Every row counts by itself: repeated rows are other rows (their own anchors,
each other's positives).  Scores are exact whatever the size of the
components; one beyond 64 bits is compared exactly and shown as the nearest
long.  Anchors without positives, and positives without negatives, give no
row; empty tables give empty results.  Only the id, vector and label columns
are read, so further columns may have any name.
"""

from __future__ import annotations

import bisect
import fractions
import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.common import written

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW_PCT, HIGH_PCT = 50, 95
ROW_BLOCK = 4096       # rows packed into one wide integer
ANCHOR_BLOCK = 16_384  # anchors that meet one block of rows in a task
_LONG = (-(1 << 63), (1 << 63) - 1)


def parse(df: DataFrame, key: Column, vector: Column, label: Column, anchor: Column) -> DataFrame:
    """``(uid, id, label, anchor, n, size, v)``: floor(256 x) of the ``n``
    components, each exact in ``size`` bytes (int16, int32 or float64; 0 for
    decimal texts of numbers beyond doubles)."""
    def run(batches):
        for batch in batches:
            out = [_floors(x.as_py()) for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(4)), pa.array([o and o[0] for o in out], pa.int32()),
                 pa.array([o and o[1] for o in out], pa.int32()), pa.array([o and o[2] for o in out], pa.binary())],
                names=["uid", "id", "label", "anchor", "n", "size", "v"])

    rows = df.select(F.monotonically_increasing_id().alias("uid"), key.cast("long").alias("id"), label.cast("long").alias("label"),
                     F.coalesce(anchor, F.lit(False)).alias("anchor"), vector.cast("array<double>").alias("x"))
    return (rows.where("label is not null and x is not null")
            .mapInArrow(run, "uid long, id long, label long, anchor boolean, n int, size int, v binary").where("v is not null"))


def _floors(x) -> tuple[int, int, bytes] | None:
    import numpy as np
    if any(c is None for c in x):
        return None
    a = np.array(x, np.float64)
    if not np.isfinite(a).all():
        return None
    if np.abs(a).max(initial=0) > 1e300:
        return len(a), 0, b",".join(str(math.floor(fractions.Fraction(c) * SCALE)).encode() for c in a.tolist())
    a = np.floor(a * SCALE)
    top = np.abs(a).max(initial=0)
    kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64
    return len(a), np.dtype(kind).itemsize, a.astype(kind).tobytes()


def integers(n: int, size: int, v: bytes):
    """Components of one row: int64 array, or Python integers where needed."""
    import numpy as np
    if not size:
        return np.array([int(c) for c in v.split(b",")], object)
    a = np.frombuffer(v, {2: np.int16, 4: np.int32, 8: np.float64}[size], n)
    return a.astype(np.int64) if np.abs(a).max(initial=0) < 2.0 ** 40 else np.array([int(c) for c in a.tolist()], object)


class Packed:
    """Rows whose components sit in the fields of one wide integer each."""

    def __init__(self, rows, top: int):
        """``rows``: equally long component arrays; ``top``: largest absolute
        component of any anchor."""
        import numpy as np
        self.count, self.dim, self.top = len(rows), len(rows[0]), top
        m = np.stack(rows)
        self.bias = -int(m.min(initial=0))
        m = m + self.bias
        self.sums = m.sum(1)                       # of the biased components
        most = self.dim * int(m.max(initial=0)) * 2 * top
        self.bytes = next((b for b in (4, 8) if most < 1 << (8 * b)), -(-max(1, most.bit_length()) // 8))
        if self.bytes <= 8 and m.dtype != object:
            kind = f"<u{self.bytes}"
            self.wide = [int.from_bytes(c.astype(kind).tobytes(), "little") for c in m.T]
        else:
            self.sums = np.array([sum(int(c) for c in r) for r in m], object)
            self.wide = [int.from_bytes(b"".join(int(c).to_bytes(self.bytes, "little") for c in col), "little") for col in m.T]

    def scores(self, anchor):
        """Exact inner products of ``anchor`` with every row."""
        import numpy as np
        total, lift = 0, self.top
        for a, w in zip(anchor.tolist(), self.wide):
            total += (a + lift) * w
        raw = total.to_bytes(self.count * self.bytes, "little")
        back = self.bias * sum(anchor.tolist())
        if self.bytes <= 8 and self.sums.dtype != object and abs(back) < 1 << 62:
            got = np.frombuffer(raw, f"<u{self.bytes}")
            if self.bytes == 4 or got.max(initial=0) < 1 << 62:
                return got.astype(np.int64) - lift * self.sums - back
        size = self.bytes
        return np.array([int.from_bytes(raw[i * size:(i + 1) * size], "little") - lift * int(s) - back
                         for i, s in enumerate(self.sums.tolist())], object)


def _order(ids, scores):
    """Order by score down, then id up (nulls last)."""
    import numpy as np
    if object in (scores.dtype, ids.dtype):
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i])), np.int64)
    return np.lexsort((ids, -scores))


def _blocks(group: pa.Table):
    """Anchors and rows of one task, by vector length."""
    rows = [(r["uid"], r["id"], r["label"], integers(r["n"], r["size"], r["v"]), r["role"], r["wanted"]) for r in group.to_pylist()]
    for n in {len(r[3]) for r in rows}:
        own = [r for r in rows if len(r[3]) == n]
        anchors = [r for r in own if r[4]]
        others = [r for r in own if not r[4]]
        if anchors and others:
            yield anchors, others


def _ids(rows):
    """Ids for ordering; a null is beyond every long."""
    import numpy as np
    if any(r[1] is None for r in rows):
        return np.array([float("inf") if r[1] is None else r[1] for r in rows], object)
    return np.array([r[1] for r in rows], np.int64)


def _top(anchors) -> int:
    return max((abs(int(c)) for a in anchors for c in ((a[3].max(), a[3].min()) if len(a[3]) else ())), default=0)


def _best_of_label(positives: int):
    """Each anchor's best rows of its own label in this block of rows."""
    def run(group: pa.Table) -> pa.Table:
        import numpy as np
        found = []
        for anchors, rows in _blocks(group):
            top = _top(anchors)
            by_label = defaultdict(lambda: ([], []))
            for side, members in enumerate((anchors, rows)):
                for r in members:
                    by_label[r[2]][side].append(r)
            for own, same in by_label.values():
                if not own or not same:
                    continue
                packed, ids = Packed([r[3] for r in same], top), _ids(same)
                uids = np.array([r[0] for r in same], np.int64)
                for a in own:
                    s = packed.scores(a[3])
                    keep = np.flatnonzero(uids != a[0])
                    if len(keep) > positives and s.dtype != object:
                        keep = keep[s[keep] >= np.partition(s[keep], len(keep) - positives)[len(keep) - positives]]
                    for i in keep[_order(ids[keep], s[keep])[:positives]].tolist():
                        found.append((a[0], same[i][0], same[i][1], str(s[i])))
        uid, pos, pid, score = zip(*found) if found else ((),) * 4
        return pa.table({"uid": pa.array(uid, pa.int64()), "positive": pa.array(pos, pa.int64()),
                         "positive_id": pa.array(pid, pa.int64()), "score": pa.array(score, pa.string())})
    return run


def _best_in_window(negatives: int, low: int, high: int):
    """For each anchor and wanted positive, this block's best rows of other
    labels within the positive's score window."""
    def run(group: pa.Table) -> pa.Table:
        import numpy as np
        found = []
        for anchors, rows in _blocks(group):
            packed, ids = Packed([r[3] for r in rows], _top(anchors)), _ids(rows)
            labels = np.array([r[2] for r in rows], np.int64)
            for a in anchors:
                scores = {w["positive"]: int(w["score"]) for w in a[5]}
                windows = {p: (-(-low * s // 100), high * s // 100) for p, s in scores.items()}
                windows = {p: w for p, w in windows.items() if w[0] <= w[1]}
                if not windows:
                    continue
                s = packed.scores(a[3])
                floor, ceil = min(w[0] for w in windows.values()), max(w[1] for w in windows.values())
                keep = np.flatnonzero((s >= floor) & (s <= ceil) & (labels != a[2]))
                keep = keep[_order(ids[keep], s[keep])]
                down = (-s[keep]).tolist()
                for p, (lo, hi) in windows.items():
                    at = bisect.bisect_left(down, -hi)
                    for i in keep[at:at + negatives].tolist():
                        if s[i] >= lo:
                            found.append((a[0], p, rows[i][1], str(s[i])))
        uid, pos, nid, score = zip(*found) if found else ((),) * 4
        return pa.table({"uid": pa.array(uid, pa.int64()), "positive": pa.array(pos, pa.int64()),
                         "negative_id": pa.array(nid, pa.int64()), "score": pa.array(score, pa.string())})
    return run


def _grid(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int) -> DataFrame:
    """Rows and anchors by (block of anchors, block of rows)."""
    mix = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("ab")
    kind = "array<struct<positive:bigint,score:string>>"
    left = rows.select(others, mix(row_blocks).alias("rb"), "uid", "id", "label", "n", "size", "v", F.lit(False).alias("role"), F.lit(None).cast(kind).alias("wanted"))
    others = F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb")
    right = anchors.select(mix(anchor_blocks).alias("ab"), others, "uid", "id", "label", "n", "size", "v", F.lit(True).alias("role"), F.col("wanted").cast(kind))
    return left.unionByName(right).groupBy("ab", "rb")


def _highest(score: str) -> list[Column]:
    """Descending order of whole numbers in texts, however long."""
    c = F.col(score)
    minus = c.startswith("-")
    return [F.when(minus, -F.length(c)).otherwise(F.length(c)).desc(), F.when(~minus, c).desc(), F.when(minus, c).asc()]


def _long(score: str) -> Column:
    return F.coalesce(F.col(score).try_cast("long"), F.when(F.col(score).startswith("-"), F.lit(_LONG[0])).otherwise(F.lit(_LONG[1])))


def mine(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
         anchor: str | Column = "vec_id % 50 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW_PCT, high: int = HIGH_PCT, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)``: for each row that ``anchor`` names and each of its
    ``positives`` best other rows of the same label, the best ``negatives``
    rows of other labels with a score of ``low`` to ``high`` per cent of the
    positive's."""
    anchor = F.expr(anchor) if isinstance(anchor, str) else anchor
    label = F.col(label) if isinstance(label, str) else label
    rows = written(parse(df, F.col(key), F.col(vector), label, anchor), "hardneg-rows")
    size = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).first()
    row_blocks, anchor_blocks = max(1, -(-size.n // row_block)), max(1, -(-size.a // anchor_block))
    anchors = rows.where("anchor")

    none = anchors.withColumn("wanted", F.lit(None))
    near = _grid(rows, none, row_blocks, anchor_blocks).applyInArrow(
        _best_of_label(positives), "uid long, positive long, positive_id long, score string")
    best = Window.partitionBy("uid").orderBy(*_highest("score"), F.col("positive_id").asc_nulls_last(), "positive")
    chosen = written(near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives), "hardneg-positives")
    wanted = chosen.groupBy("uid").agg(F.collect_list(F.struct("positive", "score")).alias("wanted"))

    asked = anchors.join(wanted, "uid")
    far = _grid(rows, asked, row_blocks, anchor_blocks).applyInArrow(
        _best_in_window(negatives, low, high), "uid long, positive long, negative_id long, score string")
    best = Window.partitionBy("uid", "positive").orderBy(*_highest("score"), F.col("negative_id").asc_nulls_last())
    ranked = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    pos = chosen.select("uid", "positive", "positive_id", _long("score").alias("positive_score"))
    return (ranked.withColumn("negative_score", _long("score")).join(pos, ["uid", "positive"])
            .join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
