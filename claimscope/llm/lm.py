"""Stupid-backoff language-model scores, computed relationally (operator 1).

Model.  Words are split at ASCII white space, A-Z lower-cased, and every word
keeps its own count.  A caller who passes ``bits`` asks for a bounded
vocabulary instead: the words with ``2 ** -bits`` of all tokens and two
occurrences, the others counted together as the unknown word.
n-grams seen ``min_count`` times or more score ``log c(n-gram) - log
c(prefix)``, others back off to the shorter n-gram at ``log ALPHA``; the
unigram score is ``log c(word) - log N``.  All counts are over all documents.

Method.  The score is additive: a document's score is the sum of its tokens'
scores backed off all the way to the unigram plus, for each n-gram that is in
the count table, the difference v between its own score and the backed-off
one:

    v = log c(g) - log c(prefix) - log ALPHA - log c(suffix) + log c(middle)

(a known n-gram has a known suffix).  So every order is one join of the
exploded n-grams with a count table, summed per document:

1. word counts: map-side sums, then an aggregate on the word's hash;
2. n-gram counts: map-side sums, dealt to hash buckets, summed there; the
   counts of their words come by a join on the word's hash;
3. words and n-grams with ``2 ** -VOCAB_BITS`` of all tokens or more (at most
   ``2 ** VOCAB_BITS``) are broadcast and summed where the document is read,
   so a hot one never meets in one bucket;
4. the rest of the words and exploded n-grams go to their bucket, are joined
   to its count table there, and partial sums per document come back.

A broadcast word is known by its place in the broadcast, any other by a 63-bit
hash.  Two broadcast words side by side are known by their two places, any
other n-gram by a 62-bit hash; two of a billion hashes meet with a probability
of some per cent, and then share a count.

n-grams travel as packed arrays (one row for a bucket and a few thousand
documents): sorted, as differences, byte by byte and compressed, which takes 5
to 8 bytes an n-gram.  Sums are in billionths of a nat as integers, so their
order does not matter.

Defined results.  Null, empty and wordless texts have no tokens, score 0 and
a null mean.  Repeated rows are scored one by one (and counted one by one).
Empty tables give empty results.  Ids of any type, null too, pass through;
only the id and text columns are read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import written

ORDER = 2             # production order; 3 is supported
MIN_COUNT = 2         # n-grams (n > 1) seen less often back off
ALPHA = 0.4
VOCAB_BITS = 20
UNIT = 10 ** 9         # integer parts of a nat
FLUSH = 1_000_000     # tokens packed together in a task
PER_BUCKET = 1_000_000  # tokens a bucket is made for
MEMO_WORDS = 400_000
RARE_MEMO = 100_000   # words that are not broadcast and yet memoised by a task
_MIX = 0x9E3779B97F4A7C15
_TOP = 1 << 63         # set in the hash of a word and the key of an n-gram: as a long it is negative
_HASHED = 1 << 62      # set in an n-gram's key unless it holds the places of two broadcast words
_PLACE = 21            # bits of a place, 1 to 2 ** VOCAB_BITS


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(h, c)``: count of each word by its 64-bit hash, summed map-side."""
    def run(batches):
        import numpy as np
        import xxhash
        own: Counter = Counter()

        def rows():
            h = np.fromiter((xxhash.xxh64_intdigest(w) | _TOP for w in own), np.uint64, len(own))
            out = pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(list(own.values()), pa.int64())], names=["h", "c"])
            own.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                own.update(_words(t.as_py()))
                if len(own) >= MEMO_WORDS:
                    yield rows()
        yield rows()

    return df.select(F.col(text).cast("binary")).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Sorted hashes of the broadcast words; word id = place + 1.  Any other
    word is its own hash or, if the vocabulary is bounded, 0, the unknown word."""

    def __init__(self, hashes, counts, total: int, bounded: bool):
        import numpy as np
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        # Without an unknown word id 0 stands for words summed elsewhere: log 1.
        self.counts = np.concatenate([[max(1, total - int(counts.sum())) if bounded else max(1, total)], counts[order]])
        self.total, self.bounded = total, bounded

    def logs(self):
        import numpy as np
        return np.log(self.counts)

    def unigram_units(self):
        import numpy as np
        return np.rint((self.logs() - np.log(max(1, self.total))) * UNIT).astype(np.int64)


class WordIds(dict):
    """word -> id.  Broadcast words are memoised (at most as many as there
    are), and some of the others at a time."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        import numpy as np
        import xxhash
        self.hash, self.np, self.bounded = xxhash.xxh64_intdigest, np, vocab.bounded
        self.ids = dict(zip(vocab.hashes.view(np.uint64).tolist(), range(1, len(vocab.hashes) + 1)))

    def __missing__(self, word: bytes) -> int:
        h = self.hash(word) | _TOP
        out = self.ids.get(h, 0)
        if not out:
            if self.bounded:
                return 0
            out = h - (1 << 64)
            if len(self) > len(self.ids) + RARE_MEMO:
                self.clear()
        self[word] = out
        return out

    def of(self, text: bytes | None):
        words = _words(text)
        return self.np.fromiter(map(self.__getitem__, words), self.np.int64, len(words))


def vocabulary(counts: DataFrame, bits: int | None = None) -> Vocabulary:
    import numpy as np
    total = counts.agg(F.sum("c")).first()[0] or 0
    kept = counts.where(F.col("c") >= _hot(total, bits)).toArrow()  # at most 2^bits rows
    return Vocabulary(kept.column("h").to_numpy().astype(np.int64), kept.column("c").to_numpy().astype(np.int64), total, bits is not None)


def _hot(total: int, bits: int | None) -> int:
    """Occurrences from which on a word or n-gram is broadcast."""
    return max(2, -(-total // (1 << (VOCAB_BITS if bits is None else bits))))


def _key(ids):
    """Keys of n-grams given as a list of their id arrays."""
    import numpy as np
    if len(ids) == 2:
        a, b = (x.astype(np.int64) for x in ids)
        places = ((a << _PLACE) | b).view(np.uint64) | np.uint64(_TOP)
        return np.where((a >= 0) & (b >= 0), places.view(np.int64), _hash(ids))
    return _hash(ids)


def _hash(ids):
    import numpy as np
    with np.errstate(over="ignore"):
        x = ids[0].astype(np.int64).view(np.uint64) + np.uint64(len(ids) << 40)  # 0 alone would stay 0
        for y in ids[1:]:
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX) + y.astype(np.int64).view(np.uint64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) | np.uint64(_TOP | _HASHED)).view(np.int64)


def _ngrams(ids, doc, order: int):
    """Keys of the n-grams inside documents, and the place of each one's first
    word; ``ids`` and ``doc`` are the tokens of several documents in a row."""
    import numpy as np
    n = len(ids) - order + 1
    if n <= 0:
        return ids[:0], np.arange(0)
    at = np.flatnonzero(doc[:n] == doc[order - 1:])
    return _key([ids[at + k] for k in range(order)]), at


def _bucket(key, buckets: int):
    import numpy as np
    return ((key.astype(np.uint64) * np.uint64(_MIX)) >> np.uint64(33)) % np.uint64(buckets)


def _flushes(batches, words: WordIds, flush: int):
    """Token ids and rows of several documents at a time: ``(keys, lengths,
    ids)`` with about ``flush`` tokens."""
    import numpy as np
    keys, parts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            ids = words.of(text.as_py())
            keys.append(key)
            parts.append(ids)
            held += len(ids)
            if held >= flush:
                yield keys, np.array([len(p) for p in parts]), np.concatenate(parts)
                keys, parts, held = [], [], 0
    if keys:
        yield keys, np.array([len(p) for p in parts]), np.concatenate(parts)


class Ints:
    """Packs arrays of longs: signs folded into the lowest bit, only the bytes
    that the largest needs, lowest bytes of all first, compressed."""

    def __init__(self):
        import zstandard
        self.pack, self.unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress

    def dumps(self, x) -> bytes:
        import numpy as np
        x = np.ascontiguousarray(x, "<i8")
        u = ((x << 1) ^ (x >> 63)).view("<u8")
        width = max(1, -(-int(u.max()).bit_length() // 8)) if len(u) else 1
        return bytes([width]) + self.pack(u.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())

    def loads(self, packed: bytes):
        import numpy as np
        width = packed[0]
        planes = np.frombuffer(self.unpack(packed[1:]), np.uint8).reshape(width, -1)
        out = np.zeros((planes.shape[1], 8), np.uint8)
        out[:, :width] = planes.T
        u = out.reshape(-1).view("<u8")
        return ((u >> np.uint64(1)) ^ (np.uint64(0) - (u & np.uint64(1)))).view("<i8")

    def dumps_rising(self, x) -> bytes:
        return self.dumps(_steps(x))

    def loads_rising(self, packed: bytes):
        import numpy as np
        return np.cumsum(self.loads(packed))


def _steps(x):
    """Differences, wrapping around; ``cumsum`` undoes them."""
    import numpy as np
    return np.diff(x, prepend=np.zeros(1, x.dtype)) if len(x) else x


def _by_bucket(bucket, buckets: int):
    """Each bucket present and the places of its rows, in their order."""
    import numpy as np
    at = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    names, starts = np.unique(bucket[at], return_index=True)
    return [(int(b), at[s:e]) for b, s, e in zip(names, starts, np.append(starts[1:], len(at)))]


def _packed(o, bucket, buckets, ids, counts, ints: Ints):
    """Rows of n-grams (``ids``: one array a position) by bucket."""
    import numpy as np
    names, keys, numbers = [], [], []
    for b, own in _by_bucket(bucket, buckets):
        names.append(b)
        keys.append(ints.dumps(np.concatenate([_steps(ids[0][own]), *(x[own] for x in ids[1:])])))
        numbers.append(ints.dumps(counts[own]))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(names), o), pa.int32()), pa.array(names, pa.int32()), pa.array(keys, pa.binary()), pa.array(numbers, pa.binary())],
        names=["ord", "bucket", "keys", "counts"])


def ngram_counts(df: DataFrame, vocab, order: int, buckets: int, text: str = "text", min_count: int = MIN_COUNT,
                 flush: int = FLUSH) -> DataFrame:
    """``(ord, bucket, key, c, pre, suf, mid)``: count table of each order
    from 2 on, with the keys of the prefix, the suffix and what they share."""
    def pack(batches):
        import numpy as np
        words, ints = WordIds(vocab.value), Ints()
        for _, lengths, ids in _flushes(batches, words, flush):
            doc = np.repeat(np.arange(len(lengths)), lengths)
            for o in range(2, order + 1):
                key, at = _ngrams(ids, doc, o)
                key, first, c = np.unique(key, return_index=True, return_counts=True)
                # Keys of two places rise with the first; the others are put in the order of their first word.
                hashed = np.flatnonzero(key.view(np.uint64) & np.uint64(_HASHED))
                if len(hashed):
                    at_hash = first[hashed]
                    srt = np.argsort(ids[at[at_hash]])
                    first[hashed], key[hashed], c[hashed] = at_hash[srt], key[hashed][srt], c[hashed][srt]
                yield _packed(o, _bucket(key, buckets), buckets, [ids[at[first] + k] for k in range(o)], c, ints)

    def add(group: pa.Table) -> pa.Table:
        import numpy as np
        o, ints = group.column("ord")[0].as_py(), Ints()
        parts = [ints.loads(x.as_py()).reshape(o, -1) for x in group.column("keys")]
        for part in parts:
            part[0] = np.cumsum(part[0])
        ids = np.concatenate(parts, 1).T
        del parts
        c = np.concatenate([ints.loads(x.as_py()) for x in group.column("counts")])
        key = _key([ids[:, k] for k in range(o)])
        at = np.argsort(key)
        key, starts = np.unique(key[at], return_index=True)
        c = np.add.reduceat(c[at], starts) if len(key) else c
        ok = c >= min_count
        n = int(ok.sum())
        ids = ids[at[starts[ok]]]
        if o == 2:
            pre, suf, mid = ids[:, 0], ids[:, 1], np.zeros(n, np.int64)
        else:
            pre, suf, mid = _key([ids[:, 0], ids[:, 1]]), _key([ids[:, 1], ids[:, 2]]), ids[:, 1]
        return pa.table({"ord": pa.array([o] * n, pa.int32()),
                         "bucket": pa.array([group.column("bucket")[0].as_py()] * n, pa.int32()),
                         "key": pa.array(key[ok]), "c": pa.array(c[ok]), "pre": pa.array(pre), "suf": pa.array(suf), "mid": pa.array(mid)})

    packed = (df.select(F.lit(None).cast("int").alias("k"), F.col(text).cast("binary").alias("t"))
              .mapInArrow(pack, "ord int, bucket int, keys binary, counts binary"))
    return packed.groupBy("ord", "bucket").applyInArrow(add, "ord int, bucket int, key long, c long, pre long, suf long, mid long")


def values(counts: DataFrame, words: DataFrame, vocab, order: int, buckets: int) -> DataFrame:
    """``(ord, bucket, key, c, v)``: what each known n-gram adds to the score
    of a document that backs off, and the unigram score of each word that is
    not broadcast (order 1)."""
    def run(batches):
        import numpy as np
        logs, total = vocab.value.logs(), np.log(max(1, vocab.value.total))
        for batch in batches:
            o, key, c = (np.asarray(batch.column(i)) for i in (0, 2, 3))
            # A word that is broadcast has its count at hand, the others' and
            # the n-grams' counts were joined.
            lp, ls, mid = (np.where(i >= 0, logs[np.maximum(i, 0)], np.log(np.maximum(n, 1))) for i, n in (
                (np.asarray(batch.column(k)), np.asarray(batch.column(k + 3))) for k in (4, 5, 6)))
            mid = np.where(o == 2, total, mid)  # the empty middle counts N
            v = np.rint((np.log(c) - lp - np.log(ALPHA) - ls + mid) * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(v)],
                                             names=["ord", "bucket", "key", "c", "v"])

    def alone(batches):
        import numpy as np
        total = np.log(max(1, vocab.value.total))
        for batch in batches:
            key, c = (np.asarray(x) for x in batch.columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(key), np.int32)), pa.array(_bucket(key, buckets).astype(np.int32)), *batch.columns,
                 pa.array(np.rint((np.log(c) - total) * UNIT).astype(np.int64))], names=["ord", "bucket", "key", "c", "v"])

    schema, bounded = "ord int, bucket int, key long, c long, v long", vocab.value.bounded
    known = words.limit(0) if bounded else words
    if order >= 3:
        known = known.union(counts.where("ord = 2").select("key", "c"))
    rows = counts
    for x in ("pre", "suf", "mid"):
        if (bounded and order == 2) or (x == "mid" and (bounded or order == 2)):
            rows = rows.withColumn(f"c_{x}", F.lit(0).cast("long"))
            continue
        # Only rows that ask for a count are shuffled.
        have = known.select(F.col(known.columns[0]).alias(x), F.col("c").alias(f"c_{x}"))
        asking = rows.where(F.col(x) < 0).join(have, x, "left").withColumn(f"c_{x}", F.coalesce(f"c_{x}", F.lit(0).cast("long")))
        rows = rows.where(F.col(x) >= 0).withColumn(f"c_{x}", F.lit(0).cast("long")).unionByName(asking)
    out = rows.select("ord", "bucket", "key", "c", "pre", "suf", "mid", "c_pre", "c_suf", "c_mid").mapInArrow(run, schema)
    return out if bounded else out.union(words.mapInArrow(alone, schema))


def score(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER,
          min_count: int = MIN_COUNT, bits: int | None = None, per_bucket: int = PER_BUCKET, flush_tokens: int = FLUSH) -> DataFrame:
    """``(key, n_tokens, logprob, mean_logprob)`` for each row; natural logs.
    ``bits`` bounds the vocabulary and the broadcast n-grams (without it every
    word counts), the other two set the size of a bucket and of a pack."""
    import numpy as np
    if not 1 <= order <= 3 or min_count < 1 or not (bits is None or 1 <= bits <= 20):
        raise ValueError("order is 1 to 3, min_count at least 1, bits 1 to 20")
    sc = df.sparkSession.sparkContext
    counted = written(word_counts(df, text), "lm-words")
    vocab = vocabulary(counted, bits)
    limit = _hot(vocab.total, bits)
    shared = sc.broadcast(vocab)
    buckets = max(1, -(-vocab.total // per_bucket))
    grams = written(ngram_counts(df, shared, order, buckets, text, min_count, flush_tokens), "lm-counts")
    known = written(values(grams, counted.where(F.col("c") < limit), shared, order, buckets), "lm-values")
    hot = known.where(F.col("c") >= limit).select("ord", "key", "v").toArrow()
    by_order = {}
    for o in range(2, order + 1):
        mine = hot.column("ord").to_numpy() == o
        k, v = hot.column("key").to_numpy()[mine], hot.column("v").to_numpy()[mine]
        at = np.argsort(k)
        by_order[o] = (k[at], v[at])
    table = sc.broadcast(by_order)
    kind = dict(df.dtypes)[key]

    def explode(batches):
        words, uni, flush = WordIds(shared.value), shared.value.unigram_units(), TaskContext.get().partitionId() << 32
        ints = Ints()
        for keys, lengths, ids in _flushes(batches, words, flush_tokens):
            n, flush = len(keys), flush + 1
            doc = np.repeat(np.arange(n), lengths)
            short = np.minimum(lengths, order - 1)  # tokens with fewer words before them
            steps = short * (short - 1) // 2 + (lengths - short) * (order - 1)
            local = _sum_by(doc, uni[np.maximum(ids, 0)], n) + steps * round(float(np.log(ALPHA)) * UNIT)
            packs = []
            for o in range(1, order + 1):
                if o == 1:
                    rare = np.flatnonzero(ids < 0)
                    grams, at = ids[rare], doc[rare]
                else:
                    grams, at = _ngrams(ids, doc, o)
                    at, (hot_k, hot_v) = doc[at], table.value[o]
                    if len(hot_k):
                        place = np.minimum(np.searchsorted(hot_k, grams), len(hot_k) - 1)
                        is_hot = hot_k[place] == grams
                        local += _sum_by(at[is_hot], hot_v[place[is_hot]], n)
                        grams, at = grams[~is_hot], at[~is_hot]
                srt = np.argsort(grams)
                grams, at = grams[srt], at[srt]
                for name, own in _by_bucket(_bucket(grams, buckets), buckets):
                    packs.append((name, ints.dumps(at[own]), ints.dumps_rising(grams[own])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([flush % buckets] * n, pa.int32()), pa.array([flush] * n, pa.int64()), pa.array(np.arange(n)), _as_array(keys),
                 pa.array(lengths.astype(np.int64)), pa.array(local), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
                names=["bucket", *sums_names])
            if packs:
                names, docs, grams = zip(*packs)
                m = len(packs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int32()), pa.array([flush] * m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, keys[0].type),
                     pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(docs, pa.binary()), pa.array(grams, pa.binary())],
                    names=["bucket", *sums_names])

    def look_up(asked: pa.Table, have: pa.Table) -> pa.Table:
        """Documents' rows as they are; for each packed row the sums of its
        documents, packed again."""
        is_doc = pa.compute.is_valid(asked.column("n"))
        plain, packed = asked.filter(is_doc), asked.filter(pa.compute.invert(is_doc))
        if not packed.num_rows or not have.num_rows:
            return plain.select(sums_names)
        keys = have.column("key").to_numpy()
        at = np.argsort(keys)
        keys, vals = keys[at], np.asarray(have.column("v"))[at]
        docs, sums, ints = [], [], Ints()
        for own, grams in zip(packed.column("docs"), packed.column("grams")):
            grams = ints.loads_rising(grams.as_py())
            place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == grams)
            row, inv = np.unique(ints.loads(own.as_py())[hit], return_inverse=True)
            docs.append(ints.dumps_rising(row))
            sums.append(ints.dumps(_sum_by(inv, vals[place[hit]], len(row))))
        m = len(docs)
        back = pa.table({"flush": packed.column("flush"), "row": pa.nulls(m, pa.int64()), "k": pa.nulls(m, plain.schema.field("k").type),
                         "n": pa.nulls(m, pa.int64()), "s": pa.nulls(m, pa.int64()), "docs": pa.array(docs, pa.binary()),
                         "grams": pa.array(sums, pa.binary())})
        return pa.concat_tables([plain.select(sums_names), back])

    def add_up(group: pa.Table) -> pa.Table:
        """One flush: its documents with all their partial sums."""
        is_doc = pa.compute.is_valid(group.column("n"))
        plain, packed = group.filter(is_doc), group.filter(pa.compute.invert(is_doc))
        s, ints = plain.column("s").to_numpy().copy(), Ints()
        place = np.empty(len(s), np.int64)
        place[np.asarray(plain.column("row"))] = np.arange(len(s))
        for own, part in zip(packed.column("docs"), packed.column("grams")):
            s[place[ints.loads_rising(own.as_py())]] += ints.loads(part.as_py())
        return pa.table({"k": plain.column("k"), "n_tokens": plain.column("n"), "s": pa.array(s)})

    sums_names = ["flush", "row", "k", "n", "s", "docs", "grams"]
    asked = df.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).mapInArrow(
        explode, f"bucket int, flush long, row long, k {kind}, n long, s long, docs binary, grams binary")
    have = known.where(F.col("c") < limit).select("bucket", "key", "v")
    sums = asked.groupBy("bucket").cogroup(have.groupBy("bucket")).applyInArrow(
        look_up, f"flush long, row long, k {kind}, n long, s long, docs binary, grams binary")
    out = sums.groupBy("flush").applyInArrow(add_up, f"k {kind}, n_tokens long, s long")
    logprob = F.col("s") / F.lit(float(UNIT))
    return out.select(F.col("k").alias(key), "n_tokens", logprob.alias("logprob"),
                      F.when(F.col("n_tokens") > 0, logprob / F.col("n_tokens")).alias("mean_logprob"))


def _sum_by(group, value, n: int):
    """Integer sums per group (exact, unlike a weighted bincount)."""
    import numpy as np
    out = np.zeros(n, np.int64)
    if len(group):
        at = np.argsort(group, kind="stable") if (np.diff(group) < 0).any() else slice(None)
        g, v = group[at], value[at]
        starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        out[g[starts]] = np.add.reduceat(v, starts)
    return out


def _as_array(scalars):
    return pa.array([x.as_py() for x in scalars], scalars[0].type)
