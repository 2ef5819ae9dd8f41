"""Language identification by averaged hashed subword embeddings
(operator 4).

Method.  A text's words (runs of letters, lower case, with boundary marks)
give character n-grams of 1 to 4 and the word itself, each hashed to one of
``BUCKETS`` rows of an embedding table.  The mean embedding of all subwords
of the text goes through a linear softmax over the languages.  Both layers are
trained by stochastic gradient descent in numpy on a bounded sample of labelled
rows: ``PER_LANG`` for each language, chosen by hash of id and text (rows equal
in both count once), ``SAMPLE_ROWS`` and ``SAMPLE_CELLS`` distinct subwords of
rows in all; so at most ``SAMPLE_ROWS`` languages, the most frequent ones, are
learned.

A held-back quarter of the sample calibrates.  A temperature makes the scores
honest.  A text is rejected by two measures:

* its share of subwords that the training rows hold (``SMOOTH`` known ones
  added, so that a few odd words do not reject a short text).  The bound is set
  by texts that must go: each language in turn is left out of the vocabulary,
  and the least share that rejects ``CAUGHT`` of the left-out texts is taken.
  It is lowered where needed so that texts of learned languages stay: they may
  have ``SLACK`` times as many unknown subwords as the worst calibration text
  but ``MAX_LOST`` of them.
* its score: the smallest from which on at most ``MAX_ERROR`` of the accepted
  calibration texts are wrong.

Prediction reads every whole text.  As both layers are linear, a subword's
row times the output matrix is its share of the logits; the sum over a word's
subwords is memoised per Python worker (bounded).

Defined results.  Null, empty and letterless texts are ``und`` with score 0
and rejected.  Without any labelled row nothing is learned: all texts are
``und``, score 0, and rejected.  With one learned language no text can be left
out, and with fewer than four sampled rows none is held back: then the share of
known subwords rejects nothing.  Null labels are never learned.  Ties go to
the language that sorts first.  Only the id, text and label columns are read.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import written

BUCKETS = 1 << 18
DIM = 16
NGRAMS = (1, 2, 3, 4)
PER_LANG = 400        # labelled rows per language for the fit and calibration ...
SAMPLE_ROWS = 8000    # ... and of all languages together
SAMPLE_CELLS = 16_000_000  # and distinct subwords of all these rows
EPOCHS, RATE = 12, 0.5
MAX_ERROR = 0.05
CAUGHT, MAX_LOST, SLACK, SMOOTH = 0.95, 0.005, 1.5, 8
UND = "und"
MEMO_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+")
_SEED = 42


class _Grams(dict):
    """n-gram -> CRC-32, for the short n-grams that most words share."""

    def __missing__(self, gram: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        h = self[gram] = zlib.crc32(gram.encode())
        return h


_GRAMS = _Grams()


def subwords(word: str, buckets: int = BUCKETS) -> list[int]:
    """Hash buckets of the n-grams of one lower-case word and the word."""
    w, seen = f"<{word}>", _GRAMS
    hashes = [seen[w[i:i + n]] for n in NGRAMS for i in range(len(w) - n + 1)]
    hashes.append(zlib.crc32(w.encode()))
    return [h % buckets for h in hashes]


def held_out(key: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text mod 5 = 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """Trained embedding and output matrix with temperature, least score,
    the buckets of the training rows (None: all) and the least share of them."""

    def __init__(self, langs, emb, out, bias, temperature=1.0, threshold=0.0, seen=None, min_known=0.0):
        self.langs, self.emb, self.out, self.bias = langs, emb, out, bias
        self.temperature, self.threshold = temperature, threshold
        self.seen, self.min_known = seen, min_known

    def predictor(self):
        return Predictor(self)


class Predictor(dict):
    """word -> row of the logit table; the rows grow with new words."""

    def __init__(self, model: Model):
        import numpy as np
        super().__init__()
        self.model = model
        self.table = (model.emb @ model.out).astype(np.float64)
        self.k = len(model.langs)
        seen = np.ones(len(self.table), bool) if model.seen is None else model.seen
        self.table = np.column_stack([self.table, seen, np.ones(len(self.table))])
        self._reset()

    def _reset(self):
        import numpy as np
        self.clear()
        self.rows = np.zeros((1024, self.k + 2))

    def __missing__(self, word: str) -> int:
        import numpy as np
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        if any(map(str.isalpha, word)):  # numerals such as a half or a superscript are no letters
            g = subwords(word, len(self.table))
            np.add.reduce(self.table.take(g, 0), 0, out=self.rows[at])
        self[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score of a text."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the text is rejected."""
        import numpy as np
        words = _WORD.findall(text.lower()) if text else []
        if not words or not self.k:
            return UND, 0.0, True
        total = np.zeros(self.k + 2)
        for at in range(0, len(words), 100_000):  # bounds the memo and the index array
            if len(self) > MEMO_WORDS:
                self._reset()
            idx = np.fromiter(map(self.__getitem__, words[at:at + 100_000]), np.int64)
            total += np.bincount(idx, minlength=len(self)).astype(float) @ self.rows[:len(self)] \
                if len(idx) > len(self) // 4 else self.rows[idx].sum(0)
        if not total[-1]:
            return UND, 0.0, True
        z = (total[:-2] / total[-1] + self.model.bias) / self.model.temperature
        e = np.exp(z - z.max())
        best = int(np.argmax(e))
        score = float(e[best] / e.sum())
        odd = _known(total[-2], total[-1]) < self.model.min_known
        return self.model.langs[best], score, bool(odd or score < self.model.threshold)


def _known(known: float, n: float) -> float:
    """Smoothed share of known subwords."""
    return (known + SMOOTH) / (n + SMOOTH)


def _sample(df: DataFrame, key: str, text: str, label: str, per_lang: int):
    """Bounded labelled sample as ``(label, buckets, counts)`` rows: per
    language the first ``per_lang`` by hash, within its part of the cells."""
    rows = df.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(label).cast("string").alias("label"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(SAMPLE_ROWS).collect()
    if not counts:
        return []
    per_lang = max(1, min(per_lang, SAMPLE_ROWS // len(counts)))
    share = df.sparkSession.createDataFrame(
        [(r.label, int(min(1.0, 1.3 * per_lang / r.n + 20 / r.n) * (1 << 30))) for r in counts], "label string, share long")
    dice = F.pmod(F.xxhash64("key", "text", F.lit(_SEED)), F.lit(1 << 30))
    # Rows equal in id and text throw the same dice: one of them is taken.
    picked = (rows.withColumn("dice", dice).join(F.broadcast(share), "label").where("dice < share")
              .groupBy("label", "dice").agg(F.min("text").alias("text")))

    def run(batches):
        import numpy as np
        for batch in batches:
            out = []
            for lab, dice_, t in zip(*(batch.column(i) for i in range(3))):
                n = np.bincount([b for w in _WORD.findall(t.as_py().lower()) for b in subwords(w)], minlength=1)
                top = np.flatnonzero(n)
                out.append((lab.as_py(), dice_.as_py(), len(top), top.astype("<i4").tobytes(), n[top].astype("<i4").tobytes()))
            cols = list(zip(*out)) if out else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], names=["label", "dice", "size", "buckets", "counts"])

    cells = written(picked.mapInArrow(run, "label string, dice long, size long, buckets binary, counts binary"), "langid-sample")
    room, taken, chosen = SAMPLE_CELLS // len(counts), {}, set()
    for r in cells.where("size > 0").select("label", "dice", "size").orderBy("dice", "label").collect():
        n, size = taken.get(r.label, (0, 0))
        if n < per_lang and (n == 0 or size + r.size <= room):
            taken[r.label] = (n + 1, size + r.size)
            chosen.add((r.label, r.dice))
    got = cells.where(F.col("dice").isin(sorted({d for _, d in chosen}))).collect()
    return [(r.label, r.buckets, r.counts) for r in sorted(got, key=lambda r: (r.dice, r.label)) if (r.label, r.dice) in chosen]


def train(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang",
          per_lang: int = PER_LANG) -> Model:
    """Fit on labelled rows of ``df`` (the caller leaves out held-out rows)."""
    import numpy as np
    sample = _sample(df, key, text, label, per_lang)
    langs = sorted({lab for lab, _, _ in sample})
    k = len(langs)
    emb, out, bias = np.zeros((BUCKETS, DIM)), np.zeros((DIM, k)), np.zeros(k)
    if not k:
        return Model([], emb, out, bias)
    rng = np.random.default_rng(_SEED)
    out = rng.normal(0, 1 / np.sqrt(DIM), (DIM, k))
    data = [(langs.index(lab), np.frombuffer(b, "<i4"), np.frombuffer(c, "<i4").astype(float)) for lab, b, c in sample]
    hold = [x for i, x in enumerate(data) if i % 4 == 3] or data
    fit = [x for i, x in enumerate(data) if i % 4 != 3] or data
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(fit)):
            y, b, n = fit[i]
            c = n / n.sum()
            h = c @ emb[b]
            p = _softmax(h @ out + bias)
            p[y] -= 1
            # Each row moves by its share of the text, scaled up so that rare
            # subwords move at all.
            emb[b] -= rate * np.minimum(c * len(b), 4.0)[:, None] * (out @ p)[None, :]
            out -= rate * np.outer(h, p)
            bias -= 0.01 * rate * p
    model = Model(langs, emb.astype(np.float32), out.astype(np.float32), bias)
    model.seen = np.zeros(BUCKETS, bool)
    for _, b, _ in fit:
        model.seen[b] = True
    z = np.array([(n / n.sum() @ emb[b]) @ out + bias for _, b, n in hold])
    y = np.array([y for y, _, _ in hold])
    grid = 2.0 ** np.arange(-4, 6.01, 0.25)
    loss = [-np.mean(np.log(np.maximum([_softmax(r / t)[c] for r, c in zip(z, y)], 1e-12))) for t in grid]
    # The sharpest temperature among equally good ones would be overconfident.
    model.temperature = float(max(t for t, v in zip(grid, loss) if v <= min(loss) + 1e-3))
    probs = np.array([_softmax(r / model.temperature) for r in z])
    score, right = probs.max(1), probs.argmax(1) == y
    for t in np.unique(np.append(score, 0.0)):
        taken = score >= t
        model.threshold = float(t)
        if (~right[taken]).sum() <= MAX_ERROR * taken.sum():
            break
    if len(data) >= 4 and k > 1:
        model.min_known = _least_known(fit, hold, k)
    return model


def _least_known(fit, hold, k: int) -> float:
    """Bound on the share of known subwords that rejects left-out languages
    and keeps learned ones."""
    import numpy as np
    langs_of, own = np.zeros(BUCKETS, np.int32), []
    for lang in range(k):
        held = [b for y, b, _ in fit if y == lang]
        own.append(np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64))
        langs_of[own[-1]] += 1
    inside, outside = [], []
    for lang in range(k):
        langs_of[own[lang]] -= 1  # leave the language out
        texts = [(b, n) for y, b, n in hold if y == lang]
        outside += [_known((n * (langs_of[b] > 0)).sum(), n.sum()) for b, n in texts]
        langs_of[own[lang]] += 1
        inside += [_known((n * (langs_of[b] > 0)).sum(), n.sum()) for b, n in texts]
    kept = 1 - SLACK * (1 - np.quantile(inside, MAX_LOST, method="lower"))
    caught = np.nextafter(np.quantile(outside, CAUGHT, method="higher"), 2)
    return float(max(0.0, min(kept, caught)))


def _softmax(z):
    import numpy as np
    e = np.exp(z - z.max())
    return e / e.sum()


_PREDICTORS: dict[str, Predictor] = {}


def predict(df: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` with ``lang_pred, score, rejected`` of every whole
    text; the text itself may be among them."""
    import uuid
    tag, shared = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(model)
    kinds, sent = dict(df.dtypes), list(dict.fromkeys([*carry, text]))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", lang_pred string, score double, rejected boolean"

    def run(batches):
        if tag not in _PREDICTORS:
            _PREDICTORS.clear()
            _PREDICTORS[tag] = shared.value.predictor()
        p = _PREDICTORS[tag]
        for batch in batches:
            got = [p.judge(t.as_py()) for t in batch.column(sent.index(text))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(carry))), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.bool_())],
                names=[*carry, "lang_pred", "score", "rejected"])

    return df.select(sent).mapInArrow(run, schema)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang",
             per_lang: int = PER_LANG) -> DataFrame:
    """Train on the rows that are not held out, predict all rows."""
    model = train(df.where(~held_out(key)), key, text, label, per_lang)
    return predict(df, model, text, (key,)).select(key, held_out(key).alias("held_out"), "lang_pred", "score", "rejected")
