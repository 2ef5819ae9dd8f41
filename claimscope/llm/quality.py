"""Line-first quality rules, built-in functions only (operator 8).

Method.  Every line with a word is judged by itself; it fails if a rule hits:

* punctuation: ``MIN_LINE_WORDS`` words or more, no closing mark at the end
  and no sentence end inside, or ``MAX_BANGS`` or more words ending in ``!!`` (shouting);
* navigation: separators (``|``, two angle marks or bullets) between parts of
  ``NAV_WORDS`` words or fewer on average;
* boilerplate: marks of mark-up (``# * $ % & | < >``) for more than
  ``MAX_SYMBOLS`` of the words, or a phrase of ``BOILERPLATE``.

Failing lines are removed.  A document that loses more than ``MAX_LOSS`` of
the characters of its lines is rejected, and so is one that fails the base
rules (under 50 words, or over half of its words in repeated 3-word windows).

Repeated windows are found by the 64-bit hash of their words, sorted with
their positions inside the row: no shuffle.

Defined results.  Null text counts as no words: all counts 0, base_failed,
not kept, null cleaned text.  A text whose lines all pass stays exactly as it
is.  Rows are judged one by one, so repeated rows, ties and null ids do no
harm; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.native import SPACE, let, total

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MIN_LINE_WORDS = 4
MAX_BANGS = 3
NAV_WORDS = 3
MAX_SYMBOLS = 0.2
MAX_LOSS = 0.5
SYMBOLS = "#*$%&|<>"
CLOSING = r"""[.!?…।॥؟۔።။。！？｡：；，、؛،:;,"'”’»)」』）\]]\s*$"""
SENTENCE = r"[.!?…।॥؟۔።။]\s|[。！？｡]"
BOILERPLATE = ("all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use",
               "terms of service", "enable javascript", "skip to content", "subscribe to our newsletter",
               "click here to", "log in to your account")


def words(text: Column) -> Column:
    """Words of a text: runs without ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def count_of(text: Column, chars: str) -> Column:
    """Number of characters of ``text`` that are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeat_words(w: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more."""
    windows = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
                          lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: F.coalesce(
            (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h),
            x.h == F.get(s, k - 1).h, x.h == F.get(s, k + 1).h, F.lit(False)))
        places = let(pairs, lambda s: F.sort_array(F.transform(twice(s), lambda x: x.i)))
        steps = let(places, lambda p: F.transform(
            p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)).cast("long")))
        return total(steps)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\f\r", "")) != "")
    return let(words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        count_of(t, SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words")))


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails a rule."""
    def rules(n: Column) -> Column:
        seps = count_of(line, "|›»•·")
        bangs = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
        low = F.lower(line)
        phrase = F.lit(False)
        for p in BOILERPLATE:
            phrase = phrase | low.contains(p)
        return (((n >= MIN_LINE_WORDS) & ~line.rlike(CLOSING) & ~line.rlike(SENTENCE)) | (bangs >= MAX_BANGS)
                | ((seps >= 2) & (n <= NAV_WORDS * (seps + 1) + seps))
                | (count_of(line, SYMBOLS) > MAX_SYMBOLS * n + 1) | phrase)

    n = F.size(F.filter(F.split(line, SPACE + "+"), lambda w: w != ""))
    return let(n, lambda c: (c > 0) & rules(c))


def clean_lines(text: Column) -> Column:
    """Struct of ``loss``, the share of the characters that failing lines
    take, and ``cleaned``, the text without them; each line is judged once."""
    size = lambda a: total(F.transform(a, lambda x: F.length(x).cast("long")))
    return let(F.split(F.coalesce(text, F.lit("")), "\n"), lambda a: let(F.filter(a, lambda x: ~line_fails(x)), lambda good: F.struct(
        F.coalesce(F.try_divide(size(a) - size(good), size(a)), F.lit(0.0)).alias("loss"),
        F.when(text.isNotNull(), F.array_join(good, "\n")).alias("cleaned"))))


def judge(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, base counts, base_failed, loss, kept, cleaned)``."""
    out = df.select(F.col(key), base_counts(F.col(text)).alias("__c"), clean_lines(F.col(text)).alias("__l"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return (out.select(key, "__c.*", "__l.*").withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("loss") <= MAX_LOSS)))
