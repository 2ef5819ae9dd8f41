"""Lookup and search that open only the months they need (F11, F14 at scale).

The claims table lies in folders by month, so a lookup by id and a text search
would open all of them.  Two narrow tables, built once and stored, name the
months first:

* ``places``: (term, month), each pair once, for the values of an id column;
* ``grams``: (three characters, month, block, marks), for the words of a text.

``BLOCK`` words that a task reads one after the other are a block, and the
words of a block lie by hash in ``SLOTS`` slots.  A row of ``grams`` marks the
slots that hold a word with these characters (``MARKS`` columns of 64 bits), so
a word costs bits and not a row for each of its parts, and the rows are combined
where the lines are read, before anything moves.  A month can hold a term if one
slot has marks of all its characters.  Every word of every line is marked, so no
month with a match is missed; as up to 64 words share a slot, a month without
one may be named, the seldomer the longer the term.

Both are dealt by the hash of what is looked up into ``PIECES`` folders and are
sorted there, so a lookup opens one folder (a search one for each three
characters) and skips its row groups.  They are ranged by all columns:
characters that most words hold still spread over files.  The months found (as
many rows as there are months, read on the driver) become a filter on the
partition column of the claims, and the claims of those months are verified by
the exact rule, so the rows are those of a full scan.

A search term has no blank, and the text of a row joins its columns by blanks;
so a match always lies inside one word of the text.  Terms under three
characters are compared with every word.  Null values take part in no lookup;
lines without a date lie in the null month, which is a month like any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.operators.filters import MONTH, search_terms, search_text, text_search

PIECES = 32  # folders of an index; raise it with the table
GRAM = 3
BLOCK = 16384  # neighbouring words, repeats included, that a row of ``grams`` speaks for
SLOTS = 256
MARKS = [f"marks_{k}" for k in range(SLOTS // 64)]


def _piece(term: Column, pieces: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(pieces)).cast("int")


def places(df: DataFrame, terms: Column, pieces: int = PIECES) -> DataFrame:
    """``(term, claim_month, piece)`` of an array of texts per row."""
    found = df.select(F.explode(terms).alias("term"), MONTH).where(F.col("term").isNotNull()).distinct()
    return found.withColumn("piece", _piece(F.col("term"), pieces))


def id_places(df: DataFrame, key: str, pieces: int = PIECES) -> DataFrame:
    return places(df, F.array(F.col(key).cast("string")), pieces)


def words(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """``(term, claim_month)``: the words of each row's text, repeats included."""
    return df.select(F.explode(F.split(search_text(cols), " ", -1)).alias("term"), MONTH).where(F.col("term").isNotNull())


def word_places(df: DataFrame, cols: Iterable[str], pieces: int = PIECES) -> DataFrame:
    return places(df, F.split(search_text(cols), " ", -1), pieces)


def grams(index: DataFrame, pieces: int = PIECES) -> DataFrame:
    """``(gram, claim_month, block, marks_0 .. marks_3, piece)`` of the terms
    of ``words`` or ``places``, each (gram, month, block) once."""
    term, slot = F.col("term"), F.pmod(F.xxhash64("term"), F.lit(SLOTS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    rows = (index.select("term", MONTH).where(F.length(term) >= GRAM)
            .withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK))
            .select("term", MONTH, "block", F.floor(slot / 64).alias("__k"), bit.alias("__bit"),
                    F.explode(F.sequence(F.lit(1), F.greatest(F.length(term) - (GRAM - 1), F.lit(1)))).alias("__i"))
            .withColumn("gram", term.substr(F.col("__i"), F.lit(GRAM))))
    marks = [F.bit_or(F.when(F.col("__k") == k, F.col("__bit")).otherwise(F.lit(0).cast("long"))).alias(c) for k, c in enumerate(MARKS)]
    return rows.groupBy("gram", MONTH, "block").agg(*marks).withColumn("piece", _piece(F.col("gram"), pieces))


def write_index(index: DataFrame, path: str) -> None:
    """Write ``places`` or ``grams`` by piece, sorted."""
    order = ["piece", *[c for c in index.columns if c != "piece"]]
    (index.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
     .option("compression", "zstd").partitionBy("piece").parquet(path))


def in_months(df: DataFrame, months: Sequence[str | None]) -> DataFrame:
    """The rows of some months, by the partition column."""
    named = [m for m in months if m is not None]
    ok = F.col(MONTH).isin(named) if named else F.lit(False)
    return df.where(ok | F.col(MONTH).isNull() if None in months else ok)


def lookup(df: DataFrame, index: DataFrame, value: str, key: str, pieces: int = PIECES) -> DataFrame:
    """the rows with ``key = value``; ``index`` is ``id_places``."""
    hit = index.where((F.col("piece") == _piece(F.lit(value), pieces)) & (F.col("term") == value))
    months = [r[0] for r in hit.select(MONTH).distinct().collect()]
    return in_months(df, months).where(F.col(key).cast("string") == F.lit(value))


def search_months(index: DataFrame, parts: DataFrame, terms: Sequence[str], pieces: int = PIECES) -> list[str | None]:
    """The months in which every term can be part of some word."""
    asked = None
    for n, term in enumerate(terms):
        if len(term) < GRAM:
            met = index.where(F.col("term").contains(term)).select(MONTH)
        else:
            cuts = sorted({term[i:i + GRAM] for i in range(len(term) - GRAM + 1)})
            asks = [(F.col("piece") == _piece(F.lit(c), pieces)) & (F.col("gram") == c) for c in cuts]
            both = (parts.where(reduce(lambda a, b: a | b, asks)).groupBy(MONTH, "block")
                    .agg(F.count(F.lit(1)).alias("n"), *[F.bit_and(c).alias(c) for c in MARKS]))
            met = both.where((F.col("n") == len(cuts)) & reduce(lambda a, b: a | b, [F.col(c) != 0 for c in MARKS])).select(MONTH)
        met = met.distinct().withColumn("n", F.lit(n))
        asked = met if asked is None else asked.union(met)
    return [r[0] for r in asked.groupBy(MONTH).count().where(F.col("count") == len(terms)).collect()]


def search(df: DataFrame, index: DataFrame, parts: DataFrame, query: str, cols: Iterable[str], pieces: int = PIECES) -> DataFrame:
    """the rows of ``text_search(df, query, cols)``; ``parts`` are the
    ``grams`` of the ``words`` of the same columns, ``index`` these words (or
    their ``places``), read only for terms under three characters."""
    cols, terms = list(cols), sorted(set(search_terms(query)))
    if terms:
        df = in_months(df, search_months(index, parts, terms, pieces))
    return text_search(df, query, cols)
