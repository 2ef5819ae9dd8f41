"""Rows as few numbers while they move.

A shuffle writes eight bytes for each column of a row, texts more.  Before a
large table is dealt or joined, :meth:`Packing.fit` reads how far the values of
its numbers and dates reach and which texts a column holds (aggregates).
:meth:`Packing.numbers` counts the values from there, :meth:`Packing.through`
lays these numbers as bits side by side in as few longs as they need while the
rows move, and :meth:`Packing.values` gives the columns back after the last move.
That is exact for every value, since the reach is read from the rows themselves;
null is a value of its own.  Texts of more than ``TEXTS`` values, numbers that need more than 62
bits and all other types travel as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DataType, DateType, DecimalType, IntegerType, LongType, ShortType, StringType

TEXTS = 255   # a column with more texts is not coded


@dataclass(frozen=True)
class Field:
    """A column's type and reach: 0 stands for null, 1 for ``low``, or 1 and up
    for the ``texts``."""

    kind: DataType
    low: int
    high: int
    texts: tuple[str, ...] = ()

    @property
    def bits(self) -> int:
        return (self.high - self.low + 1).bit_length()

    def number(self, c: str) -> Column:
        own = F.array_position(F.array(*map(F.lit, self.texts)), F.col(c)) if self.texts else whole(F.col(c), self.kind) - F.lit(self.low) + 1
        return F.coalesce(own, F.lit(0).cast("long"))

    def value(self, number: Column) -> Column:
        if self.texts:
            return F.get(F.array(*map(F.lit, self.texts)), (number - 1).cast("int"))
        n = F.when(number > 0, number + F.lit(self.low - 1))
        if isinstance(self.kind, DateType):
            return F.date_from_unix_date(n.cast("int"))
        if isinstance(self.kind, DecimalType):
            return (n.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-self.kind.scale))).cast(self.kind)
        return (n == 1) if isinstance(self.kind, BooleanType) else n.cast(self.kind)


def whole(c: Column, kind: DataType) -> Column:
    """A number or date as a long."""
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, DecimalType):
        return (c * F.lit(Decimal(10 ** kind.scale))).cast("long")
    return c.cast("int").cast("long") if isinstance(kind, BooleanType) else c.cast("long")


def _counted(kind: DataType) -> bool:
    return isinstance(kind, (ByteType, ShortType, IntegerType, LongType, DateType, BooleanType)) or isinstance(kind, DecimalType) and kind.precision <= 18


@dataclass(frozen=True)
class Packing:
    fields: dict[str, Field]

    @staticmethod
    def fit(df: DataFrame, texts: Sequence[str] = ()) -> Packing:
        """The reach of the numbers and dates of ``df`` and the values of the
        columns ``texts`` (``TEXTS`` + 1 rows a column at most)."""
        found = {}
        kinds = {f.name: f.dataType for f in df.schema if _counted(f.dataType)}
        if kinds:
            ends = df.agg(*[end(whole(F.col(c), k)) for c, k in kinds.items() for end in (F.min, F.max)]).first()
            for i, (c, kind) in enumerate(kinds.items()):
                low, high = ends[2 * i], ends[2 * i + 1]
                found[c] = Field(kind, 0 if low is None else low, 0 if high is None else high)
        if texts:
            counts = [df.where(F.col(c).isNotNull()).groupBy(F.lit(c).alias("c"), F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
                      .orderBy(F.desc("n"), "v").limit(TEXTS + 1) for c in texts]
            rows = reduce(DataFrame.unionByName, counts).collect()
            for c in texts:
                own = [r.v for r in sorted((r for r in rows if r.c == c), key=lambda r: -r.n)]
                if 0 < len(own) <= TEXTS:
                    found[c] = Field(StringType(), 1, len(own), tuple(own))
        return Packing({c: f for c, f in found.items() if f.bits <= 62 and max(abs(f.low), abs(f.high)) < 1 << 62})

    def __or__(self, other: Packing) -> Packing:
        """Both tables' columns; the reach of one that both have is the wider."""
        wide = {c: Field(a.kind, min(a.low, b.low), max(a.high, b.high)) for c, a in self.fields.items() if (b := other.fields.get(c)) and a.kind == b.kind and not a.texts + b.texts}
        one = {c: f for c, f in (self.fields | other.fields).items() if not (c in self.fields and c in other.fields)}
        return Packing({c: f for c, f in (one | wide).items() if f.bits <= 62})

    def value(self, c: str) -> Column:
        """The value of a column that is a number."""
        return self.fields[c].value(F.col(c)) if c in self.fields else F.col(c)

    def values(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.value(c).alias(c) for c in df.columns])

    def numbers(self, df: DataFrame, columns: Collection[str] | None = None) -> DataFrame:
        """Values as numbers, in some ``columns`` or all."""
        own = [c for c in df.columns if c in self.fields and (columns is None or c in columns)]
        return df.select(*[self.fields[c].number(c).alias(c) if c in own else F.col(c) for c in df.columns])

    def packed(self, df: DataFrame, apart: Collection[str], name: str = "word") -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        """Rows of numbers packed but for the columns ``apart``, and what gives
        the numbers back; ``name`` tells two tables' packed columns apart."""
        bits = {c: self.fields[c].bits for c in df.columns if c in self.fields and c not in apart}
        words: list[dict[str, int]] = []   # columns and where their bits begin
        for c in sorted(bits, key=lambda c: -bits[c]):
            ends = [sum(bits[x] for x in w) for w in words]
            at = next((i for i, end in enumerate(ends) if end + bits[c] <= 63), None)
            if at is None:
                words.append({c: 0})
            else:
                words[at][c] = ends[at]
        names = [f"__{name}{i}" for i in range(len(words))]
        packed = [reduce(Column.bitwiseOR, [F.shiftleft(c, at) for c, at in w.items()]).alias(n) for n, w in zip(names, words)]
        given = {c: F.shiftright(F.col(n), at).bitwiseAND(F.lit((1 << bits[c]) - 1)) for n, w in zip(names, words) for c, at in w.items()}

        def back(moved: DataFrame) -> DataFrame:
            own = [c for c in df.columns if c in given or c in moved.columns]
            return moved.select(*[given.get(c, F.col(c)).alias(c) for c in own], *[c for c in moved.columns if c not in [*df.columns, *names]])

        return df.select(*packed, *[c for c in df.columns if c not in bits]), back

    def through(self, df: DataFrame, apart: Collection[str], move: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``move`` applied to rows of numbers while they are packed but for the
        columns ``apart``."""
        rows, back = self.packed(df, apart)
        return back(move(rows))


NOTHING = Packing({})   # every column travels as it is
