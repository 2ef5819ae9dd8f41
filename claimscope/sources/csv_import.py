"""CSV import (S1-S3, C1-C4, C10): read the source file as text, clean the
headers, dates and amounts, report rejects, write the claims table.

The whole path is one lazy Spark job: ``read -> typed select -> write``.
The file is split across tasks; nothing is held in memory as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from claimscope import definitions as D
from claimscope.plans.packed import NOTHING, Packing
from claimscope.sources.quoted_lines import records


FILE_LINES = 1_000_000  # lines of a compressed source file
CORRUPT = "_ragged"   # column of the whole line where its number of fields is wrong


def read_claims_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1",
                    multi_line: bool = False, ragged: bool = False) -> DataFrame:
    """S1 + S2: every column as string, header names trimmed, pandas'
    missing tokens nulled (C10: Latin-1 text decoded by ``encoding``).  A
    doubled quote inside quotes is one quote.  ``multi_line`` lets quoted
    fields hold line ends; such files are split over tasks, too
    (:mod:`claimscope.sources.quoted_lines`).  ``ragged`` adds the column
    ``CORRUPT``: the line, where it has too few or too many fields."""
    options = {"encoding": encoding, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    heads = spark.read.options(**options).option("header", True).option("inferSchema", False).csv(path).columns
    schema = StructType([StructField(c, StringType()) for c in [*heads, CORRUPT]])
    options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "columnPruning": False}
    if multi_line:
        raw = records(spark, path, encoding)
        options["multiLine"] = True
        raw = raw.select(F.from_csv("record", ", ".join(f"`{f.name}` string" for f in schema), {k: str(v) for k, v in options.items() if k not in ("encoding", "columnPruning")}).alias("r")).select("r.*")
    else:
        raw = spark.read.options(**options).option("header", True).schema(schema).csv(path)
    raw = raw.toDF(*[c.strip() for c in heads], CORRUPT)
    cols = [F.when(F.col(f"`{c.strip()}`").isin(D.NA_TOKENS), F.lit(None)).otherwise(F.col(f"`{c.strip()}`")).alias(c.strip()) for c in heads]
    # Spark refuses to read the column of whole lines alone, as a count of the
    # accepted lines would; so it hangs on the first field, too.
    line = F.when(F.length(F.coalesce(F.col(f"`{heads[0].strip()}`"), F.lit(""))) >= 0, F.col(CORRUPT)).alias(CORRUPT)
    return raw.select(*cols, *([line] if ragged else []))


def parse_date(c: Column) -> Column:
    """day/month/four-digit-year text -> date; anything else null."""
    txt = F.trim(c)
    ok = txt.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    return F.when(ok, F.try_to_timestamp(txt, F.lit(D.CSV_DATE_FORMAT)).cast("date"))


def normalise_amount(c: Column) -> Column:
    """Text, thousands commas removed, trimmed."""
    return F.trim(F.regexp_replace(c.cast("string"), ",", ""))


def convert_amount(c: Column) -> Column:
    """C4: blanks and dashes -> 0; any other non-number also 0 (the import
    message promises 0.0); exponent text such as ``1e5`` is read as a number.
    A number that ``decimal(12,2)`` cannot hold is 0 too and is one of the
    rejects."""
    txt = F.when(normalise_amount(c).isin(D.AMOUNT_BLANKS), F.lit(None)).otherwise(normalise_amount(c))
    return F.coalesce(txt.try_cast("double").try_cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))


def convert_quantity(c: Column) -> Column:
    """A whole number; any other text, or one out of range, is null."""
    return F.trim(c).try_cast("double").try_cast("int")


def typed_claims(raw: DataFrame) -> DataFrame:
    """Source headers -> claims columns and types."""
    cols = []
    for src, dst in D.CSV_HEADER_MAP:
        c = F.col(f"`{src}`") if src in raw.columns else F.lit(None).cast("string")
        if dst in ("claim_prov_date", "dob"):
            cols.append(parse_date(c).alias(dst))
        elif dst == "amount":
            cols.append(convert_amount(c).alias(dst))
        elif dst == "quantity":
            cols.append(convert_quantity(c).alias(dst))
        else:
            cols.append(c.alias(dst))
    return raw.select(*cols)


def rejects(raw: DataFrame, id_col: str = "ADMIT_ID") -> DataFrame:
    """Everything that the import could not take as it stood, a row per
    field: ``id_col, field, value, reason``.  A line with a wrong number of
    fields is one reject (``field`` null, ``value`` the line); of the others
    each amount that is no plain number or does not fit, each date that is
    present but no day/month/year, and each quantity that is present but no
    number."""
    col = lambda c: F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")
    amount = normalise_amount(col("AMOUNT"))
    plain = F.coalesce(amount.rlike(D.AMOUNT_PATTERN), F.lit(False))
    found = [("AMOUNT", amount, F.when(~plain, "not a number").when(amount.try_cast("double").try_cast("decimal(12,2)").isNull(), "out of range"))] if "AMOUNT" in raw.columns else []
    for c in ("CLAIM_PROV_DATE", "DOB"):
        found.append((c, col(c), F.when(col(c).isNotNull() & parse_date(col(c)).isNull(), "not a date")))
    found.append(("QUANTITY", col("QUANTITY"), F.when(col("QUANTITY").isNotNull() & convert_quantity(col("QUANTITY")).isNull(), "not a number")))
    one = lambda field, value, reason: F.struct(F.lit(field).cast("string").alias("field"), value.alias("value"), reason.alias("reason"))
    fields = F.filter(F.array(*[one(*f) for f in found]), lambda f: f.reason.isNotNull())
    if CORRUPT in raw.columns:
        whole = F.array(one(None, F.col(CORRUPT), F.lit("wrong number of fields")))
        fields = F.when(F.col(CORRUPT).isNotNull(), whole).otherwise(fields)
    return raw.select(col(id_col).alias(id_col), F.explode(fields).alias("f")).select(id_col, "f.field", "f.value", "f.reason")


def import_claims(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", multi_line: bool = False):
    """Returns ``(claims, rejects)``.  A line with a wrong number
    of fields is only in the rejects, since its values stand in the wrong
    columns; every other line is a claim, whatever was rejected of it."""
    raw = read_claims_csv(spark, path, encoding, multi_line, ragged=True)
    return typed_claims(raw.where(F.col(CORRUPT).isNull())), rejects(raw)


def write_claims(df: DataFrame, path: str, last: Callable[[DataFrame], DataFrame] = lambda dealt: dealt, carry: Packing | None = None) -> str:
    """S3: full replace of the claims table, partitioned by service month so
    that date filters open only their months' folders.

    Rows are dealt by month with the ``rebalance`` hint: AQE splits a month
    into as many tasks and files as its bytes ask for
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), also one that holds
    a large share of all lines, and puts small months together in a task.
    Inside a file rows are sorted by date, so row-group statistics skip too.
    ``last`` adds columns that the rows need not carry while they are dealt;
    the month travels as a number.  With ``carry`` the rows come as its numbers
    and travel packed.
    """
    carry = carry or NOTHING
    day = carry.value("claim_prov_date")
    dated = df.withColumn("__mon", F.year(day) * 12 + F.month(day))
    dealt = last(carry.values(carry.through(dated, ["__mon"], lambda rows: rows.hint("rebalance", "__mon")).drop("__mon")))
    write_by_month(dealt.withColumn("claim_month", F.date_format("claim_prov_date", "yyyy-MM")), path)
    return path


def write_by_month(dealt: DataFrame, path: str) -> None:
    """Write rows that are dealt by ``claim_month`` already."""
    (dealt.sortWithinPartitions("claim_month", "claim_prov_date").write.mode("overwrite")
     .option("compression", "zstd").partitionBy("claim_month").parquet(path))


def load_claims(spark: SparkSession, path: str) -> DataFrame:
    """The stored claims table."""
    return spark.read.parquet(path)


def source_columns(claims: DataFrame) -> list[Column]:
    """The claims columns as texts under the source's headers."""
    cols = []
    for src, dst in D.CSV_HEADER_MAP:
        c = F.col(dst)
        if dst in ("claim_prov_date", "dob"):
            c = F.date_format(c, "dd/MM/yyyy")
        elif dst == "amount":
            c = F.format_number(c.cast("double"), 2)
        cols.append(c.cast("string").alias(src))
    return cols


def export_source_csv(claims: DataFrame, path: str, encoding: str = "ISO-8859-1", compression: str = "none") -> str:
    """S8 in the source layout: the claims table written back as the import
    file (source headers, day/month/year dates, amounts with thousands
    commas), e.g. to hand a cleaned extract to the upstream system.  A
    compressed file is read by one task, so those end after ``FILE_LINES``
    lines."""
    (claims.select(*source_columns(claims)).write.mode("overwrite").option("header", True)
     .option("encoding", encoding).option("escape", '"').options(**compressed(compression)).csv(path))
    return path


def compressed(compression: str) -> dict[str, object]:
    """Writer options of a text file."""
    return {"compression": compression} | ({} if compression == "none" else {"maxRecordsPerFile": FILE_LINES})
