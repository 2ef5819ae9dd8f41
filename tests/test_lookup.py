"""Indexed lookup and search: the rows of a scan, from fewer files."""

import random

import pytest
from pyspark.sql import functions as F

from claimscope.operators import filters, lookup
from claimscope.plans.registry import REGISTRY, claims
from claimscope.sources.csv_import import write_claims
from claimscope.session import scratch_path
from tests.conftest import SF_SMALL

COLS = ["id", "note", "place"]
PIECES = 5


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(11)
    words = ["Ärzte", "brand#12", "brand#2", "a", "bb", "İzmir", "x-ray", "aaa", "tab\tbed"]
    rows = []
    for i in range(600):
        date = None if i % 50 == 0 else f"20{20 + i % 3}-{1 + i % 12:02d}-03"
        note = rng.choice([None, "", " two  blanks ", *(" ".join(rng.choices(words, k=3)) for _ in range(6))])
        rows.append((f"{rng.randrange(150)}-{i % 7}", note, rng.choice(["north", "NORTH", None]), date))
    rows += rows[:20] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, note string, place string, claim_prov_date string").withColumn("claim_prov_date", F.to_date("claim_prov_date"))
    path = scratch_path(spark, "lookup-lines")
    write_claims(df, path)

    def keep(index, name):
        lookup.write_index(index, scratch_path(spark, name))
        return spark.read.schema(index.schema).parquet(scratch_path(spark, name))

    lines = spark.read.parquet(path)
    words = keep(lookup.word_places(lines, COLS, PIECES), "lookup-words")
    return lines, words, keep(lookup.grams(words, PIECES), "lookup-grams"), keep(lookup.id_places(lines, "id", PIECES), "lookup-ids")


def _rows(df):
    return sorted(map(str, df.select(*COLS, "claim_prov_date").collect()))


@pytest.mark.parametrize("query", ["", "  ", "a", "bb", "BRAND#1", "brand#2 north", "rzt", "ärzte 1", "7-3 x-r", "nowhere", "aaa aaa a", "zmir", "wo  lanks", "\tb", "tab"])
def test_search_equals_the_scan(made, query):
    lines, words, parts, _ = made
    assert _rows(lookup.search(lines, words, parts, query, COLS, PIECES)) == _rows(filters.text_search(lines, query, COLS))


@pytest.mark.parametrize("value", ["3-1", "40-2", "", "no such id"])
def test_lookup_equals_the_scan(made, value):
    lines, _, _, ids = made
    assert _rows(lookup.lookup(lines, ids, value, "id", PIECES)) == _rows(filters.claim_lookup(lines, value, "id"))


def test_empty_table(made):
    lines, words, parts, ids = (x.limit(0) for x in made)
    assert lookup.lookup(lines, ids, "3-1", "id", PIECES).count() == 0
    assert lookup.search(lines, words, parts, "brand", COLS, PIECES).count() == 0


def test_few_files_are_opened(spark):
    def opened(df):
        return {f for f in df.inputFiles()}

    def scanned(df):
        """Folders that the plan's partition filters leave."""
        return df.select(F.input_file_name().alias("f")).distinct().count()

    everything = len(opened(claims(spark, SF_SMALL)))
    for name, key in (("f14_indexed_lookup", "claim_ce"), ("f11_indexed_search", None)):
        out = REGISTRY[name](spark, SF_SMALL)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [claim_month" in plan
        assert out.count() > 0
        assert scanned(out) <= everything // 4


def test_one_folder_of_the_index_is_read(made):
    _, _, _, ids = made
    hit = ids.where((F.col("piece") == lookup._piece(F.lit("3-1"), PIECES)) & (F.col("term") == "3-1"))
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(piece" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,3-1)]" in plan


def test_index_rows_are_few_and_months_exact_enough(spark):
    """A word costs bits of the index, not a row for each of its parts; an id
    names only its own month."""
    rng = random.Random(5)
    rows = [(f"{rng.randrange(10**7)}-{i % 7}-{rng.randrange(10**5)}-{rng.randrange(10**6) / 100}", f"20{20 + i % 2}-{1 + i % 12:02d}") for i in range(30_000)]
    df = spark.createDataFrame(rows, "id string, claim_month string").repartition(2).sortWithinPartitions("claim_month")
    words = lookup.words(df, ["id"])
    parts = lookup.grams(words).cache()
    assert parts.count() < 3 * len(rows)  # about 20 rows a word as (gram, word) pairs
    assert parts.select("gram", "claim_month", "block").distinct().count() == parts.count()
    for word, month in rows[::6_000]:
        assert lookup.search_months(words, parts, [word]) == [month]
        assert month in lookup.search_months(words, parts, sorted([word[2:9], word[-4:]]))
    parts.unpersist()
