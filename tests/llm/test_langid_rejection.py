"""Rejection and sampling of the language operator (operator 4)."""

import numpy as np
from pyspark.sql import functions as F

from claimscope.llm import langid
from claimscope.llm.common import table
from tests.conftest import SF_SMALL

FOREIGN = ["Tämä on suomenkielinen lause, jota ei pitäisi hyväksyä.", "Это русское предложение и его нельзя принимать.",
           "これは日本語の文章です。", "Ez egy magyar mondat, amelyet el kell utasítani.", "xqzv kkjw wwqp zzxq"]


def test_languages_never_labelled_are_rejected(spark):
    df = table(spark, SF_SMALL.replace("0.001", "0.01"), "documents").select("doc_id", "text", "lang")
    model = langid.train(df.where(~langid.held_out() & (F.col("lang") != "de")))
    assert 0 < model.min_known < 1 and "de" not in model.langs
    got = {r.lang: r.r for r in langid.predict(df.where(langid.held_out()), model, carry=("lang",))
           .groupBy("lang").agg(F.avg(F.col("rejected").cast("double")).alias("r")).collect()}
    assert got.pop("de") >= 0.95 and max(got.values()) <= 0.01
    judge = model.predictor().judge
    assert all(judge(t)[2] for t in FOREIGN) and judge("") == ("und", 0.0, True)


def test_bound_of_known_subwords():
    rng = np.random.default_rng(3)
    # Three languages of 50 buckets each that share 20; texts of 40 subwords.
    def text(lang):
        b = np.unique(np.concatenate([rng.integers(0, 20, 20), 100 * (lang + 1) + rng.integers(0, 50, 30)]))
        return lang, b, np.ones(len(b))

    fit = [text(i % 3) for i in range(600)]
    hold = [text(i % 3) for i in range(150)]
    t = langid._least_known(fit, hold, 3)
    assert t <= 1.0
    out = [langid._known((b < 20).sum(), len(b)) for _, b, _ in hold]  # known without its language
    assert np.mean(np.array(out) < t) >= langid.CAUGHT
    # Learned texts with words of their own stay: up to SLACK times as many.
    odd = [(y, np.append(b, 900 + y), np.append(n, 12.0)) for y, b, n in hold]
    assert langid._least_known(fit, odd, 3) <= min(langid._known(n.sum() - 12, n.sum()) for _, _, n in odd)


def test_repeated_and_null_ids_are_sampled_within_the_bound(spark):
    base = table(spark, SF_SMALL, "documents").select("text", "lang").where("lang is not null").limit(150)
    for key in (F.lit(None).cast("long"), F.lit(7).cast("long")):
        df = base.withColumn("doc_id", key)
        rows = langid._sample(df.union(df).union(df), "doc_id", "text", "lang", 10)
        langs = [r[0] for r in rows]
        assert 2 <= max(langs.count(x) for x in set(langs)) <= 10
        # copies equal in id and text count once
        assert sorted(rows) == sorted(langid._sample(df, "doc_id", "text", "lang", 10)) or len(rows) == len(set(rows))


def test_every_language_is_learned_and_cells_are_bounded(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    data = [(i, " ".join(letters[i % 26] * (2 + i % 7) + letters[i // 26 % 26] * 3 for _ in range(4)), f"l{i % 260}") for i in range(1040)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert len({r[0] for r in langid._sample(df, "doc_id", "text", "lang", 4)}) == 260
    monkeypatch.setattr(langid, "SAMPLE_CELLS", 260 * 20)
    small = langid._sample(df, "doc_id", "text", "lang", 4)
    assert len({r[0] for r in small}) == 260 and len(small) < 1040


def test_one_language_and_tiny_samples_reject_nothing_by_vocabulary(spark):
    one = spark.createDataFrame([(i, f"plain words number {'x' * i}", "en") for i in range(1, 30)], "doc_id long, text string, lang string")
    assert langid.train(one).min_known == 0.0
    two = spark.createDataFrame([(1, "hello there", "en"), (2, "bonjour à tous", "fr")], "doc_id long, text string, lang string")
    model = langid.train(two)
    assert model.min_known == 0.0 and model.predictor().judge("hello there")[0] == "en"
