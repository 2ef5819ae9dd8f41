"""Texts without a letter have no language (operator 4)."""

import numpy as np

from claimscope.llm.langid import Model, subwords


def test_numerals_are_no_letters():
    rng = np.random.default_rng(1)
    p = Model(["a", "b"], rng.normal(size=(1000, 4)), rng.normal(size=(4, 2)), np.zeros(2)).predictor()
    for text in ("½ ²", "① Ⅷ", "12 _ !", "", None):
        assert p.predict(text) == ("und", 0.0)
    assert p.predict("½ a²")[0] in ("a", "b")


def test_memoised_grams_are_the_plain_ones():
    import zlib
    for word in ("a", "hello", "étés", "x" * 70):
        w = f"<{word}>"
        plain = [zlib.crc32(w[i:i + n].encode()) % 997 for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)] + [zlib.crc32(w.encode()) % 997]
        assert subwords(word, 997) == plain == subwords(word, 997)
