"""Personal data by candidate gradient boosting, built-in functions only on
the data path (operator 5).

Method.  High-recall generators propose spans of four kinds (email, ip, card,
phone): the base patterns, and wider ones (written-out addresses, eight-group
IPv6, other separators, numbers without a plus) that may overlap them and each
other.  Every candidate gets binary format and context features.  One
aggregate over the whole corpus counts passing and failing base candidates for
each feature cell; there are at most ``4 * 2 ** 8`` cells, and only they
reach the driver, where boosted depth-two trees are fitted to them.

The trees answer what the hard check cannot: whether a candidate that passes
it is personal.  They never see the check.  Their labels (``labelled``) are
weak: a passing candidate after a word that speaks against it (version, invoice,
serial; for addresses words of code) is a negative; of the others as many are negatives as pass by chance,
``CHANCE`` for each failing candidate of the same cell; the rest are positives.  As one cue makes the label,
each cell is given twice, once with both cue features hidden, so that edges
and layout must carry weight too.  ``SEEDS`` adds fixed prior counts, so that a
small or empty corpus selects by the same rules.  The scores of all cells are
calibrated (isotonic over the labelled cells); an added candidate is selected
where it passes its check and the calibrated precision reaches
``MIN_PRECISION``.  Valid base spans are always kept.

Spans are found with ``split`` and ``regexp_extract_all`` of the same
pattern: the lengths of the pieces between the matches give the positions, in
code points.  Patterns use possessive repeats, and may start only where a run
of their first characters starts or right after a match, which finds the same
leftmost matches in linear time.

Defined results.  Null text is the empty text.  A base match that fails its
check is dropped without retry.  Texts of any length are searched whole.  Rows
are judged one by one, so repeated rows and null ids do no harm; empty tables
give empty results; without candidates to learn from the prior counts decide.
Only the key and the text are read, so further columns may have any name.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.native import let, running, total

KINDS = ("email", "ip", "card", "phone")
MIN_PRECISION = 0.9
PRIOR = 1.0              # a pool of cells is taken to have seen half as many negatives
# Chance passes for each failing candidate: of random digits one in ten passes
# Luhn, of four random numbers under 1000 one set in 230 is below 256; the
# rates of addresses and phones are assumed.
CHANCE = {"email": 1 / 20, "ip": 1 / 230, "card": 1 / 9, "phone": 1 / 20}
CARD_CHARS = 12          # shorter runs of digits fail by their length, not by Luhn
HIDDEN = 0.5             # weight of the copies of a cell without its cue features
ROUNDS, RATE = 30, 0.4
BEFORE, AFTER = 32, 2    # characters of context
REDACT_BLOCK = 4096
FEATURES = ("checks", "left_edge", "right_edge", "own_word", "other_word", "layout", "one_separator", "varied")
OWN, OTHER = 1 << 3, 1 << 4  # the cue features among them
# Prior counts of every kind: features, positives, negatives.  A sound
# candidate between clean edges is personal with or without a cue, one after
# a word for other numbers is not, nor is one that runs into other characters.
SEEDS = (
    (("left_edge", "right_edge", "layout", "one_separator", "varied"), 40.0, 1.0),
    (("left_edge", "right_edge", "layout", "varied"), 40.0, 1.0),
    (("left_edge", "right_edge", "own_word", "layout", "one_separator", "varied"), 40.0, 0.5),
    (("left_edge", "right_edge", "own_word", "layout", "varied"), 40.0, 0.5),
    (("left_edge", "right_edge", "other_word", "layout", "one_separator", "varied"), 1.0, 40.0),
    (("left_edge", "right_edge", "other_word", "layout", "varied"), 1.0, 40.0),
    (("left_edge", "right_edge", "layout", "one_separator"), 2.0, 8.0),
    (("left_edge", "layout", "varied"), 4.0, 4.0),
    (("right_edge", "layout", "varied"), 4.0, 4.0),
    ((), 1.0, 8.0),
)

# kind, pattern, cheap test that a text needs to hold a match, base pattern?
GENERATORS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", True),
    ("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9][ -]?[0-9]", True),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", True),
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]++)++",
     r"[\[({]at[\])}]", False),
    ("ip", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]", False),
    ("card", r"(?<![0-9.])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{4}(?![0-9.])", r"[0-9][./_][0-9]", False),
    ("phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9-])", r"[0-9][ .-][0-9]", False),
    ("phone", r"(?<![0-9+.-])00[1-9][0-9]{0,2}[ ().-][ ().0-9-]+[0-9]", r"00[1-9]", False),
)
OWN_WORDS = {"email": r"\b(?:e-?mails?|contact|write)\b", "ip": r"\b(?:ip|host|server|address|login)\b",
             "card": r"card\b|\b(?:visa|amex|credit|payment)\b", "phone": r"phone\b|\b(?:tel|call|mobile|fax|cell|whatsapp)\b"}
# Words that speak against a kind: other numbers, and for addresses code.
_NUMBERED = r"\b(?:version|isbn|issn|order|invoice|serial|part no|article|release|build|section|chapter|doi|ref)\b|#$"
OTHER_WORDS = {"email": r"\b(?:git|ssh|package|import|clone)\b", "ip": _NUMBERED, "card": _NUMBERED, "phone": _NUMBERED}
WRITTEN_OUT = r" ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?"  # the dots of written-out addresses
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def each(c: Column, i: Column) -> Column:
        d = c.cast("long")
        two = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, two).otherwise(d)

    parts = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return total(F.transform(parts, each)) % 10 == 0


def checks(kind: str, match: Column) -> Column:
    """The hard check of a kind (always passed by base email matches)."""
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$") | match.contains(":")
    if kind == "card":
        return (n >= 12) & (n <= 19) & luhn(_digits(match))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def spans(text: Column, kind: str, pattern: str, need: str, base: bool) -> Column:
    """Candidates of one generator: array of (start, end, ok, code)."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,ok:boolean,code:int>>")

    def build(parts: Column, found: Column) -> Column:
        lens = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(parts, i))).cast("long"))
        return let(running(lens, F.lit(0).cast("long"), lambda a, x: a + x), lambda at: F.transform(found, lambda m, i: one(
            m, i, F.get(at, i) + F.length(F.get(parts, i)), F.get(parts, i), F.get(parts, i + 1))))

    def one(m: Column, i: Column, start: Column, left: Column, right: Column) -> Column:
        before, after = F.lower(F.right(left, F.lit(BEFORE))), F.left(right, F.lit(AFTER))
        ok = checks(kind, m)
        # A base candidate of valid emails needs a failing side to learn from:
        # a last label that is no top-level domain.
        sound = ok & F.regexp_replace(m, WRITTEN_OUT, ".").rlike(r"\.[A-Za-z]{2,}$") if kind == "email" else ok
        return let(features(kind, m, sound, before, after), lambda code: F.struct(
            start.cast("long").alias("start"), (start + F.length(m)).cast("long").alias("end"), ok.alias("ok"), code.alias("code")))

    hold = text.contains(need) if need == "@" else text.rlike(need)
    return F.when(hold, let(F.split(text, pattern, -1), lambda p: let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: build(p, m)))).otherwise(none)


def features(kind: str, m: Column, sound: Column, before: Column, after: Column) -> Column:
    """Bits of ``FEATURES`` as a number."""
    digits = _digits(m)
    layout = {
        "email": m.rlike(r"^[A-Za-z0-9].*[A-Za-z0-9]$"),
        "ip": ~m.rlike(r"(?:^|\.)0[0-9]"),
        "card": m.rlike(r"^[0-9]+$") | m.rlike(r"^[0-9]{4}(?:[^0-9][0-9]{4}){2,3}(?:[^0-9]?[0-9]{1,3})?$"),
        "phone": m.rlike(r"[0-9]{3}\)?[ .-]{0,2}[0-9]{3}[ .-]?[0-9]{4}$") | m.rlike(r"^(?:\+|00)[0-9]{1,3}[ .-]"),
    }[kind]
    marks = F.regexp_replace(m, "[0-9A-Za-z]", "")
    bits = (
        sound,
        (before == "") | before.rlike(r"[\s(\[{<\"':;,=/]$"),
        (after == "") | after.rlike(r"^[\s)\]}>\"',;:!?]") | after.rlike(r"^\.(?:\s|$)") | (after == "."),
        before.rlike(OWN_WORDS[kind]),
        before.rlike(OTHER_WORDS[kind]),
        layout,
        F.length(F.replace(marks, F.left(marks, F.lit(1)), F.lit(""))) == 0,
        F.length(F.replace(digits, F.left(digits, F.lit(1)), F.lit(""))) > 0 if kind != "email" else F.length(m) > 7,
    )
    code = F.lit(0)
    for i, b in enumerate(bits):
        code = code + F.when(F.coalesce(b, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0))
    return code


def candidates(text: Column) -> Column:
    """All candidates of a text, as one struct of arrays ``g0, g1, ...``."""
    return F.struct(*[spans(text, kind, pattern, need, base).alias(f"g{i}") for i, (kind, pattern, need, base) in enumerate(GENERATORS)])


def cells(df: DataFrame, text: str = "text") -> list[tuple[int, int, float, float]]:
    """``(kind, code, valid, failing)`` counts of base candidates over the
    whole corpus: at most 4 * 256 rows."""
    found = df.select(candidates(F.coalesce(F.col(text), F.lit(""))).alias("c"))

    def tagged(i: int, kind: int) -> Column:
        long = CARD_CHARS if KINDS[kind] == "card" else 0
        return F.transform(F.filter(F.col(f"c.g{i}"), lambda x: x.end - x.start >= long), lambda x: F.struct(F.lit(kind).alias("kind"), x.code.alias("code")))

    rows = F.concat(*[tagged(i, KINDS.index(g[0])) for i, g in enumerate(GENERATORS) if g[3]])
    got = (found.select(F.explode(rows).alias("x")).groupBy("x.kind", "x.code").agg(F.count("*").alias("n")).collect())
    # 'checks' is bit 0.
    return [(r.kind, r.code, float(r.n if r.code & 1 else 0), float(0 if r.code & 1 else r.n)) for r in got]


def labelled(rows: list[tuple[int, int, float, float]]) -> list[tuple[int, int, float, float]]:
    """``(kind, features without the check, positives, negatives)`` of counted
    cells ``(kind, code, passing, failing)`` and of the prior counts."""
    cell: dict[tuple[int, int], list[float]] = {}
    for k, code, p, q in rows:
        n = cell.setdefault((k, code & ~1), [0.0, 0.0])
        n[0], n[1] = n[0] + p, n[1] + q
    out: dict[tuple[int, int], list[float]] = {}

    def add(k: int, code: int, pos: float, neg: float) -> None:
        for shown, weight in ((code, 1 - HIDDEN), (code & ~(OWN | OTHER), HIDDEN)):
            n = out.setdefault((k, shown), [0.0, 0.0])
            n[0], n[1] = n[0] + weight * pos, n[1] + weight * neg

    for (k, code), (p, q) in cell.items():
        neg = p if code & OTHER else min(p, q * CHANCE[KINDS[k]])
        add(k, code, p - neg, neg)
    for k in range(len(KINDS)):
        for names, pos, neg in SEEDS:
            n = out.setdefault((k, sum(1 << FEATURES.index(f) for f in names)), [0.0, 0.0])
            n[0], n[1] = n[0] + pos, n[1] + neg
    return [(k, code, p, q) for (k, code), (p, q) in sorted(out.items()) if p + q > 0]


def boost(rows: list[tuple[int, int, float, float]]) -> list[list[float]]:
    """Boosted depth-two trees on the labels of counted cells; the raw score of
    every possible cell, ``[kind][code]``, whatever its check says."""
    width = len(FEATURES)
    bit = lambda k, code, f: (code >> f & 1) if f < width else int(k == f - width)
    data = labelled(rows)
    score = [[0.0] * (1 << width) for _ in KINDS]
    split_on = range(1, width + len(KINDS))  # not on the check
    for _ in range(ROUNDS):
        stats = []
        for k, c, p, q in data:
            pr = 1 / (1 + math.exp(-score[k][c]))
            stats.append((k, c, p * (1 - pr) - q * pr, (p + q) * pr * (1 - pr)))

        def best(members):
            g, h = sum(s[2] for s in members), sum(s[3] for s in members)
            top = (1e-6, None)
            for f in split_on:
                g1 = sum(s[2] for s in members if bit(s[0], s[1], f))
                h1 = sum(s[3] for s in members if bit(s[0], s[1], f))
                gain = g1 * g1 / (h1 + 1) + (g - g1) ** 2 / (h - h1 + 1) - g * g / (h + 1)
                if gain > top[0]:
                    top = (gain, f)
            return top[1]

        first = best(stats)
        if first is None:
            break
        leaves = []
        for side in (0, 1):
            own = [s for s in stats if bit(s[0], s[1], first) == side]
            second = best(own)
            for low in (0, 1) if second is not None else (None,):
                part = own if low is None else [s for s in own if bit(s[0], s[1], second) == low]
                step = sum(s[2] for s in part) / (sum(s[3] for s in part) + 1)
                leaves.append((side, second, low, RATE * max(-4.0, min(4.0, step))))
        for k in range(len(KINDS)):
            for c in range(1 << width):
                for side, second, low, step in leaves:
                    if bit(k, c, first) == side and (second is None or bit(k, c, second) == low):
                        score[k][c] += step
    return score


def calibrate(rows: list[tuple[int, int, float, float]], score: list[list[float]]) -> list[list[float]]:
    """Isotonic precision of every cell by its score, from the labels of the
    counted cells; 0 where the check fails."""
    seen = sorted((score[k][c], p, q) for k, c, p, q in labelled(rows))
    pools: list[list[float]] = []  # lowest score, valid, all
    for s, p, q in seen:
        pools.append([s, p, p + q + PRIOR / 2])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, p1, n1 = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + p1, pools[-1][2] + n1]

    def precision(s: float) -> float:
        under = [x for x in pools if x[0] <= s + 1e-12]
        return under[-1][1] / under[-1][2] if under else 0.0

    return [[precision(s) if c & 1 else 0.0 for c, s in enumerate(kind)] for kind in score]


def fit(df: DataFrame, text: str = "text") -> list[list[float]]:
    """Calibrated precision of every (kind, feature cell)."""
    rows = cells(df, text)
    return calibrate(rows, boost(rows))


def select(c: Column, model: list[list[float]]) -> tuple[Column, Column]:
    """Sorted arrays of (start, kind, end): base spans, and all spans."""
    def typed(i: int, keep) -> Column:
        kind, extra = KINDS.index(GENERATORS[i][0]), 0 if GENERATORS[i][3] else 1
        return F.transform(F.filter(c[f"g{i}"], keep), lambda x: F.struct(
            x.start.alias("start"), F.lit(extra).alias("extra"), F.lit(kind).alias("kind"), x.end.alias("end")))

    def chosen(good: list[int]):
        return lambda x: F.array_contains(F.lit(good), x.code)

    def plain(array: Column) -> Column:
        return F.sort_array(F.transform(array, lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end"))))

    def resolve(array: Column) -> Column:
        """Leave out added spans that begin inside a base span."""
        reach = running(F.transform(array, lambda x: F.when(x.extra == 0, x.end).otherwise(F.lit(0).cast("long"))),
                        F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))
        return let(reach, lambda r: F.filter(array, lambda x, i: (x.extra == 0) | (F.get(r, i) <= x.start)))

    base = F.concat(*[typed(i, lambda x: x.ok) for i, g in enumerate(GENERATORS) if g[3]])
    more = []
    for i, g in enumerate(GENERATORS):
        if not g[3]:
            good = [code for code, p in enumerate(model[KINDS.index(g[0])]) if p >= MIN_PRECISION]
            if good:
                more.append(typed(i, chosen(good)))
    both = let(F.sort_array(F.array_distinct(F.concat(base, *more))), resolve) if more else base
    return plain(base), plain(both)


def find(df: DataFrame, model: list[list[float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text, base, spans)`` with arrays of (start, kind, end)."""
    rows = df.select(F.col(key), F.col(text), candidates(F.coalesce(F.col(text), F.lit(""))).alias("__c"))
    base, both = select(F.col("__c"), model)
    return rows.select(key, text, base.alias("base"), both.alias("spans"))


def listed(array: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(array, lambda x: F.concat_ws(
        ":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))), ",")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Base counts, digest of the base spans, and all spans."""
    n = lambda i: F.size(F.filter("base", lambda x: x.kind == i)).cast("long")
    return found.select(key, *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """The text with every span (overlapping ones as one) put as ``[KIND]``."""
    names = F.lit([f"[{k.upper()}]" for k in KINDS])

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        """Characters a to b (exclusive), touching only their blocks."""
        i, j = F.floor(a / REDACT_BLOCK).cast("int"), F.floor(b / REDACT_BLOCK).cast("int")
        x, y = (a % REDACT_BLOCK).cast("int"), (b % REDACT_BLOCK).cast("int")
        piece = lambda k, p, n: F.coalesce(F.substring(F.get(blocks, k), p + 1, n), F.lit(""))
        return F.when(i == j, piece(i, x, y - x)).otherwise(F.concat(
            piece(i, x, F.lit(REDACT_BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), piece(j, F.lit(0), y)))

    def merge(s: Column) -> Column:
        """(start, kind, end) of the merged spans."""
        reach = running(F.transform(s, lambda x: x.end), F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))

        def groups(r: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (F.get(s, k).start >= F.get(r, k)))
            last = F.greatest(F.get(r, F.size(s) - 1), F.get(s, F.size(s) - 1).end)
            return let(heads, lambda h: F.transform(h, lambda k, g: F.struct(
                F.get(s, k).start.alias("start"), F.get(s, k).kind.alias("kind"),
                F.coalesce(F.get(r, F.get(h, g + 1)), last).alias("end"))))

        return let(reach, groups)

    def build(m: Column, blocks: Column) -> Column:
        pieces = F.transform(m, lambda x, k: F.concat(
            cut(blocks, F.coalesce(F.get(m, k - 1).end, F.lit(0).cast("long")), x.start), F.get(names, x.kind)))
        tail = cut(blocks, F.get(m, F.size(m) - 1).end, F.length(text).cast("long"))
        return F.concat(F.array_join(pieces, ""), tail)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{REDACT_BLOCK}}}"), F.lit(0))
    return F.when((F.size(found) > 0) & text.isNotNull(), let(found, lambda s: let(merge(s), lambda m: let(blocks, lambda b: build(m, b))))).otherwise(text)


def reference_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans by Python's ``re`` as the definition states them; for tests."""
    def luhn_ok(d: str) -> bool:
        return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn_ok(re.sub("[^0-9]", "", m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m.group()))
