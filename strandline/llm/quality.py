"""Quality rules: text statistics, and decision lists learnt from labelled ones.

Built-in DataFrame functions only, on all paths.  Statistics are counted inside the row, so texts are
never shuffled.  A decision list is learnt by sequential covering: a rule grows by the threshold that
gains most on two thirds of the labelled rows, is cut back to the prefix that does best on the others,
and the rows that it covers leave before the next rule is grown.  Every step is one aggregate over all
labelled rows, whose result has a row for each level of a statistic (at most 1,001 each), whatever the
number of rows.  What is learnt is an ordered list of conditions on whole numbers, given as one
conditional expression of Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Fewer words than this fail, and so does a larger share of words in repeated windows (percent).
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Classes of characters, each counted by the first of its characters, which the others are turned into.
_CLASSES = {"n_upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "n_digits": "0123456789", "n_symbols": SYMBOLS, "n_marks": "!?", "": SPACES}

#: Statistics that rules may test: what is divided, by what, and the number of levels that 1 has.
FEATURES = {
    "symbol_share": ("n_symbols", "word_chars", 1000),
    "upper_share": ("n_upper", "word_chars", 1000),
    "digit_share": ("n_digits", "word_chars", 1000),
    "marks_per_word": ("n_marks", "n_words", 500),
    "dup_line_share": ("n_dup_lines", "n_lines", 1000),
    "repeat_share": ("n_repeat_words", "n_words", 1000),
    "distinct_share": ("n_distinct_words", "n_words", 1000),
    "mean_word": ("word_chars", "n_words", 10),
    "words_per_line": ("n_words", "n_lines", 10),
}
#: Levels end here; larger ratios have the last one.
TOP = 1000

#: A rule has at most so many conditions, a list so many rules; a rule has to cover so many bad rows, and to be right so often.
CONDITIONS, RULES, LEAST_ROWS, PRECISION = 4, 16, 3, 0.9


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, whatever the number of times that ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(windows: Column) -> Column:
    """Words in windows of three that the text has twice or more, of the hashes of all its windows in order."""

    def covered(w: Column) -> Column:
        # windows in the order of their hashes: equal ones are neighbours
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(placed, lambda s: F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])))
        at = F.sort_array(F.array_compact(twice))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the counts that quality is judged by.

    ``n_words``; ``word_chars`` (code points in words); ``n_symbols`` (of ``#*$%&|<>``), ``n_upper`` (A-Z), ``n_digits``
    (0-9), ``n_marks`` (! and ?); ``n_lines`` (lines with a word), ``n_dup_lines`` (those that equal an earlier line),
    ``n_repeat_words`` (words in windows of three that occur twice or more, the first included),
    ``n_distinct_words``.  Windows are compared by 64-bit hashes within their text.

    A null text counts as an empty one, with zeros throughout.  Texts are read whole whatever their length, in the
    memory of one task.  A repeated row is a row of its own; an empty table gives an empty one.  Other columns stay,
    but for those that have the name of a count, which the count replaces.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines", "n_distinct_words"]
    names = [c for c in docs.columns if c != text and c not in counts]
    flat = docs.select(F.coalesce(docs[text], F.lit("")).alias("_text"), *[docs[c] for c in names]).toDF("_text", *[f"c{i}" for i in range(len(names))])
    others = [f"c{i}" for i in range(len(names))]
    old = "".join(x[1:] for x in _CLASSES.values())
    new = "".join(x[0] * (len(x) - 1) for x in _CLASSES.values())
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    trimmed = F.btrim("_text", F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))
    read = flat.select(
        *others, F.length("_text").alias("_n"), F.translate("_text", old, new).alias("_classes"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("_words"),
    )
    count = {c: (F.col("_n") - F.length(F.replace("_classes", F.lit(x[0]), F.lit("")))).cast("long").alias(c) for c, x in _CLASSES.items() if c}
    windows = F.when(F.size("_words") >= 3, _let(F.col("_words"), lambda w: F.transform(F.slice(w, 3, F.size(w)), lambda h, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), h))))
    told = read.select(
        *others, F.size("_words").cast("long").alias("n_words"), F.length(F.replace("_classes", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        count["n_symbols"], F.col("_lines.dup").cast("long").alias("n_dup_lines"),
        F.coalesce(_repeated(windows), F.lit(0)).cast("long").alias("n_repeat_words"),
        count["n_upper"], count["n_digits"], count["n_marks"], F.col("_lines.n").cast("long").alias("n_lines"), F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
    )
    return told.toDF(*names, *counts)


def base_failed() -> Column:
    """Whether a text is too short or repeats itself too much, of the columns of ``statistics``."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def level(feature: str) -> Column:
    """The level of a statistic, 0 to ``TOP``; null where it has no value (no words)."""
    above, below, unit = FEATURES[feature]
    return F.least(F.lit(TOP).cast("long"), F.expr(f"({unit} * {above}) div nullif({below}, 0)"))


@dataclass(frozen=True)
class Condition:
    """``feature >= bound`` or ``feature < bound``, in levels; false where the statistic has no value."""

    feature: str
    least: bool
    bound: int

    def column(self, value: Column) -> Column:
        return F.coalesce(value >= self.bound if self.least else value < self.bound, F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.least else '<'} {self.bound / FEATURES[self.feature][2]:g}"


@dataclass(frozen=True)
class Rule:
    """Texts that meet all conditions are bad; of the labelled rows that reached the rule it covered so many bad and good ones."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self, value: Callable[[str], Column]) -> Column:
        met = F.lit(True)
        for c in self.conditions:
            met = met & c.column(value(c.feature))
        return met

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + f" -> drop ({self.bad} bad, {self.good} good)"


def verdict(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that a text meets, null if none: one conditional expression over ``statistics``."""
    out = None
    for k, r in enumerate(rules, 1):
        met = r.column(level)
        out = F.when(met, F.lit(k)) if out is None else out.when(met, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    """What a condition gains: bad rows that it keeps, times the bits by which they stand out more."""
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0))) if bad else 0.0


def best_condition(levels: dict[str, list[tuple[int, int, int]]]) -> Condition | None:
    """The threshold with the largest gain, of ``(level, bad, good)`` in order for each feature; halfway between two levels.

    Of equal gains the first feature counts, of its thresholds the one that keeps more bad rows, then ``>=`` and the smaller bound.
    """
    best, found = (0.0, 0), None
    for f in FEATURES:
        rows = levels.get(f, [])
        bad0, good0 = sum(r[1] for r in rows), sum(r[2] for r in rows)
        bad = good = 0
        for (a, b, g), (after, _, _) in zip(rows, rows[1:]):
            bad, good = bad + b, good + g
            bound = (a + after + 1) // 2
            for least, n, m in ((True, bad0 - bad, good0 - good), (False, bad, good)):
                score = (round(_gain(n, m, bad0, good0), 9), n)
                if n >= LEAST_ROWS and score[0] > 0 and score > best:
                    best, found = score, Condition(f, least, bound)
    return found


def learn(labelled: DataFrame, bad: Column, share: Column, name: str = "rules") -> list[Rule]:
    """A decision list from rows of ``statistics``: ``bad`` says which are, ``share`` (0 to 8 for each row) deals them: 0 to 5 grow, 6 to 8 prune.

    Rows whose ``bad`` is null take no part.  No rows, or none that can be told apart, give an empty list.  All rows take
    part, repeated ones as often as they are there; ties are settled as ``best_condition`` says, so that a list depends on the rows alone.
    """
    scratch = Scratch(labelled.sparkSession, name)
    rows = scratch.save(labelled.select(bad.alias("bad"), (share < 6).alias("grow"), *[level(f).cast("short").alias(f) for f in FEATURES]).where("bad is not null"))
    n_bad, n_good = F.count_if("bad"), F.count_if(~F.col("bad"))
    found: list[Rule] = []
    left = F.lit(True)
    while len(found) < RULES:
        conditions: list[Condition] = []
        while len(conditions) < CONDITIONS:
            inside = rows.where(left & F.col("grow") & Rule(tuple(conditions), 0, 0).column(F.col))
            each = inside.select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("level")) for f in FEATURES])).alias("x"))
            levels: dict[str, list[tuple[int, int, int]]] = {}
            for r in each.where("x.level is not null").groupBy("x.f", "x.level").agg(n_bad.alias("b"), n_good.alias("g")).collect():  # at most 1,001 rows for each feature
                levels.setdefault(r.f, []).append((r.level, r.b, r.g))
            new = best_condition({f: sorted(x) for f, x in levels.items()})
            if new is None:
                break
            conditions.append(new)
        if not conditions:
            break
        prefixes = [Rule(tuple(conditions[:k]), 0, 0).column(F.col) for k in range(1, len(conditions) + 1)]
        part = lambda grow: [x for k, p in enumerate(prefixes) for x in (F.count_if(p & F.col("bad") & (F.col("grow") == grow)).alias(f"b{k}{int(grow)}"), F.count_if(p & ~F.col("bad") & (F.col("grow") == grow)).alias(f"g{k}{int(grow)}"))]
        got = rows.where(left).agg(*part(True), *part(False)).first()
        worth = lambda k: (got[f"b{k}0"] - got[f"g{k}0"]) / max(1, got[f"b{k}0"] + got[f"g{k}0"])
        k = max(range(len(prefixes)), key=lambda k: (worth(k), -k))
        b, g = got[f"b{k}0"] + got[f"b{k}1"], got[f"g{k}0"] + got[f"g{k}1"]
        if b < LEAST_ROWS or b < PRECISION * (b + g) or got[f"b{k}0"] < PRECISION * (got[f"b{k}0"] + got[f"g{k}0"]):
            break
        found.append(Rule(tuple(conditions[: k + 1]), b, g))
        left = left & ~prefixes[k]
    scratch.drop(rows)
    return found


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", name: str = "rules") -> list[Rule]:
    """A decision list from ``labels`` (0: bad) over the ``stats`` that pass the base; labels of one id that differ count as bad, null ones not at all.

    Rows without an id or a label take no part; extra columns of ``labels`` are not read.
    """
    told = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.min(label) == 0).alias("_bad"))
    used = stats.where(~base_failed()).join(told, stats[key] == F.col("_key"))
    return learn(used, F.col("_bad"), F.pmod(F.xxhash64("_key"), F.lit(9)), name)


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with ``base_failed``, ``kept`` and ``rule``: the rule that dropped the text (null: none did).

    Columns of these names are replaced; a text that fails the base is judged by no rule.
    """
    kept = stats.withColumn("base_failed", base_failed())
    kept = kept.withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)).cast("int"))
    return kept.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
