"""Quality rules with a short-circuit cascade, in DataFrame functions only.

A rule names the features that it reads.  ``cascade`` estimates each rule's cost and
selectivity on a sample of about ``SAMPLE`` rows, drawn over all of them, and orders
the rules by rejections per cost: the best one first, then the best among those on
the rows that it left, and so on.  The cost is counted work, the characters that a
rule's features and its own expression read in a row (a weight for each says how
many times); a feature that was wanted or read before is free.  So equal samples
give equal orders.  A document that a rule rejects meets no later rule, one that
failed the base meets none, and features that nobody wanted are computed by the
first rule that reads them, and only then.  The order changes the time, never the
verdict.

Three-word windows are told apart by 64-bit hashes within one text.

Edge cases: a null text has no words, lines or symbols; blank texts likewise;
repeated rows are judged alike; an empty table gives no rows; columns of the
input other than the key and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 2000
BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Runs of characters other than space, tab to carriage return."""
    return F.filter(F.split(F.translate(text, BLANK, " " * len(BLANK)), " "), lambda w: w != "")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated one time."""
    return F.transform(F.array(value), f)[0]


def repeated_words(w: Column) -> Column:
    """Words in three-word windows that stand twice or more, the first included."""
    hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))

    def places(h):
        return _once(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: F.sort_array(F.transform(F.filter(s, lambda e, j: F.coalesce(e["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, j + 1)["h"], F.lit(False))), lambda e: e["i"])))

    def covered(p):
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(p, start, lambda s, x: F.struct((s["n"] + F.least(F.lit(3), x - s["last"])).alias("n"), x.alias("last")))["n"]

    return _once(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(places(h))))


def _words_struct(t: Column) -> Column:
    # bound inside the expression: a filter that Catalyst pushes below must not put the split into a lambda's body
    return _once(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))


def _lines_struct(t: Column) -> Column:
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(BLANK))) > 0)
    return _once(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


@dataclass(frozen=True)
class Feature:
    #: From the text to the feature.
    value: Callable[[Column], Column]
    #: How many times its characters are read.
    weight: float


#: What words and lines are split for comes together, so one of a pair is as costly as both.
FEATURES = {
    "n_words": Feature(lambda t: F.size(words(t)).cast("long"), 3),
    "word_chars": Feature(lambda t: F.length(F.translate(t, BLANK, "")).cast("long"), 1),
    "n_symbols": Feature(lambda t: (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"), 1),
    "n_lines": Feature(lambda t: _lines_struct(t)["n_lines"], 2),
    "n_dup_lines": Feature(lambda t: _lines_struct(t)["n_dup_lines"], 2),
    "n_repeat_words": Feature(lambda t: _words_struct(t)["n_repeat_words"], 8),
    "n_chars": Feature(lambda t: F.length(t).cast("long"), 0.1),
    "n_capitals": Feature(lambda t: (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))).cast("long"), 4),
    "n_other_signs": Feature(lambda t: (F.length(F.regexp_replace(t, r"[\p{L}\p{M}]+", "")) - (F.length(t) - F.length(F.translate(t, BLANK, "")))).cast("long"), 6),
}
WANTED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", wanted: tuple[str, ...] = WANTED) -> DataFrame:
    """doc_id, text (empty for null) and the wanted features, in one pass."""
    t = F.col("text")
    df = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared = {"_w": (_words_struct, ("n_words", "n_repeat_words")), "_l": (_lines_struct, ("n_lines", "n_dup_lines"))}
    # both of a pair from one split; a single cheap one by its own expression
    use = {c: name for name, (_, pair) in shared.items() for c in pair if c in wanted and ("n_repeat_words" in wanted if name == "_w" else True)}
    df = df.select("doc_id", "text", *[shared[n][0](t).alias(n) for n in sorted(set(use.values()))], *[FEATURES[c].value(t).alias(c) for c in wanted if c not in use])
    return df.select("doc_id", "text", *[F.col(f"{use[c]}.{c}") if c in use else F.col(c) for c in wanted])


@dataclass(frozen=True)
class Rule:
    name: str
    #: The features it reads.
    reads: tuple[str, ...]
    #: True where the document goes; from the features, in order.
    rejects: Callable[..., Column]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """More than a symbol per ten words; mean word length out of 3 to 15; over 40 % of lines repeat; over 30 % capitals; under half of the characters are letters."""
    return [
        Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
        Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 3 * n) | (c > 15 * n)),
        Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 100 * d > 40 * n),
        Rule("capitals", ("n_capitals", "word_chars"), lambda c, n: 100 * c > 30 * n),
        Rule("letters", ("n_other_signs", "word_chars"), lambda o, n: 2 * o > n),
    ]


def _value(name: str, have: set[str]) -> Column:
    return F.col(name) if name in have else FEATURES[name].value(F.col("text"))


#: Work of comparing features that are there, in characters.
COMPARE = 1.0


def order_rules(docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text", sample: int = SAMPLE, wanted: tuple[str, ...] = WANTED) -> list[Rule]:
    """The rules by rejections per cost on about ``sample`` rows; ties stay in the order given."""
    n = docs.count()
    if not n or len(rules) < 2:
        return list(rules)
    some = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).sample(min(1.0, sample / n), seed=17)
    base = tuple(dict.fromkeys((*wanted, "n_words", "n_repeat_words")))
    some = features(some, wanted=base).filter(~base_failed())
    # five truth values and a length a row, of a bounded number of rows
    rows = some.select(F.length("text").alias("n"), *[F.coalesce(r.rejects(*(_value(c, set(base)) for c in r.reads)), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]).collect()
    return ordered(rules, [tuple(r) for r in rows], set(wanted))


def ordered(rules: list[Rule], rows: list[tuple], have: set[str]) -> list[Rule]:
    """Greedy order from rows of (characters, whether each rule rejects); ``have`` are the features that cost nothing."""
    left, out, have = list(range(len(rules))), [], set(have)
    while left:
        chars = sum(r[0] for r in rows)

        def gain(i):
            weight = sum(FEATURES[c].weight for c in rules[i].reads if c not in have)
            return sum(r[i + 1] for r in rows) / (COMPARE * max(1, len(rows)) + weight * chars)

        best = max(left, key=lambda i: (gain(i), -i))
        out.append(rules[best])
        left.remove(best)
        have |= set(rules[best].reads)
        rows = [r for r in rows if not r[best + 1]]
    return out


def cascade(docs: DataFrame, rules: list[Rule] | None = None, key: str = "doc_id", text: str = "text", wanted: tuple[str, ...] = WANTED) -> DataFrame:
    """doc_id, text, the wanted features, base_failed and kept."""
    have = set(wanted) | {"n_words", "n_repeat_words"}
    df = features(docs, key, text, tuple(dict.fromkeys((*wanted, "n_words", "n_repeat_words")))).withColumn("base_failed", base_failed())
    verdict = F.when(F.col("base_failed"), False)
    for r in order_rules(docs, default_rules() if rules is None else rules, key, text, wanted=wanted):
        verdict = verdict.when(r.rejects(*(_value(c, have) for c in r.reads)), False)
    return df.select("doc_id", "text", *wanted, "base_failed", verdict.otherwise(True).alias("kept"))
