"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per document; its failure is one bit of `fail_bits`, and the measurements behind it are
kept beside it.  A policy is a named, versioned set of rules, applied to the ledger as a mask without reading a text
again.  Ablations come from an aggregation of the distinct masks, of which there are at most 2 ** (number of rules).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body and its lambdas use it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(w: Column) -> Column:
    """Words of windows of WINDOW words that occur twice or more among these words."""

    def covered(hashes: Column) -> Column:
        marked = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def spread(s: Column) -> Column:
            after = F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0)))
            # neighbours in hash order that agree; both of their places are repeats
            both = F.zip_with(s, after, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            places = F.array_sort(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))
            return _let(places, lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda n, x: n + x))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(F.array_sort(marked), spread))

    windows = F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(_let(windows, covered)).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds m, a struct of all measurements of the whole text, in one pass.  Null text: no words, no lines."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    symbols = whole
    for c in SYMBOLS:
        symbols = F.replace(symbols, F.lit(c))

    def of(w: Column) -> Column:
        chars = F.length(F.array_join(w, ""))

        def lines(found: Column) -> list[Column]:
            return F.struct(F.size(found).cast("long").alias("n"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("dup"))

        by_line = _let(F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lines)
        capitals = F.filter(w, lambda x: x == F.upper(x))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            (F.length(whole) - F.length(symbols)).cast("long").alias("n_symbols"),
            by_line.alias("lines"),
            _repeat_words(w).alias("n_repeat_words"),
            _let(capitals, lambda c: F.struct(F.size(c).cast("long").alias("capital"), F.size(F.filter(c, lambda x: x == F.lower(x))).cast("long").alias("letterless"))).alias("case"),
        )

    m = _let(F.array_remove(F.split(whole, SPACE), ""), of)
    flat = docs.withColumn("m", m)
    names = ["n_words", "word_chars", "n_symbols", "n_repeat_words"]
    return flat.withColumn("m", F.struct(*[F.col(f"m.{n}") for n in names], F.col("m.lines.n").alias("n_lines"), F.col("m.lines.dup").alias("n_dup_lines"), F.col("m.case.capital").alias("n_capital"), F.col("m.case.letterless").alias("n_letterless")))


def _m(name: str) -> Column:
    return F.col(f"m.{name}")


#: Name and failure of each rule; its place in this list is its bit, so rules are only ever appended.
RULES: list[tuple[str, Callable[[], Column]]] = [
    ("few_words", lambda: _m("n_words") < 20),
    ("repeated_windows", lambda: 100 * _m("n_repeat_words") > 30 * _m("n_words")),
    ("symbols", lambda: 10 * _m("n_symbols") > _m("n_words")),
    ("repeated_lines", lambda: 100 * _m("n_dup_lines") > 30 * _m("n_lines")),
    ("short_words", lambda: _m("word_chars") < 2 * _m("n_words")),
    ("long_words", lambda: _m("word_chars") > 14 * _m("n_words")),
    ("capitals", lambda: 2 * (_m("n_capital") - _m("n_letterless")) > _m("n_words")),
    ("letterless", lambda: 5 * _m("n_letterless") > 2 * _m("n_words")),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versions are fixed once used: a change is a new name.
POLICIES: dict[str, tuple[str, ...]] = {"base-1": ("few_words", "repeated_windows"), "prose-1": tuple(BITS)}


def mask(policy: str | Sequence[str]) -> int:
    return sum(BITS[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds m (measurements) and fail_bits (one bit for each rule that the document fails).

    A text without words fails few_words alone; a very long text is measured whole.  Columns named m and fail_bits are replaced; all others, and repeated rows, stay.
    """
    bits = F.lit(0).cast("long")
    for name, failed in RULES:
        bits = bits + F.when(failed(), F.lit(BITS[name])).otherwise(F.lit(0))
    return measure(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("m", "fail_bits")]), text).withColumn("fail_bits", bits)


def passes(policy: str | Sequence[str]) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(kept: DataFrame, policy: str | Sequence[str]) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that only it drops, rows kept with the policy and without the rule."""
    own = mask(policy)
    masks = kept.groupBy(F.col("fail_bits").bitwiseAND(F.lit(own)).alias("bits")).agg(F.count("*").alias("n"))
    names = [n for n in BITS if BITS[n] & own]
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BITS[n]).cast("long").alias("bit")) for n in names])
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    rows = masks.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule").agg(total(hit).alias("failed"), total(F.col("bits") == F.col("bit")).alias("only_this"), total(F.col("bits") == 0).alias("kept"), total((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("kept_without"))
