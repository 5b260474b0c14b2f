"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is one expression over the text. A sample gives each rule's cost (work on its characters, words and lines) and
its selectivity (share that it rejects); rules then run in order of rejection per cost inside one CASE, which stops at the
first that rejects. The order changes what is spent, never the verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SEPARATOR_CLASS, require

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATOR_CLASS + "+"), "")


def repeat_words(words: Column, width: int = 5) -> Column:
    """How many words stand in a window of ``width`` words that is found twice or more, the first included.

    Windows are compared by 64-bit hash. Texts without a repeated window end at the distinct count; the others sort
    (hash, place) and add up the lengths that the repeated windows cover.
    """

    def covered(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            return F.sort_array(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, i + 1)["h"]).eqNullSafe(True)), lambda x: x["i"]))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(ordered, lambda s: let(places(s), length))

    grams = F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))).otherwise(F.array().cast("array<bigint>"))
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def lines_with_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")


def without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, "")).cast("long")


def word_chars(text: Column) -> Column:
    return without(text, _SPACES)


def n_symbols(text: Column) -> Column:
    return F.length(text).cast("long") - without(text, SYMBOLS)


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base columns of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    staged = require(docs, "doc_id", "text").withColumn("text", text).withColumn("counted", counted)
    staged = staged.select("doc_id", "text", "counted.n_words", word_chars(F.col("text")).alias("word_chars"), n_symbols(F.col("text")).alias("n_symbols"), duplicate_lines(F.col("text")).alias("n_dup_lines"), "counted.n_repeat_words")
    return staged.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def rules(text: Column) -> dict[str, Column]:
    """Each rule's rejection as one expression over the text; never null."""
    n = let(words_of(text), lambda w: F.size(w).cast("long"))
    solid = word_chars(text)
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "few_words": n < 10,
        "repetition": let(words_of(text), lambda w: 100 * repeat_words(w) > 20 * F.size(w)),
        "word_length": let(n, lambda k: (solid < 2 * k) | (solid > 20 * k)),
        "symbols": let(n, lambda k: 10 * n_symbols(text) > 3 * k),
        "repeated_lines": 10 * duplicate_lines(text) > 3 * lines_with_words(text),
        "capitals": 10 * upper > 6 * solid,
        "exclamations": let(n, lambda k: 10 * (F.length(text) - without(text, "!")) > 5 * k),
    }


def work(text: Column) -> dict[str, Column]:
    """What each rule costs on a text, in passes over its characters, words and lines: a split by a pattern reads a
    character as dearly as four plain passes, a window of words costs a hash of five and a place in a sort."""
    chars, words = F.length(text), F.size(F.split(text, " "))
    split, passes = 4 * chars, 2 * chars
    return {
        "few_words": split,
        "repetition": split + 40 * words,
        "word_length": split + passes,
        "symbols": split + 2 * passes,
        "repeated_lines": 2 * split + passes,
        "capitals": 2 * passes,
        "exclamations": split + passes,
    }


def order_rules(docs: DataFrame, named: dict[str, Column], costs: dict[str, Column], sample_rows: int = 2000) -> list[str]:
    """Rules by rejection per cost, best first; equal ones by name.

    A random sample of some ``sample_rows`` rows from all over the table, drawn with a fixed seed, gives both in one
    aggregate; costs are work done, not time taken, so that the same table gives the same order.
    """
    n = docs.count()
    sample = docs.sample(min(1.0, sample_rows / max(n, 1)), seed=42) if n > sample_rows else docs
    sums = [F.sum(rejects.cast("long")).alias(f"r_{name}") for name, rejects in named.items()]
    sums += [F.sum(costs[name].cast("long")).alias(f"c_{name}") for name in named]
    got = sample.agg(F.count("*").alias("n"), *sums).first()
    score = {name: (float(got[f"r_{name}"] or 0) + 0.5) / (got["n"] + 1) / max(float(got[f"c_{name}"] or 0), 1.0) for name in named}
    return sorted(named, key=lambda name: (-score[name], name))


def cascade(named: dict[str, Column], order: list[str]) -> Column:
    """True where no rule rejects; stops at the first that does."""
    out = None
    for name in order:
        out = F.when(named[name], False) if out is None else out.when(named[name], False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame) -> DataFrame:
    """The base columns and ``kept`` for every row of ``docs`` (doc_id, text).

    A null text is the empty text: no words, so base_failed. Rows that repeat a doc_id are judged alone; an empty
    table gives an empty result.
    """
    base = base_features(docs)
    # What the base columns already hold is not computed again; looking it up costs next to nothing.
    n, at = F.col("n_words"), {"few_words": F.lit(False), "repetition": F.lit(False)}
    at |= {"word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n), "symbols": 10 * F.col("n_symbols") > 3 * n}
    named = rules(F.col("text")) | at
    costs = work(F.col("text")) | {name: F.lit(1) for name in at}
    text = F.coalesce("text", F.lit(""))
    staged = require(docs, "text").select(text.alias("text"))
    counts = staged.select("text", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), word_chars(F.col("text")).alias("word_chars"), n_symbols(F.col("text")).alias("n_symbols"))
    order = order_rules(counts, named, costs)
    verdict = cascade(named, order)
    return base.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict)).drop("text")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all their columns, whatever their names.

    Null and empty texts have too few words and go; rows without a doc_id and rows that share one are judged by their own
    texts; an empty table gives an empty one.
    """
    names = docs.columns
    placed = docs.toDF(*[f"_{i}" for i in range(len(names))])
    text = F.coalesce(F.col(f"_{names.index('text')}"), F.lit(""))
    named = rules(text)
    return placed.where(cascade(named, order_rules(placed, named, work(text)))).toDF(*names)
