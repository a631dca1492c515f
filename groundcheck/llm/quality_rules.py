"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, let, shift_left, shift_right, space_words, without

#: Fixed: the characters counted as symbols.
SYMBOLS = ["#", "*", "$", "%", "&", "|", "<", ">"]
MARKS = ["!", "?"]
#: Very common words of English, German, Spanish and French.
STOP_WORDS = (
    "the of and to in is it that for with on as by this be at are from "
    "der die das und ist von zu mit auf den im nicht ein eine auch für sich des "
    "el la de que los las en un una por para con se del su al es no lo "
    "le les et des est du dans pour qui une par sur au pas ce il elle"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= metric <= high``; metric is a column of ``measures`` or a ratio of two."""

    name: str
    top: str
    bottom: str | None
    low: float
    high: float

    def column(self) -> Column:
        top = F.col(self.top).cast("double")
        return top if self.bottom is None else F.coalesce(F.try_divide(top, F.col(self.bottom).cast("double")), F.lit(0.0))

    def passed(self) -> Column:
        return self.column().between(self.low, self.high)


#: The base rules come first; a document that fails one of them is never kept.
BASE_RULES = [Rule("length", "n_words", None, 50, float("inf")), Rule("repeats", "n_repeat_words", "n_words", 0.0, 0.5)]
RULES = [
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.25),
    Rule("marks", "n_marks", "n_words", 0.0, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, 0.95),
    Rule("line_repeats", "n_dup_lines", "n_lines", 0.0, 0.5),
]


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first one included; each word counts once.

    A window is a number: its hash above, its place in the low bits, as many as the text needs. One sort
    brings equal windows together; neighbours with the same hash are compared word by word.
    """

    def count(words: Column, bits: Column) -> Column:
        mask = shift_left(F.lit(1).cast("long"), bits) - 1
        word = lambda i: F.get(words, i.cast("int"))
        window = lambda i: shift_left(F.xxhash64(word(i), word(i + 1), word(i + 2)), bits).bitwiseOR(i.cast("long"))

        def same(x: Column, y: Column) -> Column:
            p, q = x.bitwiseAND(mask), y.bitwiseAND(mask)
            near = shift_right(x, bits) == shift_right(y, bits)
            return F.coalesce(near & (word(p) == word(q)) & (word(p + 1) == word(q + 1)) & (word(p + 2) == word(q + 2)), F.lit(False))

        def covered(keys: Column) -> Column:
            again = F.filter(keys, lambda x, j: same(x, F.get(keys, j + 1)) | same(x, F.get(keys, j - 1)))
            places = F.sort_array(F.transform(again, lambda x: x.bitwiseAND(mask)))
            start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
            step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("n"))
            return F.aggregate(places, start, step, lambda acc: acc["n"])

        return let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)), covered)

    bits = F.length(F.bin(F.size(words).cast("long")))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(bits, lambda b: count(words, b)))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``_m``: n_words, word_chars, n_symbols, n_marks, n_stop_words, n_lines, n_dup_lines, n_repeat_words.

    Words are split once per row; all counts of a row come from that one array, in one projection. A null
    text has no words and no lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda marks: (F.octet_length(text) - F.octet_length(without(text, marks))).cast("long")  # noqa: E731  (ASCII only)
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit("[^ \\t-\\r]")))

    def of_words(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(without(text, SPACES)).cast("long").alias("word_chars"),
            count(SYMBOLS).alias("n_symbols"),
            count(MARKS).alias("n_marks"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
        )

    return docs.withColumn("_m", let(space_words(text), lambda w: let(lines, lambda x: of_words(w, x))))


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES, base: list[Rule] = BASE_RULES
) -> DataFrame:
    """One row per document: ``id_col``, the measures, base_failed, failed_rules, kept. No shuffle, no user function.

    Rows stay as they are, repeated ones too; an empty or null text fails ``length``. Columns of ``docs`` other than the two named are not read.
    """
    rows = measures(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text").select("_id", "_m.*")
    failed = F.array_compact(F.array(*[F.when(~r.passed(), F.lit(r.name)) for r in [*base, *rules]]))
    base_failed = ~reduce(lambda a, b: a & b, [r.passed() for r in base])
    return rows.select("*", base_failed.alias("base_failed"), failed.alias("failed_rules")).select(
        F.col("_id").alias(id_col), *[c for c in rows.columns if c != "_id"], "base_failed", "failed_rules",
        (F.size("failed_rules") == 0).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES, base: list[Rule] = BASE_RULES) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with their own columns. Needs no id: a row is judged by its text."""
    rows = measures(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("_text")), "_text").select("row", "_m.*")
    return rows.filter(reduce(lambda a, b: a & b, [r.passed() for r in [*base, *rules]])).select("row.*")
