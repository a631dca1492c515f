"""Text expressions. Everything here is a Column; only the composition of non-ASCII texts leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F, types as T

# The characters Python's str.strip() and \s take as white space, for trim and as a
# regex class. (?U) makes Java's \s the Unicode property, which lacks the four separators; \w is
# spelled out, since Java's Unicode form also takes combining marks.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS_SET = r"\s\x1c-\x1f"
WS = f"(?U)[{WS_SET}]"
NON_WS = f"[^{WS_SET}]"
WORD_SET = r"\p{L}\p{N}_"

# What counts as markup, a URL and an e-mail address.
EMAIL_TLDS = "com|net|org|edu|vn|io|gov|info"
URL = rf"(?U)https?://{NON_WS}+|www\.{NON_WS}+"
# Two patterns are written so that one pass over the text is enough, whatever it holds:
# * an unclosed "<" keeps its text by group 1 and ends the search, so a run of "<" is not rescanned;
# * an address always starts at the start of a run of non-blanks and its first "@" decides,
#   so the run is neither retried from each character nor from each "@".
HTML = r"<[^>]++>|(<[^>]*+)\z"
EMAIL = rf"(?U)(?<!{NON_WS}){NON_WS}[^@{WS_SET}]*+@{NON_WS}+\.(?:{EMAIL_TLDS})"


def fill_text(col: Column) -> Column:
    """Null to the empty string, everything else to text."""
    return F.coalesce(col.cast("string"), F.lit(""))


def _compose(col: Column) -> Column:
    # a nested function travels by value, so executors need no package on their path for it
    def compose(texts):
        import unicodedata

        import pyarrow as pa

        def some(part):
            return pa.array([t and unicodedata.normalize("NFC", t) for t in part.to_pylist()], pa.string())

        # few texts are Python strings at a time, whatever a batch holds
        parts = [some(texts.slice(i, 256)) for i in range(0, len(texts), 256)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.arrow_udf(compose, T.StringType())(col)


def nfc(col: Column, source: Column | None = None) -> Column:
    """Unicode NFC of a text that is not null. Spark has no such function: non-ASCII texts go through Arrow, the others stay.

    Deterministic, so filters are pushed below it. ``source`` is a stored column that ``col`` is made from without adding
    characters: where it is ASCII, so is ``col``, and an expensive ``col`` is computed once per row, on one branch or the other.
    """
    source = col if source is None else source
    return F.coalesce(_compose(F.when(F.octet_length(source) != F.char_length(source), col)), col)


def collapse_ws(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, f"{WS}+", " "))


def strip_ws(col: Column) -> Column:
    return F.trim(col, F.lit(WS_CHARS))


def normalize_ws(col: Column) -> Column:
    """Null to "", NFC, white space collapsed and stripped."""
    return collapse_ws(nfc(fill_text(col)))


def _let(col: Column, fn) -> Column:
    """Evaluate ``col`` once and hand its value to ``fn``, which may use it several times."""
    return F.transform(F.array(col), fn)[0]


def _replace_where(col: Column, marks: list[str], pattern: str, to: str) -> Column:
    """Replace only in texts that hold one of the marks: a plain byte search spares most texts the regex."""
    return _let(col, lambda s: F.when(
        reduce(lambda a, b: a | b, [s.contains(m) for m in marks]), F.regexp_replace(s, pattern, to)
    ).otherwise(s))


def clean_text(col: Column) -> Column:
    """Line breaks, markup, URLs and e-mail addresses become one space each, then normalize_ws."""
    raw = fill_text(col)
    s = F.replace(F.replace(raw, F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    s = _replace_where(s, ["<"], HTML, "$1 ")
    s = _replace_where(s, ["http", "www."], URL, " ")
    s = _replace_where(s, ["@"], EMAIL, " ")
    return collapse_ws(nfc(s, raw))


def words(col: Column, min_len: int = 1) -> Column:
    """All maximal runs of at least ``min_len`` word characters."""
    return F.regexp_extract_all(col, F.lit(f"[{WORD_SET}]{{{min_len},}}"), F.lit(0))


def simple_tokenize(col: Column) -> Column:
    """Word runs of the normalised, lower-cased text (collapsing white space would not change them)."""
    return words(F.lower(nfc(fill_text(col))))


def ws_tokenize(col: Column) -> Column:
    """White-space tokens; the empty string has none."""
    return F.array_remove(F.split(collapse_ws(fill_text(col)), " "), "")


def clean_token_len(col: Column) -> Column:
    """Token count of a text whose white space is already collapsed: no token array is built."""
    gaps = F.length(col) - F.length(F.replace(col, F.lit(" "), F.lit("")))
    return F.when(col == "", 0).otherwise(gaps + 1)


# The marker form and the three prompt texts below, as models were trained on them.


def serialize_triplet(context: Column, prompt: Column, response: Column) -> Column:
    """Join three normalised texts with the marker tokens."""
    return F.format_string("[CLS] %s [SEP] %s [SEP] %s [SEP]", context, prompt, response)


def judge_prompt(context: Column, prompt: Column, response: Column) -> Column:
    return F.format_string(
        "Context: %s\nQuestion: %s\nModel Answer: %s\n"
        "Is the model answer hallucinated based on the context? (Yes/No):",
        context, prompt, response,
    )


def answer_prompt(context: Column, prompt: Column) -> Column:
    return F.format_string(
        "Context: %s\nQuestion: %s\n"
        "Answer the question based on the context. Keep your answer brief.\nAnswer:",
        context, prompt,
    )


def reflection_prompt(claim: Column, evidence: Column) -> Column:
    return F.format_string(
        "Claim: %s\nEvidence: %s\n"
        "Based on the evidence, is the claim a hallucination? Think step-by-step.",
        claim, evidence,
    )


def run_name(model: Column, max_length: Column) -> Column:
    safe = F.regexp_replace(model, "[^A-Za-z0-9_.-]+", "_")
    return F.concat(F.trim(safe, F.lit("_")), F.lit("_len"), max_length.cast("string"))


def resolve_text_mode(model: Column, mode: str = "auto") -> Column:
    if mode != "auto":
        return F.lit(mode)
    return F.when(F.lower(model).contains("phobert"), "word_segmented").otherwise("raw")


def contains_any(col: Column, cues: list[str]) -> Column:
    """1 where the lower-cased text has any cue as a substring, else 0."""
    low = F.lower(col)
    return reduce(lambda a, b: a | b, [low.contains(c) for c in cues], F.lit(False)).cast("int")


def claims(col: Column) -> Column:
    """Array of the non-empty pieces between full stops, stripped, in order."""
    return F.array_remove(F.transform(F.split(fill_text(col), r"\."), strip_ws), "")
