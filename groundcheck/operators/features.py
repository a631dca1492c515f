"""Row-level features of a triplet table: single projections, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import overlap as ov, proba as pr, text as tx
from ..schema import EXTRINSIC_HINTS, NEGATION_CUES, NEGATION_WORDS, RULE_FEATURES


def rule_features(
    df: DataFrame,
    negation_cues: list[str] = NEGATION_CUES,
    extrinsic_hints: list[str] = EXTRINSIC_HINTS,
    normalize: bool = False,
) -> DataFrame:
    """Add the five rule features. Tokens are computed once, in a projection of their own.

    Cues are looked up in the text as it is; ``normalize`` composes it first, so that decomposed
    text is not missed.
    """
    cue_text = (lambda c: tx.nfc(tx.fill_text(F.col(c)))) if normalize else (lambda c: tx.fill_text(F.col(c)))
    tokens = df.withColumns({
        "_c": tx.simple_tokenize(F.col("context")),
        "_p": tx.simple_tokenize(F.col("prompt")),
        "_r": tx.simple_tokenize(F.col("response")),
        "_neg_c": tx.contains_any(cue_text("context"), negation_cues),
        "_neg_r": tx.contains_any(cue_text("response"), negation_cues),
        "_hint": tx.contains_any(cue_text("response"), extrinsic_hints),
    })
    return tokens.withColumns({
        "overlap_ctx_resp": ov.jaccard(F.col("_c"), F.col("_r")),
        "overlap_prompt_resp": ov.jaccard(F.col("_p"), F.col("_r")),
        "neg_mismatch": (F.col("_neg_c") != F.col("_neg_r")).cast("double"),
        "extrinsic_hint": F.col("_hint").cast("double"),
        "response_length_ratio": F.size("_r") / F.greatest(F.size("_c"), F.lit(1)),
    }).drop("_c", "_p", "_r", "_neg_c", "_neg_r", "_hint")


def rule_proba(features: DataFrame) -> DataFrame:
    """Add ``proba`` from the rule features."""
    return features.withColumn("proba", pr.rule_proba(*[F.col(c) for c in RULE_FEATURES[:4]]))


def handcrafted_features(df: DataFrame, negation_words: list[str] = NEGATION_WORDS) -> DataFrame:
    """Add the nine handcrafted columns to a preprocessed table."""
    tokens = df.withColumns({
        **{f"_{c}": F.array_remove(F.split(F.lower(f"{c}_clean"), " "), "") for c in ("context", "prompt", "response")},
        "_prompt_tok": tx.ws_tokenize(F.lower("prompt_tok")),
    })
    counted = tokens.withColumns({
        f"{c}_word_count": tx.clean_token_len(F.col(f"{c}_clean")) for c in ("context", "prompt", "response")
    })
    words = F.array(*[F.lit(w) for w in negation_words])
    r = F.col("response_word_count")
    return counted.withColumns({
        "resp_ctx_ratio": r / (F.col("context_word_count") + 1),
        "resp_prompt_ratio": r / (F.col("prompt_word_count") + 1),
        "resp_ctx_overlap": ov.jaccard(F.col("_response"), F.col("_context")),
        "resp_prompt_overlap": ov.jaccard(F.col("_response"), F.col("_prompt")),
        "has_question": tx.fill_text(F.col("prompt")).contains("?").cast("int"),
        "has_neg_prompt": F.arrays_overlap(F.col("_prompt_tok"), words).cast("int"),
    }).drop("_context", "_prompt", "_response", "_prompt_tok")


def ngram_overlap(df: DataFrame, column_a: str = "context", column_b: str = "response") -> DataFrame:
    """Add the 1-gram and 2-gram containment of column_b in column_a (white-space tokens, case kept)."""
    tokens = df.withColumns({"_a": tx.ws_tokenize(F.col(column_a)), "_b": tx.ws_tokenize(F.col(column_b))})
    return tokens.withColumns({
        "overlap_1gram": ov.containment(F.col("_a"), F.col("_b"), 1),
        "overlap_2gram": ov.containment(F.col("_a"), F.col("_b"), 2),
    }).drop("_a", "_b")
