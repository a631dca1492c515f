"""Column names, label domain, table schemas and fixed parameter lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

ID = "id"
TEXT_COLUMNS = ["context", "prompt", "response"]
LABEL = "label"
PREDICTED = "predict_label"

# The label domain in id order (0, 1, 2) and in the order EDA reports use.
LABELS = ["no", "intrinsic", "extrinsic"]
EDA_LABEL_ORDER = ["no", "extrinsic", "intrinsic"]

# Negation cues (substring test) and hedging phrases (substring test).
NEGATION_CUES = ["không", "chưa", "chẳng", "khỏi", "chả"]
EXTRINSIC_HINTS = ["ngoài ra", "bên cạnh đó", "có thể", "dường như", "nhiều nguồn", "theo một số"]

# Negation words of the prompt flag (whole-token test).
NEGATION_WORDS = ["khong", "chang", "chua", "sai", "dung", "không", "chẳng", "chưa"]

# Cell texts a CSV reader of the pandas family takes as missing.
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Preprocessing methods, and what each does to the token column.
SEGMENTING_METHODS = ["baseline", "phobert", "hybrid"]
PROMPTING_METHODS = ["llm", "semantic_entropy", "mhad", "halu_agent"]
METHODS = SEGMENTING_METHODS + ["xlm-roberta"] + PROMPTING_METHODS

# Starting blend weights (classical, transformer, rule).
DEFAULT_BLEND = (0.40, 0.50, 0.10)

# The names of the feature columns, in their order.
RULE_FEATURES = [
    "overlap_ctx_resp", "overlap_prompt_resp", "neg_mismatch", "extrinsic_hint", "response_length_ratio",
]
HANDCRAFTED_FEATURES = [
    "context_word_count", "prompt_word_count", "response_word_count",
    "resp_ctx_ratio", "resp_prompt_ratio",
    "resp_ctx_overlap", "resp_prompt_overlap",
    "has_question", "has_neg_prompt",
]


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


TRAIN_SCHEMA = _strings(ID, *TEXT_COLUMNS, LABEL)
TEST_SCHEMA = _strings(ID, *TEXT_COLUMNS)


def label_to_id(label: Column) -> Column:
    """Label text to its id in domain order; NULL outside the domain."""
    expr = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(LABELS))):
        expr = F.when(label == name, F.lit(i)).otherwise(expr)
    return expr


def id_to_label(label_id: Column) -> Column:
    expr = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(LABELS))):
        expr = F.when(label_id == i, F.lit(name)).otherwise(expr)
    return expr
