"""Triplet, sample, probe and run tables derived from the test tables (see FIXTURES.md, part D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..functions.overlap import ngrams
from ..operators.preprocess import LONGEST_COMPOUND
from ..session import spread

# Cues that occur in the invented languages of the test tables.
CUES = ["nicht", "pas", "sin"]
HINTS = ["viel", "theth", "onre"]
WORDS = ["nicht", "pas", "onre"]

DOTTED = tx.WS_CHARS + "."


# The text tables and their unique keys.
TEXT_KEYS = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the text tables are spread where one small file holds them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, *TEXT_KEYS[name]) if name in TEXT_KEYS else df


def _logits(doc_id: Column, n_chars: Column, a: int, b: int, mod: int, scale: float) -> Column:
    return F.array(*[((doc_id * (a + j) + n_chars * (b + 2 * j)) % mod) / scale for j in range(3)])


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: the text as context, its first and last sentence as prompt and response. No label."""
    return _sentences(table(spark, sf_dir, "documents"))


def text_logits(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``classical_logits`` and ``transformer_logits`` of every document, without labels."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", "n_chars")
    return {
        "classical": docs.select("id", _logits(F.col("doc_id"), F.col("n_chars"), 7, 3, 101, 25.0).alias("logits")),
        "transformer": docs.select("id", _logits(F.col("doc_id"), F.col("n_chars"), 5, 11, 97, 20.0).alias("logits")),
    }


def _sentences(docs: DataFrame, *more: Column | str) -> DataFrame:
    first = F.substring_index(F.ltrim(F.col("text"), F.lit(DOTTED)), ".", 1)
    last = F.substring_index(F.rtrim(F.col("text"), F.lit(DOTTED)), ".", -1)
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("context"),
        F.rtrim(first, F.lit(tx.WS_CHARS)).alias("prompt"),
        F.ltrim(last, F.lit(tx.WS_CHARS)).alias("response"),
        *more,
    )


def labelled_triplets(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """``texts`` of the documents that have labels; with ``how`` left of all documents, the others without a label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumn("_known", F.lit(True))
    label = F.when(F.col("toxic") == 1, "extrinsic").when(F.col("quality") == 0, "intrinsic").when(F.col("_known"), "no")
    return _sentences(docs.join(labels, "doc_id", how), label.alias("label"), "doc_id", "n_chars")


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_triplets(spark, sf_dir).drop("doc_id", "n_chars")


def all_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triplets of every document, those without a label too."""
    return labelled_triplets(spark, sf_dir, "left").drop("doc_id", "n_chars")


def dialogue_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn, the assistant turn after it, and the turn before it as context.

    Turns are numbered without gaps, so neighbours meet in equi-joins on (conversation, turn); a
    conversation that holds a third of all turns is spread like any other.
    """
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answer = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return user.join(answer, ["conv_id", "turn"]).join(before, ["conv_id", "turn"], "left").select(
        F.concat_ws(":", F.col("conv_id"), F.col("turn")).alias("id"), F.coalesce("context", F.lit("")).alias("context"),
        "prompt", "response",
    )


def classical_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = labelled_triplets(spark, sf_dir)
    return t.select("id", "label", _logits(F.col("doc_id"), F.col("n_chars"), 7, 3, 101, 25.0).alias("logits"))


def transformer_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = labelled_triplets(spark, sf_dir)
    return t.select("id", "label", _logits(F.col("doc_id"), F.col("n_chars"), 5, 11, 97, 20.0).alias("logits"))


def answer_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five answers per prompt: vectors of ``embeddings``, texts of the document with the same number."""
    vectors, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    text = F.when(F.col("vec_id") % 7 == 0, "  ").otherwise(F.col("text"))
    return vectors.join(docs, F.col("vec_id") == F.col("doc_id"), "left").select(
        F.expr("vec_id div 5").cast("string").alias("id"), (F.col("vec_id") % 5).cast("int").alias("sample_idx"),
        text.alias("response"), "embedding",
    )


def sample_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 5").cast("string").alias("id"), (F.col("vec_id") % 5).cast("int").alias("sample_idx"), "embedding"
    )


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ensemble members per prompt."""
    return table(spark, sf_dir, "documents").select(
        F.expr("doc_id div 3").alias("prompt_id"), (F.col("doc_id") % 3).cast("int").alias("member_idx"), "text"
    )


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five token vectors per text, the mask keeps the first 0 to 4 of them."""
    place, group = F.col("vec_id") % 5, F.expr("vec_id div 5")
    return table(spark, sf_dir, "embeddings").select(
        group.cast("string").alias("id"), F.when(place < group % 5, 1).otherwise(0).alias("mask"), "embedding"
    )


def _probe_step() -> Column:
    return F.when(F.col("vec_id") % 2 == 0, "init").otherwise("final")


def probe_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` read as a coordinate table of probe weights, one probe per label and parity."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("layer"), _probe_step().alias("step"), F.col("vec_id").alias("out_dim"),
        F.posexplode("embedding").alias("in_dim", "w"),
    ).withColumn("w", F.col("w").cast("double"))


def probe_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden bias and output weight of every hidden neuron."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("layer"), _probe_step().alias("step"), F.col("vec_id").alias("out_dim"),
        F.get("embedding", F.lit(0)).cast("double").alias("b1"), F.get("embedding", F.lit(1)).cast("double").alias("w2"),
    )


def probe_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe_outputs(spark, sf_dir).groupBy("layer", "step").agg((F.count(F.lit(1)) / 1000.0).alias("b2"))


def hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as the state of one text (20 vectors), layer (10) and step (2)."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 20").cast("string").alias("id"), F.expr("cast((vec_id % 20) div 2 as int)").alias("layer"),
        _probe_step().alias("step"), F.transform("embedding", lambda v: v.cast("double")).alias("h"),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds: the 2- to 4-word runs of the benchmark items."""
    tokens = table(spark, sf_dir, "benchmark").select(tx.ws_tokenize(F.lower(tx.clean_text(F.col("text")))).alias("t"))
    grams = F.concat(*[ngrams(F.col("t"), n, " ") for n in range(2, LONGEST_COMPOUND + 1)])
    return tokens.select(F.explode(grams).alias("compound")).distinct()


def stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lower-cased token that occurs in at least a fifth of the benchmark items."""
    items = table(spark, sf_dir, "benchmark")
    n = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    tokens = items.select("item_id", F.explode(F.array_distinct(tx.ws_tokenize(F.lower("text")))).alias("word"))
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") * 5 >= n).select("word")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two tools say about a claim: the benchmark items, and the documents, that hold it."""
    def holders(name: str, key: str) -> DataFrame:
        source = table(spark, sf_dir, name)
        return source.select(key, F.explode(F.array_distinct(tx.claims(F.col("text")))).alias("claim")).groupBy("claim")

    items = holders("benchmark", "item_id").agg(F.min("item_id").alias("x")).select(
        "claim", F.lit(1).alias("tool_ord"), F.lit("benchmark").alias("tool"), F.concat(F.lit("item "), F.col("x")).alias("result")
    )
    docs = holders("documents", "doc_id").agg(F.count(F.lit(1)).alias("x")).select(
        "claim", F.lit(0).alias("tool_ord"), F.lit("corpus").alias("tool"),
        F.when(F.col("x") > 1, F.concat(F.lit("in "), F.col("x"), F.lit(" documents"))).otherwise("").alias("result"),
    )
    return items.union(docs)


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per source and language; its limit follows from the number of its documents."""
    base = F.when(F.col("lang") == "fr", "team/PhoBERT base ").otherwise("team/xlm base ")
    kind = F.when(F.col("lang") == "fr", "roberta").when(F.col("lang") == "de", "xlm-roberta").otherwise("bert")
    positions = F.when(F.col("lang") != "es", 250 + (F.count(F.lit(1)) * 37) % 300)
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(positions.cast("int").alias("max_position_embeddings")).select(
        F.concat(base, F.col("source"), F.lit("/"), F.col("lang")).alias("model_name"), kind.alias("model_type"), "max_position_embeddings"
    )


def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored scores of the runs of length 256 of the models with an even number of documents."""
    docs = table(spark, sf_dir, "documents")
    base = F.when(F.col("lang") == "fr", "team/PhoBERT base ").otherwise("team/xlm base ")
    groups = docs.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("n_chars") % 100).alias("a"), F.avg(F.col("n_chars") % 50).alias("b"),
        F.sum("n_chars").alias("c"),
    )
    return groups.filter("n % 2 = 0").select(
        tx.run_name(F.concat(base, F.col("source"), F.lit("/"), F.col("lang")), F.lit(256)).alias("run_name"),
        F.round(F.col("a") / 100, 6).alias("macro_f1"), F.round(F.col("b") / 50, 6).alias("accuracy"),
        F.when(F.col("lang") != "de", F.round(F.col("c") / 60000.0, 6)).alias("elapsed_minutes"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five epochs per source, with coarse scores so that ties occur."""
    return table(spark, sf_dir, "documents").groupBy(
        F.col("source").alias("run_name"), (F.col("doc_id") % 5).cast("int").alias("epoch")
    ).agg(
        F.round(F.avg(F.col("n_chars") % 10) / 10, 1).alias("val_f1_macro"),
        F.round(F.avg(F.col("n_chars") % 7) / 7, 6).alias("val_acc"),
    )
