"""Semantic entropy, claims, ensembles and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import proba as pr, vectors as vec
from ..operators import claims as cl, entropy as en, evaluate as ev, probes as pb
from ..sources import fixtures as fx
from . import oracle as o
from .oracle import sql
from .registry import big, joined, query, r6

TAU = 0.1
LAYERS = list(range(10))

# one step per sample: the first center that is near enough, else the sample itself
CLUSTERS = [f"""folds AS (
  SELECT id, 0 AS i, [0] AS centers, [0] AS state FROM samples WHERE sample_idx = 0
  UNION ALL
  SELECT f.id, f.i + 1, CASE WHEN hit IS NULL THEN list_append(centers, f.i + 1) ELSE centers END,
    list_append(state, coalesce(hit, f.i + 1))
  FROM (
    SELECT f.id, f.i, f.centers, f.state, (
      SELECT min(c.sample_idx) FROM samples c
      WHERE c.id = f.id AND list_contains(f.centers, c.sample_idx) AND list_cosine_similarity(c.e, s.e) >= {TAU}) AS hit
    FROM folds f JOIN samples s ON s.id = f.id AND s.sample_idx = f.i + 1) f)""",
    "clusters AS (SELECT id, generate_subscripts(state, 1) - 1 AS sample_idx, unnest(state) AS center_idx FROM folds WHERE i = 4)",
    "sizes AS (SELECT id, center_idx, count(*) AS n FROM clusters GROUP BY ALL)",
    "entropies AS (SELECT id, sum(n) AS n_samples, count(*) AS n_clusters, sum(-(n / 5) * ln(n / 5 + 1e-9)) AS semantic_entropy FROM sizes GROUP BY id)",
]


@query("cosine", sql(["samples"], """
SELECT a.id, a.sample_idx, round(list_cosine_similarity(a.e, b.e), 6) AS cosine
FROM samples a JOIN samples b ON a.id = b.id AND b.sample_idx = a.sample_idx + 1"""))
def cosine(spark, sf):
    s = fx.sample_vectors(spark, sf).withColumn("norm", vec.norm(F.col("embedding")))
    following = s.select("id", (F.col("sample_idx") - 1).alias("sample_idx"), F.col("embedding").alias("b"), F.col("norm").alias("nb"))
    pairs = s.join(following, ["id", "sample_idx"])
    return pairs.select("id", "sample_idx", r6(vec.cosine(F.col("embedding"), F.col("b"), F.col("norm"), F.col("nb")), "cosine"))


@query("mean_pool", f"""
WITH t AS (
  SELECT CAST(vec_id // 5 AS VARCHAR) AS id, CASE WHEN vec_id % 5 < (vec_id // 5) % 5 THEN 1 ELSE 0 END AS mask,
    generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT id, CAST(dim AS BIGINT) AS dim, round(sum(x * mask) / greatest(sum(mask), 1e-9), 6) AS value FROM t GROUP BY id, dim""")
def mean_pool(spark, sf):
    pooled = en.mean_pool(fx.token_vectors(spark, sf)).select("id", F.posexplode("embedding").alias("dim", "value"))
    return pooled.select("id", big("dim"), r6("value"))


@query("collect_samples", f"""
SELECT CAST(vec_id // 5 AS VARCHAR) AS id, string_agg(CASE WHEN vec_id % 7 = 0 OR text IS NULL OR {o.strip('text')} = '' THEN ' ' ELSE {o.strip('text')} END, chr(9247) ORDER BY vec_id) AS answers
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id GROUP BY 1""")
def collect_samples(spark, sf):
    return cl.collect_samples(fx.answer_samples(spark, sf)).select("id", joined("generated_responses", "answers"))


@query("greedy_cluster", sql(["samples"], "SELECT id, CAST(sample_idx AS BIGINT) AS sample_idx, CAST(center_idx AS BIGINT) AS center_idx FROM clusters", CLUSTERS, recursive=True))
def greedy_cluster(spark, sf):
    return en.greedy_cluster(fx.sample_vectors(spark, sf), TAU).select("id", big("sample_idx"), big("center_idx"))


@query("semantic_entropy", sql(["samples"], "SELECT id, CAST(n_samples AS BIGINT) AS n_samples, n_clusters, round(semantic_entropy, 6) AS semantic_entropy FROM entropies", CLUSTERS, recursive=True))
def semantic_entropy(spark, sf):
    return en.semantic_entropy(fx.sample_vectors(spark, sf), TAU).select("id", "n_samples", "n_clusters", r6("semantic_entropy"))


REPORT = CLUSTERS + ["""report AS (
  SELECT t.id, t.prompt, t.response AS original_response, CASE WHEN t.doc_id % 17 = 0 THEN 'unknown' ELSE t.label END AS true_label,
    coalesce(e.semantic_entropy, 0.0) AS semantic_entropy, coalesce(e.n_samples, 0) AS n_answers
  FROM triplets t LEFT JOIN entropies e ON e.id = t.id)"""]


def report(spark, sf):
    source = fx.labelled_triplets(spark, sf).withColumn("label", F.when(F.col("doc_id") % 17 != 0, F.col("label")))
    return en.semantic_entropy_report(source, fx.answer_samples(spark, sf), TAU)


@query("semantic_entropy_report", sql(["samples", "triplets"], """
SELECT id, prompt, original_response, true_label, CAST(n_answers AS BIGINT) AS n_answers, round(semantic_entropy, 6) AS semantic_entropy FROM report""", REPORT, recursive=True))
def semantic_entropy_report(spark, sf):
    return report(spark, sf).select(
        "id", "prompt", "original_response", "true_label", big(F.size("generated_responses"), "n_answers"), r6("semantic_entropy")
    )


@query("entropy_by_label", sql(["samples", "triplets"], """
SELECT true_label, round(avg(semantic_entropy), 6) AS mean, round(stddev_samp(semantic_entropy), 6) AS std, count(*) AS count FROM report GROUP BY true_label""", REPORT, recursive=True))
def entropy_by_label(spark, sf):
    return en.entropy_by_label(report(spark, sf)).select("true_label", r6("mean"), r6("std"), "count")


@query("overall_entropy", sql(["samples", "triplets"], """
SELECT round(avg(semantic_entropy), 6) AS mean, round(stddev_samp(semantic_entropy), 6) AS std, count(*) AS count FROM report""", REPORT, recursive=True))
def overall_entropy(spark, sf):
    return en.overall_entropy(report(spark, sf)).select(r6("mean"), r6("std"), "count")


@query("entropy_auc", sql(["samples", "triplets"], """
SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)
  / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg
FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk
  FROM (SELECT CASE WHEN true_label = 'no' THEN 0 ELSE 1 END AS y, round(semantic_entropy, 9) AS s FROM report WHERE true_label <> 'unknown'))""", REPORT, recursive=True))
def entropy_auc(spark, sf):
    known = report(spark, sf).filter("true_label <> 'unknown'")
    scored = known.select(F.round("semantic_entropy", 9).alias("s"), pr.is_hallucinated(F.col("true_label")).alias("y"))
    return ev.auc_roc(scored, "s", "y").select(r6("auc"), "n_pos", "n_neg")


# --- claims -------------------------------------------------------------------

DOC_CLAIMS = f"""doc_lists AS (SELECT CAST(doc_id AS VARCHAR) AS id, {o.claims('text')} AS l FROM documents),
doc_claims AS (SELECT id, generate_subscripts(l, 1) - 1 AS claim_idx, unnest(l) AS claim FROM doc_lists)"""


def documents(spark, sf):
    return fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("response"))


@query("segment_claims", sql([], "SELECT id, CAST(claim_idx AS BIGINT) AS claim_idx, claim FROM doc_claims", [DOC_CLAIMS]))
def segment_claims(spark, sf):
    return cl.segment_claims(documents(spark, sf)).select("id", big("claim_idx"), "claim")


FOUND = """found AS (
  SELECT claim, string_agg('[' || tool || '] ' || result, ' | ' ORDER BY tool_ord) AS evidence FROM evidence WHERE result <> '' GROUP BY claim)"""


@query("gather_evidence", sql(["evidence"], """
SELECT id, CAST(claim_idx AS BIGINT) AS claim_idx, coalesce(f.evidence, 'No external evidence found.') AS evidence
FROM doc_claims c LEFT JOIN found f ON c.claim = f.claim""", [DOC_CLAIMS, FOUND]))
def gather_evidence(spark, sf):
    claims = cl.segment_claims(documents(spark, sf))
    return cl.gather_evidence(claims, fx.evidence(spark, sf)).select("id", big("claim_idx"), "evidence")


PROMPT_SQL = """'Claim: ' || claim || chr(10) || 'Evidence: ' || evidence || chr(10)
  || 'Based on the evidence, is the claim a hallucination? Think step-by-step.' AS reflection_prompt"""


@query("reflection_prompt", sql(["verified"], f"SELECT id, CAST(claim_idx AS BIGINT) AS claim_idx, {PROMPT_SQL} FROM verified"))
def reflection_prompt(spark, sf):
    return cl.detect_claims(documents(spark, sf), fx.evidence(spark, sf)).select("id", big("claim_idx"), "reflection_prompt")


@query("detect_claims", sql(["verified"], f"SELECT id, CAST(claim_idx AS BIGINT) AS claim_idx, claim, evidence, {PROMPT_SQL} FROM verified"))
def detect_claims(spark, sf):
    return cl.detect_claims(documents(spark, sf), fx.evidence(spark, sf)).withColumn("claim_idx", big("claim_idx"))


@query("collect_ensemble", "SELECT doc_id // 3 AS prompt_id, string_agg(text, chr(9247) ORDER BY doc_id) AS texts FROM documents GROUP BY 1")
def collect_ensemble(spark, sf):
    return cl.collect_ensemble(fx.generations(spark, sf)).select("prompt_id", joined("generated_texts", "texts"))


# --- probes -------------------------------------------------------------------

SELECTED = ["""importance AS (SELECT layer, step, in_dim, avg(abs(w)) AS importance FROM probe_weights GROUP BY ALL)""",
    """ranked AS (SELECT *, row_number() OVER p AS rank, sum(importance * importance) OVER (PARTITION BY layer, step) AS total,
    coalesce(sum(importance * importance) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM importance WINDOW p AS (PARTITION BY layer, step ORDER BY importance DESC, in_dim))""",
    "selected AS (SELECT layer, step, in_dim, importance, rank FROM ranked WHERE before < 0.9 * total OR rank = 1)"]


@query("neuron_selection", sql(["probe_weights"], """
SELECT CAST(layer AS BIGINT) AS layer, step, CAST(in_dim AS BIGINT) AS in_dim, round(importance, 6) AS importance, rank FROM selected""", SELECTED))
def neuron_selection(spark, sf):
    s = pb.neuron_selection(fx.probe_weights(spark, sf))
    return s.select(big("layer"), "step", big("in_dim"), r6("importance"), big("rank"))


@query("construct_hav", sql(["probe_weights", "probe_states"], """
SELECT s.id, CAST(row_number() OVER (PARTITION BY s.id ORDER BY s.layer, CASE s.step WHEN 'init' THEN 0 ELSE 1 END, n.rank) - 1 AS BIGINT) AS pos,
  round(s.h[n.in_dim + 1], 6) AS value
FROM probe_states s JOIN selected n ON n.layer = s.layer AND n.step = s.step""", SELECTED))
def construct_hav(spark, sf):
    hav = pb.construct_hav(fx.hidden_states(spark, sf), pb.neuron_selection(fx.probe_weights(spark, sf)), LAYERS)
    return hav.select("id", F.posexplode("hav").alias("pos", "value")).select("id", big("pos"), r6("value"))


@query("probe_score", sql(["probe_states"], """
SELECT s.id, CAST(s.layer AS BIGINT) AS layer, s.step, round(1 / (1 + exp(-(sum(greatest(list_dot_product(s.h, w.w1) + w.b1, 0) * w.w2) + count(*) / 1000))), 6) AS score
FROM probe_states s JOIN hidden w ON w.layer = s.layer AND w.step = s.step GROUP BY s.id, s.layer, s.step""", ["""hidden AS (
  SELECT label AS layer, CASE WHEN vec_id % 2 = 0 THEN 'init' ELSE 'final' END AS step, CAST(embedding AS DOUBLE[]) AS w1,
    CAST(embedding[1] AS DOUBLE) AS b1, CAST(embedding[2] AS DOUBLE) AS w2 FROM embeddings)"""]))
def probe_score(spark, sf):
    probes = pb.pack_probes(fx.probe_weights(spark, sf), fx.probe_outputs(spark, sf))
    scored = pb.probe_score(fx.hidden_states(spark, sf), probes, fx.probe_bias(spark, sf))
    return scored.select("id", big("layer"), "step", r6("score"))
