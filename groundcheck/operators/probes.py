"""Neuron selection over probe weights, the awareness vector, and probe scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

STEPS = ["init", "final"]


def neuron_selection(weights: DataFrame, alpha: float = 0.9) -> DataFrame:
    """``(layer, step, in_dim, importance, rank)`` of the selected input neurons of each probe.

    Importance is the mean absolute weight over all outputs of the probe; an absent coordinate is a zero. The shortest prefix, by falling
    importance, whose squares reach alpha of the total is kept, at least one neuron. After the
    aggregation a probe has one row per input neuron, so the window is bounded by the model width.
    """
    alpha = min(max(alpha, 0.0), 1.0)
    outputs = weights.groupBy("layer", "step").agg(F.count_distinct("out_dim").alias("_outputs"))
    sums = weights.groupBy("layer", "step", "in_dim").agg(F.sum(F.abs("w")).alias("_sum"))
    importance = sums.join(outputs, ["layer", "step"]).select(
        "layer", "step", "in_dim", (F.col("_sum") / F.col("_outputs")).alias("importance")
    )
    probe = Window.partitionBy("layer", "step")
    order = probe.orderBy(F.desc("importance"), F.asc("in_dim"))
    square = F.col("importance") * F.col("importance")
    ranked = importance.select(
        "*",
        F.row_number().over(order).alias("rank"),
        F.coalesce(F.sum(square).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"),
        F.sum(square).over(probe).alias("_total"),
    )
    return ranked.filter((F.col("_before") < alpha * F.col("_total")) | (F.col("rank") == 1)).drop("_before", "_total")


def construct_hav(states: DataFrame, selection: DataFrame, layers: list[int]) -> DataFrame:
    """``(id, hav)``: over the layers in order, the selected values of the first then of the last step.

    The selection becomes one row per probe, at most 2 x len(layers) rows of the model's width, which Spark broadcasts if it
    is small; a state row picks its values in place.
    """
    picks = (
        selection.filter(F.col("layer").isin(layers)).groupBy("layer", "step")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "in_dim"))).alias("_p"))
        .select("layer", "step", F.col("_p.in_dim").alias("_dims"))
    )
    values = F.transform("_dims", lambda d: F.element_at(F.col("h"), d.cast("int") + 1))
    layer_order = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer"))
    step_order = F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col("step"))
    parts = states.join(picks, ["layer", "step"]).select(
        "id", layer_order.alias("l"), step_order.alias("s"), values.alias("v")
    )
    return parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("l", "s", "v"))).alias("_l")).select(
        "id", F.flatten("_l.v").alias("hav")
    )


def pack_probes(weights: DataFrame, outputs: DataFrame) -> DataFrame:
    """``(layer, step, out_dim, dims, w1, b1, w2)``: one row per hidden neuron, its weights and their input positions.

    ``outputs`` is ``(layer, step, out_dim, b1, w2)``. Absent coordinates are zeros; a neuron without any keeps its bias.
    """
    rows = weights.groupBy("layer", "step", "out_dim").agg(
        F.array_sort(F.collect_list(F.struct("in_dim", "w"))).alias("_w")
    )
    keys = ["layer", "step", "out_dim"]
    packed = rows.select(*keys, F.col("_w.in_dim").alias("dims"), F.col("_w.w").alias("w1"))
    return outputs.select(*keys, "b1", "w2").join(packed, keys, "left").select(*keys, "dims", "w1", "b1", "w2")


def hidden_sums(inputs: np.ndarray, weights: np.ndarray, b1: np.ndarray, w2: np.ndarray, rows: int = 2_048, neurons: int = 2_048) -> np.ndarray:
    """w2 . relu(W1 h + b1) of each input row: ``rows`` states meet ``neurons`` neurons at a time, so what is held does not grow with their product."""
    z = np.zeros(len(inputs))
    for i in range(0, len(inputs), rows):
        for j in range(0, len(weights), neurons):
            hidden = inputs[i : i + rows] @ weights[j : j + neurons].T
            hidden += b1[j : j + neurons]
            np.maximum(hidden, 0.0, out=hidden)
            z[i : i + rows] += hidden @ w2[j : j + neurons]
    return z


def _score_block(states: pd.DataFrame, probe: pd.DataFrame) -> pd.DataFrame:
    out = states[["id", "layer", "step"]].copy()
    if states.empty:
        return out.assign(score=pd.Series(dtype="float64"))
    if probe.empty:
        raise ValueError(f"no probe for layer {out['layer'].iloc[0]}, step {out['step'].iloc[0]}")
    inputs = np.stack(states["h"].to_numpy())
    weights = np.zeros((len(probe), inputs.shape[1]))
    for row, dims, w in zip(weights, probe["dims"], probe["w1"]):
        if dims is not None:
            row[np.asarray(dims)] = w
    z = hidden_sums(inputs, weights, probe["b1"].to_numpy(), probe["w2"].to_numpy()) + float(probe["b2"].iloc[0])
    return out.assign(score=1.0 / (1.0 + np.exp(-z)))


def probe_score(states: DataFrame, probes: DataFrame, bias: DataFrame, rows_per_block: int = 65_536) -> DataFrame:
    """``(id, layer, step, score)``: sigmoid(w2 . relu(W1 h + b1) + b2) with the probe of the state's layer and step.

    States are cut into blocks of about ``rows_per_block`` rows, each probe into as many as its own states need, so a task multiplies one
    block by one probe whatever the table size, and a probe's weights travel once unless a single task could not hold its states. The
    numbers of blocks are a small table inside the plan. Weights stand at their input
    position, absent ones are zeros. A state whose layer and step have no probe is an error.
    ``bias`` is ``(layer, step, b2)``.
    """
    probe = ["layer", "step"]
    blocks = states.groupBy(*probe).agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("_blocks"))
    left = states.join(blocks, probe).withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).drop("_blocks")
    right = probes.join(bias, probe).join(blocks, probe).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    keys = [*probe, "block"]
    row_type = states.schema["id"].dataType.simpleString()
    layer_type = states.schema["layer"].dataType.simpleString()
    return (
        left.groupBy(*keys).cogroup(right.groupBy(*keys))
        .applyInPandas(_score_block, f"id {row_type}, layer {layer_type}, step string, score double")
    )
