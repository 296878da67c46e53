"""The seam where window scores come from: a table of them, a logistic model, or an ONNX model in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_table(windows: DataFrame, scores: DataFrame, on: list[str]) -> DataFrame:
    """windows with their class and score from a table of scores."""
    return windows.join(scores, on)


def from_linear(windows: DataFrame, features: str, weights: dict[str, tuple[list[float], float]]) -> DataFrame:
    """One row per window and class: score = sigmoid(w . x + b). Weights are a model's, so small and fixed."""
    rows = []
    for name, (w, b) in weights.items():
        dot = F.aggregate(F.zip_with(features, F.array(*map(F.lit, w)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        rows.append(F.struct(F.lit(name).alias("class"), (1.0 / (1.0 + F.exp(-(dot + b)))).alias("score")))
    return windows.select("*", F.explode(F.array(*rows)).alias("__s")).select(*windows.columns, "__s.class", "__s.score")


def from_onnx(windows: DataFrame, features: str, model: bytes, classes: list[str]) -> DataFrame:
    """One row per window and class, from an ONNX model of one float32 input (batch, n) and one output (batch, classes)."""
    shared = windows.sparkSession.sparkContext.broadcast(model)
    names = windows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema) + ", scores array<double>"

    def run(batches):
        import onnxruntime

        session = onnxruntime.InferenceSession(shared.value)
        for batch in batches:
            x = np.array(batch.column(names.index(features)).to_pylist(), np.float32)
            y = session.run(None, {session.get_inputs()[0].name: x})[0] if len(x) else np.zeros((0, len(classes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([list(map(float, r)) for r in y], pa.list_(pa.float64()))], [*names, "scores"])

    scored = windows.mapInArrow(run, schema)
    return scored.select(*names, F.posexplode("scores").alias("__c", "score")).select(*names, F.element_at(F.array(*map(F.lit, classes)), F.col("__c") + 1).alias("class"), "score")
