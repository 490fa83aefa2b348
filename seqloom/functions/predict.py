"""Models in workers: loaded once a worker, applied to batches of bounded size, several layers in one pass."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The models of this worker by the name that the driver gave them.
_HERE: dict[str, Callable] = {}

#: Bytes of vectors that a model sees at once.
BATCH_BYTES = 16 << 20

Model = Callable[[np.ndarray], dict[str, np.ndarray]]


def here(name: str, load: Callable[[], Model]) -> Model:
    """The worker's model of that name; loaded when it is first asked for. Spark hands a worker on from task to task, so others find it there."""
    if name not in _HERE:
        _HERE[name] = load()
    return _HERE[name]


def _column(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    if x.ndim == 1:
        return pa.array(x, kind)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), kind.value_type))


def with_layers(
    df: DataFrame,
    load: Callable[[], Model],
    layers: dict[str, str],
    vector: str = "feature",
    out: str = "layers",
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """df with a struct of what the model gives for each vector: layers, by name, and their types, array<double> or a plain one.

    load: makes the model, a function from a matrix of vectors to a dict of the layers, in rows. Vectors of one length are put together until they have
    batch_bytes; a null vector gives a null struct.
    """
    name, kinds = uuid.uuid4().hex, {c: T._parse_datatype_string(k) for c, k in layers.items()}
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.struct([pa.field(c, to_arrow_type(k)) for c, k in kinds.items()])
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StructType([T.StructField(c, k) for c, k in kinds.items()]))])
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = here(name, load)
        for b in batches:
            v = b.column(at)
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            parts = []
            for n in np.unique(sizes[np.isfinite(sizes)]).astype(int).tolist():
                rows = np.flatnonzero(sizes == n)
                step = max(1, batch_bytes // max(8 * n, 1))
                for own in (rows[i : i + step] for i in range(0, len(rows), step)):
                    x = v.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), n)
                    made = model(x)
                    parts.append((own, pa.StructArray.from_arrays([_column(np.asarray(made[f.name]), f.type) for f in arrow], fields=list(arrow))))
            if parts:
                order = np.concatenate([p[0] for p in parts])
                place = np.full(len(b), -1)
                place[order] = np.arange(len(order))
                found = pa.concat_arrays([p[1] for p in parts]).take(pa.array(place, mask=place < 0))
            else:
                found = pa.nulls(len(b), arrow)
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, out])

    return df.mapInArrow(run, schema)


def perceptron(weights: dict[str, np.ndarray]) -> Model:
    """A perceptron from its weights: w0, b0, w1, b1 and so on, rectified between; layers: hidden (the last but one), scores, label."""
    depth = sum(1 for k in weights if k.startswith("w"))

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        hidden = x
        for i in range(depth - 1):
            hidden = np.maximum(hidden @ weights[f"w{i}"] + weights[f"b{i}"], 0)
        scores = hidden @ weights[f"w{depth - 1}"] + weights[f"b{depth - 1}"]
        return {"hidden": hidden, "scores": scores, "label": scores.argmax(1)}

    return run


def linear(weights: dict[str, np.ndarray]) -> Model:
    """A projection of centered vectors: mean, components; layer: scores, label the largest."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        scores = (x - weights["mean"]) @ weights["components"].T
        return {"hidden": x, "scores": scores, "label": scores.argmax(1)}

    return run


#: The kinds of stored models, by the arrays that they must have.
FORMATS = ((("w0", "b0"), perceptron), (("mean", "components"), linear))


def load_model(path: str) -> Model:
    """The model of an .npz, its kind told by the arrays in it. The path is one that workers share."""
    from seqloom.sources import npy

    names = npy.members(path)
    for needs, make in FORMATS:
        if set(needs) <= set(names):
            return make({n: (m := npy.member(path, n)).read(0, m.rows) for n in names})
    raise ValueError(f"{path}: no known kind of model has the arrays {sorted(names)}")


def predicted(df: DataFrame, path: str, vector: str = "feature", out: str = "label") -> DataFrame:
    """df with the label that a stored model gives each vector, null for null."""
    if out in df.columns:
        raise ValueError(f"{out} is there already")
    return with_layers(df, lambda: load_model(path), {"label": "bigint"}, vector, "__layers").withColumn(out, F.col("__layers.label")).drop("__layers")
