"""Feature vectors and models over them.

Models are Spark ML pipelines or plain coefficient tables, saved as data; nothing is
unpickled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """sample_id and ``features``: long tables (sample_id, key, n) one after another, each in the order of its key.

    ``parts`` holds a table and its key column; each table must be zero-filled, so
    that all samples have the same keys.
    """
    long = None
    for i, (table, key) in enumerate(parts):
        rows = table.select("sample_id", F.lit(i).alias("part"), F.col(key).alias("key") if dict(table.dtypes)[key] != "string" else F.lit(0).cast("long").alias("key"), (F.col(key) if dict(table.dtypes)[key] == "string" else F.lit("")).alias("word"), F.col("n").cast("double").alias("x"))
        long = rows if long is None else long.unionByName(rows)
    # One sample's vector: about 1400 numbers.
    ordered = F.array_sort(F.collect_list(F.struct("part", "key", "word", "x")))
    return long.groupBy("sample_id").agg(F.transform(ordered, lambda r: r["x"]).alias("features"))


def fit_pca(rows: DataFrame, k: int = 2) -> PCAModel:
    return PCA(k=k, inputCol="__v", outputCol="__p").fit(rows.select(array_to_vector("features").alias("__v")))


def project(rows: DataFrame, model: PCAModel, names: tuple[str, ...] = ("umap1", "umap2")) -> DataFrame:
    """``rows`` with the leading components; the default embedding."""
    moved = model.transform(rows.withColumn("__v", array_to_vector("features"))).withColumn("__a", vector_to_array("__p"))
    return moved.select(*rows.columns, *(F.col("__a")[i].alias(n) for i, n in enumerate(names)))


def project_with(rows: DataFrame, transform: Callable[[pd.Series], pd.DataFrame], names: tuple[str, ...] = ("umap1", "umap2")) -> DataFrame:
    """``rows`` with what a caller's reducer makes of their vectors, batch by batch."""
    columns = rows.columns

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = transform(part["features"])
            yield pd.concat([part[columns].reset_index(drop=True), made.set_axis(list(names), axis=1).reset_index(drop=True)], axis=1)

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"{n} double" for n in names)])
    return rows.mapInPandas(batches, kinds)


def linear(rows: DataFrame, weights: list[float], intercept: float = 0.0, name: str = "prediction") -> DataFrame:
    """A linear predictor over ``features``."""
    products = F.zip_with("features", F.array(*map(F.lit, map(float, weights))), lambda a, b: a * b)
    return rows.withColumn(name, F.aggregate(products, F.lit(float(intercept)), lambda a, b: a + b))


def logistic(rows: DataFrame, weights: list[float], intercept: float = 0.0, name: str = "probability") -> DataFrame:
    """The chance of the positive class of a two-class linear model."""
    scored = linear(rows, weights, intercept, "__z")
    return scored.withColumn(name, 1 / (1 + F.exp(-F.col("__z")))).drop("__z")


def multinomial(rows: DataFrame, classes: dict[str, tuple[list[float], float]]) -> DataFrame:
    """``rows`` with the likeliest class (of equals the first by name) and its probability."""
    scored = rows
    for i, (weights, intercept) in enumerate(classes.values()):
        scored = linear(scored, weights, intercept, f"__z{i}")
    top = F.greatest(*(F.col(f"__z{i}") for i in range(len(classes)))) if len(classes) > 1 else F.col("__z0")
    total = sum((F.exp(F.col(f"__z{i}") - top) for i in range(len(classes))), F.lit(0.0))
    label = F.coalesce(*(F.when(F.col(f"__z{i}") == top, F.lit(name)) for i, name in sorted(enumerate(classes), key=lambda p: p[1])))
    return scored.withColumns({"label": label, "probability": 1 / total}).drop(*(f"__z{i}" for i in range(len(classes))))


def store_rows(projected: DataFrame, names: list[str], file_col: str = "sample_id") -> DataFrame:
    """sample_id, feature_name, value: features by the names given and both coordinates, under a fresh id made of the file's stem and 8 hex digits."""
    stem = F.regexp_extract(file_col, r"([^/]+?)(\.[^./]*)?$", 1)
    named = projected.withColumn("__id", F.concat(stem, F.lit("_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8)))
    pairs = F.concat(F.zip_with(F.array(*map(F.lit, names)), "features", lambda n, x: F.struct(n.alias("feature_name"), x.alias("value"))), F.array(*(F.struct(F.lit(c).alias("feature_name"), F.col(c).alias("value")) for c in ("umap1", "umap2"))))
    return named.select(F.col("__id").alias("sample_id"), F.inline(pairs))


def genotype(rows: DataFrame, spec: dict) -> DataFrame:
    """sample_id, probability, label, label_probability, prediction from a coefficient table.

    ``spec``: ``mean`` and ``components`` of a PCA; ``binary`` and ``regressor`` as
    (weights, intercept) over the components; ``classes`` by label likewise.  Each
    sample is scored by itself.
    """
    centred = F.zip_with("features", F.array(*map(F.lit, map(float, spec["mean"]))), lambda a, b: a - b)
    moved = rows.withColumn("features", centred)
    for i, component in enumerate(spec["components"]):
        moved = linear(moved, component, 0.0, f"__pc{i}")
    moved = moved.withColumn("features", F.array(*(F.col(f"__pc{i}") for i in range(len(spec["components"]))))).select("sample_id", "features")
    scored = multinomial(moved, {k: tuple(v) for k, v in spec["classes"].items()}).withColumnRenamed("probability", "label_probability")
    return linear(logistic(scored, *spec["binary"]), *spec["regressor"]).select("sample_id", "probability", "label", "label_probability", "prediction")
