"""Two-component view of a feature table, as drawn behind cluster plots."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.columns import quoted
from panelwright.operators.stats import corr_matrix, standardize


def principal_axes(df: DataFrame, features: Sequence[str]) -> list[tuple[float, list[float]]]:
    """(variance share, loadings) of all components of the standardised features, largest first.

    One distributed aggregate gives the correlations; only that p x p matrix is decomposed here.
    Each component is signed so that its largest loading is positive.
    """
    place = {f: i for i, f in enumerate(features)}
    r = np.eye(len(features))
    for row in corr_matrix(df, list(features)).collect():
        if row["r"] is None:
            raise ValueError(f"{row['a']} or {row['b']} is constant or has missing values")
        r[place[row["a"]], place[row["b"]]] = row["r"]
    values, vectors = np.linalg.eigh(r)
    axes = []
    for i in np.argsort(values)[::-1]:
        v = vectors[:, i]
        largest = int(np.argmax(np.round(np.abs(v), 9)))
        axes.append((float(values[i] / len(features)), [float(x) for x in v * np.sign(v[largest])]))
    return axes


def pca_projection(
    df: DataFrame, id_column: str, features: Sequence[str], *, keep: Sequence[str] = (), components: int = 2
) -> DataFrame:
    """Scores pc1, pc2 of the standardised features per id; two features are projected as they are."""
    scaled = standardize(df, features)
    if len(features) == 2:
        scores = [quoted(f).alias(f"pc{i}") for i, f in enumerate(features, 1)]
    else:
        scores = []
        for i, (_, loadings) in enumerate(principal_axes(df, features)[:components], 1):
            parts = [F.lit(w) * quoted(f) for w, f in zip(loadings, features)]
            scores.append(sum(parts[1:], parts[0]).alias(f"pc{i}"))
    return scaled.select(quoted(id_column), *scores, *[quoted(c) for c in keep])


def loadings_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(component, share, feature, loading) of all components."""
    rows = []
    for i, (share, loadings) in enumerate(principal_axes(df, features), 1):
        rows += [(i, share, f, w) for f, w in zip(features, loadings)]
    return df.sparkSession.createDataFrame(rows, "component int, share double, feature string, loading double")
