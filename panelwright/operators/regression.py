"""Least squares with full inference, for one table or for every group at once.

The data is read once: per group one aggregate holds the row count, the means and the centred
cross-products of response and terms. What remains per group is a (p + 1) x (p + 1) problem,
solved where the aggregate lies, so neither rows nor groups pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.tails import f_upper, t_two_sided
from panelwright.operators.columns import quoted
from panelwright.operators.joins import left_join
from panelwright.operators.quantiles import exact_quantiles
from panelwright.session import materialise

# Share of a term's own variance that must be left after the earlier terms explain theirs.
TOLERANCE = 1e-11


@dataclass(frozen=True)
class Model:
    """A response and its terms; a term is a column, or several columns multiplied."""

    response: str
    terms: tuple[tuple[str, ...], ...]

    @property
    def names(self) -> list[str]:
        return [":".join(t) for t in self.terms]


def interaction(*columns: str) -> tuple[str, ...]:
    """The product of columns alone."""
    return tuple(columns)


def crossed(a: str, b: str) -> list[tuple[str, ...]]:
    """Two columns and their product."""
    return [(a,), (b,), (a, b)]


def model(response: str, *terms: str | tuple[str, ...] | list[tuple[str, ...]]) -> Model:
    """Build a model from column names, interaction(...) and crossed(...); lower orders come first."""
    flat: list[tuple[str, ...]] = []
    for t in terms:
        for one in [(t,)] if isinstance(t, str) else t if isinstance(t, list) else [t]:
            if one not in flat:
                flat.append(one)
    return Model(response, tuple(sorted(flat, key=len)))


def _product(term: Iterable[str]) -> Column:
    value = None
    for c in term:
        factor = quoted(c).cast("double")
        value = factor if value is None else value * factor
    return value


FIT_FIELDS = (
    "term string, position int, estimate double, std_error double, t double, p double, "
    "n long, dropped long, rank int, df long, sigma double, r2 double, adj_r2 double, "
    "f double, f_df long, f_p double"
)


def ols(df: DataFrame, spec: Model, *, by: Sequence[str] = ()) -> DataFrame:
    """Fit a model with intercept, per group if asked; one row per term with the model's figures beside.

    Rows lacking any value of this model are left out and counted in `dropped`. A term that the
    earlier ones determine, or for which there are too few rows, gets NULL instead of failing.
    """
    return ols_many(df, {"": spec}, by=by).drop("model")


def ols_many(df: DataFrame, models: Mapping[str, Model], *, by: Sequence[str] = ()) -> DataFrame:
    """Fit several models on one table in one scan; the rows of ols() with the model's name before them."""
    gram = _gram(df, models, by)
    names = {name: ["(intercept)", *spec.names] for name, spec in models.items()}
    keys = T.StructType([df.schema[b] for b in by]).add("model", T.StringType(), False)
    schema = T.StructType([*keys.fields, *T.StructType.fromDDL(FIT_FIELDS).fields])

    def solve(batches):
        for batch in batches:
            rows = []
            for record in batch.itertuples(index=False, name=None):
                key, (n, dropped, means, cross) = record[: len(by) + 1], record[len(by) + 1 :]
                rows += [(*key, *fit) for fit in _solve(names[key[-1]], n, dropped, means, cross)]
            yield pd.DataFrame(rows, columns=schema.names).astype(object).where(lambda x: x.notna(), None)

    return gram.mapInPandas(solve, schema)


def _gram(df: DataFrame, models: Mapping[str, Model], by: Sequence[str]) -> DataFrame:
    """(by..., model, n, dropped, means, co-moments): one aggregate for all groups and models.

    A product that several models use is computed once for a row; each model leaves out the rows
    that lack one of its own values.
    """
    wanted = {name: [*spec.terms, (spec.response,)] for name, spec in models.items()}
    cells = {t: f"__x{i}" for i, t in enumerate(dict.fromkeys(t for ts in wanted.values() for t in ts))}
    rows = df.select(*[quoted(b) for b in by], *[_product(t).alias(c) for t, c in cells.items()])
    flags, facts = {}, []
    for i, (name, terms) in enumerate(wanted.items()):
        usable = F.lit(True)
        for t in terms:
            usable = usable & F.col(cells[t]).isNotNull() & ~F.isnan(cells[t])
        flags[f"__ok{i}"] = usable
        values = [F.when(F.col(f"__ok{i}"), F.col(cells[t])) for t in terms]
        facts.append(
            F.struct(
                F.lit(name).alias("__model"),
                F.count_if(f"__ok{i}").alias("__n"),
                F.count_if(~F.col(f"__ok{i}")).alias("__dropped"),
                F.array(*[F.avg(v) for v in values]).alias("__means"),
                F.array(*[F.covar_pop(a, b) for a, b in combinations_with_replacement(values, 2)]).alias("__cross"),
            )
        )
    found = rows.withColumns(flags).groupBy(*[quoted(b) for b in by]).agg(F.array(*facts).alias("__facts"))
    return found.select(*[quoted(b) for b in by], F.inline("__facts"))


def _solve(names, n, dropped, means, cross) -> list[tuple]:
    """Rows (term, position, estimate ... f_p) of one group from its means and co-moments."""
    p = len(names) - 1
    blank = [None] * 4
    if n == 0:
        return [(t, i, *blank, 0, dropped, 0, 0, *[None] * 6) for i, t in enumerate(names)]
    means = np.asarray(means, dtype=float)
    s = np.zeros((p + 1, p + 1))
    s[np.triu_indices(p + 1)] = cross
    s = (s + np.triu(s, 1).T) * n
    scale = np.sqrt(np.diag(s))
    scale[scale == 0] = 1.0
    r = s / np.outer(scale, scale)

    used: list[int] = []
    for j in range(p):
        if s[j, j] <= 0 or len(used) + 1 >= n:
            continue
        left = r[j, j]
        if used:
            left -= r[j, used] @ np.linalg.solve(r[np.ix_(used, used)], r[used, j])
        if left > TOLERANCE:
            used.append(j)
    rank = len(used)
    df = int(n) - rank - 1
    tss = s[p, p]
    inverse = np.linalg.inv(r[np.ix_(used, used)]) if used else np.zeros((0, 0))
    slopes = (inverse @ r[used, p]) * scale[p] / scale[used] if used else np.zeros(0)
    inverse = inverse / np.outer(scale[used], scale[used]) if used else inverse
    rss = max(tss - float(slopes @ s[used, p]), 0.0) if used else tss
    if rss < tss * 1e-15:
        rss = 0.0
    sigma = float(np.sqrt(rss / df)) if df > 0 else None
    r2 = 1.0 - rss / tss if tss > 0 else None
    adjusted = 1.0 - (1.0 - r2) * (n - 1) / df if df > 0 and r2 is not None else None
    f = f_p = None
    if df > 0 and rank and rss > 0:
        f = (tss - rss) / rank / (rss / df)
        f_p = f_upper(f, rank, df)

    estimates = {0: float(means[p] - slopes @ means[used])}
    spread = {0: 1.0 / n + float(means[used] @ inverse @ means[used])}
    for i, j in enumerate(used):
        estimates[j + 1] = float(slopes[i])
        spread[j + 1] = float(inverse[i, i])
    figures = (int(n), dropped, rank, df, sigma, r2, adjusted, f, rank, f_p)
    out = []
    for i, name in enumerate(names):
        row = blank
        if i in estimates:
            error = sigma * float(np.sqrt(max(spread[i], 0.0))) if sigma is not None else None
            t = estimates[i] / error if error else None
            row = [estimates[i], error, t, t_two_sided(t, df) if t is not None else None]
        out.append((name, i, *row, *figures))
    return out


def coefficients(fit: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return fit.select(*by, "term", "position", "estimate", "std_error", "t", "p")


def model_figures(fit: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per model: rows used and dropped, rank, degrees of freedom, sigma, R2, F."""
    return fit.filter("position = 0").select(
        *by, "n", "dropped", "rank", "df", "sigma", "r2", "adj_r2", "f", "f_df", "f_p"
    )


def with_residuals(df: DataFrame, spec: Model, fit: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Add `fitted` and `residual`; NULL where the row lacks a value of the model."""
    wide = fit.groupBy(*[quoted(b).alias(f"__by_{b}") for b in by]).agg(
        *[
            F.coalesce(F.max(F.when(F.col("position") == i, F.col("estimate"))), F.lit(0.0)).alias(f"__b{i}")
            for i in range(len(spec.terms) + 1)
        ]
    )
    if by:
        wide = materialise(wide, "coefficients")
        joined = left_join(df, wide, [(b, f"__by_{b}") for b in by])
        b = [F.col(f"__b{i}") for i in range(len(spec.terms) + 1)]
    else:
        whole = wide.agg(F.array(*[F.first(f"__b{i}") for i in range(len(spec.terms) + 1)])).scalar()
        joined, b = df, [F.get(whole, F.lit(i)) for i in range(len(spec.terms) + 1)]
    fitted = b[0]
    for i, t in enumerate(spec.terms):
        fitted = fitted + b[i + 1] * _product(t)
    return joined.select(
        *[quoted(c) for c in df.columns],
        fitted.alias("fitted"),
        (quoted(spec.response).cast("double") - fitted).alias("residual"),
    )


def residual_quantiles(df: DataFrame, spec: Model, fit: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles and maximum of the residuals, per group if asked."""
    residuals = with_residuals(df, spec, fit, by=by)
    q = exact_quantiles(residuals, by, ["residual"], (0.0, 0.25, 0.5, 0.75, 1.0))
    names = ("min", "q1", "median", "q3", "max")
    return q.select(*by, *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(names)])


def ols_catalogue(models: Mapping[str, tuple[DataFrame, Model]]) -> DataFrame:
    """Fit many models, each on its own table, into one result; models of one table share a scan."""
    tables: dict[int, tuple[DataFrame, dict[str, Model]]] = {}
    for name, (df, spec) in models.items():
        tables.setdefault(id(df), (df, {}))[1][name] = spec
    fits = None
    for df, specs in tables.values():
        fit = ols_many(df, specs)
        fits = fit if fits is None else fits.unionByName(fit)
    return fits
