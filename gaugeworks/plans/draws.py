"""SQL of the resampling weights and of intervals over replicates."""

from __future__ import annotations

from ..operators import resampling as rs

B = 1000  # replicates


def draws(source: str, seed: str, n: int = B, unit: str = "unit") -> str:
    """CTE wt (unit, b, w): Poisson weights of the relation's units, and b = -1 for the sample itself."""
    steps = " + ".join(f"(u >= {c})::INT" for c in rs.CUTS)
    return f"""hx_ AS (SELECT unit, k, sha256('{seed}:' || unit || ':' || k) AS h FROM (SELECT DISTINCT {unit} AS unit FROM {source}), (SELECT unnest(range({-(-n // rs.DRAWS)})) AS k)),
 ux_ AS (SELECT unit, k * {rs.DRAWS} + j AS b, ('0x' || substr(h, 4 * j + 1, 4))::INT AS u FROM hx_, (SELECT unnest(range({rs.DRAWS})) AS j) WHERE k * {rs.DRAWS} + j < {n}),
 wt AS (SELECT unit, b, {steps} AS w FROM ux_ UNION ALL SELECT DISTINCT {unit}, -1, 1 FROM {source})"""


def ci(value: str, source: str, keys: str = "axis") -> str:
    return f"SELECT {keys}, max({value}) FILTER (b = -1) AS point, quantile_cont({value}, 0.025) FILTER (b >= 0) AS ci_low, quantile_cont({value}, 0.975) FILTER (b >= 0) AS ci_high, count({value}) FILTER (b >= 0) AS replicates FROM {source} GROUP BY {keys}"
