"""Logistic regressions in SQL, for the oracles: unrolled Newton steps, each one aggregate per fit and one small elimination."""
from __future__ import annotations

_STEPS = 9


def newton_sql(rows: str, p: int, ridge: float = 0.0, name: str = "nt") -> str:
    """CTEs up to ``name`` (r, b, h): coefficients and information of the fits r of ``rows`` (r, y, w, z), z beginning with 1."""
    cells = "[" + ", ".join("[" + ", ".join(f"SUM(v * z[{i}] * z[{j}])" for j in range(1, p + 1)) + "]" for i in range(1, p + 1)) + "]"
    grads = "[" + ", ".join(f"SUM(w * (y - mu) * z[{i}])" for i in range(1, p + 1)) + "]"
    out = f"{name}0 AS (SELECT r, [{', '.join(['CAST(0 AS DOUBLE)'] * p)}] AS b FROM {rows} GROUP BY r)"
    for k in range(_STEPS + 1):
        out += (f", {name}{k}m AS (SELECT q.r, y, w, z, 1 / (1 + exp(-list_inner_product(z, b))) AS mu FROM {rows} q JOIN {name}{k} c ON q.r = c.r)"
                f", {name}{k}s AS (SELECT r, {grads} AS g, {cells} AS h FROM (SELECT *, w * mu * (1 - mu) AS v FROM {name}{k}m) GROUP BY r)")
        if k == _STEPS:
            break
        full = (f"list_transform(h, lambda row, i: list_concat(list_transform(row, lambda x, j: x + CASE WHEN i = j AND i > 1 THEN {ridge} ELSE 0 END), "
                f"[g[i] - CASE WHEN i > 1 THEN {ridge} * b[i] ELSE 0 END]))")
        out += f", {name}{k}a AS (SELECT c.r, b, {full} AS m FROM {name}{k}s s JOIN {name}{k} c ON s.r = c.r), " + solve_sql(f"{name}{k}a", f"{name}{k}x", p)
        out += f", {name}{k + 1} AS (SELECT r, list_transform(b, lambda x, i: x + m[i][{p + 1}]) AS b FROM {name}{k}x)"
    return out + f", {name} AS (SELECT c.r, b, h FROM {name}{_STEPS} c JOIN {name}{_STEPS}s s ON c.r = s.r)"


def solve_sql(source: str, name: str, p: int) -> str:
    """CTE ``name``: ``source`` with the rows of matrix m reduced, so that its right part becomes the solution."""
    at, out = source, ""
    for k in range(1, p + 1):
        to = f"{name}_{k}" if k < p else name
        out += (f"{', ' if out else ''}{to} AS (SELECT * REPLACE (list_transform(m, lambda row, i: CASE WHEN i = {k} THEN list_transform(row, lambda x: x / row[{k}]) "
                f"ELSE list_transform(row, lambda x, j: x - row[{k}] * m[{k}][j] / m[{k}][{k}]) END) AS m) FROM {at})")
        at = to
    return out


def balanced_sql(source: str, train: str, features: list[str], name: str) -> str:
    """CTEs of the balanced fits of ``source`` (r, y, features) on its rows where ``train``: scales, rows and ``name`` (r, b, h)."""
    stats_ = ", ".join(f"AVG({f}) AS m_{f}, stddev_pop({f}) AS d_{f}" for f in features)
    z = "[1.0, " + ", ".join(f"({f} - m_{f}) / d_{f}" for f in features) + "]"
    return (f"{name}_f AS (SELECT r, {stats_}, COUNT(*) / (2.0 * SUM(y)) AS w1, COUNT(*) / (2.0 * SUM(1 - y)) AS w0 FROM {source} WHERE {train} GROUP BY r), "
            f"{name}_r AS (SELECT q.r, CAST(y AS DOUBLE) AS y, CASE WHEN y = 1 THEN w1 ELSE w0 END AS w, {z} AS z FROM {source} q JOIN {name}_f f ON q.r = f.r WHERE {train}), "
            + newton_sql(f"{name}_r", len(features) + 1, 1.0, name))
