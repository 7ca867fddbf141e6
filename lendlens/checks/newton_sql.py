"""The SQL of a penalised logistic fit: unrolled Newton steps, every linear system solved by elimination in plain columns."""

from __future__ import annotations

from collections.abc import Sequence

STEPS = 14  # as many as reach the last digit from a start at zero


def _eliminated(source: str, name: str, k: int, width: int, carried: Sequence[str]) -> list[str]:
    """Named queries that turn row ``source`` with a_i_j (k equations, ``width`` columns, of which the first k are the matrix)
    into the solutions x_i_j of all further columns (Gauss-Jordan; the matrix is positive definite, so no pivots are searched)."""
    out, before = [], source
    for p in range(k):
        cells = []
        for i in range(k):
            for j in range(width):
                row = f"a_{p}_{j} / a_{p}_{p}"
                cells.append(f"{row} AS a_{i}_{j}" if i == p else f"a_{i}_{j} - a_{i}_{p} * {row} AS a_{i}_{j}")
        out.append(f"{name}_{p} AS (SELECT {', '.join([*carried, *cells])} FROM {before})")
        before = f"{name}_{p}"
    return out


def _slopes(name: str, before: str, k: int, sigma: float, further: list[str]) -> str:
    """Hessian and right-hand sides ``further`` at the coefficients b0, b1, … of row ``before``."""
    xs = ["1", *[f"x{i}" for i in range(1, k)]]
    betas = [f"b{i}" for i in range(k)]
    eta = " + ".join(f"{b} * {x}" for b, x in zip(betas, xs))
    cells = [
        f"sum(n * p * (1 - p) * {xs[i]} * {xs[j]})" + (f" + 1 / CAST({sigma * sigma!r} AS DOUBLE)" if i == j else "") + f" AS a_{i}_{j}"
        for i in range(k) for j in range(k)
    ]
    gradient = [f"sum((s - n * p) * {x}) - {b} / CAST({sigma * sigma!r} AS DOUBLE)" for x, b in zip(xs, betas)]
    sides = [f"{gradient[i] if side == 'gradient' else ('1e0' if side == str(i) else '0e0')} AS a_{i}_{k + c}" for c, side in enumerate(further) for i in range(k)]
    return f"{name} AS MATERIALIZED (SELECT {', '.join([*betas, *cells, *sides])} FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM counted, {before}) f GROUP BY {', '.join(betas)})"


def fitted_sql(loans: str, columns: Sequence[str], sigma: float) -> str:
    """A WITH list whose last query ``fit`` is one row: the mode b0, b1, … and its covariance c_i_j; ``counted`` holds the loans.

    ``loans`` is a query with the columns and ``outcome``.
    """
    k = len(columns) + 1
    betas = [f"b{i}" for i in range(k)]
    xs = ", ".join(f"CAST({c} AS DOUBLE) AS x{i + 1}" for i, c in enumerate(columns))
    names = ", ".join(f"x{i}" for i in range(1, k))
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*columns, "outcome"])
    parts = [f"counted AS MATERIALIZED (SELECT {names}, count(*) AS n, sum(outcome) AS s FROM (SELECT {xs}, outcome FROM ({loans}) l WHERE {known}) v GROUP BY {names})"]
    parts.append("at0 AS (SELECT " + ", ".join(f"0e0 AS {b}" for b in betas) + ")")
    for step in range(STEPS):
        parts.append(_slopes(f"slope{step}", f"at{step}", k, sigma, ["gradient"]))
        parts += _eliminated(f"slope{step}", f"solve{step}", k, k + 1, betas)
        moved = ", ".join(f"b{i} + a_{i}_{k} AS b{i}" for i in range(k))
        parts.append(f"at{step + 1} AS MATERIALIZED (SELECT {moved} FROM solve{step}_{k - 1})")
    parts.append(_slopes("curve", f"at{STEPS}", k, sigma, [str(i) for i in range(k)]))
    parts += _eliminated("curve", "inverse", k, 2 * k, betas)
    covariance = ", ".join(f"a_{i}_{k + j} AS c_{i}_{j}" for i in range(k) for j in range(k))
    parts.append(f"fit AS MATERIALIZED (SELECT {', '.join(betas)}, {covariance} FROM inverse_{k - 1})")
    return ",\n".join(parts)


def cholesky_sql(k: int) -> list[str]:
    """Queries chol0 … that add the lower factor l_i_j of the covariance to ``fit``, column by column."""
    out, before = [], "fit"
    for j in range(k):
        inner = "".join(f" - l_{j}_{m} * l_{j}_{m}" for m in range(j))
        out.append(f"chol{j}_ AS (SELECT *, sqrt(c_{j}_{j}{inner}) AS l_{j}_{j} FROM {before})")
        cells = "".join(f", (c_{i}_{j}" + "".join(f" - l_{i}_{m} * l_{j}_{m}" for m in range(j)) + f") / l_{j}_{j} AS l_{i}_{j}" for i in range(j + 1, k))
        out.append(f"chol{j} AS MATERIALIZED (SELECT *{cells} FROM chol{j}_)")
        before = f"chol{j}"
    return out


def number_sql(seed: int, salt: int, key: str) -> str:
    """A number below 2^60, as ``acceptance`` draws it."""
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{salt}', CAST({key} AS VARCHAR))), 1, 15) AS BIGINT)"


def normal_sql(seed: int, key: str) -> str:
    low, high = (f"(({number_sql(seed, salt, key)} + 0.5e0) / 1152921504606846976e0)" for salt in (0, 1))
    return f"sqrt(-2 * ln({low})) * cos(2 * pi() * {high})"


def drawn_sql(k: int, n: int, seed: int = 1) -> str:
    """Queries after ``fitted_sql``: ``drawn`` has draw_id and beta_0, beta_1, … of n joint draws."""
    z = ", ".join(f"{normal_sql(seed + i, 'draw_id')} AS z{i}" for i in range(k))
    betas = ", ".join(f"b{i}" + "".join(f" + l_{i}_{j} * z{j}" for j in range(i + 1)) + f" AS beta_{i}" for i in range(k))
    numbers = f"numbers AS (SELECT draw_id, {z} FROM range({n}) r(draw_id))"
    return ",\n".join([*cholesky_sql(k), numbers, f"drawn AS MATERIALIZED (SELECT draw_id, {betas} FROM numbers, chol{k - 1})"])
