"""SQL for indices of small windows: eigenvalues of 6 by 6 matrices come from traces of powers.

The traces give the characteristic polynomial (Newton's identities); its roots, all real, are found
from the largest down by Newton steps and divided out.
"""

from __future__ import annotations

from .base import EDGES

NAMES = ["omega", "omega_cross", "omega_first", "omega_shape", "omega_signed", "gap", "absorption", "erank", "erank_returns", "balance", "balance_signs", "turbulence", "surprise"]
SIZE = 6


def eigenvalues(name: str) -> str:
    """Tables ``<name>v (win, l1..l6)`` of the symmetric matrices ``<name> (win, i, j, v)``, largest first."""
    steps = [
        f"{name}2 AS (SELECT a.win, a.i, b.j, sum(a.v * b.v) AS v FROM {name} a JOIN {name} b ON a.win = b.win AND a.j = b.i GROUP BY 1, 2, 3)",
        f"{name}3 AS (SELECT a.win, a.i, b.j, sum(a.v * b.v) AS v FROM {name}2 a JOIN {name} b ON a.win = b.win AND a.j = b.i GROUP BY 1, 2, 3)",
        f"{name}t AS (SELECT a.win, sum(CASE WHEN a.i = a.j THEN a.v ELSE 0 END) AS t1, sum(a.v * a.v) AS t2, sum(a.v * b.v) AS t3, sum(b.v * b.v) AS t4, sum(b.v * c.v) AS t5, sum(c.v * c.v) AS t6 FROM {name} a JOIN {name}2 b USING (win, i, j) JOIN {name}3 c USING (win, i, j) GROUP BY 1)",
    ]
    e = ["1.0"]
    select = []
    for k in range(1, SIZE + 1):
        terms = " ".join(f"{'+' if i % 2 else '-'} {f'e{k - i}' if k > i else '1.0'} * t{i}" for i in range(1, k + 1))
        select.append(f"(0.0 {terms}) / {k} AS e{k}")
        e.append(f"e{k}")
    steps.append(f"{name}e AS (SELECT win, t2, {', '.join(select)} FROM {name}t)")
    steps.append(f"{name}p0 AS (SELECT win, sqrt(t2) + 1e-12 AS l0, " + ", ".join(f"{'-' if k % 2 else ''}{e[k]} AS c{k}" for k in range(SIZE + 1)) + f" FROM {name}e)")
    for k in range(1, SIZE + 1):
        degree = SIZE + 1 - k
        value, slope = "c0", f"{degree}.0 * c0"
        for i in range(1, degree + 1):
            value = f"({value} * x + c{i})"
        for i in range(1, degree):
            slope = f"({slope} * x + {degree - i}.0 * c{i})"
        newton = f"list_reduce(list_concat([l{k - 1}], list_transform(range(120), lambda n: 0.0)), lambda x, n: x - coalesce({value} / nullif({slope}, 0), 0))"
        root = newton if degree > 1 else "-c1 / c0"
        kept = ", ".join(f"l{i}" for i in range(k))
        steps.append(f"{name}r{k} AS (SELECT win, {kept}, {root} AS l{k}, " + ", ".join(f"c{i}" for i in range(degree + 1)) + f" FROM {name}p{k - 1})")
        if degree > 1:
            new, out = "c0", ["c0"]
            for i in range(1, degree):
                new = f"(c{i} + l{k} * {new})"
                out.append(f"{new} AS c{i}")
            steps.append(f"{name}p{k} AS (SELECT win, {kept}, l{k}, " + ", ".join(out) + f" FROM {name}r{k})")
    steps.append(f"{name}v AS (SELECT win, " + ", ".join(f"l{i}" for i in range(1, SIZE + 1)) + f" FROM {name}r{SIZE})")
    return ",\n".join(steps)


roots = [f"l{i}" for i in range(1, SIZE + 1)]
exps = " + ".join(f"exp({x})" for x in roots)


def rank_of(weights: list[str]) -> str:
    """exp of the entropy of weights as shares of their sum."""
    total = "(" + " + ".join(weights) + ")"
    return "exp(-(" + " + ".join(f"{w} / {total} * ln({w} / {total})" for w in weights) + "))"


MATRICES = (
    EDGES
    + """,
nodes AS (SELECT DISTINCT win, node FROM mem),
full_edges AS (SELECT win, i, j, rho FROM both_ways UNION ALL SELECT win, node, node, 0.0 FROM nodes),
ms AS (SELECT win, i, j, rho AS v FROM full_edges),
ma AS (SELECT win, i, j, abs(rho) AS v FROM full_edges),
mg AS (SELECT win, i, j, CASE WHEN rho > 0.25 THEN 1.0 WHEN rho < -0.25 THEN -1.0 ELSE 0.0 END AS v FROM full_edges),
mh AS (SELECT win, i, j, abs(v) AS v FROM mg),
mc AS (SELECT win, i, j, CASE WHEN i = j THEN 1.0 ELSE rho END AS v FROM full_edges),
ml AS (SELECT f.win, i, j, CASE WHEN i = j THEN degree ELSE -abs(rho) END AS v FROM full_edges f JOIN deg d ON d.win = f.win AND d.node = f.i),
vars AS (SELECT win, node, var_samp(ret) AS s FROM mem GROUP BY 1, 2), tot AS (SELECT win, sum(s) AS tot FROM vars GROUP BY 1),
mv AS (SELECT c.win, c.i, c.j, c.v * sqrt(a.s * b.s) / tot AS v FROM mc c JOIN vars a ON a.win = c.win AND a.node = c.i JOIN vars b ON b.win = c.win AND b.node = c.j JOIN tot ON tot.win = c.win),
"""
    + ",\n".join(eigenvalues(m) for m in ("ms", "ma", "mg", "mh", "mc", "ml", "mv"))
)
#: The last row's distance from the mean, and powers of the covariance (over its trace) applied to it.
POWERS = "y0 AS (SELECT m.win, m.node AS i, any_value(m.ret) FILTER (m.pos = h.\"end\" - 1) - avg(m.ret) AS v FROM mem m JOIN hops h USING (win) GROUP BY 1, 2),\n" + ",\n".join(
    f"y{k} AS (SELECT a.win, a.i, sum(a.v * b.v) AS v FROM mv a JOIN y{k - 1} b ON a.win = b.win AND a.j = b.i GROUP BY 1, 2)" for k in range(1, SIZE)
) + ",\nyy AS (SELECT y0.win, " + ", ".join(f"sum(y0.v * y{k}.v) AS u{k}" for k in range(SIZE)) + " FROM y0 " + " ".join(f"JOIN y{k} ON y{k}.win = y0.win AND y{k}.i = y0.i" for k in range(1, SIZE)) + " GROUP BY 1)"

INDICES = (
    MATRICES
    + ",\n"
    + POWERS
    + f""",
tri_mass AS (SELECT win, 6 * sum(w) AS mass, 6 * sum(sw) AS signed_mass FROM tri GROUP BY 1),
gn AS (SELECT win, (count(*) + 1 - 2 * sum(run) / any_value(tot)) / count(*) AS gini FROM (SELECT win, sum(degree) OVER (PARTITION BY win ORDER BY degree, node ROWS UNBOUNDED PRECEDING) AS run, sum(degree) OVER (PARTITION BY win) AS tot FROM deg) GROUP BY 1),
dg AS (SELECT win, sum(degree) / {SIZE * (SIZE - 1)} AS density, var_pop(degree) AS spread, avg(degree) AS mean_degree, sum(degree ^ 2) AS paths FROM deg GROUP BY 1),
ed AS (SELECT win, 2 * sum(rho ^ 2) AS tr_a2 FROM edges GROUP BY 1),
base AS (SELECT win, mass, mass / (paths - tr_a2) AS clustering, signed_mass / (paths - tr_a2) AS signed_clustering, density, spread, mean_degree, gini FROM tri_mass JOIN dg USING (win) JOIN ed USING (win) JOIN gn USING (win)),
gap AS (SELECT win, greatest(l5, 1e-6) AS gap FROM mlv),
plain AS (SELECT win, {exps} AS e FROM msv), strong AS (SELECT win, {exps} AS e FROM mav), plain_signs AS (SELECT win, {exps} AS e FROM mgv), strong_signs AS (SELECT win, {exps} AS e FROM mhv),
ranks AS (SELECT win, {rank_of(roots)} AS erank FROM mcv), ranks_returns AS (SELECT win, {rank_of([f"sqrt({x})" for x in roots])} AS erank_returns, l1 AS absorption FROM mvv),
turb AS (SELECT win, -(u5 - e1 * u4 + e2 * u3 - e3 * u2 + e4 * u1 - e5 * u0) / e6 / tot AS turbulence FROM yy JOIN mve USING (win) JOIN tot USING (win)),
magn AS (SELECT y0.win, sum(v * v / s) AS magnitude FROM y0 JOIN vars ON vars.win = y0.win AND vars.node = y0.i GROUP BY 1),
indices AS (SELECT b.win, clustering * density * spread * gap AS omega, mass * density * gap / spread AS omega_cross, clustering * density * gap / (spread + 1e-12) AS omega_first, clustering * mean_degree * gap / (gini + 1e-12) AS omega_shape, signed_clustering * density * spread * gap AS omega_signed, gap,
  absorption, erank, erank_returns, plain.e / strong.e AS balance, plain_signs.e / strong_signs.e AS balance_signs, turbulence, turbulence / magnitude AS surprise
  FROM base b JOIN gap USING (win) JOIN plain USING (win) JOIN strong USING (win) JOIN plain_signs USING (win) JOIN strong_signs USING (win) JOIN ranks USING (win) JOIN ranks_returns USING (win) JOIN turb USING (win) JOIN magn USING (win))"""
)


def exponential(name: str, terms: int = 34) -> str:
    """``<name>d (win, node, d)``: the diagonal of exp of ``<name> (win, i, j, v)``, by its series."""
    steps = [f"{name}x0 AS (SELECT DISTINCT win, i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS v FROM {name})"]
    for k in range(1, terms):
        steps.append(f"{name}x{k} AS MATERIALIZED (SELECT a.win, a.i, b.j, sum(a.v * b.v) / {k} AS v FROM {name}x{k - 1} a JOIN {name} b ON a.win = b.win AND a.j = b.i GROUP BY 1, 2, 3)")
    every = " UNION ALL ".join(f"SELECT win, i, v FROM {name}x{k} WHERE i = j" for k in range(terms))
    return ",\n".join([*steps, f"{name}d AS (SELECT win, i AS node, sum(v) AS d FROM ({every}) GROUP BY 1, 2)"])


NODE_BALANCE = (
    EDGES
    + """,
full_edges AS (SELECT win, i, j, rho FROM both_ways UNION ALL SELECT DISTINCT win, node, node, 0.0 FROM mem),
ms AS (SELECT win, i, j, rho AS v FROM full_edges), ma AS (SELECT win, i, j, abs(rho) AS v FROM full_edges),
"""
    + exponential("ms")
    + ",\n"
    + exponential("ma")
    + """,
nb AS (SELECT win, node, p.d / q.d AS local_balance, sum(p.d) OVER (PARTITION BY win) / sum(q.d) OVER (PARTITION BY win) AS balance, sum(p.d) OVER (PARTITION BY win) / sum(q.d) OVER (PARTITION BY win) - p.d / q.d AS balance_gap FROM msd p JOIN mad q USING (win, node))"""
)
