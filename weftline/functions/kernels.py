"""Small numpy kernels on one window's correlation matrix; Spark deals the windows to tasks.

``c`` is a correlation matrix; ``a`` its absolute values and ``s`` its values, both with a zero
diagonal; ``x`` a window of returns (rows are dates).
"""

from __future__ import annotations

import numpy as np


def correlation(x: np.ndarray) -> np.ndarray:
    """Correlations of columns; a column without variance has 0 with all others and with itself."""
    d = x - x.mean(axis=0)
    n = np.sqrt((d * d).sum(axis=0))
    u = np.divide(d, n, out=np.zeros_like(d), where=n > 1e-12)
    return u.T @ u


def off_diagonal(c: np.ndarray) -> np.ndarray:
    return c - np.diag(np.diag(c))


def unit_diagonal(c: np.ndarray) -> np.ndarray:
    """``c`` with ones on its diagonal, so that every node is at distance 0 of itself."""
    return off_diagonal(c) + np.eye(len(c))


def spectral_gap(a: np.ndarray) -> float:
    """Second least eigenvalue of the weighted Laplacian."""
    return float(np.linalg.eigvalsh(np.diag(a.sum(axis=1)) - a)[1]) if len(a) > 1 else 0.0


def parts(a: np.ndarray) -> tuple[float, float, float, float]:
    """Triangle mass, clustering, density and degree variance."""
    n, a2 = len(a), a @ a
    mass, k = float((a2 * a).sum()), a.sum(axis=1)
    paths = float(a2.sum() - np.trace(a2))
    return mass, mass / paths if paths > 0 else 0.0, float(a.sum() / (n * (n - 1))) if n > 1 else 0.0, float(k.var())


def omega(a: np.ndarray) -> float:
    """Clustering, density and degree variance times the spectral gap (modularity proxy 1 / gap, gap at least 1e-6)."""
    _, c, d, v = parts(a)
    return c * d * v * max(spectral_gap(a), 1e-6)


def omega_cross_market(a: np.ndarray) -> float:
    """Triangle mass times density times gap over degree variance; nan under three nodes or without degree variance."""
    mass, _, d, v = parts(a)
    gap = spectral_gap(a)
    return mass * d * (gap if gap > 1e-10 else 1e-5) / v if len(a) >= 3 and v > 0 else float("nan")


def gini(x: np.ndarray) -> float:
    x, s = np.sort(x), x.sum()
    return float((len(x) + 1 - 2 * x.cumsum().sum() / s) / len(x)) if s > 0 else 0.0


def omega_first(a: np.ndarray) -> float:
    _, c, d, v = parts(a)
    return c * d * max(spectral_gap(a), 1e-6) / (v + 1e-12)


def omega_shape(a: np.ndarray) -> float:
    _, c, _, _ = parts(a)
    k = a.sum(axis=1)
    return c * float(k.mean()) * max(spectral_gap(a), 1e-6) / (gini(k) + 1e-12)


def omega_signed(s: np.ndarray) -> float:
    """The composite index with the signed triangle mass in its clustering."""
    a = np.abs(s)
    a2 = a @ a
    paths = float(a2.sum() - np.trace(a2))
    _, _, d, v = parts(a)
    return (float(np.trace(s @ s @ s)) / paths if paths > 0 else 0.0) * d * v * max(spectral_gap(a), 1e-6)


def absorption(x: np.ndarray, k: int) -> float:
    """Share of the covariance eigenvalues that the ``k`` largest hold."""
    w = np.linalg.eigvalsh(np.cov(x, rowvar=False))
    return float(w[-k:].sum() / w.sum()) if w.sum() > 0 else 0.0


def entropy_rank(weights: np.ndarray) -> float:
    p = weights / weights.sum() if weights.sum() > 0 else np.ones(1)
    p = p[p > 0]
    return float(np.exp(-(p * np.log(p)).sum()))


def effective_rank(c: np.ndarray) -> float:
    return entropy_rank(np.clip(np.linalg.eigvalsh(c), 1e-9, None))


def effective_rank_returns(x: np.ndarray) -> float:
    q = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    return entropy_rank(q[q > 1e-12]) if (q > 1e-12).any() else 1.0


def balance(s: np.ndarray) -> float:
    """tr exp(s) / tr exp(|s|), from eigenvalues with the largest taken out of both."""
    e, f = np.linalg.eigvalsh(s), np.linalg.eigvalsh(np.abs(s))
    m, k = e.max(), f.max()
    return float(np.exp(m + np.log(np.exp(e - m).sum()) - k - np.log(np.exp(f - k).sum())))


def local_balance(s: np.ndarray) -> np.ndarray:
    """The same ratio at each node's diagonal entry."""

    def diagonal(m: np.ndarray) -> tuple[float, np.ndarray]:
        w, v = np.linalg.eigh(m)
        return w.max(), (v * v) @ np.exp(w - w.max())

    (m, p), (k, q) = diagonal(s), diagonal(np.abs(s))
    return p / q * np.exp(m - k)


def signs(c: np.ndarray, threshold: float = 0.25) -> np.ndarray:
    return off_diagonal(np.where(c > threshold, 1.0, np.where(c < -threshold, -1.0, 0.0)))


def surprise(x: np.ndarray) -> tuple[float, float, float]:
    """Of the last row: Mahalanobis turbulence, magnitude (no correlations) and their ratio."""
    cov, y = np.cov(x, rowvar=False), x[-1] - x.mean(axis=0)
    turbulence = float(y @ np.linalg.pinv(cov) @ y)
    magnitude = float(y @ np.linalg.pinv(np.diag(np.diag(cov))) @ y)
    return turbulence, magnitude, turbulence / magnitude if magnitude > 0 else 0.0


def factor_count(values: np.ndarray, n: int, rows: int, rule: str | int) -> int:
    """Factors by a fixed number, ``kaiser`` (above 1) or ``edge`` (above the Marchenko-Pastur edge); at least 1."""
    if isinstance(rule, int):
        return rule
    return max(1, int((values > (1.0 if rule == "kaiser" else (1 + np.sqrt(n / rows)) ** 2)).sum()))


def spectral_attribution(c: np.ndarray, rows: int, rule: str | int) -> np.ndarray:
    w, v = np.linalg.eigh(c)
    return np.abs(v[:, -factor_count(w, len(c), rows, rule) :]).sum(axis=1)


def distance(c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(2 * (1 - c), 0, None))


def earth_mover(p: np.ndarray, q: np.ndarray, cost: np.ndarray) -> float:
    """Least cost of moving distribution ``p`` to ``q`` where ``cost`` is a metric: what both have at a place stays there."""
    gain = p - q
    rows, columns = np.flatnonzero(gain > 1e-15), np.flatnonzero(gain < -1e-15)
    return transport(gain[rows], -gain[columns], cost[np.ix_(rows, columns)])


def likely_arcs(supply: np.ndarray, need: np.ndarray, c: np.ndarray, rounds: int = 200) -> list[int]:
    """All arcs (row * columns + column), first those that carry most of what they could in a smoothed plan (scaling of rows and columns by turns)."""
    width = 0.006 * float(c.max() - c.min()) or 1.0
    kernel, a = np.exp((c.min() - c) / width), np.ones(len(supply))
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            b = need / (a @ kernel)
            a = supply / (kernel @ b)
        part = a[:, None] * kernel * b / np.minimum(supply[:, None], need)
    return np.argsort(-np.nan_to_num(part, posinf=0.0), axis=None, kind="stable").tolist()


def first_tree(supply: list[float], need: list[float], arcs: list[int]) -> list[list[tuple[int, float]]]:
    """For each place (rows, then columns) its neighbours and flows in a spanning tree that meets all supplies: each arc of the list in turn takes what it can and closes a row or a column."""
    rows, columns = len(supply), len(need)
    left, beside = [*supply, *need], [[] for _ in range(rows + columns)]
    closed, open_rows, open_columns = [False] * (rows + columns), rows, columns
    for e in arcs:
        i, j = e // columns, rows + e % columns
        if closed[i] or closed[j]:
            continue
        flow = min(left[i], left[j])
        beside[i].append((j, flow))
        beside[j].append((i, flow))
        shut_row = open_columns == 1 or (left[i] <= left[j] and open_rows > 1)
        left[i] -= flow
        left[j] -= flow
        closed[i if shut_row else j] = True
        open_rows, open_columns = open_rows - shut_row, open_columns - (not shut_row)
        if not open_rows or not open_columns:
            break
    return beside


def transport(supply: np.ndarray, need: np.ndarray, c: np.ndarray, rows_at_once: int = 64) -> float:
    """Least cost of moving ``supply`` to ``need`` (equal sums): network simplex from a tree of likely arcs.

    The basis is a tree of rows and columns with a price each. An arc that is cheaper than its ends'
    prices enters; on the cycle that it closes the arc that is first used up leaves, and the part cut off
    is hung anew with its prices shifted. Some rows are priced at a time, until all show no such arc: then
    the prices prove the plan least. Supplies are raised by about 1e-13 each, so that no step is idle.
    """
    m, k = c.shape
    if not m or not k:
        return 0.0
    supply = supply + 1e-13 * (1 + np.arange(m) % 97 / 97)
    need = need.astype(float).copy()
    need[need.argmax()] += supply.sum() - need.sum()
    beside = first_tree(supply.tolist(), need.tolist(), likely_arcs(supply, need, c))
    above, flow, below = [-1] * (m + k), [0.0] * (m + k), [set() for _ in range(m + k)]
    row_price, column_price = np.zeros(m), np.zeros(k)
    stack = [0]
    while stack:
        x = stack.pop()
        for y, f in beside[x]:
            if y != above[x]:
                above[y], flow[y] = x, f
                below[x].add(y)
                if x < m:
                    column_price[y - m] = c[x, y - m] - row_price[x]
                else:
                    row_price[y] = c[y, x - m] - column_price[x - m]
                stack.append(y)
    parts = [(i, min(i + rows_at_once, m)) for i in range(0, m, rows_at_once)]
    at = settled = 0
    while settled < len(parts):
        low, high = parts[at]
        at = (at + 1) % len(parts)
        gap = c[low:high] - column_price
        gap -= row_price[low:high, None]
        best = int(gap.argmin())
        less = float(gap.flat[best])
        if less > -1e-12:
            settled += 1
            continue
        settled = 0
        row, column = low + best // k, m + best % k
        from_row = [row]
        while above[from_row[-1]] >= 0:
            from_row.append(above[from_row[-1]])
        place = {x: i for i, x in enumerate(from_row)}
        from_column, x = [], column
        while x not in place:
            from_column.append(x)
            x = above[x]
        from_row = from_row[: place[x]]
        # the arcs over a row on the row's way to the common ancestor, and over a column on the column's, carry less
        falling = from_row[::2] + from_column[::2]
        out = min(falling, key=flow.__getitem__)
        amount = flow[out]
        for x in falling:
            flow[x] -= amount
        for x in from_row[1::2] + from_column[1::2]:
            flow[x] += amount
        by_row = out in from_row
        path, parent, f = (from_row, column, amount) if by_row else (from_column, row, amount)
        for x in path:
            below[above[x]].discard(x)
            above[x], parent, flow[x], f = parent, x, f, flow[x]
            below[above[x]].add(x)
            if x == out:
                break
        moved, stack = [], [path[0]]
        while stack:
            x = stack.pop()
            moved.append(x)
            stack.extend(below[x])
        shift = less if by_row else -less
        row_price[[x for x in moved if x < m]] += shift
        column_price[[x - m for x in moved if x >= m]] -= shift
    return float(sum(flow[x] * (c[x, p - m] if x < m else c[p, x - m]) for x, p in enumerate(above) if p >= 0))


def curvature_sums(c: np.ndarray, first: int = 0, last: int | None = None) -> tuple[float, float, float, int]:
    """Of the edges number ``first`` to ``last`` (pairs i < j in order): sums of Ollivier-Ricci curvature, of it times absolute correlation, of absolute correlation, and how many count.

    A node's measure spreads over its neighbours by absolute correlation; edges shorter than 1e-9 do not count.
    """
    a, d, n = np.abs(off_diagonal(c)), distance(c), len(c)
    np.fill_diagonal(d, 0.0)
    k = a.sum(axis=1, keepdims=True)
    measure = np.divide(a, k, out=np.full_like(a, 1.0 / n), where=k > 0)
    rows, columns = (x[first:last] for x in np.triu_indices(n, 1))
    pairs = [(i, j) for i, j in zip(rows.tolist(), columns.tolist()) if d[i, j] > 1e-9]
    r = np.array([1 - earth_mover(measure[i], measure[j], d) / d[i, j] for i, j in pairs])
    w = np.array([a[i, j] for i, j in pairs])
    return float(r.sum()), float((r * w).sum()), float(w.sum()), len(pairs)


def curvature(c: np.ndarray) -> tuple[float, float]:
    """Mean curvature of all edges, plain and weighted by absolute correlation; 0 without edges."""
    total, weighted, weight, n = curvature_sums(c)
    return total / n if n else 0.0, weighted / weight if weight > 0 else 0.0


def rips_pairs(d: np.ndarray, top: int = 2) -> list[tuple[int, float, float]]:
    """(dimension, birth, death) of the Vietoris-Rips filtration up to ``top``-simplices; no zero-length or endless classes.

    For a few dozen points and any dimension: columns of the boundary matrix are sets of rows, reduced
    over two elements from the left. ``loops_and_parts`` is for many points and dimensions 0 and 1.
    """
    from itertools import combinations

    n = len(d)
    simplices = sorted((max((d[i, j] for i, j in combinations(v, 2)), default=0.0), k, v) for k in range(top + 1) for v in combinations(range(n), k + 1))
    place = {v: i for i, (_, _, v) in enumerate(simplices)}
    owner: dict[int, set[int]] = {}
    out = []
    for death, k, v in simplices:
        column = {place[f] for f in combinations(v, k)} if k else set()
        while column and (low := max(column)) in owner:
            column ^= owner[low]
        if column:
            low = max(column)
            owner[low] = column
            birth = simplices[low][0]
            if death > birth:
                out.append((k - 1, float(birth), float(death)))
    return out


def loops_and_parts(d: np.ndarray) -> list[tuple[int, float, float]]:
    """``rips_pairs`` for dimensions 0 and 1 of any number of points.

    At the enclosing radius (the least over points of the largest distance from it) all is one cone, so
    longer edges change nothing. Edges that join parts end those; each other edge, longest first, is
    paired with the first triangle left in its reduced coboundary, and most need no reduction.
    """
    n = len(d)
    if n < 2:
        return []
    radius = d.max(axis=1).min()
    rows, columns = np.triu_indices(n, 1)
    order = np.argsort(d[rows, columns], kind="stable")
    edges = [(float(d[i, j]), int(i), int(j)) for i, j in zip(rows[order], columns[order]) if d[i, j] <= radius]
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out, cycles = [], []
    for length, i, j in edges:
        a, b = root(i), root(j)
        if a == b:
            cycles.append((length, i, j))
        else:
            up[b] = a
            if length > 0:
                out.append((0, 0.0, length))

    def coboundary(length: float, i: int, j: int) -> set[tuple[float, int, int, int]]:
        far = np.maximum(np.maximum(d[i], d[j]), length)
        far[[i, j]] = np.inf
        return {(float(far[k]), *sorted((i, j, int(k)))) for k in np.flatnonzero(far <= radius)}

    owner: dict[tuple[float, int, int, int], tuple[float, int, int] | set] = {}
    for edge in reversed(cycles):
        column, reduced = coboundary(*edge), False
        while column and (first := min(column)) in owner:
            other = owner[first]
            column ^= other if isinstance(other, set) else coboundary(*other)
            reduced = True
        if column:
            first = min(column)
            owner[first] = column if reduced else edge  # an unreduced column is made again when needed
            if first[0] > edge[0]:
                out.append((1, edge[0], first[0]))
    return out


def factor_model(c: np.ndarray, rows: int, rule: str | int = "edge") -> tuple[np.ndarray, np.ndarray]:
    """Loadings B and idiosyncratic variances d (at least 1e-6) with c close to B B' + diag(d)."""
    w, v = np.linalg.eigh(c)
    k = factor_count(w, len(c), rows, rule)
    b = v[:, -k:] * np.sqrt(np.clip(w[-k:], 0, None))
    return b, np.clip(1 - (b * b).sum(axis=1), 1e-6, None)


def shrink_target(s: np.ndarray, kind: str) -> np.ndarray:
    """Targets for a covariance: ``identity`` (mean variance), ``constant`` (mean correlation), ``degree`` (rank one, from degrees) or ``triadic`` (two-step weights).

    The last two are correlations by scaling their diagonal to 1; the degrees' own are then all 1.
    """
    sd = np.sqrt(np.diag(s))
    scale = np.outer(sd, sd)
    c = s / scale
    n = len(s)
    if kind == "identity":
        return np.eye(n) * np.diag(s).mean()
    if kind == "constant":
        r = np.full((n, n), off_diagonal(c).sum() / (n * (n - 1)))
    else:
        a = np.abs(off_diagonal(c))
        r = np.outer(a.sum(axis=1), a.sum(axis=1)) if kind == "degree" else a @ a
        root = np.sqrt(np.clip(np.diag(r), 1e-12, None))
        r = r / np.outer(root, root)
    np.fill_diagonal(r, 1.0)
    return r * scale


def nonlinear_shrinkage(x: np.ndarray) -> np.ndarray:
    """Analytical nonlinear shrinkage of the sample covariance with an Epanechnikov kernel (fewer columns than rows)."""
    rows, p = len(x) - 1, x.shape[1]
    w, v = np.linalg.eigh(np.cov(x, rowvar=False))
    ratio, h = p / rows, rows ** (-1 / 3)
    gap = (w[:, None] - w[None, :]) / (h * w[None, :])
    root5 = np.sqrt(5.0)
    density = (3 / (4 * root5) * np.maximum(1 - gap**2 / 5, 0) / (h * w[None, :])).mean(axis=1)
    inner = 3 / (4 * root5 * np.pi) * (1 - gap**2 / 5) * np.log(np.abs((root5 - gap) / (root5 + gap)), where=np.abs(np.abs(gap) - root5) > 1e-12, out=np.zeros_like(gap))
    hilbert = ((-3 / (10 * np.pi) * gap + inner) / (h * w[None, :])).mean(axis=1)
    shrunk = w / ((np.pi * ratio * w * density) ** 2 + (1 - ratio - np.pi * ratio * w * hilbert) ** 2)
    return (v * shrunk) @ v.T


def minimum_variance(s: np.ndarray) -> np.ndarray:
    """Weights of sum 1 with the least variance under covariance ``s``: in its eigenvectors each direction weighs its sum over its variance.

    Directions of less than 1e-12 of the largest variance count as that much.
    """
    values, vectors = np.linalg.eigh(s)
    w = vectors @ (vectors.sum(axis=0) / np.maximum(values, 1e-12 * max(float(values[-1]), 1e-300)))
    return w / w.sum()
