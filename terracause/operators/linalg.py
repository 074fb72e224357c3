"""Small NumPy kernels for grouped maps: one pixel's matrices at a time."""

from __future__ import annotations

import numpy as np


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a square system; NaN where it is singular."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.full(b.shape, np.nan)


def least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x, y, rcond=None)[0]


def entropy_approximation(u: np.ndarray) -> float:
    """Maximum-entropy approximation of a standardised variable's differential entropy (Hyvarinen 1998)."""
    k1, k2, gamma = 79.047, 7.4129, 0.37457
    a = np.log(np.cosh(u)).mean() - gamma
    b = (u * np.exp(-(u**2) / 2)).mean()
    return (1 + np.log(2 * np.pi)) / 2 - k1 * a * a - k2 * b * b


def causal_order(x: np.ndarray, forbidden: set[tuple[int, int]] = frozenset()) -> list[int]:
    """DirectLiNGAM: again and again the variable whose residuals are least dependent on it (pairwise likelihood ratios)."""
    x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
    left, order = list(range(x.shape[1])), []
    while len(left) > 1:
        best, least = left[0], np.inf
        free = [i for i in left if all((j, i) in forbidden or (i, j) not in forbidden for j in left if j != i)] or left
        for i in free:
            cost = 0.0
            for j in left:
                if i == j:
                    continue
                a, b = _unit(x[:, i]), _unit(x[:, j])
                r = (a * b).mean()
                s = np.sqrt(max(1 - r * r, 1e-12))
                diff = (entropy_approximation(b) + entropy_approximation((a - r * b) / s)) - (entropy_approximation(a) + entropy_approximation((b - r * a) / s))
                cost += min(0.0, diff) ** 2
            if cost < least:
                best, least = i, cost
        order.append(best)
        left.remove(best)
        a = x[:, best]
        for j in left:
            x[:, j] = x[:, j] - (a * x[:, j]).mean() / max((a * a).mean(), 1e-12) * a
    return order + left


def _unit(v: np.ndarray) -> np.ndarray:
    return (v - v.mean()) / max(v.std(), 1e-12)


def weights_along(x: np.ndarray, order: list[int], forbidden: set[tuple[int, int]] = frozenset()) -> np.ndarray:
    """B[child, parent] by least squares on the earlier variables of an order, pruned by an adaptive lasso with BIC."""
    n, d = x.shape
    b = np.zeros((d, d))
    c = x - x.mean(0)
    for k, child in enumerate(order):
        parents = [p for p in order[:k] if (p, child) not in forbidden]
        if parents:
            b[child, parents] = adaptive_lasso(c[:, parents], c[:, child])
    return b


def adaptive_lasso(x: np.ndarray, y: np.ndarray, steps: int = 24) -> np.ndarray:
    """Lasso weighted by the least-squares fit; of the supports along its path the one with the best BIC after a plain refit, so that weights aren't shrunk.

    Coordinate descent on sums.
    """
    n = len(y)
    ols = least_squares(x, y)
    w = np.abs(ols) + 1e-12
    xs = x * w
    g, h, yy = xs.T @ xs / n, xs.T @ y / n, y @ y / n
    best, least, seen = ols, np.inf, set()
    # few numbers: plain floats are faster than arrays
    lines, diagonal = g.tolist(), np.diag(g).tolist()
    beta, left = [0.0] * len(w), h.tolist()  # left: h - g beta
    for penalty in np.geomspace(max(np.abs(h).max(), 1e-12), max(np.abs(h).max(), 1e-12) * 1e-4, steps).tolist():
        for _ in range(50):
            moved = 0.0
            for j, size in enumerate(diagonal):
                if size > 0:
                    rho = left[j] + size * beta[j]
                    new = (rho - penalty if rho > penalty else rho + penalty if rho < -penalty else 0.0) / size
                    step = new - beta[j]
                    if step:
                        beta[j] = new
                        left = [v - step * c for v, c in zip(left, lines[j], strict=True)]
                        moved = max(moved, abs(step))
            if moved < 1e-8:
                break
        some = tuple(j for j, v in enumerate(beta) if v)
        if some in seen:
            continue
        seen.add(some)
        at = list(some)
        b = np.zeros(len(w))
        b[at] = least_squares(g[np.ix_(at, at)], h[at])
        bic = n * np.log(max(yy - h @ b, 1e-300)) + np.log(n) * len(at)
        if bic < least:
            best, least = b * w, bic
    return best


def lagged_weights(x: np.ndarray, lags: int, forbidden: set[tuple[int, int]] = frozenset(), prune: bool = True) -> list[np.ndarray]:
    """VAR-LiNGAM of one series: B_0 (acyclic, by the order of the innovations) and B_1 ... B_p as child x parent.

    With ``prune``, each child has one adaptive lasso over its earlier variables and all variables of
    all lags together, so that edges without use vanish whatever their lag; else B_l = (I - B_0) A_l.
    """
    reduced, e = var_fit(x, lags)
    order = causal_order(e, forbidden)
    d = x.shape[1]
    if not prune:
        b0 = weights_along(e, order, forbidden)
        return [b0, *[(np.eye(d) - b0) @ a for a in reduced]]
    now = x[lags:] - x[lags:].mean(0)
    past = np.concatenate([x[lags - k : len(x) - k] for k in range(1, lags + 1)], axis=1)
    past = past - past.mean(0)
    out = [np.zeros((d, d)) for _ in range(lags + 1)]
    for i, child in enumerate(order):
        parents = [p for p in order[:i] if (p, child) not in forbidden]
        w = adaptive_lasso(np.concatenate([now[:, parents], past], axis=1), now[:, child])
        out[0][child, parents] = w[: len(parents)]
        for k in range(lags):
            out[k + 1][child] = w[len(parents) + k * d : len(parents) + (k + 1) * d]
    return out


def var_redrawn(a: list[np.ndarray], shocks: np.ndarray, start: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A series that starts like the given one and goes on with shocks drawn from ``shocks``."""
    p = len(a)
    out = np.zeros((p + len(places), start.shape[1]))
    out[:p] = start[:p]
    out[p:] = shocks[places]
    for t in range(p, len(out)):
        for k in range(p):
            out[t] += a[k] @ out[t - 1 - k]
    return out


def portmanteau_each(e: np.ndarray, lags: int) -> np.ndarray:
    """Sum of the adjusted multivariate portmanteau over lags, for each of many series (series x rows x variables)."""
    n = e.shape[1]
    c = e - e.mean(1, keepdims=True)
    inverse = np.linalg.pinv(c.transpose(0, 2, 1) @ c / n)
    out = np.zeros(len(e))
    for h in range(1, lags + 1):
        ch = c[:, h:].transpose(0, 2, 1) @ c[:, :-h] / n
        out += n * n / (n - h) * np.einsum("nij,nij->n", inverse @ ch, ch @ inverse)
    return out


def var_residuals_each(y: np.ndarray, lags: int) -> np.ndarray:
    """Residuals of an intercept-free VAR of each of many series (series x rows x variables)."""
    n = y.shape[1]
    past = np.concatenate([y[:, lags - k : n - k] for k in range(1, lags + 1)], axis=2)
    gram = past.transpose(0, 2, 1) @ past
    coef = np.linalg.pinv(gram, hermitian=True) @ (past.transpose(0, 2, 1) @ y[:, lags:])
    return y[:, lags:] - past @ coef


def var_fit(x: np.ndarray, lags: int, intercept: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    """Reduced-form coefficients A_1 … A_p and innovations."""
    n, d = x.shape
    past = np.concatenate([x[lags - k : n - k] for k in range(1, lags + 1)], axis=1)
    z = np.concatenate([np.ones((n - lags, 1)), past], axis=1) if intercept else past
    coef = least_squares(z, x[lags:])
    body = coef[1:] if intercept else coef
    return [body[(k - 1) * d : k * d].T for k in range(1, lags + 1)], x[lags:] - z @ coef


def lag_order(x: np.ndarray, most: int, criterion: str) -> int:
    """Lags by bic, aic, hqic or fpe over a common sample; ``none`` takes the most."""
    if criterion == "none":
        return most
    d, n = x.shape[1], len(x) - most
    scores = []
    for p in range(1, most + 1):
        _, e = var_fit(x[most - p :], p)
        k = d * d * p + d
        sign, logdet = np.linalg.slogdet(e.T @ e / n)
        logdet = logdet if sign > 0 else np.inf
        if criterion == "fpe":
            scores.append(d * np.log((n + d * p + 1) / max(n - d * p - 1, 1)) + logdet)
        else:
            scores.append(logdet + k * {"bic": np.log(n), "aic": 2.0, "hqic": 2 * np.log(np.log(n))}[criterion] / n)
    return int(np.argmin(scores)) + 1


def spectral_radius(lagged: list[np.ndarray]) -> float:
    """Largest absolute eigenvalue of the companion matrix."""
    d, p = len(lagged[0]), len(lagged)
    top = np.concatenate(lagged, axis=1)
    companion = np.concatenate([top, np.eye(d * (p - 1), d * p)]) if p > 1 else top
    return float(np.abs(np.linalg.eigvals(companion)).max())


def dynamic_effects(b0: np.ndarray, lagged: list[np.ndarray], horizon: int) -> list[np.ndarray]:
    """Theta_0 = (I - B0)^-1, Theta_h = sum over l of A_l Theta_{h-l}, with A_l = (I - B0)^-1 B_l."""
    inverse = np.linalg.inv(np.eye(len(b0)) - b0)
    reduced = [inverse @ b for b in lagged]
    out = [inverse]
    for h in range(1, horizon + 1):
        out.append(sum((a @ out[h - 1 - i] for i, a in enumerate(reduced) if h - 1 - i >= 0), np.zeros_like(b0)))
    return out


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function: the chi-square tail is gamma_tail(k/2, q/2)."""
    from math import exp, lgamma, log

    if x <= 0:
        return 1.0
    scale = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        for _ in range(10_000):
            k += 1
            term *= x / k
            total += term
            if term < total * 1e-15:
                break
        return min(1.0, max(0.0, 1 - total * scale))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, max(0.0, h * scale))


def portmanteau(e: np.ndarray, lags: int) -> np.ndarray:
    """Adjusted multivariate portmanteau contributions of lags 1 … ``lags``."""
    n = len(e)
    c = e - e.mean(0)
    inverse = np.linalg.pinv(c.T @ c / n)
    out = []
    for h in range(1, lags + 1):
        ch = c[h:].T @ c[:-h] / n
        out.append(n * n / (n - h) * float(np.trace(ch.T @ inverse @ ch @ inverse)))
    return np.array(out)


def separations(r: np.ndarray, n: float, critical: float) -> tuple[np.ndarray, dict[tuple[int, int], tuple[int, ...]]]:
    """Skeleton of the PC algorithm from a correlation matrix, and the set that separates each pair that isn't linked.

    Pairs are tested given ever larger sets of the neighbours that either had when the size began, by
    Fisher's z of the partial correlation.
    """
    from itertools import combinations

    d = len(r)
    near, apart, size = np.ones((d, d), bool) & ~np.eye(d, dtype=bool), {}, 0
    while near.sum(1).max(initial=0) > size:
        before = [set(np.flatnonzero(line).tolist()) for line in near]
        for i, j in combinations(range(d), 2):
            tried: set[tuple[int, ...]] = set()
            for end, other in ((i, j), (j, i)):
                for given in combinations(sorted(before[end] - {other}), size):
                    if near[i, j] and given not in tried:
                        tried.add(given)
                        part = np.linalg.pinv(r[np.ix_([i, j, *given], [i, j, *given])], hermitian=True)
                        rho = -part[0, 1] / np.sqrt(part[0, 0] * part[1, 1])
                        if not abs(np.arctanh(np.clip(rho, -1 + 1e-12, 1 - 1e-12))) * np.sqrt(max(n - size - 3, 0)) > critical:
                            near[i, j] = near[j, i] = False
                            apart[i, j] = given
        size += 1
    return near, apart


def orientations(near: np.ndarray, apart: dict[tuple[int, int], tuple[int, ...]]) -> np.ndarray:
    """Arrow heads (from, to) of a skeleton: colliders first, then Meek's rules until nothing changes. Both ends have one where colliders disagree."""
    d, head = len(near), np.zeros(near.shape, bool)
    for (i, j), given in sorted(apart.items()):
        for k in np.flatnonzero(near[i] & near[j]):
            if k not in given:
                head[i, k] = head[j, k] = True
    while True:
        before = head.copy()
        for i in range(d):
            for j in np.flatnonzero(near[i]):
                if head[i, j] or head[j, i]:
                    continue
                into = [k for k in range(d) if near[k, i] and head[k, i] and not head[i, k]]
                away = any(not near[k, j] and k != j for k in into)
                round_ = any(near[k, j] and head[i, k] and not head[k, i] and head[k, j] and not head[j, k] for k in range(d))
                ways = [k for k in range(d) if near[i, k] and not head[i, k] and not head[k, i] and near[k, j] and head[k, j] and not head[j, k]]
                if away or round_ or any(not near[a, b] for x, a in enumerate(ways) for b in ways[x + 1 :]):
                    head[i, j] = True
        if (head == before).all():
            return head
