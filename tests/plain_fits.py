"""The five models fitted to one lake in one process, by damped least squares with numeric derivatives: what the distributed fits are held against."""

import math

import numpy as np

MODELS = {"linear": 2, "quadratic": 3, "power": 3, "exponential": 3, "logarithmic": 3}
FLOOR = 1e-6
MONOTONE_SLACK = -1e-10
EXACT = 1e-12


def predict(model: str, h: np.ndarray, p) -> np.ndarray:
    with np.errstate(all="ignore"):
        if model == "linear":
            return p[0] * h + p[1]
        if model == "quadratic":
            return (p[0] * h + p[1]) * h + p[2]
        if model == "exponential":
            return p[0] * np.exp(p[1] * (h - p[2]))
        above = np.maximum(h - p[2 if model == "power" else 1], FLOOR)
        return p[0] * above ** p[1] if model == "power" else p[0] * np.log(above) + p[2]


def first_guess(model: str, h: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Slope from the ranges (1 for a range of 0), levels from the minima."""
    span_h, span_a = float(np.ptp(h)) or 1.0, float(np.ptp(a)) or 1.0
    slope, below = span_a / span_h, float(h.min()) - 0.1 * span_h
    if model == "linear":
        return np.array([slope, a.min() - slope * h.min()])
    if model == "quadratic":
        return np.array([0.0, slope, a.min()])
    return np.array([slope, below, 1.0]) if model == "logarithmic" else np.array([slope, 1.0, below])


def damped_least_squares(model: str, h: np.ndarray, a: np.ndarray, sigma: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Parameters and their covariance by Levenberg's and Marquardt's method with numeric derivatives; None if it breaks down."""
    p = first_guess(model, h, a)
    if model in ("linear", "quadratic"):
        # Solved directly around the mean level, then expanded: levels are large against their range.
        d = h - h.mean()
        powers = np.stack([d**k for k in range(MODELS[model] - 1, -1, -1)], 1) / sigma[:, None]
        if np.linalg.matrix_rank(powers) < powers.shape[1]:
            return None
        c, inverse = np.linalg.lstsq(powers, a / sigma, rcond=None)[0], np.linalg.inv(powers.T @ powers)
        m = h.mean()
        turn = np.array([[1, 0], [-m, 1]]) if model == "linear" else np.array([[1, 0, 0], [-2 * m, 1, 0], [m * m, -m, 1]])
        return turn @ c, turn @ inverse @ turn.T

    def residual(q):
        return (a - predict(model, h, q)) / sigma

    def slopes(q):
        out = np.empty((len(h), len(q)))
        for k in range(len(q)):
            step = 1.5e-8 * max(abs(q[k]), 1e-4)
            up = q.copy()
            up[k] += step
            out[:, k] = (predict(model, h, up) - predict(model, h, q)) / step / sigma
        return out

    r = residual(p)
    cost, damping, used = float(r @ r), 1e-3, 1
    if not np.isfinite(cost):
        return None
    while used < limit:
        j = slopes(p)
        used += len(p)
        if not np.isfinite(j).all():
            return None
        gram, down = j.T @ j, j.T @ r
        better = False
        while damping < 1e16 and used < limit:
            try:
                step = np.linalg.solve(gram + damping * np.diag(np.maximum(np.diag(gram), 1e-30)), down)
            except np.linalg.LinAlgError:
                damping *= 10
                continue
            r_new = residual(p + step)
            used += 1
            new = float(r_new @ r_new)
            if np.isfinite(new) and new <= cost:
                better = True
                break
            damping *= 4
        if not better:
            break
        gain = cost - new
        p, r, cost, damping = p + step, r_new, new, max(damping / 9, 1e-12)
        if gain <= 1e-12 * cost or np.abs(step).max() <= 1e-12 * np.abs(p).max():
            break
    covariance = np.linalg.pinv(slopes(p).T @ slopes(p))
    return (p, covariance) if np.isfinite(p).all() else None


def fit_lake(h: np.ndarray, a: np.ndarray, sigma: np.ndarray, cfg) -> list[tuple]:
    """A candidate for each model, fitted or not."""
    out = []
    n = len(h)
    total = float(((a - a.mean()) ** 2).sum()) if n else 0.0
    for i, (model, k) in enumerate(MODELS.items()):
        found = damped_least_squares(model, h, a, sigma, cfg.max_evaluations) if n >= 2 else None
        if found is None:
            out.append((model, [], [], None, math.inf, math.inf, False, False, i))
            continue
        p, covariance = found
        rss = float(((a - predict(model, h, p)) ** 2).sum())
        rss = 0.0 if rss <= EXACT * total else rss
        bic = n * math.log(rss / n) + k * math.log(n) if rss > 0 else -math.inf
        curve = predict(model, np.linspace(h.min(), h.max(), cfg.n_curve_samples), p)
        out.append((model, p.tolist(), np.sqrt(np.maximum(np.diag(covariance), 0)).tolist(), 1 - rss / total if total else 0.0, bic, math.sqrt(rss / n), bool((np.diff(curve) >= MONOTONE_SLACK).all()), True, i))
    return out
