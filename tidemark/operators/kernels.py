"""Kernels that columns can't express: complexity, recurrence, causality, topology, hidden states.

Each takes one numeric series (or two); ``grouped`` runs a set of them for each
key in Arrow batches.  Windowed kernels see one window at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from math import factorial, log, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray], float]


def finite(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return x[np.isfinite(x)]


def embedded(x: np.ndarray, m: int, tau: int = 1) -> np.ndarray:
    n = len(x) - (m - 1) * tau
    return np.stack([x[i * tau : i * tau + n] for i in range(m)], axis=1) if n > 0 else np.zeros((0, m))


def permutation_entropy(x: np.ndarray, m: int = 3, tau: int = 1, normal: bool = True) -> float:
    """Entropy (bits) of ordinal patterns; equal values keep their order."""
    v = embedded(finite(x), m, tau)
    if not len(v):
        return np.nan
    counts = Counter(map(tuple, np.argsort(v, axis=1, kind="stable")))
    h = -sum(c / len(v) * log2(c / len(v)) for c in counts.values())
    return h / log2(factorial(m)) if normal else h


def lempel_ziv(x: np.ndarray, bins: int = 3) -> float:
    """Phrases of the LZ78 parse of the series' quantile symbols, times log_bins(n) / n."""
    x = finite(x)
    if len(x) < 4 or np.ptp(x) == 0:
        return np.nan
    symbols = np.searchsorted(np.quantile(x, np.arange(1, bins) / bins), x, side="right")
    seen: set[tuple] = set()
    phrase: tuple = ()
    count = 0
    for s in symbols.tolist():
        phrase = (*phrase, s)
        if phrase not in seen:
            seen.add(phrase)
            count += 1
            phrase = ()
    return (count + bool(phrase)) * log(len(x), bins) / len(x)


def hurst(x: np.ndarray, most: int = 20) -> float:
    """Slope of log deviation of lagged sums against log lag."""
    x = finite(x)
    lags = [k for k in range(2, most) if k < len(x) // 2]
    path = np.cumsum(x)
    sd = np.array([np.std(path[k:] - path[:-k]) for k in lags])
    ok = sd > 0
    return float(np.polyfit(np.log(np.array(lags)[ok]), np.log(sd[ok]), 1)[0]) if ok.sum() > 2 else np.nan


def dfa(x: np.ndarray, scales: int = 10) -> float:
    """Detrended fluctuation exponent over logarithmic window sizes."""
    x = finite(x)
    if len(x) < 32:
        return np.nan
    path = np.cumsum(x - x.mean())
    sizes = np.unique(np.geomspace(4, len(x) // 4, scales).astype(int))
    level = []
    for n in sizes:
        k = len(path) // n
        part = path[: k * n].reshape(k, n)
        t = np.arange(n) - (n - 1) / 2
        slope = (part @ t) / (t @ t)
        rest = part - part.mean(axis=1, keepdims=True) - slope[:, None] * t
        level.append(np.sqrt((rest**2).mean()))
    level = np.array(level)
    ok = level > 0
    return float(np.polyfit(np.log(sizes[ok]), np.log(level[ok]), 1)[0]) if ok.sum() > 2 else np.nan


def run_lengths(x: np.ndarray) -> np.ndarray:
    s = np.sign(finite(x))
    edges = np.flatnonzero(np.diff(s)) + 1
    return np.diff(np.r_[0, edges, len(s)]) if len(s) else np.zeros(0)


def mean_run(x: np.ndarray) -> float:
    return float(run_lengths(x).mean()) if len(finite(x)) else np.nan


def run_entropy(x: np.ndarray) -> float:
    lengths = Counter(run_lengths(x).tolist())
    total = sum(lengths.values())
    return -sum(c / total * log2(c / total) for c in lengths.values()) if total else np.nan


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """Negative log ratio of matching templates of m + 1 and m values (Chebyshev, within r robust deviations)."""
    x = finite(x)
    tol = r * 1.4826 * np.median(np.abs(x - np.median(x))) if len(x) else 0
    count = []
    for k in (m, m + 1):
        v = embedded(x, k)[: len(x) - m]
        count.append(sum(int((np.abs(v[i + 1 :] - v[i]).max(axis=1) <= tol).sum()) for i in range(len(v) - 1)) if len(v) > 1 else 0)
    return -log(count[1] / count[0]) if count[0] and count[1] else np.nan


def approximate_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    x = finite(x)
    tol = r * x.std() if len(x) else 0

    def phi(k: int) -> float:
        v = embedded(x, k)
        share = [(np.abs(v - v[i]).max(axis=1) <= tol).mean() for i in range(len(v))]
        return float(np.mean(np.log(share)))

    return phi(m) - phi(m + 1) if len(x) > m + 1 else np.nan


def multiscale_entropy(x: np.ndarray, scales: int = 5) -> float:
    """Mean sample entropy of block means at scales 1, 2, ..."""
    x = finite(x)
    each = [sample_entropy(x[: len(x) // s * s].reshape(-1, s).mean(axis=1)) for s in range(1, scales + 1) if len(x) // s > 10]
    return float(np.nanmean(each)) if each and not np.isnan(each).all() else np.nan


def recurrence(x: np.ndarray, m: int = 3, delay: int = 1, share: float = 0.1) -> dict[str, float]:
    """Recurrence rate, determinism, laminarity, trapping time and longest diagonal."""
    v = embedded(finite(x), m, delay)
    if len(v) < 5:
        return dict.fromkeys(("rate", "determinism", "laminarity", "trapping", "longest"), np.nan)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    hit = d <= np.quantile(d[np.triu_indices(len(v), 1)], share)

    def lines(rows: list[np.ndarray]) -> np.ndarray:
        out = []
        for row in rows:
            edge = np.diff(np.r_[0, row.astype(int), 0])
            out.append(np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1))
        return np.concatenate(out) if out else np.zeros(0)

    diag = lines([np.diagonal(hit, k) for k in range(1, len(v))])
    vert = lines([hit[:, k] for k in range(len(v))])
    long_d, long_v = diag[diag >= 2], vert[vert >= 2]
    return {
        "rate": float(hit[np.triu_indices(len(v), 1)].mean()),
        "determinism": float(long_d.sum() / max(diag.sum(), 1)),
        "laminarity": float(long_v.sum() / max(vert.sum(), 1)),
        "trapping": float(long_v.mean()) if len(long_v) else 0.0,
        "longest": float(diag.max()) if len(diag) else 0.0,
    }


def granger(y: np.ndarray, x: np.ndarray, most: int = 5) -> tuple[int, float]:
    """Lag chosen by BIC, and the F statistic of x's lags in the regression of y."""

    def rss(columns: list[np.ndarray], target: np.ndarray) -> float:
        a = np.column_stack([np.ones(len(target)), *columns])
        return float(((target - a @ np.linalg.lstsq(a, target, rcond=None)[0]) ** 2).sum())

    n, best = len(y) - most, (np.inf, 0, 0.0)
    for p in range(1, most + 1):
        own = [y[most - k : len(y) - k] for k in range(1, p + 1)]
        other = [x[most - k : len(x) - k] for k in range(1, p + 1)]
        full, base = rss(own + other, y[most:]), rss(own, y[most:])
        bic = n * log(max(full, 1e-300) / n) + (2 * p + 1) * log(n)
        f = (base - full) / p / max(full / (n - 2 * p - 1), 1e-300)
        best = min(best, (bic, p, f))
    return best[1], best[2]


def cross_map(x: np.ndarray, y: np.ndarray, m: int = 3, tau: int = 1) -> float:
    """Skill (correlation) of y estimated from x's neighbours in its delay embedding."""
    v = embedded(x, m, tau)
    target = y[(m - 1) * tau :]
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, : m + 1]
    dist = np.take_along_axis(d, near, axis=1)
    w = np.exp(-dist / np.maximum(dist[:, :1], 1e-12))
    guess = (target[near] * w).sum(axis=1) / w.sum(axis=1)
    return float(np.corrcoef(guess, target)[0, 1])


def h0_lifetimes(points: np.ndarray) -> np.ndarray:
    """Deaths of connected components as the radius grows: the edges of a minimum spanning tree."""
    p = np.asarray(points, float)
    if p.ndim == 1:
        return np.sort(np.diff(np.sort(p)))
    left, best = set(range(1, len(p))), np.sqrt(((p - p[0]) ** 2).sum(axis=1))
    out = []
    while left:
        k = min(left, key=best.__getitem__)
        out.append(best[k])
        left.remove(k)
        best = np.minimum(best, np.sqrt(((p - p[k]) ** 2).sum(axis=1)))
    return np.sort(np.array(out))


def h0_wasserstein(a: np.ndarray, b: np.ndarray) -> float:
    """Distance of two lists of lifetimes; births are 0, so sorted matching is best, unmatched go to the diagonal."""
    a, b = np.sort(a)[::-1], np.sort(b)[::-1]
    n = max(len(a), len(b))
    return float(np.abs(np.r_[a, np.zeros(n - len(a))] - np.r_[b, np.zeros(n - len(b))]).sum())


def h0_diagram(points: np.ndarray) -> np.ndarray:
    """(birth, death) of each point's component; the last one, which never merges, ends with the longest life."""
    n = len(points)
    deaths = h0_lifetimes(points) if n > 1 else np.zeros(0)
    return np.c_[np.zeros(n), np.r_[deaths, [deaths.max() if len(deaths) else 0.0] * (n > 0)]]


def h0_landscape(diagram: np.ndarray, bins: int = 32) -> np.ndarray:
    """Density of the lifetimes in equal bins from 0 to a little above the longest; zeros without any."""
    if not len(diagram):
        return np.zeros(bins)
    life = diagram[:, 1] - diagram[:, 0]
    return np.histogram(life, bins, (0, life.max() + 1e-12), density=True)[0]


def covers(must: np.ndarray, near: np.ndarray) -> bool:
    """Whether all rows of ``must`` can have a column each that ``near`` allows: an augmenting path for each row in turn."""
    of: dict[int, int] = {}
    for row in must:
        back, stack, seen, end = {}, [int(row)], set(), -1
        while stack and end < 0:
            at = stack.pop()
            for c in np.flatnonzero(near[at]).tolist():
                if c in seen:
                    continue
                seen.add(c)
                back[c] = at
                if c not in of:
                    end = c
                    break
                stack.append(of[c])
        if end < 0:
            return False
        while end >= 0:  # the path's edges change sides
            row_at = back[end]
            of[end], end = row_at, next((c for c, r in of.items() if r == row_at and c != end), -1)
    return True


def bottleneck(a: np.ndarray, b: np.ndarray) -> float:
    """Least distance within which all points of two diagrams can be matched, to one another or to the diagonal.

    The distance is found among those of pairs and of points to the diagonal.  A point nearer to the diagonal than it
    needs no partner; a matching that serves all others on both sides exists if one exists for each side by itself.
    """
    to_a, to_b = (np.abs(d[:, 1] - d[:, 0]) / 2 for d in (a, b))
    apart = np.abs(a[:, None] - b[None]).max(axis=2) if len(a) and len(b) else np.zeros((len(a), len(b)))
    steps = np.unique(np.r_[0.0, apart.ravel(), to_a, to_b])
    low, high = 0, len(steps) - 1
    while low < high:
        mid = (low + high) // 2
        near = apart <= steps[mid]
        if covers(np.flatnonzero(to_a > steps[mid]), near) and covers(np.flatnonzero(to_b > steps[mid]), near.T):
            high = mid
        else:
            low = mid + 1
    return float(steps[low])


def hidden_states(features: np.ndarray, k: int = 3, rounds: int = 50, seed: int = 0) -> np.ndarray:
    """Most likely states of a Gaussian hidden Markov model with diagonal covariances, fitted by EM."""
    x = np.asarray(features, float)
    x = x[:, None] if x.ndim == 1 else x
    n = len(x)
    order = np.argsort(x[:, -1], kind="stable")
    state = np.zeros(n, int)
    state[order] = np.arange(n) * k // max(n, 1)
    mu = np.stack([x[state == j].mean(axis=0) for j in range(k)])
    var = np.stack([x[state == j].var(axis=0) for j in range(k)]) + 1e-8
    move, start = np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1)), np.full(k, 1 / k)
    like = lambda: -0.5 * (((x[:, None] - mu) ** 2) / var + np.log(2 * np.pi * var)).sum(axis=2)
    for _ in range(rounds):
        b = np.exp(like() - like().max(axis=1, keepdims=True)) + 1e-300
        fwd, bwd = np.empty((n, k)), np.ones((n, k))
        scale = np.empty(n)
        for t in range(n):
            a = (start if t == 0 else fwd[t - 1] @ move) * b[t]
            scale[t] = a.sum()
            fwd[t] = a / scale[t]
        for t in range(n - 2, -1, -1):
            bwd[t] = move @ (b[t + 1] * bwd[t + 1]) / scale[t + 1]
        g = fwd * bwd
        g /= g.sum(axis=1, keepdims=True)
        xi = (fwd[:-1, :, None] * move * (b[1:] * bwd[1:] / scale[1:, None])[:, None, :]).sum(axis=0)
        move, start = xi / xi.sum(axis=1, keepdims=True), g[0]
        weight = g.sum(axis=0)[:, None]
        mu = g.T @ x / weight
        var = np.stack([(g[:, j : j + 1] * (x - mu[j]) ** 2).sum(axis=0) for j in range(k)]) / weight + 1e-8
    log_b, log_m = like(), np.log(move + 1e-300)
    score, back = np.log(start + 1e-300) + log_b[0], np.zeros((n, k), int)
    for t in range(1, n):
        path = score[:, None] + log_m
        back[t] = path.argmax(axis=0)
        score = path.max(axis=0) + log_b[t]
    out = np.empty(n, int)
    out[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def huber_location(x: np.ndarray, c: float = 1.5, rounds: int = 50) -> float:
    x = finite(x)
    if not len(x):
        return np.nan
    mu, s = np.median(x), 1.4826 * np.median(np.abs(x - np.median(x))) + 1e-12
    for _ in range(rounds):
        w = np.minimum(1, c * s / np.maximum(np.abs(x - mu), 1e-12))
        new = (w * x).sum() / w.sum()
        if abs(new - mu) < 1e-10:
            break
        mu = new
    return float(mu)


def hodges_lehmann(x: np.ndarray) -> float:
    x = finite(x)
    i, j = np.triu_indices(len(x))
    return float(np.median((x[i] + x[j]) / 2)) if len(x) else np.nan


def trimmed_mean(x: np.ndarray, trim: float = 0.1) -> float:
    x = np.sort(finite(x))
    k = int(len(x) * trim)
    return float(x[k : len(x) - k].mean()) if len(x) > 2 * k else np.nan


def page_hinkley(x: np.ndarray, delta: float = 0.005, limit: float = 5.0) -> int:
    """Position of the first alarm that the mean has risen, -1 without."""
    total = mean = low = 0.0
    for k, v in enumerate(finite(x)):
        mean += (v - mean) / (k + 1)
        total += v - mean - delta
        low = min(low, total)
        if total - low > limit:
            return k
    return -1


SUITE: dict[str, Kernel] = {
    "permutation_entropy": permutation_entropy,
    "lempel_ziv": lempel_ziv,
    "hurst": hurst,
    "dfa": dfa,
    "mean_run": mean_run,
    "run_entropy": run_entropy,
    "sample_entropy": sample_entropy,
    "approximate_entropy": approximate_entropy,
    "multiscale_entropy": multiscale_entropy,
    "huber": huber_location,
    "hodges_lehmann": hodges_lehmann,
    "trimmed_mean": trimmed_mean,
    "page_hinkley": lambda x: float(page_hinkley(x)),
}


def grouped(rows: DataFrame, by: Sequence[str], order: str, x: str, kernels: dict[str, Kernel] = SUITE, last: int | None = None) -> DataFrame:
    """One row for each group with each kernel of its series (of its ``last`` values)."""
    names = list(by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[x].to_numpy(float)
        v = v if last is None else v[-last:]
        return pd.DataFrame([[*key, *(f(v) for f in kernels.values())]], columns=[*names, *kernels])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    schema = f"{kinds}, " + ", ".join(f"{k} double" for k in kernels)
    return rows.select(*names, order, x).groupBy(*names).applyInPandas(run, schema)


def windowed(rows: DataFrame, by: Sequence[str], order: str, x: str, n: int, kernels: dict[str, Kernel]) -> DataFrame:
    """Each kernel over the last n values at every row; null before there are n."""
    names = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        v = pdf[x].to_numpy(float)
        out = pdf[[*names, order]].copy()
        for name, f in kernels.items():
            out[name] = [f(v[k - n + 1 : k + 1]) if k >= n - 1 else np.nan for k in range(len(v))]
        return out

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*names, order])
    schema = f"{kinds}, " + ", ".join(f"{k} double" for k in kernels)
    return rows.select(*names, order, x).groupBy(*names).applyInPandas(run, schema)


def huber_z(windows: np.ndarray, k: float = 1.345) -> np.ndarray:
    """Of each row, a window: how far its last value is from a robust mean, in robust deviations; NaN below three values.

    Values beyond k median deviations from the median weigh inversely to their distance.  Without a median
    deviation the median and the plain deviation serve; without that either there is no score.
    """
    known = np.isfinite(windows)
    n = known.sum(axis=1)
    x = np.where(known, windows, np.nan)
    x[n == 0] = 0.0
    mid = np.nanmedian(x, axis=1)
    spread = np.nanmedian(np.abs(x - mid[:, None]), axis=1)
    far = np.abs(x - mid[:, None]) / (k * spread + 1e-9)[:, None]
    weight = np.where(known, 1 / np.maximum(far, 1.0), 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(spread > 0, np.nansum(weight * x, axis=1) / weight.sum(axis=1), mid)
        sd = np.where(spread > 0, 1.4826 * spread, np.nanstd(x, axis=1))
        out = (windows[:, -1] - mean) / sd
    return np.where((n >= 3) & (sd > 0), out, np.nan)


def streamed(rows: DataFrame, by: Sequence[str], order: str, x: str, n: int, kernels: dict[str, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Kernels of all windows of the last ``n`` rows at every row; null before there are n rows, and where a kernel has no value.

    A group's rows stream by, sorted: all windows of an Arrow batch are taken at once, and the last n - 1 values are
    carried to the next batch, so no series is held.  A kernel takes a matrix of windows and gives a value for each.
    Rows of equal order are taken by value.
    """
    names = list(by)
    kinds = [rows.schema[c].dataType.simpleString() for c in (*names, order)]
    src = rows.select(*names, order, F.col(x).cast("double").alias("_x"))
    dealt = src.repartition(*names).sortWithinPartitions(*names, order, "_x")
    block = max(1, (1 << 22) // n)  # windows that are unfolded at a time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tail = None, np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(len(names) + 1).to_numpy(zero_copy_only=False).astype(float)
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(names)))))
            heads = [k for k, v in enumerate(keys) if not k or v != keys[k - 1]]
            out = {name: np.full(len(values), np.nan) for name in kernels}
            for a, b in zip(heads, [*heads[1:], len(values)]):
                if keys[a] != key:
                    key, tail = keys[a], np.zeros(0)
                whole = np.r_[tail, values[a:b]]
                if len(whole) >= n:
                    windows = np.lib.stride_tricks.sliding_window_view(whole, n)
                    first = b - len(windows)
                    for name, f in kernels.items():
                        for k in range(0, len(windows), block):
                            out[name][first + k : first + min(k + block, len(windows))] = f(windows[k : k + block])
                tail = whole[len(whole) - min(n - 1, len(whole)) :]
            cols = [pa.array(v, from_pandas=True) for v in out.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names) + 1)), *cols], [*names, order, *kernels])

    schema = ", ".join(f"`{c}` {t}" for c, t in zip([*names, order], kinds)) + ", " + ", ".join(f"{k} double" for k in kernels)
    return dealt.mapInArrow(run, schema)


def adaptive_cooldown(rows: DataFrame, by: Sequence[str], order: str, fired: str, vol: str, base: int = 5, stretch: float = 2.0) -> DataFrame:
    """Signals that follow the last kept one by more than a cooldown that grows with volatility over its median."""
    names = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        v = pdf[vol].to_numpy(float)
        typical = np.nanmedian(v) if np.isfinite(v).any() else 1.0
        kept, free = [], 0
        for k, on in enumerate(pdf[fired].fillna(False).to_numpy(bool)):
            go = bool(on) and k >= free
            if go:
                ratio = v[k] / typical if np.isfinite(v[k]) and typical > 0 else 1.0
                free = k + 1 + int(base * max(1.0, min(ratio, stretch)))
            kept.append(go)
        return pdf[[*names, order]].assign(kept=kept)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*names, order])
    return rows.select(*names, order, fired, vol).groupBy(*names).applyInPandas(run, f"{kinds}, kept boolean")


# matrices of several series


def portfolio_var(returns: np.ndarray, weights: np.ndarray, alpha: float = 0.05) -> float:
    """Quantile of the weighted return of rows that are complete."""
    r = returns[np.isfinite(returns).all(axis=1)]
    return float(np.quantile(r @ weights, alpha)) if len(r) else np.nan


def stability(features: np.ndarray) -> float:
    """Share of the largest eigenvalue of the correlation matrix."""
    x = features[np.isfinite(features).all(axis=1)]
    if len(x) < 3 or (x.std(axis=0) < 1e-12).any():
        return np.nan
    values = np.linalg.eigvalsh(np.corrcoef(x.T))
    return float(values[-1] / values.sum())


def tail_correlation(returns: np.ndarray, share: float = 0.05) -> float:
    """Mean pairwise correlation on the rows with the worst mean return."""
    x = returns[np.isfinite(returns).all(axis=1)]
    bad = x[x.mean(axis=1) <= np.quantile(x.mean(axis=1), share)] if len(x) else x
    if len(bad) < 3 or (bad.std(axis=0) < 1e-12).any():
        return np.nan
    c = np.corrcoef(bad.T)
    return float(c[np.triu_indices(len(c), 1)].mean())


def reversion_half_life(x: np.ndarray) -> float:
    """Half-life of a first-order autoregression; infinite without reversion is NaN."""
    x = finite(x)
    if len(x) < 10:
        return np.nan
    slope = np.polyfit(x[:-1], np.diff(x), 1)[0]
    return float(-np.log(2) / np.log1p(slope)) if -1 < slope < 0 else np.nan


def windowed_matrix(rows: DataFrame, order: str, columns: Sequence[str], n: int, kernels: dict[str, Callable[[np.ndarray], float]], by: Sequence[str] = ()) -> DataFrame:
    """Each kernel of the last n rows of several columns, at every row of a group."""
    names = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        v = pdf[list(columns)].to_numpy(float)
        out = pdf[[*names, order]].copy()
        for name, f in kernels.items():
            out[name] = [f(v[k - n + 1 : k + 1]) if k >= n - 1 else np.nan for k in range(len(v))]
        return out

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*names, order])
    schema = f"{kinds}, " + ", ".join(f"{k} double" for k in kernels)
    src = rows.select(*names, order, *columns)
    if not names:
        return src.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, schema)
    return src.groupBy(*names).applyInPandas(run, schema)
