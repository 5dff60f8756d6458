"""Numeric kernels that windows cannot express: recursive filters and smoothing splines."""

from __future__ import annotations

import numpy as np


def butterworth(order: int, cutoff, kind: str = "low") -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth filter.

    ``cutoff`` is a share of the Nyquist frequency, two of them for "stop" and "pass",
    which then have twice the poles. Designed by the bilinear transform of the
    analogue prototype's poles.
    """
    w = np.atleast_1d(np.asarray(cutoff, float))
    warped = np.tan(np.pi * w / 2)
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    if kind == "low":
        p, z, at = warped[0] * poles, np.zeros(0), 1.0
    elif kind == "high":
        p, z, at = warped[0] / poles, np.zeros(order), -1.0
    else:
        middle, half = np.sqrt(warped[0] * warped[1]), (warped[1] - warped[0]) / 2
        scaled = half * poles if kind == "pass" else half / poles
        root = np.sqrt(scaled**2 - middle**2 + 0j)
        p = np.concatenate([scaled + root, scaled - root])
        if kind == "pass":
            z, at = np.zeros(order), np.exp(2j * np.arctan(middle))
        else:
            z, at = np.concatenate([np.full(order, 1j * middle), np.full(order, -1j * middle)]), 1.0
    digital_p = (1 + p) / (1 - p)
    digital_z = np.concatenate([(1 + z) / (1 - z), np.full(len(p) - len(z), -1.0)])
    b, a = np.poly(digital_z), np.poly(digital_p)
    # Unit gain where the filter passes: 0, Nyquist, or the band's middle.
    gain = np.polyval(a, at) / np.polyval(b, at)
    return np.real(b * np.abs(gain)), np.real(a)


LONG = 1 << 13  # samples from which one series is cut into blocks that run side by side


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The filter's output along the first axis; ``state`` moves on."""
    n = len(a)
    y = np.empty_like(x)
    for i in range(len(x)):
        y[i] = b[0] * x[i] + (state[0] if n > 1 else 0)
        for j in range(n - 2):
            state[j] = state[j + 1] + b[j + 1] * x[i] - a[j + 1] * y[i]
        if n > 1:
            state[n - 2] = b[n - 1] * x[i] - a[n - 1] * y[i]
    return y


def recurse(b: np.ndarray, a: np.ndarray, x: np.ndarray, steady: bool = False, long: int = LONG) -> np.ndarray:
    """The filter's output along the first axis; columns are independent.

    It starts at rest, or (``steady``) as if the first value had always held. A long
    series is cut into blocks that run side by side from rest; what the state at a
    block's begin adds is linear in it, so it is added by a product afterwards.
    """
    n = max(len(a), len(b))
    b, a = np.append(b, np.zeros(n - len(b))) / a[0], np.append(a, np.zeros(n - len(a))) / a[0]
    x = np.asarray(x, float)
    state = np.zeros((n - 1, *x.shape[1:]))
    if steady and len(x):
        rest = (b.sum() / a.sum()) * x[0]
        tail = np.zeros_like(x[0])
        for i in range(n - 1, 0, -1):
            tail = tail + b[i] * x[0] - a[i] * rest
            state[i - 1] = tail
    if x.ndim > 1 or len(x) < long or n < 2:
        return _run(b, a, x, state)
    size = int(np.sqrt(len(x)))
    blocks = -(-len(x) // size)
    side = np.append(x, np.zeros(blocks * size - len(x))).reshape(blocks, size).T.copy()
    ends = np.zeros((n - 1, blocks))
    y = _run(b, a, side, ends)
    power = np.eye(n - 1)
    response = _run(b, a, np.zeros((size, n - 1)), power)
    begins = np.empty((n - 1, blocks))
    for k in range(blocks):
        begins[:, k] = state
        state = power @ state + ends[:, k]
    return (y + response @ begins).T.ravel()[: len(x)]


def both_ways(b: np.ndarray, a: np.ndarray, x: np.ndarray, edges: str = "rev", steady: bool = False) -> np.ndarray:
    """Zero-phase filtering: forward, then backward.

    A twentieth of the samples (one at least) pads each end, mirrored with the edge
    sample (``rev``) or repeating it (``rep1``). Each pass starts at rest; the forward
    one runs on over zeros for the filter's length twice.
    """
    x = np.asarray(x, float)
    n = len(x)
    if not n:
        return x
    pad = 0 if edges == "none" else max(1, n // 20)
    if edges == "rev":
        x = np.concatenate([x[pad - 1 :: -1], x, x[: n - pad - 1 : -1] if n > pad else x[::-1]])
    elif edges == "rep1":
        x = np.concatenate([np.repeat(x[:1], pad, 0), x, np.repeat(x[-1:], pad, 0)])
    m = len(x)
    tail = np.zeros((0 if steady else 2 * max(len(a), len(b)), *x.shape[1:]))
    y = recurse(b, a, np.concatenate([x, tail]), steady)
    y = recurse(b, a, y[::-1], steady)[::-1][:m]
    return y[pad : pad + n]


class Spline:
    """Natural cubic smoothing spline of one series with distinct, sorted times.

    Minimises the squared residuals plus lambda times the integral of the squared
    second derivative, time being scaled to 0..1, by the banded system of second
    derivatives. Lambda grows as 256**(3 * spar - 1) from the ratio of the two terms'
    traces; without spar, generalised cross-validation picks it.
    """

    def __init__(self, t: np.ndarray, y: np.ndarray):
        t = np.asarray(t, float)
        self.y, self.n = np.asarray(y, float), len(t)
        span = t[-1] - t[0] if len(t) > 1 else 1.0
        h = np.diff((t - t[0]) / span)
        m = self.n - 2
        self.small = m < 1
        if self.small:
            return
        inv = 1 / h
        q0, q2 = inv[:-1], inv[1:]
        q1 = -(q0 + q2)
        self.q = (q0, q1, q2)
        self.r = ((h[:-1] + h[1:]) / 3, h[1:-1] / 6)
        # Bands of Q'Q, where Q takes second derivatives' weights to values.
        self.qq = (q0**2 + q1**2 + q2**2, q1[:-1] * q0[1:] + q2[:-1] * q1[1:], q2[:-2] * q0[2:])
        self.ratio = self.n / max(1e-300, float((self.qq[0] / self.r[0]).sum()))

    def _solve(self, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each lambda (a column) the fitted values and the trace of (I - hat)."""
        m, k = self.n - 2, len(lam)
        d0 = self.r[0][:, None] + lam * self.qq[0][:, None]
        d1 = self.r[1][:, None] + lam * self.qq[1][:, None]
        d2 = lam * self.qq[2][:, None]
        q0, q1, q2 = self.q
        none = np.zeros(k)
        d, u, v = np.empty((m, k)), np.zeros((m, k)), np.zeros((m, k))
        z = np.repeat((q0 * self.y[:-2] + q1 * self.y[1:-1] + q2 * self.y[2:])[:, None], k, axis=1)
        for i in range(m):
            du = d[i - 1] * u[i - 1] if i else none
            d[i] = d0[i] - (du * u[i - 1] if i else 0) - (d[i - 2] * v[i - 2] ** 2 if i > 1 else 0)
            if i:
                z[i] -= u[i - 1] * z[i - 1]
            if i > 1:
                z[i] -= v[i - 2] * z[i - 2]
            if i < m - 1:
                u[i] = (d1[i] - (du * v[i - 1] if i else 0)) / d[i]
            if i < m - 2:
                v[i] = d2[i] / d[i]
        z /= d
        # Back through the system, with the central bands of its inverse.
        s0, s1, s2 = np.zeros((m + 2, k)), np.zeros((m + 2, k)), np.zeros((m + 2, k))
        z = np.concatenate([z, np.zeros((2, k))])
        for i in range(m - 1, -1, -1):
            z[i] -= u[i] * z[i + 1] + v[i] * z[i + 2]
            s1[i] = -u[i] * s0[i + 1] - v[i] * s1[i + 1]
            s2[i] = -u[i] * s1[i + 1] - v[i] * s0[i + 2]
            s0[i] = 1 / d[i] - u[i] * s1[i] - v[i] * s2[i]
        z = z[:m]
        fit = np.repeat(self.y[:, None], k, axis=1)
        fit[:-2] -= lam * q0[:, None] * z
        fit[1:-1] -= lam * q1[:, None] * z
        fit[2:] -= lam * q2[:, None] * z
        trace = lam * (self.qq[0] @ s0[:m] + 2 * (self.qq[1] @ s1[: max(0, m - 1)]) + 2 * (self.qq[2] @ s2[: max(0, m - 2)]))
        return fit, trace

    def fit(self, spar: float | None = None) -> tuple[np.ndarray, float]:
        """Fitted values and the spar used: the given one, or that of least cross-validation score in -1.5..1.5 to 1e-4."""
        if self.small:
            return self.y.copy(), spar if spar is not None else 0.0
        of = lambda s: self._solve(self.ratio * 256 ** (3 * np.atleast_1d(s) - 1))
        if spar is not None:
            return of(spar)[0][:, 0], float(spar)
        lo, hi = -1.5, 1.5
        while True:
            tried = np.linspace(lo, hi, 25)
            fit, trace = of(tried)
            best = int((((self.y[:, None] - fit) ** 2).sum(axis=0) / np.maximum(trace, 1e-12) ** 2).argmin())
            if hi - lo <= 24e-4:
                return fit[:, best], float(tried[best])
            lo, hi = float(tried[max(0, best - 1)]), float(tried[min(24, best + 1)])


def _banded(series: list[Spline], lam: np.ndarray) -> list[np.ndarray]:
    """The fitted values of many series of three samples or more, of one length, side by side: ``Spline._solve`` without the trace."""
    q0, q1, q2 = (np.stack([s.q[j] for s in series], axis=1) for j in range(3))
    y = np.stack([s.y for s in series], axis=1)
    d0 = np.stack([s.r[0] for s in series], axis=1) + lam * np.stack([s.qq[0] for s in series], axis=1)
    d1 = np.stack([s.r[1] for s in series], axis=1) + lam * np.stack([s.qq[1] for s in series], axis=1)
    d2 = lam * np.stack([s.qq[2] for s in series], axis=1)
    m = len(d0)
    d, u, v = np.empty_like(d0), np.zeros_like(d0), np.zeros_like(d0)
    z = np.zeros((m + 2, len(series)))
    z[:m] = q0 * y[:-2] + q1 * y[1:-1] + q2 * y[2:]
    for i in range(m):
        du = d[i - 1] * u[i - 1] if i else 0
        d[i] = d0[i] - (du * u[i - 1] if i else 0) - (d[i - 2] * v[i - 2] ** 2 if i > 1 else 0)
        if i:
            z[i] -= u[i - 1] * z[i - 1]
        if i > 1:
            z[i] -= v[i - 2] * z[i - 2]
        if i < m - 1:
            u[i] = (d1[i] - (du * v[i - 1] if i else 0)) / d[i]
        if i < m - 2:
            v[i] = d2[i] / d[i]
    z[:m] /= d
    for i in range(m - 1, -1, -1):
        z[i] -= u[i] * z[i + 1] + v[i] * z[i + 2]
    y[:-2] -= lam * q0 * z[:m]
    y[1:-1] -= lam * q1 * z[:m]
    y[2:] -= lam * q2 * z[:m]
    return list(y.T)


SIDE = 1 << 20  # samples of series that are fitted side by side


def smoothed(series: list[tuple[np.ndarray, np.ndarray]], spar: float | None = None) -> list[np.ndarray]:
    """Fitted values of each (times, values) as ``Spline.fit`` gives them; with ``spar`` those of one length go side by side."""
    if spar is None:
        return [Spline(t, y).fit()[0] for t, y in series]
    out: list[np.ndarray] = [None] * len(series)
    alike: dict[int, list[int]] = {}
    for k, (t, _) in enumerate(series):
        alike.setdefault(len(t), []).append(k)
    for n, members in alike.items():
        step = max(1, SIDE // max(1, n))
        for a in range(0, len(members), step):
            group = members[a : a + step]
            splines = [Spline(*series[k]) for k in group]
            fits = [s.y.copy() for s in splines] if splines[0].small else _banded(splines, np.array([s.ratio for s in splines]) * 256 ** (3 * np.atleast_1d(spar) - 1))
            for k, y in zip(group, fits, strict=True):
                out[k] = y
    return out


def filtered(series: list[np.ndarray], b: np.ndarray, a: np.ndarray, edges: str = "rev", steady: bool = False) -> list[np.ndarray]:
    """Each series by ``both_ways``; those of one length that are not cut into blocks, with their pads, go side by side."""
    out: list[np.ndarray] = [None] * len(series)
    alike: dict[int, list[int]] = {}
    for k, x in enumerate(series):
        alike.setdefault(len(x), []).append(k)
    for n, members in alike.items():
        step = max(1, SIDE // max(1, n)) if n < LONG // 2 else 1
        for at in range(0, len(members), step):
            group = members[at : at + step]
            if len(group) == 1:
                out[group[0]] = both_ways(b, a, series[group[0]], edges, steady)
                continue
            for k, y in zip(group, both_ways(b, a, np.stack([series[k] for k in group], axis=1), edges, steady).T, strict=True):
                out[k] = y
    return out
