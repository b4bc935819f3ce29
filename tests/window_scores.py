"""Sliding-window metrics of one image triple written on whole arrays, which the tests hold the library's relations against."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

EPS = np.finfo(float).eps


def gaussian_taps(n: int, sigma: float) -> np.ndarray:
    x = np.arange(n) - (n - 1) / 2
    g = np.exp(-x * x / (2 * sigma * sigma))
    return g / g.sum()


def valid(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Separable correlation where the window fits."""
    y = sliding_window_view(x, len(taps), 0) @ taps
    return sliding_window_view(y, len(taps), 1) @ taps


def local(x: np.ndarray, y: np.ndarray, taps: np.ndarray) -> tuple[np.ndarray, ...]:
    """Local means, variances and covariance; rounding noise is none."""
    mx, my = valid(x, taps), valid(y, taps)

    def spread(both: np.ndarray, mean: np.ndarray) -> np.ndarray:
        d = both - mean
        return np.where(np.abs(d) <= 1e-13 * np.abs(both), 0, d)

    return mx, my, spread(valid(x * x, taps), mx * mx), spread(valid(y * y, taps), my * my), spread(valid(x * y, taps), mx * my)


def ssim_map(x: np.ndarray, y: np.ndarray, taps: np.ndarray, c1: float, c2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    mx, my, vx, vy, cov = local(x, y, taps)
    return (2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2)), vx, vy, cov


def ssim(a: np.ndarray, b: np.ndarray, f: np.ndarray) -> float:
    """Mean of both sources' SSIM; Gaussian 11 x 11 of deviation 1.5, replicated border, dynamic range 1."""
    taps, wide = gaussian_taps(11, 1.5), lambda x: np.pad(x, 5, mode="edge")
    return float(np.mean([ssim_map(wide(f), wide(s), taps, 1e-4, 9e-4)[0].mean() for s in (a, b)]))


def _gain(ref: np.ndarray, dist: np.ndarray, taps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, residual variance and signal variance of the fused image as a blurred copy of its source."""
    _, _, vr, vd, cov = local(ref, dist, taps)
    vr, vd = np.maximum(vr, 0), np.maximum(vd, 0)
    g = cov / (vr + 1e-10)
    rest = vd - g * cov
    flat = vr < 1e-10
    g, rest, vr = np.where(flat, 0, g), np.where(flat, vd, rest), np.where(flat, 0, vr)
    still = vd < 1e-10
    g, rest = np.where(still, 0, g), np.where(still, 0, rest)
    rest, g = np.where(g < 0, vd, rest), np.maximum(g, 0)
    return g, np.maximum(rest, 1e-10), vr


def _scales(ref: np.ndarray, dist: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for scale in range(4):
        n = 2 ** (4 - scale) + 1
        taps = gaussian_taps(n, n / 5)
        if scale:
            ref, dist = valid(ref, taps)[::2, ::2], valid(dist, taps)[::2, ::2]
        yield _gain(ref, dist, taps)


def vif_one(ref: np.ndarray, dist: np.ndarray, noise: float = 2.0) -> float:
    """Visual information fidelity in the pixel domain."""
    top = below = 0.0
    for g, rest, v in _scales(ref, dist):
        top += np.log10(1 + g * g * v / (rest + noise)).sum()
        below += np.log10(1 + v / noise).sum()
    return top / below if below else float("nan")


def vif(a: np.ndarray, b: np.ndarray, f: np.ndarray) -> float:
    return vif_one(a, f) + vif_one(b, f)


def viff(a: np.ndarray, b: np.ndarray, f: np.ndarray) -> float:
    """Visual information fidelity for fusion: per pixel the source of smaller gain, weighted over scales."""
    # fixed values of the metric: noise variance, guard, weights of the scales
    noise, small, weights = 0.005 * 255 * 255, 1e-7, np.array([1, 0, 0.15, 1]) / 2.15
    score = []
    for (ga, ra, va), (gb, rb, vb) in zip(_scales(a, f), _scales(b, f)):
        top = np.where(ga < gb, np.log10(1 + ga * ga * va / (ra + noise)), np.log10(1 + gb * gb * vb / (rb + noise)))
        below = np.where(ga < gb, np.log10(1 + va / noise), np.log10(1 + vb / noise))
        score.append((top + small).sum() / (below + small).sum())
    return float(np.array(score) @ weights)


def _exposure_quality(a: np.ndarray, b: np.ndarray, f: np.ndarray, size: int = 11, k: float = 0.03, loose: bool = False) -> float:
    """Structure agreement of f with the weighted, normalised patches of both sources; ``loose`` has other guards against division by zero."""
    stack = np.stack([sliding_window_view(x, (size, size)).reshape(-1, size * size) for x in (a, b)])
    fused, taps = sliding_window_view(f, (size, size)).reshape(-1, size * size), np.outer(gaussian_taps(size, 1.5), gaussian_taps(size, 1.5)).ravel()
    mu = stack.mean(2, keepdims=True)
    centred = stack - mu
    ed = np.sqrt(np.maximum(size * size * ((stack * stack).mean(2) - mu[..., 0] ** 2), 0)) + 0.001
    both = stack.sum(0)
    small = 1e-10 if loose else EPS
    ratio = (np.linalg.norm(both - both.mean(1, keepdims=True), axis=1) + small) / (np.linalg.norm(centred, axis=2).sum(0) + small)
    ratio = np.clip(ratio, small, 1 - small) if loose else np.where(ratio > 1, 1 - EPS, ratio)
    power = np.minimum(np.tan(np.pi / 2 * ratio), 10)
    weight = (ed / size) ** power + (0 if loose else EPS)
    weight /= weight.sum(0) + (small if loose else 0)
    want = ((weight / (ed + small if loose else ed))[..., None] * centred).sum(0)
    norm = np.linalg.norm(want, axis=1)
    want *= np.where(norm > 0, ed.max(0) / np.where(norm > 0, norm, 1), 1)[:, None]
    x, y = want - (want @ taps)[:, None], fused - (fused @ taps)[:, None]
    c = (k * 255) ** 2
    return float(((2 * (x * y) @ taps + c) / ((x * x) @ taps + (y * y) @ taps + c)).mean())


def _half(x: np.ndarray, before: bool = False) -> np.ndarray:
    """2 x 2 mean with a symmetric border, every second pixel; with the next pixel, or with the one ``before``."""
    side = (1, 0) if before else (0, 1)
    p = np.pad(x, (side, side), mode="symmetric")
    return ((p[:-1, :-1] + p[1:, :-1] + p[:-1, 1:] + p[1:, 1:]) / 4)[::2, ::2]


def ms_ssim(a: np.ndarray, b: np.ndarray, f: np.ndarray) -> float:
    """Multi-scale structure quality, three levels; minus infinity for images that are too small."""
    if min(a.shape) / 4 < 11:
        return float("-inf")
    weights, out = np.array([0.0448, 0.2856, 0.3001]), 1.0
    for w in weights / weights.sum():
        out *= _exposure_quality(a, b, f) ** w
        a, b, f = _half(a), _half(b), _half(f)
    return float(out)


def ms_ssim_loose(a: np.ndarray, b: np.ndarray, f: np.ndarray) -> float | None:
    """The other common form of MS_SSIM: without a least size (null below one window), halved with the pixel before, other guards."""
    weights, out = np.array([0.0448, 0.2856, 0.3001]), 1.0
    for w in weights / weights.sum():
        if min(a.shape) < 11:
            return None
        out *= max(_exposure_quality(a, b, f, loose=True), 0.0) ** w
        a, b, f = (_half(x, before=True) for x in (a, b, f))
    return float(out)


def _share(va: np.ndarray, vb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = (va + vb) == 0
    va, vb = va + 0.5 * none, vb + 0.5 * none
    return va / (va + vb), va, vb


def _prewitt(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, 1)
    cols, rows = p[:-2] + p[1:-1] + p[2:], p[:, :-2] + p[:, 1:-1] + p[:, 2:]
    return np.hypot(cols[:, :-2] - cols[:, 2:], rows[:-2] - rows[2:])


def piella(a: np.ndarray, b: np.ndarray, f: np.ndarray, kind: int = 1) -> float:
    """Saliency-weighted SSIM: 1 plain, 2 weighted, 3 weighted on edges and squared."""
    if min(a.shape) < 11:
        return float("-inf")
    if kind == 3:
        a, b, f = (_prewitt(x) for x in (a, b, f))
    taps, c1, c2 = gaussian_taps(11, 1.5), (0.01 * 255) ** 2, (0.03 * 255) ** 2
    _, va, vb, _ = ssim_map(a, b, taps, c1, c2)
    lam, va, vb = _share(va, vb)
    q = lam * ssim_map(f, a, taps, c1, c2)[0] + (1 - lam) * ssim_map(f, b, taps, c1, c2)[0]
    if kind == 1:
        return float(q.mean())
    w = np.maximum(va, vb)
    return float((w / w.sum() * q).sum()) ** (2 if kind == 3 else 1)


def yang(a: np.ndarray, b: np.ndarray, f: np.ndarray) -> float:
    """QY: blend by local variance where the sources agree, the better source elsewhere."""
    taps, c = gaussian_taps(7, 1.5), 2e-16
    with np.errstate(all="ignore"):
        ab, va, vb, _ = ssim_map(a, b, taps, c, c)
        fa, fb = ssim_map(a, f, taps, c, c)[0], ssim_map(b, f, taps, c, c)[0]
        lam = va / (va + vb)
        return float(np.where(ab >= 0.75, lam * fa + (1 - lam) * fb, np.maximum(fa, fb)).mean())


def cvejic(a: np.ndarray, b: np.ndarray, f: np.ndarray) -> float:
    """QC: SSIM weighted by the share of local covariance."""
    taps, c = gaussian_taps(7, 1.5), 2e-16
    with np.errstate(all="ignore"):
        fa, _, _, ca = ssim_map(a, f, taps, c, c)
        fb, _, _, cb = ssim_map(b, f, taps, c, c)
        s = ca / (ca + cb)
        return float(np.where(s < 0, 0, np.where(s > 1, 1, s * fa + (1 - s) * fb)).mean())


METRICS = {"SSIM": ssim, "MS_SSIM": ms_ssim, "MS_SSIM_loose": ms_ssim_loose, "VIF": vif, "VIFF": viff, "Q": piella, "Qw": lambda a, b, f: piella(a, b, f, 2), "Qe": lambda a, b, f: piella(a, b, f, 3), "QY": yang, "QC": cvejic}
