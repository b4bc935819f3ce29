"""Filters of pyramids: named one-dimensional taps, and banks of kernels for spatial steerable pyramids."""

from __future__ import annotations

import math
from dataclasses import dataclass

from lumenfuse.operators.convolve import binomial

# Quadrature mirror filters of odd length, with the gain of a halving.
QMF5 = (-0.076103, 0.3535534, 0.8593118, 0.3535534, -0.076103)
QMF9 = (0.02807382, -0.060944743, -0.073386624, 0.41472545, 0.7973934, 0.41472545, -0.073386624, -0.060944743, 0.02807382)
QMF13 = (-0.014556438, 0.021651438, 0.039045125, -0.09800052, -0.057827797, 0.42995453, 0.7737113, 0.42995453, -0.057827797, -0.09800052, 0.039045125, 0.021651438, -0.014556438)
# Quadrature mirror filters of even length, of sum 1.
QMF8 = (0.00938715, -0.07065183, 0.06942827, 0.4899808, 0.4899808, 0.06942827, -0.07065183, 0.00938715)
QMF12 = (-0.003809699, 0.01885659, -0.002710326, -0.08469594, 0.08846992, 0.4843894, 0.4843894, 0.08846992, -0.08469594, -0.002710326, 0.01885659, -0.003809699)
QMF16 = (0.001050167, -0.005054526, -0.002589756, 0.0276414, -0.009666376, -0.09039223, 0.09779817, 0.4810284, 0.4810284, 0.09779817, -0.09039223, -0.009666376, 0.0276414, -0.002589756, -0.005054526, 0.001050167)
# Daubechies filters of 2, 3 and 4 vanishing moments.
DAUB2 = (0.482962913145, 0.836516303738, 0.224143868042, -0.129409522551)
DAUB3 = (0.332670552950, 0.806891509311, 0.459877502118, -0.135011020010, -0.085441273882, 0.035226291882)
DAUB4 = (0.230377813309, 0.714846570553, 0.630880767930, -0.027983769417, -0.187034811719, 0.030841381836, 0.032883011667, -0.010597401785)

_AS_THEY_ARE = {"qmf5": QMF5, "qmf9": QMF9, "qmf13": QMF13, "daub2": DAUB2, "daub3": DAUB3, "daub4": DAUB4}
_OF_SUM_ONE = {"qmf8": QMF8, "qmf12": QMF12, "qmf16": QMF16, "haar": (0.5, 0.5), "gauss3": (0.25, 0.5, 0.25), "gauss5": (0.0625, 0.25, 0.375, 0.25, 0.0625)}


def named(name: str) -> list[float]:
    """Taps of sum sqrt(2) by name: binomN, qmf5, qmf8, qmf9, qmf12, qmf13, qmf16, haar, daub2 to daub4, gauss3, gauss5."""
    if name.startswith("binom") and name[5:].isdigit():
        return [math.sqrt(2) * t for t in binomial(int(name[5:]))]
    if name in _AS_THEY_ARE:
        return list(_AS_THEY_ARE[name])
    if name in _OF_SUM_ONE:
        return [math.sqrt(2) * t for t in _OF_SUM_ONE[name]]
    raise ValueError(f"no filter is called {name!r}")


@dataclass(frozen=True)
class FilterBank:
    """Kernels of a spatial steerable pyramid: the two residual filters, the low-pass filter of a level, and the oriented ones."""

    low0: list[list[float]]
    high0: list[list[float]]
    low: list[list[float]]
    bands: list[list[list[float]]]


def _octant(text: str) -> list[list[float]]:
    """A kernel that is symmetric in rows, columns and diagonals, from one eighth of it: row k of ``text`` holds columns k to the middle."""
    part = [[float(x) for x in line.split()] for line in text.strip().splitlines()]
    fold = [*range(len(part)), *range(len(part) - 2, -1, -1)]
    return [[part[min(i, j)][max(i, j) - min(i, j)] for j in fold] for i in fold]


def _odd_rows(text: str) -> list[list[float]]:
    """A kernel that is symmetric in columns and changes its sign over the middle row, from its upper left quarter."""
    part = [[float(x) for x in line.split()] for line in text.strip().splitlines()]
    upper = [line + line[-2::-1] for line in part]
    return [*upper, [0.0] * len(upper[0]), *[[-x for x in line] for line in upper[::-1]]]


# Kernels without orientation.
SP0 = FilterBank(
    low0=_octant("""
-4.514000e-04 -1.137100e-04 -3.725800e-04 -3.743860e-03
-6.119520e-03 -1.344160e-02 -7.563200e-03
6.441488e-02 1.524935e-01
3.153017e-01
"""),
    high0=_octant("""
5.997200e-04 -6.068000e-05 -3.324900e-04 -3.325600e-04 -2.406600e-04
1.263100e-04 4.927100e-04 1.459700e-04 -3.732100e-04
-1.616650e-03 -1.437358e-02 -2.420138e-02
-6.300923e-02 -9.623594e-02
8.554893e-01
"""),
    low=_octant("""
-2.257000e-04 -8.064400e-04 -5.686000e-05 8.741400e-04 -1.862800e-04 -1.031640e-03 -1.871920e-03
1.417620e-03 -1.903800e-04 -2.449060e-03 -4.596420e-03 -7.006740e-03 -6.948900e-03
-3.059760e-03 -6.401000e-03 -6.720800e-03 -5.236180e-03 -3.781600e-03
-5.260020e-03 3.938620e-03 1.722078e-02 2.449600e-02
3.220744e-02 6.306262e-02 7.624674e-02
1.116388e-01 1.348999e-01
1.576508e-01
"""),
    bands=[_octant("""
-9.066000e-05 -1.738640e-03 -4.942500e-03 -7.889390e-03 -1.009473e-02
-4.625150e-03 -7.272540e-03 -7.623410e-03 -9.091950e-03
-2.129540e-02 -2.435662e-02 -3.487008e-02
-1.730466e-02 -3.158605e-02
9.464195e-01
""")],
)
# Kernels of two orientations; the second band is the first one with rows and columns exchanged and the sign changed.
_UP_AND_DOWN = _odd_rows("""
-6.125880e-03 8.052600e-03 2.103714e-02 1.536890e-02 1.851466e-02
1.287416e-02 9.611520e-03 -1.023569e-02 -6.009450e-03 -1.872620e-03
5.641530e-03 -4.168400e-03 2.382180e-02 5.375324e-02 2.076086e-02
8.957260e-03 1.751170e-03 1.836909e-02 -1.265655e-01 -2.996168e-01
""")
SP1 = FilterBank(
    low0=_octant("""
-8.701000e-05 -1.354280e-03 -1.601260e-03 -5.033700e-04 2.524010e-03
2.921580e-03 7.522720e-03 8.224420e-03 1.107620e-03
-7.061290e-03 -3.769487e-02 -3.297137e-02
4.381320e-02 1.811603e-01
4.376250e-01
"""),
    high0=_octant("""
-9.570000e-04 -2.424100e-04 -1.424720e-03 -8.742600e-04 -1.166810e-03
-4.317530e-03 8.998600e-04 9.156420e-03 1.098012e-02
1.706347e-02 1.094866e-02 -5.897780e-03
-7.841370e-02 -1.562827e-01
7.282593e-01
"""),
    low=_octant("""
-4.350000e-05 1.207800e-04 -6.771400e-04 -1.243400e-04 -8.006400e-04 -1.597040e-03 -2.516800e-04 -4.202000e-04 1.262000e-03
4.460600e-04 -5.814600e-04 5.621600e-04 -1.368800e-04 2.325540e-03 2.889860e-03 4.287280e-03 5.589400e-03
1.460780e-03 2.160540e-03 3.761360e-03 3.080980e-03 4.112200e-03 2.221220e-03 5.538200e-04
3.175780e-03 3.184680e-03 -1.777480e-03 -7.431700e-03 -9.056920e-03 -9.637220e-03
-3.530640e-03 -1.260420e-02 -1.884744e-02 -1.750818e-02 -1.648568e-02
-2.022938e-02 -1.109170e-02 3.955660e-03 1.438512e-02
2.190660e-02 6.806584e-02 9.058014e-02
1.445500e-01 1.773651e-01
2.120374e-01
"""),
    bands=[_UP_AND_DOWN, [[-x for x in column] for column in zip(*_UP_AND_DOWN)]],
)
BANKS = {"sp0": SP0, "sp1": SP1}
