"""Superposition and angles of point chains, from sums and windows alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import merged

AXES = "xyz"


def _det(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def superposed_rmsd(pred: DataFrame, true: DataFrame, key: str) -> DataFrame:
    """key, n, rmsd: root mean square distance of matching points (key, i, x, y, z) after the best rotation and shift; NaN for fewer than three points.

    Points without a partner are left out.
    """
    both = merged(pred).join(true.select(key, "i", *(F.col(a).alias(f"t{a}") for a in AXES)), [key, "i"])
    first = both.groupBy(key).agg(*(F.avg(c).alias(f"_{c}") for a in AXES for c in (a, f"t{a}")))
    near = both.join(first, key).select(key, *((F.col(c) - F.col(f"_{c}")).alias(c) for a in AXES for c in (a, f"t{a}")))  # far from the origin, sums of squares lose their last digits
    return rmsd_of(near, [key], list(AXES), [f"t{a}" for a in AXES]).withColumn("rmsd", F.when(F.col("n") < 3, float("nan")).otherwise(F.col("rmsd")))


def rmsd_of(both: DataFrame, keys: list[str], own: list[str], other: list[str]) -> DataFrame:
    """keys, n, rmsd of points given by three columns each, after the best rotation and shift.

    One grouping gives the covariance of each group; the sum of its singular values, the last one with the sign of
    the determinant, decides the distance. So no group is held in a task.
    """
    n = F.count(F.lit(1))
    centred = lambda a, b: F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n
    spread = [centred(a, a) for a in (*own, *other)]
    sums = both.groupBy(*keys).agg(n.alias("n"), sum(spread[1:], spread[0]).alias("e"), *(centred(a, b).alias(f"h{i}{j}") for i, a in enumerate(own) for j, b in enumerate(other)))
    h = [[F.col(f"h{i}{j}") for j in range(3)] for i in range(3)]
    k = [[h[0][i] * h[0][j] + h[1][i] * h[1][j] + h[2][i] * h[2][j] for j in range(3)] for i in range(3)]
    sums = sums.select(*keys, "n", "e", F.signum(_det(h)).alias("sign"), *(k[i][j].alias(f"k{i}{j}") for i in range(3) for j in range(i, 3)))
    c = lambda i, j: F.col(f"k{min(i, j)}{max(i, j)}")
    sums = sums.withColumn("q", (c(0, 0) + c(1, 1) + c(2, 2)) / 3)
    off = c(0, 1) * c(0, 1) + c(0, 2) * c(0, 2) + c(1, 2) * c(1, 2)
    on = [(c(i, i) - F.col("q")) * (c(i, i) - F.col("q")) for i in range(3)]
    sums = sums.withColumn("w", F.sqrt((on[0] + on[1] + on[2] + 2 * off) / 6))
    b = [[(c(i, j) - F.col("q") if i == j else c(i, j)) / F.nullif("w", F.lit(0.0)) for j in range(3)] for i in range(3)]
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _det(b) / 2))) / 3
    sums = sums.withColumn("turn", F.when(F.col("w") > 0, turn).otherwise(0.0))
    top, low = (F.col("q") + 2 * F.col("w") * F.cos(F.col("turn") + x) for x in (0.0, 2 * math.pi / 3))
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    kept = root(top) + root(3 * F.col("q") - top - low) + F.col("sign") * root(low)
    return sums.select(*keys, "n", root((F.col("e") - 2 * kept) / F.col("n")).alias("rmsd"))


def dihedrals(pts: DataFrame, key: str) -> DataFrame:
    """key, i, angle: degrees of the dihedral of each four points in a row, by i; NaN-free where the middle bond has length."""
    w = Window.partitionBy(key).orderBy("i")
    bond = {a: F.lead(a).over(w) - F.col(a) for a in AXES}
    own = pts.select(key, "i", *(d.alias(a) for a, d in bond.items()))
    own = own.select(key, "i", *(F.lead(a, m).over(w).alias(f"{a}{m}") if m else F.col(a).alias(f"{a}0") for m in range(3) for a in AXES))
    v = [[F.col(f"{a}{m}") for a in AXES] for m in range(3)]
    cross = lambda s, t: [s[1] * t[2] - s[2] * t[1], s[2] * t[0] - s[0] * t[2], s[0] * t[1] - s[1] * t[0]]
    dot = lambda s, t: s[0] * t[0] + s[1] * t[1] + s[2] * t[2]
    n1, n2 = cross(v[0], v[1]), cross(v[1], v[2])
    sine = F.sqrt(dot(v[1], v[1])) * dot(v[0], n2)
    return own.where("x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL").select(key, "i", F.degrees(F.atan2(sine, dot(n1, n2))).alias("angle"))


def angle_error(a: Column, b: Column, period: float = 360.0) -> Column:
    """Smallest absolute difference of two angles."""
    d = F.pmod(a - b, F.lit(period))
    return F.least(d, F.lit(period) - d)
