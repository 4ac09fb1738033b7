"""Scores of predicted chains of atoms against true ones.

An atom table has a row for each atom that is there: key (of the chain), res (residue, from 0 without gaps), slot, x, y, z. Atoms that
only one of two tables has take no part. Pairs are found by joins on residues or in blocks of space, so no chain has to fit a task,
but for `gdt`, which refines superpositions and takes one chain's points of a slot (bounded by its residues) at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import AXES, rmsd_of
from .relational import merged

#: Slots of the backbone atoms in a residue.
N_SLOT, CA_SLOT, C_SLOT, O_SLOT = 0, 1, 2, 3
#: Cells of space to the side of a block; cells beyond this number count as one.
BLOCK, FARTHEST = 4, 1e15


def both_atoms(pred: DataFrame, true: DataFrame, key: str) -> DataFrame:
    """Atoms of both tables: key, res, slot, p and t (arrays of x, y, z)."""
    place = F.array(*AXES)
    return merged(pred.select(key, "res", "slot", place.alias("p"))).join(true.select(key, "res", "slot", place.alias("t")), [key, "res", "slot"])


def _minus(a: Column, b: Column) -> list[Column]:
    return [F.get(a, F.lit(i)) - F.get(b, F.lit(i)) for i in range(3)]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def dihedral(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Degrees of the dihedral of four points (arrays of three); null where three of them lie on a line or one is missing."""
    u, v, w = _minus(b, a), _minus(c, b), _minus(d, c)
    n, m = _cross(u, v), _cross(v, w)
    flat = F.greatest(F.lit(0.0), F.least(_dot(n, n), _dot(m, m))) < 1e-16
    return F.when(~flat, F.degrees(F.atan2(F.sqrt(_dot(v, v)) * _dot(u, m), _dot(n, m))))


def backbone_angles(atoms: DataFrame, key: str, *places: str) -> DataFrame:
    """key, res, angle (phi, psi or omega) and for each place column (p, t) its degrees, for all residues whose four atoms are there."""
    wide = atoms.where(F.col("slot").isin(N_SLOT, CA_SLOT, C_SLOT)).groupBy(key, "res").agg(
        *(F.max(F.when(F.col("slot") == s, F.col(c))).alias(f"{c}{s}") for c in places for s in (N_SLOT, CA_SLOT, C_SLOT))
    )
    near = wide.select(key, (F.col("res") - 1).alias("res"), *(F.col(f"{c}{s}").alias(f"next_{c}{s}") for c in places for s in (N_SLOT, CA_SLOT, C_SLOT)))
    pairs = merged(wide).join(near, [key, "res"])  # a residue and the next one
    at = lambda c, s: F.col(f"{c}{s}")
    four = {
        "phi": lambda c: (at(c, C_SLOT), at(f"next_{c}", N_SLOT), at(f"next_{c}", CA_SLOT), at(f"next_{c}", C_SLOT)),
        "psi": lambda c: (at(c, N_SLOT), at(c, CA_SLOT), at(c, C_SLOT), at(f"next_{c}", N_SLOT)),
        "omega": lambda c: (at(c, CA_SLOT), at(c, C_SLOT), at(f"next_{c}", N_SLOT), at(f"next_{c}", CA_SLOT)),
    }
    of = {"phi": F.col("res") + 1, "psi": F.col("res"), "omega": F.col("res")}
    rows = F.array(*(F.struct(of[a].cast("int").alias("res"), F.lit(a).alias("angle"), *(dihedral(*four[a](c)).alias(c) for c in places)) for a in four))
    found = pairs.select(key, F.explode(rows).alias("x")).select(key, "x.*")
    return found.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in places)))


def with_all(chains: DataFrame, scores: DataFrame, key: str, score: str, empty: float) -> DataFrame:
    """key and score of every chain; a chain without a score gets `empty`."""
    return chains.select(key).distinct().join(scores, key, "left").select(key, F.coalesce(score, F.lit(empty)).alias(score))


def backbone_score(pred: DataFrame, true: DataFrame, key: str) -> DataFrame:
    """key, backbone: 1 less the mean over phi, psi and omega of the mean angle error (a half turn is 1); chains without angles score 1."""
    a = backbone_angles(both_atoms(pred, true, key), key, "p", "t")
    turn = F.pmod(F.col("p") - F.col("t"), F.lit(360.0))
    means = a.groupBy(key, "angle").agg(F.avg(F.least(turn, 360.0 - turn) / 180.0).alias("e")).groupBy(key).agg(F.avg("e").alias("e"))
    scores = means.select(key, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("e"))).alias("backbone"))
    return with_all(true, scores, key, "backbone", 1.0)


def ramachandran(atoms: DataFrame, key: str) -> DataFrame:
    """key, n, helix, beta, coil: shares of residues whose phi and psi lie in broad regions; chains without such residues have nulls and n 0."""
    place = atoms.select(key, "res", "slot", F.array(*AXES).alias("p"))
    a = backbone_angles(place, key, "p")
    phi, psi = (a.where(F.col("angle") == x).select(key, "res", F.col("p").alias(x)) for x in ("phi", "psi"))
    f, s = F.col("phi"), F.col("psi")
    helix = f.between(-120, -25) & s.between(-100, 45)
    beta = ~helix & ((f.between(-180, -60) & s.between(45, 180)) | (f.between(45, 180) & s.between(-180, -120)))
    n = F.count(F.lit(1))
    sums = phi.join(psi, [key, "res"]).groupBy(key).agg(n.alias("n"), (F.count_if(helix) / n).alias("helix"), (F.count_if(beta) / n).alias("beta"))
    sums = sums.withColumn("coil", F.greatest(F.lit(0.0), 1 - F.col("helix") - F.col("beta")))
    return atoms.select(key).distinct().join(sums, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def dipdiff(pred: DataFrame, true: DataFrame, key: str, slots: tuple[int, ...] = (CA_SLOT, O_SLOT), limits: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0), lengths: DataFrame | None = None) -> DataFrame:
    """key, dipdiff: mean over residues of the share of pairs of their and their neighbours' atoms whose distance is kept within limits (strictly).

    Windows of fewer than two atoms are left out; chains without windows score 1. lengths: key, n_res; else a chain ends with its last atom.
    """
    own = both_atoms(pred, true, key).where(F.col("slot").isin(*slots))
    last = true.groupBy(key).agg(F.max("res").alias("last")) if lengths is None else lengths.select(key, (F.col("n_res") - 1).alias("last"))
    seen = own.join(last, key).select(key, F.explode(F.sequence(F.greatest(F.lit(0), F.col("res") - 1), F.least(F.col("res") + 1, F.col("last")))).alias("at"), "res", "slot", "p", "t")
    a, b = seen, seen.select(key, "at", *(F.col(c).alias(f"{c}2") for c in ("res", "slot", "p", "t")))  # six atoms of a window at most
    pairs = merged(a).join(b, [key, "at"]).where("struct(res, slot) < struct(res2, slot2)")
    length = lambda x, y: F.sqrt(_dot(_minus(F.col(x), F.col(y)), _minus(F.col(x), F.col(y))))
    gap = F.abs(length("p", "p2") - length("t", "t2"))
    kept = reduce(lambda x, y: x + y, ((gap < z).cast("double") for z in limits)) / len(limits)
    scores = pairs.groupBy(key, "at").agg(F.avg(kept).alias("s")).groupBy(key).agg(F.avg("s").alias("dipdiff"))
    return with_all(true, scores, key, "dipdiff", 1.0)


def clash_pairs(atoms: DataFrame, key: str, overlap: float, widest: float) -> DataFrame:
    """key, a and b (residue, slot) of atoms of residues more than one apart whose spheres overlap by more than `overlap`.

    atoms has `radius` too, 0 or less taking no part; none is above `widest`, which sets how far apart atoms still meet.
    """
    size = 2.0 * widest - overlap
    if size <= 0:
        raise ValueError("spheres of this size cannot overlap by so much")
    own = atoms.where("radius > 0").select(key, F.struct("res", "slot").alias("id"), "radius", F.array(*AXES).alias("p"))
    met = near_pairs(own, key, "p", size).where(F.col("id2.res") - F.col("id.res") > 1)
    return met.where(F.col("radius") + F.col("radius2") - F.col("d") > overlap).select(key, F.col("id").alias("a"), F.col("id2").alias("b"))


def clash_score(atoms: DataFrame, key: str, overlap: float = 0.4, widest: float = 1.8) -> DataFrame:
    """key, n_clashes, clash: 1 / (1 + clashes for 1000 atoms / 100)."""
    n = atoms.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hits = clash_pairs(atoms, key, overlap, widest).groupBy(key).agg(F.count(F.lit(1)).alias("n_clashes"))
    both = n.join(hits, key, "left").withColumn("n_clashes", F.coalesce("n_clashes", F.lit(0)))
    return both.select(key, "n_clashes", (1 / (1 + 10.0 * F.col("n_clashes") / F.col("n"))).alias("clash"))


def apart(a: Column, b: Column) -> Column:
    """Distance of two places (arrays of three)."""
    return F.sqrt(sum((F.pow(F.get(a, F.lit(i)) - F.get(b, F.lit(i)), F.lit(2)) for i in (1, 2)), F.pow(F.get(a, F.lit(0)) - F.get(b, F.lit(0)), F.lit(2))))


def near_pairs(atoms: DataFrame, key: str, place: str, limit: float) -> DataFrame:
    """Ordered pairs of different atoms (key, id and others) whose `place` (x, y, z) is within limit: a's columns, b's with `2` after them, and d.

    An atom meets those of the 27 cells around it. Cells are gathered in blocks of BLOCK to a side, each with the cells next to it, so atoms are shuffled
    once for a small chain and 3.4 times in space without end; pairs are made in their block and not shuffled. Places that are not finite, and those without a key, are near nothing.
    """
    rest, at, of = [c for c in atoms.columns if c != key], [f"_c{i}" for i in range(3)], [f"_b{i}" for i in range(3)]
    block = lambda c: F.floor((c + BLOCK // 2) / BLOCK)  # noqa: E731  the origin is in the middle of a block
    cell = lambda i: F.floor(F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.get(place, F.lit(i)) / limit)))
    own = atoms.where(reduce(lambda a, b: a & b, (F.abs(F.get(place, F.lit(i))) < float("inf") for i in range(3)), F.col(key).isNotNull()))
    own = own.select(key, F.struct(*rest).alias("_a"), *(cell(i).alias(c) for i, c in enumerate(at)))
    for c, b in zip(at, of):
        own = own.select("*", F.explode(F.sequence(block(F.col(c) - 1), block(F.col(c) + 1))).alias(b))
    cells = own.repartition(key, *of).groupBy(key, *of, *at).agg(F.collect_list("_a").alias("_atoms"))
    met = cells.groupBy(key, *of).agg(F.collect_list(F.struct(*at, "_atoms")).alias("_cells"))
    met = met.select(key, *of, "_cells", F.explode("_cells").alias("_m")).where(reduce(lambda a, b: a & b, (block(F.col(f"_m.{c}")) == F.col(b) for c, b in zip(at, of))))
    met = met.select(key, "_m", F.explode("_cells").alias("_n")).where(reduce(lambda a, b: a & b, (F.abs(F.col(f"_m.{c}") - F.col(f"_n.{c}")) <= 1 for c in at)))
    met = met.select(key, F.col("_n._atoms").alias("_n"), F.explode("_m._atoms").alias("_a")).select(key, "_n", "_a.*")
    met = met.select(key, *rest, F.explode("_n").alias("_b")).select(key, *rest, *(F.col(f"_b.{c}").alias(f"{c}2") for c in rest))
    return met.where("id <> id2").withColumn("d", apart(F.col(place), F.col(f"{place}2"))).where(F.col("d") <= limit)


def _seeds(n: int, most: int = 48) -> np.ndarray:
    """A row of flags for each start: all points, then windows of 3, 5 and 9."""
    rows = [np.ones((1, n), bool)]
    for width in (3, 5, 9):
        if n >= width:
            begins = np.arange(0, n - width + 1, max(1, (n - width) // most))
            rows.append((np.arange(n) >= begins[:, None]) & (np.arange(n) < begins[:, None] + width))
    return np.concatenate(rows)


def within(p: np.ndarray, t: np.ndarray, limits: tuple[float, ...], rounds: int = 8) -> list[int]:
    """For each limit, how many points one superposition brings within it at most.

    All starts are superposed in one go, on the points that they hold; those then within the limit are what the next round superposes, until they stay the same or are fewer than three.
    """
    n = len(p)
    if n < 3:
        return [0] * len(limits)
    p, t = p - p.mean(0), t - t.mean(0)
    outer, out = np.concatenate([(p[:, :, None] * t[:, None, :]).reshape(n, 9), p, t], 1), []
    for limit in limits:
        on, best = _seeds(n), 0
        for turn in range(rounds):
            sums, m = on @ outer, on.sum(1)[:, None]
            cp, ct = sums[:, 9:12] / m, sums[:, 12:] / m
            u, _, v = np.linalg.svd((sums[:, :9] - m * (cp[:, :, None] * ct[:, None, :]).reshape(-1, 9)).reshape(-1, 3, 3))
            u[np.linalg.det(u @ v) < 0, :, -1] *= -1
            near = np.linalg.norm((p - cp[:, None]) @ (u @ v) + ct[:, None] - t, axis=2) <= limit
            count = near.sum(1)
            ended = (count < 3) | (near == on).all(1) | (turn == rounds - 1)
            best = max(best, int(count[ended].max(initial=0)))
            on = near[~ended]
            if not len(on) or best == n:
                break
        out.append(best)
    return out


def gdt(pred: DataFrame, true: DataFrame, key: str, limits: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0), slot: int = CA_SLOT) -> DataFrame:
    """key, n, gdt: mean over limits of the largest share of points (of one slot) within them; fewer than three points score 0.

    (1, 2, 4, 8) gives the other usual form.
    """
    pts = both_atoms(pred, true, key).where(F.col("slot") == slot)
    kind = pts.schema[key].dataType.simpleString()

    def score(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("res")
        p, t = np.array(x["p"].tolist(), float), np.array(x["t"].tolist(), float)
        return pd.DataFrame({key: [x[key].iloc[0]], "n": [len(x)], "gdt": [float(np.mean(within(p, t, limits))) / len(x)]})

    found = pts.groupBy(key).applyInPandas(score, f"`{key}` {kind}, n long, gdt double")
    return true.select(key).distinct().join(found, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("gdt", F.lit(0.0)).alias("gdt"))


def spheres(atoms: DataFrame, true_pairs: DataFrame, key: str, radius: float, limits: tuple[float, ...]) -> DataFrame:
    """key, spheres: mean over limits of the share of spheres around CA atoms whose atoms superpose within that root mean square distance.

    The sums that decide a superposition are taken over the pairs, from the sphere's centre, so no sphere is gathered. Those of fewer than three atoms are left out.
    """
    own = true_pairs.where((F.col("slot") == CA_SLOT) & (F.col("d") <= radius))
    away = own.select(key, "id", *((F.get(f"{c}2", F.lit(i)) - F.get(c, F.lit(i))).alias(f"{c}{i}") for c in "pt" for i in range(3)))
    zero = atoms.where(F.col("slot") == CA_SLOT).select(key, "id", *(F.lit(0.0).alias(f"{c}{i}") for c in "pt" for i in range(3)))
    each = rmsd_of(away.unionByName(zero), [key, "id"], [f"p{i}" for i in range(3)], [f"t{i}" for i in range(3)]).where("n >= 3")
    share = reduce(lambda a, b: a + b, (F.avg((F.col("rmsd") <= x).cast("double")) for x in limits)) / len(limits)
    return each.groupBy(key).agg(share.alias("spheres"))


def sphere_scores(pred: DataFrame, true: DataFrame, key: str, radius: float = 6.0, limits: tuple[float, ...] = (2.0, 4.0)) -> DataFrame:
    """key and spheres of all chains of true; chains without spheres score 1."""
    atoms = both_atoms(pred, true, key).withColumn("id", F.struct("res", "slot"))
    return with_all(true, spheres(atoms, near_pairs(atoms, key, "t", radius), key, radius, limits), key, "spheres", 1.0)
