"""All scores of predicted chains in one go: atoms are matched once, and two relations of near pairs feed the sums.

Input: pred and true, atom tables as in `chains`, and types (key, res and type, the residue's id, 0 to 20; one row for each residue). Pairs
come from cells of space, so they grow with the atoms. Only `gdt_counts` takes the points of one slot of a whole chain at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import residues
from ..sources.places import freed, stored
from . import chains
from .chains import apart, near_pairs, within
from .relational import merged

#: Weights of the components in the score, limits of kept distances, of superposed points and of spheres.
WEIGHTS = {"gdt_ha": 0.25, "lddt_all": 0.09375, "cad": 0.09375, "spheres": 0.09375, "sidechain": 0.09375, "clash": 0.125, "backbone": 0.125, "dipdiff": 0.125}
KEPT, GDT_HA, GDT_TS, SPHERES = (0.5, 1.0, 2.0, 4.0), (0.5, 1.0, 2.0, 4.0), (1.0, 2.0, 4.0, 8.0), (2.0, 4.0)
#: What a chain gets where there is nothing to score.
EMPTY = {"gdt_ha": 0.0, "gdt_ts": 0.0, "lddt_ca": 0.0, "lddt_backbone": 0.0, "lddt_all": 0.0, "cad": 1.0, "spheres": 1.0, "sidechain": 1.0, "clash": 1.0, "backbone": 1.0, "dipdiff": 1.0}


def matched(pred: DataFrame, true: DataFrame, types: DataFrame, key: str) -> DataFrame:
    """Atoms of both tables (key, id of res and slot, res, slot, type, p, t, radius) of residues that types has; an atom without a known name has radius 0."""
    known = residues.slots(types.sparkSession).select("type", "slot", "radius")
    own = types.select(key, "res", F.least(F.greatest(F.col("type"), F.lit(0)), F.lit(residues.UNKNOWN)).alias("type"))
    both = merged(chains.both_atoms(pred, true, key)).join(own, [key, "res"]).join(F.broadcast(known), ["type", "slot"], "left")  # fewer than 200 rows
    return both.select(key, F.struct("res", "slot").alias("id"), "res", "slot", "type", "p", "t", F.coalesce("radius", F.lit(0.0)).alias("radius"))


def lddts(true_pairs: DataFrame, key: str, cutoff: float) -> DataFrame:
    """key, lddt_ca, lddt_backbone and lddt_all: mean over atoms of the share of true neighbours nearer than cutoff, of other residues, whose distance is kept (strictly)."""
    sets = {"ca": F.greatest("slot", "slot2") + F.when(F.least("slot", "slot2") == chains.CA_SLOT, 0).otherwise(99) == chains.CA_SLOT, "backbone": F.greatest("slot", "slot2") <= chains.O_SLOT, "all": F.lit(True)}
    gap = F.abs(F.col("d") - apart(F.col("p"), F.col("p2")))
    kept = reduce(lambda a, b: a + b, ((gap < x).cast("double") for x in KEPT)) / len(KEPT)
    own = true_pairs.where((F.col("d") < cutoff) & (F.col("res") != F.col("res2"))).withColumn("kept", kept)
    each = own.groupBy(key, "id").agg(*(F.count_if(c).alias(f"n_{s}") for s, c in sets.items()), *(F.sum(F.when(c, F.col("kept"))).alias(f"k_{s}") for s, c in sets.items()))
    return each.groupBy(key).agg(*(F.avg(F.when(F.col(f"n_{s}") > 0, F.col(f"k_{s}") / (F.col(f"n_{s}") + 1e-8))).alias(f"lddt_{s}") for s in sets))


def cad(atoms: DataFrame, true_pairs: DataFrame, pred_pairs: DataFrame, key: str, contact: float) -> DataFrame:
    """key, cad: 1 less the contact shares that differ, to the larger ones, over all pairs of residues; contacts are atoms nearer than `contact`."""
    side = lambda pairs, name: pairs.where((F.col("d") < contact) & (F.col("res") < F.col("res2"))).groupBy(key, "res", "res2").agg(F.count(F.lit(1)).alias(name))
    both = side(true_pairs, "n_t").join(side(pred_pairs, "n_p"), [key, "res", "res2"], "full").fillna(0, ["n_t", "n_p"])
    sizes = atoms.groupBy(key, "res").agg(F.count(F.lit(1)).alias("m"))
    both = both.join(sizes, [key, "res"]).join(sizes.select(key, F.col("res").alias("res2"), F.col("m").alias("m2")), [key, "res2"])
    whole = F.col("m") * F.col("m2")
    sums = both.groupBy(key).agg(F.sum(F.abs(F.col("n_p") - F.col("n_t")) / whole).alias("off"), F.sum(F.greatest("n_p", "n_t") / whole).alias("any"))
    return sums.select(key, F.when(F.col("any") <= 1e-8, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("off") / F.col("any")))).alias("cad"))


def clash(atoms: DataFrame, pred_pairs: DataFrame, key: str, overlap: float) -> DataFrame:
    """key, clash: 1 / (1 + clashes for 1000 atoms / 100) of predicted atoms of residues more than one apart."""
    hit = (F.col("res2") - F.col("res") > 1) & (F.least("radius", "radius2") > 0) & (F.col("radius") + F.col("radius2") - F.col("d") > overlap)
    hits = pred_pairs.where(hit).groupBy(key).agg(F.count(F.lit(1)).alias("hits"))
    sizes = atoms.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
    return sizes.join(hits, key, "left").select(key, (1 / (1 + 10.0 * F.coalesce("hits", F.lit(0)) / F.col("m"))).alias("clash"))


def burial(atoms: DataFrame, key: str, reach: float) -> DataFrame:
    """key, res, burial: 0.25 + 0.75 * the least of 1 and a twentieth of the residues within reach, CB to CB (CA where there is none).

    Chains with fewer than two such places have 1 throughout; residues without one are not listed.
    """
    no_cb = residues.slots(atoms.sparkSession).where("atom = 'CB'").select("type").distinct()
    has_cb = [r["type"] for r in no_cb.collect()]  # fewer than 20
    central = lambda t, s: F.when((s == 4) & t.isin(has_cb), 0).when(s == chains.CA_SLOT, 1)
    order = central(F.col("type"), F.col("slot"))
    chosen = atoms.where(order.isNotNull()).groupBy(key, F.col("res").alias("id")).agg(F.min_by("t", order).alias("t"))
    size = chosen.groupBy(key).agg(F.count(F.lit(1)).alias("places"))
    n = near_pairs(chosen, key, "t", reach).groupBy(key, F.col("id").alias("res")).agg(F.count(F.lit(1)).alias("n"))
    chosen = chosen.select(key, F.col("id").alias("res"))
    out = chosen.join(size, key).join(n, [key, "res"], "left")
    return out.select(key, "res", F.when(F.col("places") < 2, 1.0).otherwise(0.25 + 0.75 * F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / 20)).alias("burial"))


def chi_angles(atoms: DataFrame, key: str) -> DataFrame:
    """key, res, chi, p and t (degrees), half_turn and weight of the first two side-chain angles whose four atoms are there; an angle on a line is 0."""
    table = residues.chi_places(atoms.sparkSession)
    own = atoms.join(F.broadcast(table), ["type", "slot"])  # fewer than 200 rows
    four = own.groupBy(key, "res", "chi", "half_turn", "weight").agg(F.count(F.lit(1)).alias("n"), *(F.max(F.when(F.col("place") == k, F.col(c))).alias(f"{c}{k}") for c in "pt" for k in range(1, 5)))
    angle = lambda c: F.coalesce(chains.dihedral(*(F.col(f"{c}{k}") for k in range(1, 5))), F.lit(0.0)).alias(c)
    return four.where("n = 4").select(key, "res", "chi", angle("p"), angle("t"), "half_turn", "weight")


def sidechain(angles: DataFrame, buried: DataFrame, key: str) -> DataFrame:
    """key, sidechain: 1 less the mean angle error (a half turn is 1), weighted by angle and burial; where a half turn changes nothing, the smaller error counts."""
    turn = F.pmod(F.col("p") - F.col("t"), F.lit(360.0))
    off = F.least(turn, 360.0 - turn)
    error = F.when(F.col("half_turn"), F.least(off, 180.0 - off)).otherwise(off) / 180.0
    own = angles.join(buried, [key, "res"], "left").withColumn("w", F.col("weight") * F.coalesce("burial", F.lit(0.25)))
    mean = own.groupBy(key).agg((F.sum(F.col("w") * error) / F.greatest(F.sum("w"), F.lit(1e-8))).alias("e"))
    return mean.select(key, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("e"))).alias("sidechain"))


def gdt_counts(atoms: DataFrame, key: str, slot: int = chains.CA_SLOT) -> DataFrame:
    """key, gdt_ha and gdt_ts: means over their limits of the largest share of points of a slot within them."""
    limits = sorted({*GDT_HA, *GDT_TS})
    points = atoms.where(F.col("slot") == slot).select(key, "res", "p", "t")

    def score(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("res")
        found = dict(zip(limits, within(np.array(x["p"].tolist(), float), np.array(x["t"].tolist(), float), tuple(limits))))
        mean = lambda some: float(np.mean([found[z] for z in some]) / len(x))
        return pd.DataFrame({key: [x[key].iloc[0]], "gdt_ha": [mean(GDT_HA)], "gdt_ts": [mean(GDT_TS)]})

    return points.groupBy(key).applyInPandas(score, f"`{key}` {points.schema[key].dataType.simpleString()}, gdt_ha double, gdt_ts double")


def components(pred: DataFrame, true: DataFrame, types: DataFrame, key: str, cutoff: float = 15.0, contact: float = 5.0, reach: float = 10.0, radius: float = 6.0, overlap: float = 0.4, wanted: tuple[str, ...] = ("score", *EMPTY)) -> DataFrame:
    """key, score and its components, for every chain of types; columns that are not wanted are not worked out.

    Atoms that one table lacks take no part. Where there is nothing to score, the components that count what is found are 0 and those that count what
    is wrong are 1 (EMPTY). contact has to be at least twice the largest radius less the overlap, and no distance above cutoff but contact is looked at.
    """
    if contact < 2 * max(residues.RADII.values()) - overlap or cutoff < max(reach, radius, contact):
        raise ValueError("contact or cutoff is too small for the other distances")
    with freed(types.sparkSession):
        atoms = stored(matched(pred, true, types, key), "atoms")
    own = atoms.select(key, "id", "res", "slot", "p", "t", "radius")
    true_pairs, pred_pairs = near_pairs(own.drop("radius"), key, "t", cutoff), near_pairs(own.drop("t"), key, "p", contact)
    p, t = (atoms.select(key, "res", "slot", *(F.get(c, F.lit(i)).alias(a) for i, a in enumerate("xyz"))) for c in "pt")
    lengths = types.groupBy(key).agg((F.max("res") + 1).alias("n_res"))
    parts = [
        gdt_counts(atoms, key), lddts(true_pairs, key, cutoff), cad(atoms, true_pairs, pred_pairs, key, contact), chains.spheres(atoms, true_pairs, key, radius, SPHERES),
        sidechain(chi_angles(atoms, key), burial(atoms, key, reach), key), clash(atoms, pred_pairs, key, overlap),
        chains.backbone_score(p, t, key), chains.dipdiff(p, t, key, lengths=lengths),
    ]
    needed = {*wanted, *(WEIGHTS if "score" in wanted else ())}
    parts = [x for x in parts if needed & {*x.columns}]
    out = reduce(lambda a, b: a.join(b, key, "left"), parts, lengths.select(key))
    out = out.fillna({c: v for c, v in EMPTY.items() if c in out.columns})
    return out.select(key, *(reduce(lambda a, b: a + b, (w * F.col(c) for c, w in WEIGHTS.items())).alias(c) if c == "score" else c for c in wanted))
