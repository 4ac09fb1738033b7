"""Residues and their atoms as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Three letters, one letter and the atoms in the order of their slots, of the twenty residues in the order of their ids.
RESIDUES = """
ALA A N CA C O CB
ARG R N CA C O CB CG CD NE CZ NH1 NH2
ASN N N CA C O CB CG OD1 ND2
ASP D N CA C O CB CG OD1 OD2
CYS C N CA C O CB SG
GLN Q N CA C O CB CG CD OE1 NE2
GLU E N CA C O CB CG CD OE1 OE2
GLY G N CA C O
HIS H N CA C O CB CG ND1 CD2 CE1 NE2
ILE I N CA C O CB CG1 CG2 CD1
LEU L N CA C O CB CG CD1 CD2
LYS K N CA C O CB CG CD CE NZ
MET M N CA C O CB CG SD CE
PHE F N CA C O CB CG CD1 CD2 CE1 CE2 CZ
PRO P N CA C O CB CG CD
SER S N CA C O CB OG
THR T N CA C O CB OG1 CG2
TRP W N CA C O CB CG CD1 CD2 NE1 CE2 CE3 CZ2 CZ3 CH2
TYR Y N CA C O CB CG CD1 CD2 CE1 CE2 CZ OH
VAL V N CA C O CB CG1 CG2
"""
#: The last atoms of the first two side-chain angles; the first goes N CA CB x, the second CA CB x y.
CHI = """
ARG CG CD
ASN CG OD1
ASP CG OD1
CYS SG
GLN CG CD
GLU CG CD
HIS CG ND1
ILE CG1 CD1
LEU CG CD1
LYS CG CD
MET CG SD
PHE CG CD1
PRO CG CD
SER OG
THR OG1
TRP CG CD1
TYR CG CD1
VAL CG1
"""
#: Angles that a half turn leaves the same (first or second), radii of atoms by element, weights of the two angles.
HALF_TURN = {("ASP", 2), ("PHE", 2), ("TYR", 2), ("VAL", 1), ("LEU", 2)}
RADII = {"C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80}
CHI_WEIGHTS = {1: 2.0, 2: 1.0}
UNKNOWN, N_SLOTS = 20, 14

_ROWS = [line.split() for line in RESIDUES.split("\n") if line]
IDS = {three: i for i, (three, *_) in enumerate(_ROWS)}
ATOMS = {three: atoms for three, _, *atoms in _ROWS}
LETTERS = {three: one for three, one, *_ in _ROWS}


def slots(spark: SparkSession) -> DataFrame:
    """residue, type, letter, atom, slot and radius of every atom of the twenty residues: fewer than 200 rows."""
    rows = [(three, IDS[three], LETTERS[three], a, k, RADII[a[0]]) for three, atoms in ATOMS.items() for k, a in enumerate(atoms)]
    return spark.createDataFrame(rows, "residue string, type int, letter string, atom string, slot int, radius double")


def chi_places(spark: SparkSession) -> DataFrame:
    """type, chi (1 or 2), place (1 to 4), slot, half_turn and weight of the atoms of side-chain angles: fewer than 200 rows."""
    rows = []
    for three, *last in (line.split() for line in CHI.split("\n") if line):
        for chi in range(1, len(last) + 1):
            four = ["N", "CA", "CB", *last][chi - 1 : chi + 3]
            rows += [(IDS[three], chi, k, ATOMS[three].index(a), (three, chi) in HALF_TURN, CHI_WEIGHTS[chi]) for k, a in enumerate(four, 1)]
    return spark.createDataFrame(rows, "type int, chi int, place int, slot int, half_turn boolean, weight double")


def letter_of(residue: Column) -> Column:
    """One letter of a three-letter name in any case, X for one that is not among the twenty."""
    named = F.map_from_arrays(F.array(*map(F.lit, LETTERS)), F.array(*map(F.lit, LETTERS.values())))
    return F.coalesce(F.try_element_at(named, F.upper(residue)), F.lit("X"))
