"""All scores of chains against plain versions in numpy."""

import numpy as np
import pytest

from loomwork.functions import residues
from loomwork.operators import chains, composite

NAMES = [*residues.IDS, "UNK"]


def frames(spark, made):
    """pred, true and types of {key: (pred, true, mask, types)} with (n, 14, 3) arrays."""
    atoms = lambda k, x, mask: [(k, int(r), int(s), *map(float, x[r, s])) for r, s in zip(*np.nonzero(mask))]
    schema = "key string, res int, slot int, x double, y double, z double"
    pred, true = (spark.createDataFrame([a for k, v in made.items() for a in atoms(k, v[i], v[2])], schema) for i in (0, 1))
    return pred, true, spark.createDataFrame([(k, r, int(t)) for k, v in made.items() for r, t in enumerate(v[3])], "key string, res int, type int")


def turned(p, t, on):
    cp, ct = p[on].mean(0), t[on].mean(0)
    u, _, v = np.linalg.svd((p[on] - cp).T @ (t[on] - ct))
    if np.linalg.det(u @ v) < 0:
        u[:, -1] *= -1
    return (p - cp) @ (u @ v) + ct


def plain_gdt(p, t, limit):
    n = len(p)
    if n < 3:
        return 0
    seeds = [list(range(n))] + [list(range(s, s + w)) for w in (3, 5, 9) if n >= w for s in range(0, n - w + 1, max(1, (n - w) // 48))]
    best = 0
    for on in seeds:
        for _ in range(8):
            near = [i for i, d in enumerate(np.linalg.norm(turned(p, t, on) - t, axis=1)) if d <= limit]
            if len(near) < 3 or near == on:
                break
            on = near
        best = max(best, len(near))
    return best


def angle(a, b, c, d):
    b0, b1, b2 = a - b, c - b, d - c
    b1 = b1 / max(np.linalg.norm(b1), 1e-8)
    v, w = b0 - b0 @ b1 * b1, b2 - b2 @ b1 * b1
    return np.arctan2(np.cross(b1, v) @ w, v @ w)


def plain(pred, true, mask, types):
    n, out = len(types), {}
    where = list(zip(*np.nonzero(mask)))
    dist = lambda x: np.linalg.norm(x[:, None] - x[None], axis=2)
    P, T = pred[mask], true[mask]
    dp, dt, res = dist(P), dist(T), np.array([r for r, _ in where])
    slot = np.array([s for _, s in where])
    for name, chosen in (("ca", slot == 1), ("backbone", slot < 4), ("all", slot >= 0)):
        scores = []
        for i in np.flatnonzero(chosen):
            near = (dt[i] < 15) & chosen & (res != res[i])
            if near.any():
                scores.append(np.mean([(np.abs(dt[i] - dp[i])[near] < x).sum() / (near.sum() + 1e-8) for x in (0.5, 1, 2, 4)]))
        out[f"lddt_{name}"] = np.mean(scores) if scores else 0.0
    off = whole = 0.0
    for a in range(n):
        for b in range(n):
            x, y = np.flatnonzero(res == a), np.flatnonzero(res == b)
            if a != b and len(x) and len(y):
                cp, ct = (d[np.ix_(x, y)] < 5 for d in (dp, dt))
                off, whole = off + abs(cp.sum() - ct.sum()) / cp.size, whole + max(cp.sum(), ct.sum()) / cp.size
    out["cad"] = 1.0 if whole <= 1e-8 else min(1.0, max(0.0, 1 - off / whole))
    rms = []
    for i in np.flatnonzero(slot == 1):
        on = np.flatnonzero(dt[i] <= 6)
        if len(on) >= 3:
            rms.append(np.sqrt(((turned(P[on], T[on], list(range(len(on)))) - T[on]) ** 2).sum(1).mean()))
    out["spheres"] = np.mean([[r <= z for r in rms] for z in (2, 4)]) if rms else 1.0
    ca = np.flatnonzero(slot == 1)
    for name, limits in (("gdt_ha", (0.5, 1, 2, 4)), ("gdt_ts", (1, 2, 4, 8))):
        out[name] = np.mean([plain_gdt(P[ca], T[ca], z) / len(ca) for z in limits]) if len(ca) else 0.0
    radius = np.array([residues.RADII[residues.ATOMS[NAMES[types[r]]][s][0]] if types[r] < 20 and s < len(residues.ATOMS[NAMES[types[r]]]) else 0 for r, s in where])
    hits = ((radius[:, None] + radius[None] - dp > 0.4) & (res[None] - res[:, None] > 1) & (radius[:, None] > 0) & (radius[None] > 0)).sum() if len(where) else 0
    out["clash"] = 1 / (1 + 1000 * hits / len(where) / 100) if len(where) else 1.0
    place = {}
    for r in range(n):
        cb = 4 if types[r] < 20 and "CB" in residues.ATOMS[NAMES[types[r]]] else 1
        for s in (cb, 1):
            if r not in place and mask[r, s]:
                place[r] = true[r, s]
    burial = {r: 1.0 if len(place) < 2 else 0.25 + 0.75 * min(1, sum(np.linalg.norm(place[r] - q) <= 10 for k, q in place.items() if k != r) / 20 if r in place else 0) for r in range(n)}
    errors = weights = 0.0
    last = {three: rest for three, *rest in (line.split() for line in residues.CHI.split("\n") if line)}
    for r in range(n):
        name = NAMES[types[r]]
        for chi in range(1, len(last.get(name, ())) + 1):
            four = [residues.ATOMS[name].index(a) for a in ["N", "CA", "CB", *last[name]][chi - 1 : chi + 3]]
            if mask[r, four].all():
                delta = abs((angle(*pred[r, four]) - angle(*true[r, four]) + np.pi) % (2 * np.pi) - np.pi)
                delta = min(delta, np.pi - delta) if (name, chi) in residues.HALF_TURN else delta
                w = residues.CHI_WEIGHTS[chi] * burial[r]
                errors, weights = errors + w * delta / np.pi, weights + w
    out["sidechain"] = 1 - errors / weights if weights else 1.0
    return out


def chain(rng, n, noise, drop=0.1, spread=4.0):
    true = rng.normal(0, 1.2, (n, 14, 3)) + np.cumsum(rng.normal(0, spread, (n, 3)), 0)[:, None]
    types = rng.integers(0, 21, n)
    mask = rng.random((n, 14)) >= drop
    for r in range(n):
        mask[r, len(residues.ATOMS[NAMES[types[r]]]) if types[r] < 20 else 6 :] = False
    return true + rng.normal(0, noise, true.shape), true, mask, types


def test_components_against_plain_ones(spark):
    rng = np.random.default_rng(11)
    made = {"a": chain(rng, 30, 0.4), "b": chain(rng, 18, 2.0, spread=2.0), "c": chain(rng, 9, 0.05), "d": chain(rng, 2, 0.5)}
    got = {r["key"]: r.asDict() for r in composite.components(*frames(spark, made), "key").collect()}
    for key, one in made.items():
        want = plain(*one)
        assert {c: round(got[key][c], 5) for c in want} == {c: round(float(v), 5) for c, v in want.items()}, key
        assert np.isclose(got[key]["score"], sum(w * got[key][c] for c, w in composite.WEIGHTS.items()))


def test_a_perfect_chain_is_all_ones(spark):
    true = np.zeros((6, 14, 3))
    true[..., 0], true[..., 1], true[..., 2] = np.arange(6)[:, None] * 3.8, np.arange(14) * 0.1, np.arange(14) * 0.05
    one = (true, true, np.ones((6, 14), bool), np.zeros(6, int))
    row = composite.components(*frames(spark, {"k": one}), "key").first().asDict()
    assert all(np.isclose(row[c], 1.0, atol=1e-6) for c in row if c != "key")
    pred = true.copy()
    pred[4] = pred[0]
    row = composite.components(*frames(spark, {"k": (pred, *one[1:])}), "key").first()
    assert row["clash"] < 1 and row["cad"] < 1 and row["score"] < 1


def test_chains_without_atoms_and_small_limits(spark):
    rng = np.random.default_rng(1)
    full = chain(rng, 3, 0.1)
    pred, true, types = frames(spark, {"k": full})
    types = types.unionByName(spark.createDataFrame([("none", 0, 3), ("none", 1, 99)], types.schema))
    got = {r["key"]: r.asDict() for r in composite.components(pred, true, types, "key").collect()}
    assert {c: got["none"][c] for c in composite.EMPTY} == composite.EMPTY
    with pytest.raises(ValueError):
        composite.components(pred, true, types, "key", contact=1.0)
    assert composite.components(pred, true, types.limit(0), "key").count() == 0


def test_batched_superpositions_are_the_plain_ones():
    rng = np.random.default_rng(4)
    for n in (0, 2, 3, 4, 9, 40, 120):
        t = np.cumsum(rng.normal(0, 3, (n, 3)), 0)
        p = t + rng.normal(0, 1, (n, 3)) * rng.choice([0.2, 3], (n, 1))
        assert chains.within(p, t, (0.5, 2.0)) == [plain_gdt(p, t, 0.5), plain_gdt(p, t, 2.0)]


def test_only_what_is_wanted_is_worked_out(spark):
    made = {"a": chain(np.random.default_rng(11), 12, 0.4)}
    whole = composite.components(*frames(spark, made), "key").first().asDict()
    some = composite.components(*frames(spark, made), "key", wanted=("cad", "lddt_ca"))
    assert some.columns == ["key", "cad", "lddt_ca"] and "InPandas" not in some._jdf.queryExecution().executedPlan().toString()
    got = some.first().asDict()
    assert all(np.isclose(got[c], whole[c]) for c in ("cad", "lddt_ca"))
