"""The interest shortlist against plain Python."""

import random

import pytest

from harborline.operators import ranking as K

SHAPES = ["rising", "inverse_u_peak", "failed_recovery", "flat", "u_recovery"]


def brute(yoy, shares, shapes, zs, headline):
    size, share = {}, dict(shares)
    for g, y in yoy:
        size[g] = max(size.get(g, 0.0), abs(y))
    first = lambda names, key, k: sorted(names, key=lambda g: (-key(g), g))[:k]
    gap = {}
    for p, z in zs:
        if not p.startswith("BLOC:"):
            gap[p] = max(gap.get(p, 0.0), abs(z))
    kinds = {
        "mover": first(size, size.get, 3), "dependency": first([g for g, s in share.items() if s >= 0.85], share.get, 3),
        "flip": first({g for g, s in shapes if s in ("inverse_u_peak", "failed_recovery")}, lambda g: size.get(g, 0.0), 2), "mirror": first(gap, gap.get, 2),
    }
    out = []
    for s in {s for names in kinds.values() for s in names} - headline:
        mine = sorted(k for k, names in kinds.items() if s in names)
        out.append((s, len(mine), size.get(s, 0.0) + share.get(s, 0.0) + gap.get(s, 0.0) / 2, ",".join(mine)))
    return sorted(out, key=lambda r: (-r[1], -r[2], r[0]))[:8]


@pytest.mark.parametrize("seed", range(3))
def test_shortlist_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    groups = [f"g{i}" for i in range(12)]
    yoy = [(g, rng.uniform(-2, 2)) for g in groups[:9] for _ in range(2)]
    shares = [(g, rng.uniform(0.7, 1.0)) for g in groups[2:]]
    shapes = [(g, rng.choice(SHAPES)) for g in groups for _ in range(2)]
    zs = [(p, rng.uniform(-4, 4)) for p in ("N01", "N02", "N03", "N04") for _ in range(3)] + [("BLOC:eu_bloc", 9.0)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    branches = K.shortlist_branches(frame(yoy, "group_name string, value_yoy double"), frame(shares, "group_name string, value_share double"), frame(shapes, "group_name string, shape string"), frame(zs, "partner string, z double"))
    got = K.interest_shortlist(branches, frame([("g1",)], "subject string")).collect()
    want = brute(yoy, shares, shapes, zs, {"g1"})
    assert [(r.subject, r.n_kinds, r.kinds) for r in got] == [(s, n, k) for s, n, _, k in want]
    assert [r.strength for r in got] == pytest.approx([x for _, _, x, _ in want])
    assert max(r.n_kinds for r in got) > 1
