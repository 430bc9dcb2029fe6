"""Density clusters against the definition, set by set on dense matrices."""

import datetime as dt
import random

import pytest

from newsgrain.operators import density

START = dt.date(2024, 1, 1)


def parts_of(s, d, upto, strict):
    left, out = set(s), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            part.add(x)
            near = {y for y in left if (w := d.get((min(x, y), max(x, y)))) is not None and (w < upto or not strict and w == upto)}
            left -= near
            todo += near
        out.append(frozenset(part))
    return out


def level_of(s, d):
    """The least distance up to which links hold s together."""
    return next(t for t in sorted({w for (x, y), w in d.items() if x in s and y in s}) if len(parts_of(s, d, t, False)) == 1)


def heaviest(s, birth, d):
    """(mass, clusters) of the best choice at or under s."""
    leaves, here = {}, s
    while True:
        density_here = 1 / max(level_of(here, d), density.LEAST)
        large = [p for p in parts_of(here, d, level_of(here, d), True) if len(p) > 1]
        gone = here if len(large) != 1 else here - large[0]
        leaves |= dict.fromkeys(gone, density_here)
        if len(large) != 1:
            break
        here = large[0]
    own = sum(x - birth for x in leaves.values())
    below = [heaviest(p, density_here, d) for p in large]
    if below and sum(m for m, _ in below) > own + 1e-9:
        return sum(m for m, _ in below), [c for _, cs in below for c in cs]
    return own, [s]


def by_definition(pairs, day, cut, gate, neighbours):
    d = {(a, b): w for a, b, w in pairs if w < cut}
    if neighbours > 1:
        near = {x: sorted(w for p, w in d.items() if x in p) for x in day}
        core = {x: ws[neighbours - 1] for x, ws in near.items() if len(ws) >= neighbours}
        d = {(a, b): max(w, core[a], core[b]) for (a, b), w in d.items() if a in core and b in core}
    out, todo = {x: x for x in day}, [(p, cut) for p in parts_of(day, d, cut, True)]
    while todo:
        s, above = todo.pop()
        if len(s) < 2:
            continue
        if max(day[x] for x in s) - min(day[x] for x in s) > gate:
            todo += [(p, level_of(s, d)) for p in parts_of(s, d, level_of(s, d), True)]
            continue
        for c in heaviest(s, 1 / above, d)[1]:
            out |= dict.fromkeys(c, min(c))
    return out


def block(seed):
    rng = random.Random(seed)
    n, spread = rng.randint(3, 16), rng.choice([20, 60, 150])
    day = {100 * seed + i: rng.randint(0, spread) for i in range(n)}
    ids, step = sorted(day), rng.choice([0.05, 0.001])
    place = {i: (rng.choice([0, 1, 2, 3]) * 0.25 + rng.random() * 0.2, rng.random() * 0.3) for i in ids}
    pairs = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if abs(day[a] - day[b]) <= 30:
                far = ((place[a][0] - place[b][0]) ** 2 + (place[a][1] - place[b][1]) ** 2) ** 0.5 + 0.2 * abs(day[a] - day[b]) / 30
                pairs.append((a, b, round(round(far / step) * step, 6)))  # coarse steps make ties
    return pairs, day


@pytest.mark.parametrize(("neighbours", "most"), [(1, 1 << 16), (1, 0), (2, 12)])
def test_blocks(spark, neighbours, most):
    """Forty blocks at once; with most = 0 every component goes by rounds."""
    blocks = [block(seed) for seed in range(40)]
    pairs, day = [p for b in blocks for p in b[0]], {i: x for b in blocks for i, x in b[1].items()}
    days = spark.createDataFrame([(i, START + dt.timedelta(x)) for i, x in day.items()], "id long, day date")
    got = {r.id: r.cluster for r in density.density_clusters(spark.createDataFrame(pairs, "a long, b long, distance double").repartition(3), days, 0.8, 30, neighbours=neighbours, most=most).collect()}
    want = {}
    for p, x in blocks:
        want |= by_definition(p, x, 0.8, 30, neighbours)
    assert got == want
    sizes = {c: [day[i] for i in got if got[i] == c] for c in set(got.values())}
    assert all(max(v) - min(v) <= 30 for v in sizes.values())
    assert sum(len(v) == 1 for v in sizes.values()) > 5 and sum(len(v) > 2 for v in sizes.values()) > 20


def test_noise_and_chains(spark):
    """Two tight pairs joined by a loose link stay two; a far event is noise; a chain over 90 days at even steps falls apart; equal events have a finite density."""
    day = {1: 0, 2: 0, 3: 1, 4: 1, 5: 9, 10: 0, 11: 30, 12: 60, 13: 90, 20: 5, 21: 5, 22: 5}
    pairs = [(1, 2, 0.1), (3, 4, 0.1), (2, 3, 0.5), (4, 5, 0.95), (10, 11, 0.4), (11, 12, 0.4), (12, 13, 0.4), (20, 21, 0.0), (21, 22, 0.0), (20, 22, 0.0), (1, 5, 1.2)]
    nodes = spark.createDataFrame([(i, START + dt.timedelta(x), 10 + (i in (2, 4)), i % 3) for i, x in day.items()], "id long, day date, articles long, days long")
    got = {r.id: r.master for r in density.consolidate_by_density(spark.createDataFrame(pairs, "a long, b long, distance double"), nodes).collect()}
    assert got == {1: 2, 2: 2, 3: 4, 4: 4, 5: 5, 10: 10, 11: 11, 12: 12, 13: 13, 20: 20, 21: 20, 22: 20}


def test_spanning_forest(spark):
    rng = random.Random(9)
    links = list({(a, b): (a, b, rng.choice([0.1, 0.2, 0.3, rng.random()])) for a, b in ((x, y) for x, y in ((rng.randrange(60), rng.randrange(60)) for _ in range(300)) if x < y)}.values())
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    want = set()
    for w, a, b in sorted((w, a, b) for a, b, w in links):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.add((a, b, w))
    got = density.spanning_forest(spark.createDataFrame(links, "a long, b long, w double")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_without_pairs(spark):
    nodes = spark.createDataFrame([(1, START), (2, None)], "id long, day date")
    none = spark.createDataFrame([], "a long, b long, distance double")
    assert sorted(map(tuple, density.density_clusters(none, nodes).collect())) == [(1, 1), (2, 2)]
