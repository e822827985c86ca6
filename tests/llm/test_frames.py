import numpy as np
import pytest

from sitewise.llm import frames, nearcopies, overlap

SCHEMA = "frame_key long, source_file string, material_id string, n_atoms int, numbers array<int>, positions array<array<double>>, cell array<array<double>>, rep long, key string, cls int"
CELL = np.array([[8.0, 0.0, 0.0], [0.4, 7.5, 0.0], [0.0, -0.3, 9.0]])
rng = np.random.default_rng(4)
BASE = rng.random((14, 3)) @ CELL
Z = [3] * 4 + [8] * 6 + [17] * 4


def row(key, split, x, z=Z, cell=CELL, name="src"):
    x = None if x is None else [list(map(float, p)) for p in x]
    return (key, f"{name}_{split}.xyz", "mp-1", 1, list(z), x, [list(map(float, c)) for c in cell], 0, "k", 0)


def jitter(x, d):
    v = rng.normal(size=x.shape)
    return x + v / np.linalg.norm(v, axis=1)[:, None] * d


ORDER = rng.permutation(14)
ROWS = [
    row(1, "train", BASE),
    row(2, "val", jitter(BASE, 0.019)[ORDER], [Z[i] for i in ORDER]),  # all moved, in another order
    row(3, "TEST", BASE + np.array([[1, 0, -2]] * 14) @ CELL),  # shifted by lattice vectors
    row(4, "test", np.vstack([BASE[:-1], BASE[-1:] + 0.03])),  # one atom too far for an overlap
    row(5, "val", BASE, Z[:-1] + [9]),  # another element
    row(6, "val", BASE, cell=CELL + np.eye(3) * 0.06),  # another cell
    row(7, "train", BASE),  # a copy
    row(8, "val", None),
    row(9, "test", BASE[:-3], Z[:-3]),  # 3 of 14 atoms left out: 22 / 25 = 0.88
    row(10, "val", BASE[:9], Z[:9]),  # 18 / 23 = 0.7826 is more than 0.78
    row(11, "val", BASE[:8], Z[:8]),  # 16 / 22 isn't
    row(12, "none.dat", BASE),  # no split
    row(13, "val", [], []),
    row(14, "test", jitter(BASE, 0.049)),
]


def truth(rows, tolerance, share):
    """Every pair by the exact test."""
    fs = [(r[0], r[1].rsplit("_", 1)[1].lower().removesuffix(".xyz"), np.array(r[4]), np.array(r[5], float), np.array(r[6])) for r in rows if r[5]]
    out = set()
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if frames.same_cell(a[4], b[4]):
                m = frames.paired(frames.near(a[2], a[3], a[4], b[2], b[3], tolerance))
                n = len(a[2]) + len(b[2])
                if (2 * m == n) if share is None else 2 * m > share * n:
                    out.add((a[0], b[0], a[1], b[1]))
    return out


def test_overlaps(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {tuple(sorted((r.k_t, r.k_o))) for r in overlap.frame_overlaps(df).collect()}
    want = {(a, b) for a, b, s, t in truth(ROWS, 0.02, None) if ("train" in (s, t)) and s != t and {s, t} <= {"train", "val", "test"}}
    assert got == want and (1, 2) in got and (3, 7) in got and (1, 4) not in got


def test_near_pairs_and_groups(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = {(a, b) for a, b, _, _ in truth(ROWS, 0.05, 0.78)}
    assert {tuple(r) for r in nearcopies.near_pairs(df).select("a", "b").collect()} == want
    assert (1, 9) in want and (1, 10) in want and (1, 11) not in want and (1, 14) in want
    g = {r.frame_key: r for r in nearcopies.near_groups(df).collect()}
    assert 8 not in g and 13 not in g and g[14].group_id == 1 and g[6].n_links == 0 and g[6].group_size == 1
    assert sum(r.n_links for r in g.values()) == 2 * len(want)


def test_small_and_many(spark):
    """Frames of few atoms, and a crowd of one material whose atoms all vibrate about the same sites."""
    r = np.random.default_rng(9)
    rows = [row(i, r.choice(["train", "val"]), BASE + r.uniform(-0.3, 0.3, BASE.shape)) for i in range(60)]
    rows += [row(100 + i, r.choice(["train", "test"]), np.array(rows[i][5]) + r.uniform(-0.01, 0.01, BASE.shape)) for i in range(0, 60, 3)]
    rows += [row(200 + i, "val", BASE[:k] + 0.001 * i, Z[:k]) for i, k in enumerate([1, 1, 2, 2, 3, 3, 4, 4, 5])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(x) for x in nearcopies.near_pairs(df).select("a", "b").collect()} == {(a, b) for a, b, _, _ in truth(rows, 0.05, 0.78)}
    got = {tuple(sorted((x.k_t, x.k_o))) for x in overlap.frame_overlaps(df).collect()}
    assert got == {(a, b) for a, b, s, t in truth(rows, 0.02, None) if (s == "train") != (t == "train")}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert overlap.frame_overlaps(none).count() == 0
    assert nearcopies.near_pairs(none).count() == 0 and nearcopies.near_groups(none).count() == 0


@pytest.mark.parametrize("level", range(len(overlap.LEVELS)))
@pytest.mark.parametrize("n", [4, 14, 25, 60])
def test_block_recall_at_the_tolerance(level, n):
    """All atoms moved by the whole tolerance, and cells changed: how often a code block still agrees, by size and width."""
    kind = overlap.LEVELS[level]
    k, phase = overlap.waves(kind.block * kind.segments)
    r, hit = np.random.default_rng(2), {False: [], True: []}
    for i in range(200):
        cell = np.diag(r.uniform(5.2, 11.5, 3)) + r.uniform(-0.5, 0.5, (3, 3)) * (1 - np.eye(3))
        z, x = r.choice([3, 8, 17, 26], n), r.random((n, 3)) @ cell
        v = r.normal(size=x.shape)
        y = x + 0.02 * v / np.linalg.norm(v, axis=1)[:, None]
        changed = cell + (r.uniform(-0.05, 0.05, (3, 3)) if i % 2 else 0)
        a, b = (overlap.sums(frames.Frames(z, p, c, np.array([n])), k, phase) for p, c in ((x, cell), (y, changed)))
        same = np.intersect1d(overlap.blocks(a, np.array([1]), kind, True), overlap.blocks(b, np.array([1]), kind, False))
        hit[bool(i % 2)].append(len(same) > 0 and ((a > 0) != (b > 0)).sum() <= overlap.RADIUS * a.shape[1])
    print(level, n, np.mean(hit[False]), np.mean(hit[True]))
    assert np.mean(hit[False]) == 1.0 and np.mean(hit[True]) > 0.9


@pytest.mark.parametrize("n", range(1, 60))
def test_bands_cover_the_ratio(n):
    for m in range(n, int(n * nearcopies.RATIO) + 1):
        if 2 * min(n, m) / (n + m) > nearcopies.SHARE:
            assert set(nearcopies.bands(n)) & set(nearcopies.bands(m))


def test_pairing_is_a_maximum_matching():
    ok = np.array([[1, 1, 0], [1, 0, 0], [0, 1, 1]], bool)
    assert frames.paired(ok) == 3 and frames.paired(np.zeros((0, 3), bool)) == 0 and frames.paired(np.ones((4, 2), bool)) == 2


def test_hops(spark):
    schema = "row_id long, material_id string, edge_id string, _split string, split_t string"
    rows = [(1, "mp-1", "mp-1_0_1_0_0_1", "train", "x"), (2, " MP−1", "mp-1_1_0_0_0_-1", "Validation", "x"), (3, "mp-1", "mp-1_0_1_0_0_1", None, "x"), (4, "mp-1", "mp-1_0_1", "val", "x"), (5, None, "mp-1_0_1_0_0_1", "val", "x"), (6, "mp-1", "mp-1_0_1_0_0_1", "test", "x"), (7, "mp-1", None, "test", "x"), (8, "mp-1", "mp-1_0_1_0_0_1", "train", "x")]
    got = {(r.k_t, r.k_o, r.split_o) for r in overlap.hop_overlaps(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 2, "val"), (1, 6, "test"), (8, 2, "val"), (8, 6, "test")}


def edge_pairs(count, changed, wrapped, seed=21):
    """Pairs right at the edge: all atoms moved by the whole 0.05 Å, atoms left out until the share is just reached."""
    r, rows = np.random.default_rng(seed), []
    for i in range(count):
        n = int(r.integers(7, 26))
        cell = np.diag(r.uniform(5.2, 11.5, 3)) + r.uniform(-0.5, 0.5, (3, 3)) * (1 - np.eye(3))
        x, z = r.random((n, 3)) @ cell, r.choice([3, 8, 17, 26], n)
        keep = int(np.floor(nearcopies.SHARE * n / (2 - nearcopies.SHARE) + 1e-9)) + 1
        v = r.normal(size=(keep, 3))
        y = x[:keep] + v / np.linalg.norm(v, axis=1)[:, None] * 0.049999
        y = y + (r.integers(-2, 3, (keep, 3)) @ cell if wrapped else 0)
        rows += [row(2 * i, "train", x, z.tolist(), cell), row(2 * i + 1, "val", y, z[:keep].tolist(), cell + (r.uniform(-0.05, 0.05, (3, 3)) if changed else 0))]
    return rows


@pytest.mark.parametrize(("changed", "wrapped"), [(False, False), (False, True), (True, False), (True, True)])
def test_recall_of_changed_and_wrapped_cells(spark, changed, wrapped):
    rows = edge_pairs(500, changed, wrapped)
    want = {(2 * i, 2 * i + 1) for i in range(500)}
    got = {tuple(x) for x in nearcopies.near_pairs(spark.createDataFrame(rows, SCHEMA)).select("a", "b").collect()}
    assert len(got & want) >= (465 if changed and wrapped else 498)


@pytest.mark.parametrize("level", range(len(nearcopies.LEVELS)))
@pytest.mark.parametrize(("changed", "least"), [(False, 0.98), (True, 0.95)])
def test_recall_of_every_level(level, changed, least):
    """The same pairs by the segments that each level of load compares."""
    rows = edge_pairs(80, changed, False, seed=30 + level)
    f = frames.Frames(np.concatenate([r[4] for r in rows]), np.concatenate([np.array(r[5]) for r in rows]), np.array([r[6] for r in rows]), np.array([len(r[4]) for r in rows]))
    of, key = nearcopies.segment_keys(f, level)
    sets = [set() for _ in rows]
    for i, k in zip(of.tolist(), key.tolist(), strict=True):
        sets[i].add(k)
    assert np.mean([bool(sets[2 * i] & sets[2 * i + 1]) for i in range(80)]) >= least


def test_frames_of_a_crowded_cell_change_level(spark, monkeypatch):
    """A crowd in one cell makes longer segments; pairs across the border of two levels are found too."""
    monkeypatch.setattr(nearcopies, "LEVELS", (nearcopies.LEVELS[0]._replace(load=20), *nearcopies.LEVELS[1:]))
    r = np.random.default_rng(12)
    rows = [row(i, "train", BASE + r.uniform(-0.3, 0.3, BASE.shape)) for i in range(40)]
    rows += [row(100 + i, "test", np.array(rows[i][5]) + r.uniform(-0.02, 0.02, BASE.shape), cell=CELL + r.uniform(-0.04, 0.04, (3, 3))) for i in range(0, 40, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    reps = frames.representatives(frames.readable(df))
    assert {x.levels for x in nearcopies.levels(reps).collect()} >= {2}
    found = {tuple(x) for x in nearcopies.candidates(reps).collect()}
    assert {(a, b) for a, b, _, _ in truth(rows, 0.05, 0.78)} <= found


def test_bound_keeps_every_pair_that_holds():
    """Own bins against reachable bins, in one cell: no atom within the tolerance counts as lone."""
    for a, b in zip(*(iter(edge_pairs(200, False, True)),) * 2, strict=True):
        for s, t in ((a, b), (b, a)):
            own, _ = nearcopies.bitmaps(np.array(s[4]), np.array(s[5]), np.array(s[6]))
            _, near = nearcopies.bitmaps(np.array(t[4]), np.array(t[5]), np.array(t[6]))
            lone = sum(int(w).bit_count() for w in (own & ~near).view(np.uint64))
            assert lone <= len(s[4]) - len(b[4])
