"""HDBSCAN against a plain version over dense matrices."""

import numpy as np
import pytest

from skein.operators import density


def plain(ids, x, least):
    """Labels by brute force: dense matrix, Kruskal over all pairs, a condensed tree walked from the root."""
    n = len(ids)
    d = density.distances(x, x)
    core = np.sort(d, axis=1)[:, least - 1]
    pairs = sorted((max(d[i, j], core[i], core[j]), min(ids[i], ids[j]), max(ids[i], ids[j]), i, j) for i in range(n) for j in range(i))
    top, members, kids, weight = list(range(n)), {i: [i] for i in range(n)}, {}, {}
    for w, _, _, i, j in pairs:
        if top[i] == top[j]:
            continue
        a, b, new = top[i], top[j], n + len(kids)
        kids[new], weight[new], members[new] = (a, b), w, members[a] + members[b]
        for m in members[new]:
            top[m] = new
    lam = lambda node: 1 / max(weight[node], density.NEAREST)
    label = np.full(n, -1)

    def walk(node, birth):
        """Stability of the cluster that begins here, and its clusters: lists of members picked within."""
        stability, value, chosen = 0.0, 0.0, []
        while True:
            if node < n:
                return stability, value, chosen
            a, b = kids[node]
            big = [c for c in (a, b) if len(members[c]) >= least]
            at = lam(node)
            if len(big) == 2:
                for c in big:
                    stability += len(members[c]) * (at - birth)
                    own, within, parts = walk(c, at)
                    if not parts or own >= within:
                        value, chosen = value + own, [*chosen, members[c]]
                    else:
                        value, chosen = value + within, chosen + parts
                return stability, value, chosen
            stability += sum(len(members[c]) for c in (a, b) if c not in big) * (at - birth)
            if not big:
                return stability, value, chosen
            node = big[0]

    for m in walk(max(kids), 0.0)[2]:
        label[m] = min(ids[i] for i in m)
    return {int(i): (int(v) if v >= 0 else None) for i, v in zip(ids, label, strict=True)}


def test_squares_choose_pairs_for_exact_distances():
    # every pair of a search had its exact distance worked out, whether or not it could be among the nearest
    r = np.random.default_rng(3)
    for shift in (0.0, 1e3):  # far from the origin a product's squares are less exact, and say so
        q, x = r.normal(size=(40, 16)) + shift, r.normal(size=(300, 16)) + shift
        q[:5] = x[:5]
        exact, (near, off) = density.distances(q, x), density.squares(q, x)
        assert (np.abs(near - exact**2) <= off).all()
        i, j = np.nonzero(near <= np.partition(near, 4, axis=1)[:, 4, None] + 2 * off)
        assert (density.paired(q, x, i, j) == exact[i, j]).all() and len(i) < 40 * 20
        for k in range(40):
            assert (np.sort(density.paired(q, x, i, j)[i == k])[:5] == np.sort(exact[k])[:5]).all()



def blobs(seed, n, dims=6):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 4, (5, dims))
    x = np.concatenate([centres[k % 5] + rnd.normal(0, 0.3 + 0.5 * (k % 3), dims) for k in range(n)]).reshape(n, dims)
    x[-n // 6 :] = rnd.normal(0, 6, (n // 6, dims))
    return x.astype(np.float32), [int(i) for i in rnd.permutation(n) * 7]


@pytest.mark.parametrize(("seed", "n", "block", "pivots", "subtree"), [(1, 150, 4096, 256, 200_000), (2, 216, 16, 7, 40)])
def test_hdbscan(spark, monkeypatch, seed, n, block, pivots, subtree):
    for name, value in (("BLOCK", block), ("PIVOTS", pivots), ("SUBTREE", subtree), ("QUERIES", 50)):
        monkeypatch.setattr(density, name, value)
    x, ids = blobs(seed, n)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(10_000, None)], "id long, x array<float>")
    got = {r["id"]: r["cluster"] for r in density.hdbscan(df).collect()}
    want = plain(ids, x.astype(np.float64), 5)
    assert got == want | {10_000: None} and len(set(want.values())) > 3


def test_equal_vectors_and_few(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100 + i, [0.0, 1.0 + i / 100]) for i in range(8)] + [(200 + i, [-9.0 - 5 * i, 3.0 * i]) for i in range(4)]
    got = {r["id"]: r["cluster"] for r in density.hdbscan(spark.createDataFrame(rows, "id long, x array<float>")).collect()}
    assert {got[i] for i in range(40)} == {0} and {got[100 + i] for i in range(8)} == {100} and {got[200 + i] for i in range(4)} == {None}
    few = density.hdbscan(spark.createDataFrame(rows[-4:], "id long, x array<float>")).collect()
    assert len(few) == 4 and all(r["cluster"] is None for r in few)
    assert density.hdbscan(spark.createDataFrame([], "id long, x array<float>")).count() == 0


def test_near_centroids(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 8)
    monkeypatch.setattr(density, "PIVOTS", 5)
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(70, 5))
    got = {r["cluster"]: r["merged"] for r in density.merge_near(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cluster long, x array<double>"), 0.8).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near, low = u @ u.T >= 0.8, list(range(70))
    for _ in range(70):
        low = [min(low[j] for j in np.flatnonzero(near[i])) for i in range(70)]
    assert got == dict(enumerate(low)) and len(set(low)) > 5


def test_face_clusters(spark):
    rnd = np.random.default_rng(9)
    rows = []
    for i in range(90):
        v = np.eye(4)[i % 3] * 3 + rnd.normal(0, 0.2, 4)
        rows.append((i, f"p{i // 2}", v.tolist(), 0.4 if i % 30 == 7 else 0.5 + (i * 7 % 50) / 100))
    dets = spark.createDataFrame([*rows, rows[5]], "det_id long, photo_id string, embedding array<float>, det_score double")
    clusters = density.face_clusters(dets)
    got = {r["det_id"]: r["cluster_id"] for r in clusters.collect()}
    assert len(got) == 90 and all(got[i] == -1 for i in (7, 37, 67))
    groups = [{got[i] for i in range(90) if i % 3 == k and i % 30 != 7} - {-1} for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    report = {r["cluster_id"]: r for r in density.cluster_report(dets, clusters).collect()}
    score = {r[0]: r[3] for r in rows}
    for c, r in report.items():
        mine = sorted((i for i, g in got.items() if g == c), key=lambda i: (-score[i], i))
        assert r["n_faces"] == len(mine) and r["exemplar_dets"] == ",".join(map(str, mine[:9])) and r["exemplar_photos"] == ",".join(f"p{i // 2}" for i in mine[:9])


def test_small_tables_need_no_rounds(spark, monkeypatch):
    # components, pointers and clusters took a round of jobs for each step of their depth, however few they were
    rnd = np.random.default_rng(12)
    big = 2**60  # not exact as doubles
    edges = spark.createDataFrame([(big + int(a), big + int(b)) for a, b in rnd.integers(0, 90, (60, 2))], "a long, b long")
    pointers = spark.createDataFrame([(big + k, big + max(0, k - 1 - k % 3), big + k if k % 7 == 3 else None) for k in range(60)], "node long, up long, best long")
    clusters = spark.createDataFrame([(big + k, big + (k - 1) // 2 if k else None, float(rnd.integers(1, 9)) * 2.0 ** -(k // 4)) for k in range(40)] + [(5, big + 39, 0.5), (4, big + 39, 0.25)], "cluster long, parent long, stability double")
    cuts = []

    def cut(df):
        cuts.append(1)
        return df.localCheckpoint()

    def told():
        return [sorted(map(repr, map(tuple, df.collect()))) for df in (density.joined(edges, cut), density.followed(pointers, cut), density.picked(clusters, cut))]

    got, few = told(), len(cuts)
    monkeypatch.setattr(density, "SUBTREE", 3)
    cuts.clear()
    assert got == told() and few <= 8 < len(cuts)
