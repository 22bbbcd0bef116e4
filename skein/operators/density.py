"""Density clustering of vectors (E-20): HDBSCAN as joins, searches within blocks and rounds.

1. Equal vectors are one point with a weight, so that copies of one vector cost nothing further.
2. Points belong to the cell of their nearest pivot, and cells are dealt into blocks of some BLOCK points. A search
   goes to the blocks of those cells only that the triangle inequality can't rule out: a cell of radius r about pivot
   p holds nothing nearer to q than d(q, p) - r. A search in the point's own block gives the bound for all others.
3. Core distances are the k-th nearest neighbour's. The minimum spanning tree of mutual reachability comes by Boruvka
   rounds, in which every component finds its least edge outwards; edges are ordered by (weight, ids), so ties can't
   make a circle.
4. Edges in their order merge components: the dendrogram. It's divided at the middle edge, again and again: components of
   the lower half are trees of their own, and one node each in the upper half; what has at most SUBTREE edges is a task's, and so are components, pointers and clusters of at most so many rows.
5. A merge of two sides of `least` points or more is a split. Points follow their parents to the last split above
   them by doubling steps. Clusters have the stability of what falls out of them, and from the leaves up the more
   stable of a cluster and its parts is picked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, ship
from .iterative import components
from .ranking import ranked

PIVOTS, BLOCK, QUERIES, SUBTREE = 256, 4096, 512, 200_000
NEAREST = 1e-9  # equal vectors count as this far apart, so that their density is finite
SLACK = 1e-9
Cut = Callable[[DataFrame], DataFrame]


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances, the same to the last bit in either direction."""
    out = np.zeros((len(q), len(x)))
    for k in range(q.shape[1]):
        d = q[:, k, None] - x[None, :, k]
        out += d * d
    return np.sqrt(out)


def paired(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """distances(q, x)[i, j], the same to the last bit."""
    out = np.zeros(len(i))
    for k in range(q.shape[1]):
        d = q[i, k] - x[j, k]
        out += d * d
    return np.sqrt(out)


def squares(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Squares of the distances by one matrix product, and how far they may be off: they say which pairs are worth an exact distance."""
    nq, nx = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", x, x)
    out = q @ x.T
    out *= -2
    out += nq[:, None]
    out += nx
    return out, 8 * (q.shape[1] + 4) * np.finfo(np.float64).eps * (np.sqrt(nq.max(initial=0)) + np.sqrt(nx.max(initial=0))) ** 2


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def in_one(df: DataFrame, rule: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What `rule` makes of a whole table of at most SUBTREE rows, in one task."""
    ship(df.sparkSession)
    return df.groupBy().applyInArrow(rule, schema)


def joined(edges: DataFrame, cut: Cut) -> DataFrame:
    """components() of edges(a, b); at most SUBTREE of them are a task's, and need no rounds."""
    edges = cut(edges.select("a", "b").distinct())
    if edges.count() > SUBTREE:
        return components(edges, cut=cut)

    def united(rows: pa.Table) -> pa.Table:
        parent: dict[int, int] = {}

        def root(n: int) -> int:
            while parent.setdefault(n, n) != n:
                parent[n] = n = parent[parent[n]]
            return n

        for a, b in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return pa.table({"node": pa.array(list(parent), pa.int64()), "component": pa.array([root(n) for n in list(parent)], pa.int64())})

    return cut(in_one(edges, united, "node long, component long"))


class Cells:
    """Points dealt to the cells of their nearest pivot, and cells to blocks.

    `points` gets cell and salt. Pivots are at most PIVOTS points, whatever the table's size, and few enough for
    cells of a quarter of a block: with smaller ones queries cost more on their way than in their search. They, and a radius and
    a number of blocks for each, are all that tasks get.
    """

    def __init__(self, points: DataFrame, cut: Cut):
        ship(points.sparkSession)
        self.pivots = pivots = np.array([r["x"] for r in points.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-4 * points.count() // BLOCK))).select("x").collect()], np.float64)
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in points.schema)}, cell int, reach double"

        def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    d = distances(stacked(rows.x), pivots)
                    yield rows.assign(cell=d.argmin(axis=1).astype(np.int32), reach=d.min(axis=1))

        placed = cut(points.mapInPandas(home, schema)) if len(pivots) else points.withColumns({"cell": F.lit(0), "reach": F.lit(0.0)})
        self.radius, self.blocks = np.zeros(max(1, len(pivots))), np.ones(max(1, len(pivots)), np.int64)
        for r in placed.groupBy("cell").agg(F.max("reach").alias("reach"), F.ceil(F.count("*") / BLOCK).alias("blocks")).collect():
            self.radius[r["cell"]], self.blocks[r["cell"]] = r["reach"], r["blocks"]
        blocks = F.element_at(F.array(*(F.lit(int(b)) for b in self.blocks)), F.col("cell") + 1)
        self.points = placed.drop("reach").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), blocks))

    def asked(self, queries: DataFrame) -> DataFrame:
        """queries(..., x, cell, salt, core, bound), once for every further block where something within `bound` may be, in cell and salt."""
        pivots, radius, blocks = self.pivots, self.radius, self.blocks

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for every in batches:
                for start in range(0, len(every), QUERIES):
                    rows = every.iloc[start : start + QUERIES]
                    near = np.maximum(distances(stacked(rows.x), pivots) - radius, rows.core.to_numpy()[:, None])
                    q, cell = np.nonzero(near <= rows.bound.to_numpy()[:, None] + SLACK)
                    times = blocks[cell]
                    salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    q, cell = np.repeat(q, times), np.repeat(cell, times)
                    other = (cell != rows.cell.to_numpy()[q]) | (salt != rows.salt.to_numpy()[q])
                    yield rows.iloc[q[other]].assign(cell=cell[other].astype(np.int32), salt=salt[other])

        return queries.mapInPandas(visit, queries.schema)

    def search(self, data: DataFrame, queries: DataFrame, answer: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
        """What `answer` says of some queries, the points of a block and their vectors, for each block that is asked. Both sides have the same columns."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block, held, points, x = None, [], None, None
            for rows in batches:
                keys = rows[["cell", "salt", "side"]].to_numpy()
                edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(rows)]
                for a, b in zip(edges, edges[1:]):
                    if a == b:
                        continue
                    if tuple(keys[a, :2]) != block:
                        block, held, points = tuple(keys[a, :2]), [], None
                    if keys[a, 2] == 0:
                        held.append(rows.iloc[a:b])
                    elif held:
                        if points is None:
                            points = pd.concat(held)
                            x = stacked(points.x)
                        for at in range(a, b, QUERIES):
                            yield answer(rows.iloc[at : min(b, at + QUERIES)], points, x)

        both = data.withColumn("side", F.lit(0)).unionByName(queries.withColumn("side", F.lit(1)))
        return both.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "side").mapInPandas(run, schema)


def core_distances(cells: Cells, k: int, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """id and core (the distance within which k points are, itself counted), and the nearest (id, other, d) of every point."""
    points = cells.points.select("id", "x", "weight", "cell", "salt").withColumns({"core": F.lit(0.0), "bound": F.lit(0.0)})

    def nearest(q: pd.DataFrame, p: pd.DataFrame, xp: np.ndarray) -> pd.DataFrame:
        xq, m = stacked(q.x), min(k, len(p))
        d2, off = squares(xq, xp)
        i, j = np.nonzero(d2 <= np.partition(d2, m - 1, axis=1)[:, m - 1, None] + 2 * off)
        d = paired(xq, xp, i, j)
        order = np.lexsort((d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < m
        i, j, d = i[first], j[first], d[first]
        return pd.DataFrame({"id": q.id.to_numpy()[i], "d": d, "other": p.id.to_numpy()[j], "w": p.weight.to_numpy()[j]})

    def merged(found: DataFrame) -> DataFrame:
        lists = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other", "w"))), 1, k).alias("near"))
        within = f"aggregate(near, struct(0L as w, double('infinity') as d), (s, e) -> if(s.w >= {k}, s, struct(s.w + e.w as w, if(s.w + e.w >= {k}, e.d, double('infinity')) as d)), s -> s.d)"
        return lists.withColumn("core", F.expr(within))

    schema = "id long, d double, other long, w long"
    own = cut(merged(cells.search(points, points, nearest, schema)))
    wide = points.drop("bound").join(own.select("id", F.col("core").alias("bound")), "id").select(points.columns)
    more = cells.search(points, cells.asked(wide), nearest, schema)
    every = cut(merged(own.select("id", F.explode("near").alias("n")).select("id", "n.d", "n.other", "n.w").union(more)))
    return every.select("id", "core"), every.select("id", F.explode("near").alias("n")).select("id", "n.other", "n.d").where("id <> other")


def spanning_tree(cells: Cells, core: DataFrame, near: DataFrame, cut: Cut) -> DataFrame:
    """Edges (a, b, w), a < b, of the minimum spanning tree of mutual reachability."""
    points = cut(cells.points.select("id", "x", "cell", "salt").join(core, "id"))
    of_other = core.select(F.col("id").alias("other"), F.col("core").alias("_c"))
    known = cut(near.join(core, "id").join(of_other, "other").select("id", "other", F.greatest("d", "core", "_c").alias("w")))
    member = points.select("id", F.col("id").alias("comp"))
    chosen: list[DataFrame] = []
    best_schema = "comp long, w double, a long, b long, to long"

    def outwards(q: pd.DataFrame, p: pd.DataFrame, xp: np.ndarray) -> pd.DataFrame:
        xq, mine, comp_q, core_q = stacked(q.x), q.id.to_numpy(), q.comp.to_numpy(), q.core.to_numpy()
        limit = q.bound.to_numpy() + SLACK
        ids, comp, core_p = p.id.to_numpy(), p.comp.to_numpy(), p.core.to_numpy()
        w2, off = squares(xq, xp)
        np.maximum(w2, core_p**2, out=w2)
        np.maximum(w2, core_q[:, None] ** 2, out=w2)
        w2[comp_q[:, None] == comp] = np.inf
        with np.errstate(over="ignore"):
            i, j = np.nonzero((w2 <= np.minimum(w2.min(axis=1), limit**2)[:, None] + 2 * off) & np.isfinite(w2))
        w = np.maximum(np.maximum(paired(xq, xp, i, j), core_q[i]), core_p[j])
        i, j, w = i[w <= limit[i]], j[w <= limit[i]], w[w <= limit[i]]
        order = np.lexsort((ids[j], w, i))  # of a query's ties the least id
        order = order[np.unique(i[order], return_index=True)[1]]
        i, j, w = i[order], j[order], w[order]
        found = pd.DataFrame({"comp": comp_q[i], "w": w, "a": np.minimum(mine[i], ids[j]), "b": np.maximum(mine[i], ids[j]), "to": comp[j]})
        return found.sort_values(["comp", "w", "a", "b"]).drop_duplicates("comp")

    def least(found: DataFrame) -> DataFrame:
        return found.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")).select("comp", "e.*")

    for _ in range(points.count().bit_length() + 1):
        placed = cut(points.join(member, "id"))
        member = placed.select("id", "comp")
        to = member.select(F.col("id").alias("other"), F.col("comp").alias("to"))
        listed = known.join(member, "id").join(to, "other").where("comp <> to").select("comp", "w", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "to")
        bounded = lambda bound: placed.join(bound.select("comp", F.col("w").alias("bound")), "comp", "left").fillna(float("inf"), ["bound"]).where(f"core <= bound + {SLACK}").select(*placed.columns, "bound")
        data = placed.withColumn("bound", F.lit(0.0))
        first = least(listed)
        first = cut(least(first.union(cells.search(data, bounded(first), outwards, best_schema))))
        best = cut(least(first.union(cells.search(data, cells.asked(bounded(first)), outwards, best_schema))))
        if best.isEmpty():
            break
        chosen.append(best.select("a", "b", "w"))
        now = joined(best.select(F.col("comp").alias("a"), F.col("to").alias("b")), cut)
        member = member.join(now.withColumnRenamed("node", "comp"), "comp").select("id", F.col("component").alias("comp"))
    else:
        raise RuntimeError("the spanning tree did not close")
    edges = points.select("id", "id", "core").toDF("a", "b", "w").limit(0)
    for part in chosen:
        edges = edges.union(part)
    return edges.distinct()


def dendrogram(edges: DataFrame, leaves: DataFrame, cut: Cut) -> DataFrame:
    """Merges (rank, w, left, right, left_size, right_size) of a tree's edges in the order of their weights.

    Leaves (id, weight) are nodes -1 - id, merges are their ranks.
    """
    size = leaves.select((-1 - F.col("id")).alias("node"), "weight")
    sized = lambda d, c: d.join(size.select(F.col("node").alias(c), F.col("weight").alias(f"{c}_size")), c)
    open_ = ranked(edges, "w", "a", "b").select("rank", "w", (-1 - F.col("a")).alias("u"), (-1 - F.col("b")).alias("v"))
    open_ = cut(sized(sized(open_, "u"), "v").withColumn("tree", F.lit(-1).cast("long")))
    while True:
        large = cut(open_.groupBy("tree").agg(F.count("*").alias("n"), F.expr("percentile(rank, 0.5)").alias("middle")).where(F.col("n") > SUBTREE))
        if large.isEmpty():
            break
        halves = cut(open_.join(F.broadcast(large.select("tree", "middle")), "tree", "left"))
        low, high = halves.where("rank <= middle"), halves.where("rank > middle").drop("middle")
        united = components(low.select(F.col("u").alias("a"), F.col("v").alias("b")), cut=cut)
        low = low.join(united.withColumnRenamed("node", "u"), "u")
        top = low.groupBy("component").agg(F.max("rank").alias("top"))
        each = low.select("component", F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("u_size").alias("s")), F.struct(F.col("v").alias("n"), F.col("v_size").alias("s")))).alias("x")).select("component", "x.*").distinct()
        contracted = cut(each.join(top, "component").join(each.groupBy("component").agg(F.sum("s").alias("whole")), "component").select("n", "top", "whole"))
        for c in ("u", "v"):
            high = high.join(contracted.toDF(c, "_top", "_whole"), c, "left").withColumns({f"{c}_size": F.coalesce("_whole", f"{c}_size"), c: F.coalesce("_top", c)}).drop("_top", "_whole")
        names = ["rank", "w", "u", "v", "u_size", "v_size", "tree"]
        low = low.join(top, "component").drop("tree").withColumnRenamed("top", "tree")
        open_ = cut(halves.where("middle is null").select(names).union(high.select(names)).union(low.select(names)))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}
        top: dict[int, tuple[int, int]] = {}

        def root(n: int) -> int:
            while parent.setdefault(n, n) != n:
                parent[n] = n = parent[parent[n]]
            return n

        out = []
        for rank, w, u, v, us, vs in rows.sort_values("rank")[["rank", "w", "u", "v", "u_size", "v_size"]].itertuples(index=False):
            a, b = root(u), root(v)
            (left, ls), (right, rs) = top.get(a, (u, us)), top.get(b, (v, vs))
            out.append((rank, w, left, right, ls, rs))
            parent[b] = a
            top[a] = (rank, ls + rs)
        return pd.DataFrame(out, columns=["rank", "w", "left", "right", "left_size", "right_size"])

    return open_.groupBy("tree").applyInPandas(merge, "rank long, w double, left long, right long, left_size long, right_size long")


def followed(pointers: DataFrame, cut: Cut, rounds: int = 64) -> DataFrame:
    """(node, up, best) with `up` followed to its end, a node that points at itself, and best the last of those on the way that isn't null."""
    now = cut(pointers)
    if now.count() <= SUBTREE:

        def end(rows: pa.Table) -> pa.Table:
            node, up, best = (rows.column(c).fill_null(0).to_numpy() for c in ("node", "up", "best"))
            known, order = rows.column("best").is_valid().to_numpy(), np.argsort(node)
            at = order[np.searchsorted(node, up, sorter=order)]
            for _ in range(rounds):
                best, known, further = np.where(known[at], best[at], best), known | known[at], at[at]
                if (further == at).all():
                    return pa.table({"node": node, "up": node[at], "best": pa.array(best, mask=~known)})
                at = further
            raise RuntimeError("pointers did not end")

        return cut(in_one(now, end, "node long, up long, best long"))
    for _ in range(rounds):
        above = now.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("best").alias("_best"))
        step = cut(now.join(above, "up").select("node", F.col("_up").alias("up"), F.coalesce("_best", "best").alias("best"), (F.col("_up") != F.col("up")).alias("moved")))
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now
    raise RuntimeError("pointers did not end")


def picked(clusters: DataFrame, cut: Cut) -> DataFrame:
    """(cluster, best) for clusters(cluster, parent, stability): the cluster or the outermost ancestor that is picked, null where none is.

    A cluster is picked over its parts if its stability is at least the sum of theirs; the root never is.
    """
    tree = cut(clusters.join(clusters.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("parts")), "cluster", "left").fillna(0, ["parts"]))
    if tree.count() <= SUBTREE:

        def upwards(rows: pa.Table) -> pa.Table:
            stability, parent, parts = ({k: v for k, v in zip(rows.column("cluster").to_pylist(), rows.column(c).to_pylist(), strict=True)} for c in ("stability", "parent", "parts"))
            ready, sums, value, best = sorted(c for c in parts if not parts[c]), {}, {}, {}
            for c in ready:  # grows as parts are done
                value[c] = max(stability[c], sums.get(c, stability[c]))
                best[c] = c if parent[c] is not None and stability[c] >= sums.get(c, stability[c]) else None
                if (p := parent[c]) in parts:
                    sums[p], parts[p] = sums.get(p, 0.0) + value[c], parts[p] - 1
                    if not parts[p]:
                        ready.append(p)
            return pa.table({"node": pa.array(ready, pa.int64()), "up": pa.array([c if parent[c] is None else parent[c] for c in ready], pa.int64()), "best": pa.array([best[c] for c in ready], pa.int64())})

        return followed(in_one(tree, upwards, "node long, up long, best long"), cut).select(F.col("node").alias("cluster"), "best")
    done = cut(tree.where("parts = 0").select("cluster", "parent", F.col("stability").alias("value"), F.lit(True).alias("own")))
    fresh = done
    while not fresh.isEmpty():
        sums = done.groupBy(F.col("parent").alias("cluster")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
        ready = tree.join(sums, "cluster").where("n = parts").join(done.select("cluster"), "cluster", "left_anti")
        fresh = cut(ready.select("cluster", "parent", F.greatest("stability", "s").alias("value"), (F.col("stability") >= F.col("s")).alias("own")))
        done = cut(done.union(fresh))
    mine = F.when(F.col("own") & F.col("parent").isNotNull(), F.col("cluster"))
    return followed(done.select(F.col("cluster").alias("node"), F.coalesce("parent", "cluster").alias("up"), mine.alias("best")), cut).select(F.col("node").alias("cluster"), "best")


def condensed(merges: DataFrame, leaves: DataFrame, core: DataFrame, least: int, cut: Cut) -> DataFrame:
    """(id, cluster) of every leaf: the picked cluster that it falls out of, or null."""
    density = lambda w: 1.0 / F.greatest(w, F.lit(NEAREST))
    side = lambda s: F.struct(F.col(s).alias("node"), F.col(f"{s}_size").alias("size"))
    split = (F.col("left_size") >= least) & (F.col("right_size") >= least)
    child = merges.select(F.explode(F.array(side("left"), side("right"))).alias("c"), F.col("rank").alias("parent"), density(F.col("w")).alias("at"), split.alias("split"), (F.col("left_size") + F.col("right_size")).alias("parent_size"))
    child = child.select("c.*", "parent", "at", "split", "parent_size")
    every = merges.select(F.col("rank").alias("node"), (F.col("left_size") + F.col("right_size")).alias("size")).union(leaves.select((-1 - F.col("id")).alias("node"), F.col("weight").alias("size")))
    nodes = cut(every.join(child.drop("size"), "node", "left"))
    starts = (F.col("size") >= least) & (F.coalesce("split", F.lit(True)))
    up = followed(nodes.select("node", F.when(starts | F.col("parent").isNull(), F.col("node")).otherwise(F.col("parent")).alias("up"), F.lit(None).cast("long").alias("best")), cut).select("node", F.col("up").alias("cluster"))
    of_parent = up.select(F.col("node").alias("parent"), F.col("cluster").alias("parent_cluster"))
    placed = cut(nodes.join(up, "node").join(of_parent, "parent", "left").withColumn("starts", starts))
    falls = placed.where(f"size < {least} and parent_size >= {least}").select(F.col("parent_cluster").alias("cluster"), "size", "at")
    heavy = placed.where(f"node < 0 and size >= {least}").join(core.select((-1 - F.col("id")).alias("node"), "core"), "node").select("cluster", "size", density(F.col("core")).alias("at"))
    parts = placed.where("starts and parent is not null").select(F.col("parent_cluster").alias("cluster"), "size", "at")
    born = placed.where("starts").select("cluster", F.col("parent_cluster").alias("up"), F.coalesce("at", F.lit(0.0)).alias("birth"))
    mass = falls.union(heavy).union(parts).groupBy("cluster").agg(F.sum(F.col("size") * F.col("at")).alias("m"), F.sum("size").alias("n"))
    clusters = cut(born.join(mass, "cluster").select("cluster", F.col("up").alias("parent"), (F.col("m") - F.col("birth") * F.col("n")).alias("stability")))
    leaf = placed.where("node < 0").select((-1 - F.col("node")).alias("id"), "cluster")
    return leaf.join(picked(clusters, cut), "cluster", "left").select("id", F.col("best").alias("cluster"))


def hdbscan(vectors: DataFrame, least: int = 5) -> DataFrame:
    """(id, cluster) of vectors(id long, x array<float>): clusters of `least` vectors or more, named by their least id; null is noise.

    Ids are unique; vectors without values are noise. An empty table gives no rows, and fewer than `least` vectors are
    all noise. Equal vectors count as NEAREST apart.
    """
    scratch = Scratch(vectors.sparkSession)
    cut = scratch.cut
    full = vectors.where("id is not null and x is not null")
    distinct = cut(full.groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    if (distinct.agg(F.sum("weight").alias("n")).first()["n"] or 0) < least:
        return vectors.select("id", F.lit(None).cast("long").alias("cluster"))
    cells = Cells(distinct.select("id", "x", "weight"), cut)
    core, near = core_distances(cells, least, cut)
    leaves = distinct.select("id", "weight")
    found = condensed(cut(dendrogram(spanning_tree(cells, core, near, cut), leaves, cut)), leaves, core, least, cut).where("cluster is not null")
    named = cut(found.join(distinct.select("id", "x"), "id"))
    named = named.join(named.groupBy("cluster").agg(F.min("id").alias("name")), "cluster").select("x", F.col("name").alias("cluster"))
    return scratch.end(vectors.join(cut(named), "x", "left").select("id", "cluster"))


def merge_near(centroids: DataFrame, cosine: float = 0.5) -> DataFrame:
    """(cluster, merged) for centroids(cluster long, x array<double>): the least cluster of those that cosines of at least this much connect.

    Unit vectors of that cosine lie within sqrt(2 - 2 cosine), so the search goes to the cells within this distance.
    In a block a query names one cluster of each component that it meets, not all of its neighbours.
    """
    ship(centroids.sparkSession)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    unit = centroids.withColumn("_n", norm).select(F.col("cluster").alias("id"), F.transform("x", lambda v: F.when(F.col("_n") > 0, v / F.col("_n")).otherwise(v)).alias("x"))
    scratch = Scratch(centroids.sparkSession)
    cells = Cells(scratch.cut(unit), scratch.cut)
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    points = cells.points.withColumns({"core": F.lit(0.0), "bound": F.lit(reach)})

    def meets(q: pd.DataFrame, p: pd.DataFrame, xp: np.ndarray) -> pd.DataFrame:
        xq, ids = stacked(q.x), p.id.to_numpy()
        near = xq @ xp.T >= cosine - 1e-12
        parent = list(range(len(ids)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        out = []
        for row, mine in zip(near, q.id.to_numpy(), strict=True):
            met = {}
            for i in np.flatnonzero(row & (ids != mine)):
                met.setdefault(root(int(i)), int(i))
            out += [(mine, ids[i]) for i in met.values()]
            roots = list(met)
            for r in roots[1:]:  # this query joins them
                parent[r] = roots[0]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    links = cells.search(points, points, meets, "a long, b long").union(cells.search(points, cells.asked(points), meets, "a long, b long"))
    united = joined(links, scratch.cut)
    return scratch.end(centroids.join(united.withColumnRenamed("node", "cluster"), "cluster", "left").select("cluster", F.coalesce("component", "cluster").alias("merged")))


def face_clusters(dets: DataFrame, least: int = 5, score: float = 0.5, cosine: float = 0.5) -> DataFrame:
    """E-20: det_id and cluster_id of dets(det_id long, embedding array<float>, det_score): HDBSCAN over the detections of at least
    this score, clusters of near centroids united, numbered from 0 by falling size (then least det_id); -1 is noise.

    Detections that appear twice count once. The reference's numbers follow its own union order; ours don't depend on any.
    """
    scratch = Scratch(dets.sparkSession)
    cut = scratch.cut
    once = cut(dets.groupBy("det_id").agg(F.min_by("embedding", "det_score").alias("x"), F.max("det_score").alias("det_score")))
    found = cut(hdbscan(once.where(F.col("det_score") >= score).select(F.col("det_id").alias("id"), "x"), least).where("cluster is not null"))
    members = found.join(once.select(F.col("det_id").alias("id"), "x"), "id")
    each = members.select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    centroids = cut(each.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("x")))
    united = found.join(merge_near(centroids, cosine), "cluster").select(F.col("id").alias("det_id"), "merged")
    sizes = united.groupBy("merged").agg(F.count("*").alias("n"), F.min("det_id").alias("least_id"))
    numbers = ranked(sizes, F.col("n").desc(), F.col("least_id"), name="cluster_id").select("merged", "cluster_id")
    return scratch.end(once.select("det_id").join(united.join(numbers, "merged").select("det_id", "cluster_id"), "det_id", "left").fillna(-1, ["cluster_id"]))


def cluster_report(dets: DataFrame, clusters: DataFrame, exemplars: int = 9) -> DataFrame:
    """Of each cluster the number of detections, the best `exemplars` of them by score, and their photos."""
    rows = clusters.where("cluster_id >= 0").join(dets.select("det_id", "photo_id", "det_score").dropDuplicates(["det_id"]), "det_id")
    best = F.struct((-F.col("det_score")).alias("s"), "det_id", "photo_id")
    parts = rows.groupBy("cluster_id", F.pmod(F.xxhash64("det_id"), F.lit(64)).alias("part")).agg(F.count("*").alias("n"), F.min_by("det_id", best).alias("_"), F.slice(F.array_sort(F.collect_list(best)), 1, exemplars).alias("top"))
    whole = parts.groupBy("cluster_id").agg(F.sum("n").alias("n_faces"), F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, exemplars).alias("top"))
    text = lambda c: F.array_join(F.transform("top", lambda e: e[c].cast("string")), ",")
    return whole.select("cluster_id", "n_faces", text("det_id").alias("exemplar_dets"), text("photo_id").alias("exemplar_photos"))
