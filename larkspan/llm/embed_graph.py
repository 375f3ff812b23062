"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one node. Nodes are dealt to the shards of their nearest centroids, two or more each, so shards
overlap. There are as many shards as keep their mean size, whatever the number of rows: beyond what one set of centroids
can make, further sets divide the residuals. In each shard every node gets robustly pruned edges to near nodes; the lists of all shards are united. In each
shard all its nodes then search the united graph: greedily from the medoid, and from every node found in range on
through all nodes in range. Pairs are verified by their cosine in double precision. Recall is audited against brute
force for a sample of nodes; if it is too low, the shards overlap more and all is done again.

A shard of more than `cap` nodes is split, and each two of its parts meet in a unit. A pair that meets in several
shards counts in the first of them only, so links are counted without writing down pairs, and a unit gives a
spanning forest of its links. Centroids are learned from a bounded sample; all rows are indexed.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of another length
do not link. Repeated rows are copies that link with each other. An empty table gives an empty table. Columns other than the id
and the vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .graph import components

THRESHOLD, SLACK = 0.95, 0.05
#: Nodes of a shard on average and at most; shards of a node; edges of a node; nodes kept in a search.
MEAN, CAP, OVERLAP, DEGREE, BEAM = 600, 2000, 3, 20, 24
#: Nodes that centroids are learned from, and centroids of a level, at most; nodes audited at most.
SAMPLE, CENTROIDS, AUDIT = 20_000, 4096, 200
#: Pruning: an edge is left out if a nearer neighbour is nearer to its end by this factor.
ALPHA = 1.2


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means with a fixed start."""
    rng = np.random.default_rng(5)
    c = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(norm > 0, new / np.maximum(norm, 1e-300), c)
    return c


def means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Plain k-means with a fixed start."""
    rng = np.random.default_rng(6)
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        own = np.concatenate([_farness(x[i : i + 1024], c).argmin(axis=1) for i in range(0, len(x), 1024)])
        n = np.bincount(own, minlength=k)
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
    return c


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """The pruned out-edges of each row of unit vectors, with those back added up to twice the degree."""
    n = len(x)
    wide = min(n - 1, 2 * degree)
    edges: list[list[int]] = [[] for _ in range(n)]
    for i in range(0, n, 512):
        sims = x[i : i + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -2
        near = np.argpartition(-sims, wide - 1, axis=1)[:, :wide] if wide else np.zeros((len(sims), 0), int)
        for r, row in enumerate(near):
            row = row[np.argsort(-sims[r, row], kind="stable")]
            far = np.sqrt(np.maximum(0, 2 - 2 * sims[r, row]))
            between = np.sqrt(np.maximum(0, 2 - 2 * (x[row] @ x[row].T)))
            alive = np.ones(len(row), bool)
            kept: list[int] = []
            for j in range(len(row)):
                if alive[j]:
                    kept.append(int(row[j]))
                    if len(kept) == degree:
                        break
                    alive &= alpha * between[j] > far
            edges[i + r] = kept
    out = [list(e) for e in edges]
    for a, e in enumerate(edges):
        for b in e:
            if len(out[b]) < 2 * degree and a not in out[b]:
                out[b].append(a)
    return [np.array(e, np.int64) for e in out]


def range_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entry: int, reach: float, beam: int = BEAM) -> np.ndarray:
    """Greedy search from entry, then expansion through all nodes in range. edges: rows of numbers, -1 for none.
    Returns a matrix: query by node, true where seen with cosine of at least reach."""
    n, q = len(x), len(queries)
    seen, hit = np.zeros((q, n + 1), bool), np.zeros((q, n), bool)
    ids = np.full((q, beam), n)
    sims = np.full((q, beam), -np.inf)
    done = np.ones((q, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, x[queries] @ x[entry], False
    seen[:, entry] = seen[:, n] = True
    rows = np.arange(q)
    while len(rows):
        best = np.argmax(np.where(done[rows], -np.inf, sims[rows]), axis=1)
        at = ids[rows, best]
        done[rows, best] = True
        near = edges[at]
        fresh = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        s = np.where(fresh, np.einsum("ij,ikj->ik", x[queries[rows]], x[np.minimum(near, n - 1)]), -np.inf)
        all_ids, all_sims = np.concatenate([ids[rows], near], 1), np.concatenate([sims[rows], s], 1)
        all_done = np.concatenate([done[rows], ~fresh], 1)
        # All that was seen in range is kept for the expansion, in the beam or not.
        r, c = np.nonzero(s >= reach)
        hit[rows[r], near[r, c]] = True
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[rows], sims[rows], done[rows] = (np.take_along_axis(m, top, 1) for m in (all_ids, all_sims, all_done))
        rows = rows[(~done[rows] & (sims[rows] > -np.inf)).any(axis=1)]
    hit[np.arange(q), entry] |= x[queries] @ x[entry] >= reach
    hit[np.arange(q), queries] = True
    front = np.stack(np.nonzero(hit), 1)
    while len(front):
        new = []
        for i in range(0, len(front), 65536):
            f = front[i : i + 65536]
            near = edges[f[:, 1]]
            pair = np.stack([np.repeat(f[:, 0], near.shape[1]), near.ravel()], 1)
            pair = pair[(pair[:, 1] < n)]
            pair = pair[~hit[pair[:, 0], pair[:, 1]]]
            if not len(pair):
                continue
            code = np.unique(pair[:, 0] * n + pair[:, 1])
            a, b = code // n, code % n
            ok = np.concatenate([np.einsum("ij,ij->i", x[queries[a[j : j + 65536]]], x[b[j : j + 65536]]) for j in range(0, len(a), 65536)]) >= reach
            hit[a[ok], b[ok]] = True
            new.append(np.stack([a[ok], b[ok]], 1))
        front = np.concatenate(new) if new else np.zeros((0, 2), np.int64)
    return hit


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    at = np.asarray(column.offsets)
    return np.split(column.flatten().to_numpy(zero_copy_only=False), (at - at[0])[1:-1])


UNIT = ["shard", "part_a", "part_b"]


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("node")
    nodes, x = table["node"].to_numpy(), _matrix(table["unit"])
    edges = robust_prune(x) if len(x) > 1 else [np.zeros(0, np.int64)]
    return pa.table({"node": pa.array(nodes), "near": pa.array([nodes[e] for e in edges], pa.list_(pa.int64()))})


def _search(table: pa.Table, threshold: float, slack: float, beam: int) -> pa.Table:
    """Links of a unit; by the graph if the table has it, else by all pairs."""
    table = table.sort_by("node")
    nodes, x, size = table["node"].to_numpy(), _matrix(table["unit"]), table["copies"].to_numpy()
    homes, part = _matrix(table["homes"]).astype(np.int64), table["part"].to_numpy()
    shard, a, b = (table[c][0].as_py() for c in UNIT)
    n = len(nodes)
    found = np.zeros((n, n), bool)
    if "near" in table.column_names:
        inside = []
        for e in _lists(table["near"]):
            at = np.searchsorted(nodes, e)
            at[at == n] = 0
            inside.append(at[nodes[at] == e])
        edges = np.full((n, max(1, max(map(len, inside)))), n)
        for i, e in enumerate(inside):
            edges[i, : len(e)] = e
        medoid = int(np.argmax(x @ x.mean(axis=0)))
        for i in range(0, n, 512):
            found[i : i + 512] = range_search(x, edges, np.arange(i, min(n, i + 512)), medoid, threshold - slack, beam)
    else:
        for i in range(0, n, 512):
            found[i : i + 512] = x[i : i + 512] @ x.T >= threshold - 1e-9
    found |= found.T
    np.fill_diagonal(found, False)
    p, q = np.nonzero(np.triu(found))
    ok = np.concatenate([np.einsum("ij,ij->i", x[p[i : i + (1 << 16)]], x[q[i : i + (1 << 16)]]) >= threshold for i in range(0, len(p), 1 << 16)]) if len(p) else np.zeros(0, bool)
    p, q = p[ok], q[ok]
    links = np.zeros((n, n), bool)
    links[p, q] = links[q, p] = True
    own = np.zeros(len(p), bool)
    for i in range(0, len(p), 1 << 16):
        h, g = homes[p[i : i + (1 << 16)]], homes[q[i : i + (1 << 16)]]
        if "near" in table.column_names:
            own[i : i + (1 << 16)] = np.where((h[:, :, None] == g[:, None, :]).any(axis=2), h, np.iinfo(np.int64).max).min(axis=1) == shard
        else:
            own[i : i + (1 << 16)] = np.minimum(h[:, 0], g[:, 0]) == shard
    if a != b:
        own &= part[p] != part[q]
    p, q = p[own], q[own]
    count = np.bincount(p, size[q], n).astype(np.int64) + np.bincount(q, size[p], n).astype(np.int64)
    tree: list[tuple[int, int]] = []
    left = links.any(axis=1)
    while left.any():
        todo = [int(np.argmax(left))]
        left[todo[0]] = False
        while todo:
            u = todo.pop()
            new = np.flatnonzero(links[u] & left)
            left[new] = False
            tree += [(u, int(v)) for v in new]
            todo.extend(new.tolist())
    some = np.flatnonzero(count)
    t = np.array(tree, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(np.concatenate([nodes[some], nodes[t[:, 0]]])), "n": pa.array(np.concatenate([count[some], np.zeros(len(t), np.int64)])), "b": pa.array([None] * len(some) + nodes[t[:, 1]].tolist(), pa.int64())})


def _sample(nodes: DataFrame, count: int) -> np.ndarray:
    place = (F.xxhash64("node", F.lit("centroid")) % 1_000_000 + 1_000_000) % 1_000_000 / 1e6
    return np.array([r["unit"] for r in nodes.where(place < min(1.0, SAMPLE / count)).orderBy("node").select("unit").collect()])


def _learned(nodes: DataFrame, count: int, overlap: int) -> np.ndarray:
    """Centroids of a sample of the nodes."""
    x = _sample(nodes, count)
    k = max(1, min(CENTROIDS, count * overlap // MEAN, len(x) // 4))
    return centroids(x, k) if len(x) else np.zeros((1, 1))


def codebooks(x: np.ndarray, cells: int) -> list[np.ndarray]:
    """Centroids in levels: each further level divides the residuals that the ones before leave, alike in all their cells.
    A level has at most CENTROIDS and a quarter of the sample, so few centroids make as many cells as are wanted."""
    books: list[np.ndarray] = []
    most = max(2, min(CENTROIDS, len(x) // 4))
    rest = x
    while cells > 1 or not books:
        k = max(1, min(cells, most))
        book = centroids(rest, k) if not books else means(rest, k)
        books.append(book)
        near = np.concatenate([_farness(rest[i : i + 1024], book).argmin(axis=1) for i in range(0, len(rest), 1024)])
        rest = rest - book[near]
        cells = -(-cells // max(2, k))
    return books


def _farness(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, less the rows' own squares."""
    return (book**2).sum(axis=1) - 2 * (x @ book.T)


def cells_of(v: np.ndarray, books: list[np.ndarray], wide: int) -> np.ndarray:
    """The numbers of the `wide` cells found nearest to each row, by a search that keeps as many at each level; sorted."""
    out = []
    for i in range(0, len(v), 256):
        x = v[i : i + 256]
        rest, cell = x[:, None, :], np.zeros((len(x), 1), np.int64)
        for book in books:
            far = (rest**2).sum(axis=2)[:, :, None] + _farness(rest.reshape(-1, rest.shape[2]), book).reshape(len(x), rest.shape[1], -1)
            far = far.reshape(len(x), -1)
            n = min(wide, far.shape[1])
            best = np.argpartition(far, n - 1, axis=1)[:, :n]
            old, new = best // len(book), best % len(book)
            cell = np.take_along_axis(cell, old, 1) * len(book) + new
            rest = np.take_along_axis(rest, old[:, :, None], 1) - book[new]
        out.append(np.sort(cell, axis=1))
    return np.concatenate(out)


def _units(each: DataFrame) -> DataFrame:
    """shard, part_a, part_b, part, node, unit, copies, homes, of rows with a shard: each node in each unit that it belongs to."""
    parts = each.groupBy("shard").count().select("shard", F.ceil(F.col("count") / CAP).cast("int").alias("parts"))
    # A row a shard, of which there is one for some hundreds of nodes; Spark broadcasts them if they are few.
    each = each.join(parts, "shard").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).otherwise(0))
    other = F.explode(F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0))))
    each = each.withColumn("other", other)
    return each.select("shard", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "part", "node", "unit", "copies", "homes")


def _index(spark: SparkSession, nodes: DataFrame, count: int, overlap: int) -> DataFrame:
    """The units of nodes that are dealt to the shards of their nearest centroids, in as many levels as keep shards small."""
    x = _sample(nodes, count)
    books = codebooks(x, max(1, count * overlap // MEAN)) if len(x) else [np.zeros((1, 1))]
    wide = min(overlap, math.prod(map(len, books)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            top = cells_of(v, books, wide) if v.shape[1] == books[0].shape[1] else np.zeros((len(v), wide), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top.tolist(), pa.list_(pa.int64()))], names=["node", "unit", "copies", "homes"])

    homes = C.scratch(nodes.mapInArrow(assign, "node long, unit array<double>, copies long, homes array<long>"), "homes")
    return _units(homes.withColumn("shard", F.explode("homes")))


def merged(c: np.ndarray, angle: float) -> np.ndarray:
    """A number for each centroid; those that a chain of steps of at most angle joins have the same."""
    unit = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    close = unit @ unit.T >= math.cos(angle)
    of = np.full(len(c), -1)
    for i in range(len(c)):
        if of[i] < 0:
            of[i], todo = i, [i]
            while todo:
                new = np.flatnonzero(close[todo.pop()] & (of < 0))
                of[new] = i
                todo.extend(new.tolist())
    return of


def _index_exact(spark: SparkSession, nodes: DataFrame, count: int, overlap: int, threshold: float) -> DataFrame:
    """Units in which every pair of at least the threshold meets; homes holds a node's own shard only.

    A node's own shard is that of its nearest centroid. By the triangle inequality of angles, a node within the
    threshold's angle t of one that has centroid c for its nearest is within its own nearest centroid's angle + 2t of
    c, and within the radius of c's nodes + t. It is a guest in all such shards of a lower number than its own, and a
    pair counts in the lower of its own shards. Centroids of a crowded region are one shard, so guests are few there."""
    c = _learned(nodes, count, overlap)
    c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    angle = math.acos(max(-1.0, min(1.0, threshold)))
    shard_of = merged(c, angle)

    def nearest(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        angles = np.arccos(np.clip(v @ c.T, -1, 1))
        return angles, np.argmin(angles, axis=1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius = np.full(len(c), -np.inf)
        for batch in batches:
            if batch.num_rows:
                angles, own = nearest(_matrix(batch.column(0)))
                np.maximum.at(radius, own, angles[np.arange(len(own)), own])
        some = np.flatnonzero(np.isfinite(radius))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(radius[some])], names=["c", "r"])

    radius = np.full(len(c), -np.inf)
    for r in nodes.select("unit").mapInArrow(measure, "c long, r double").groupBy("c").agg(F.max("r").alias("r")).collect():
        radius[r["c"]] = r["r"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            angles, own = nearest(_matrix(batch.column(1)))
            # 1e-6: angles near 0 are that uncertain.
            most = np.minimum(angles[np.arange(len(own)), own, None] + 2 * angle, radius[None, :] + angle) + 1e-6
            home = shard_of[own]
            shards = [np.unique(np.append(g[g < h], h)).tolist() for g, h in ((shard_of[near], h) for near, h in zip(angles <= most, home, strict=True))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[h] for h in home.tolist()], pa.list_(pa.int64())), pa.array(shards, pa.list_(pa.int64()))], names=["node", "unit", "copies", "homes", "shards"])

    homes = C.scratch(nodes.mapInArrow(assign, "node long, unit array<double>, copies long, homes array<long>, shards array<long>"), "homes")
    return _units(homes.withColumn("shard", F.explode("shards")).drop("shards"))


def _linked(spark: SparkSession, nodes: DataFrame, count: int, overlap: int, threshold: float) -> DataFrame:
    units = _index(spark, nodes, count, overlap)
    built = units.select(*UNIT, "node", "unit").groupBy(*UNIT).applyInArrow(_build, "node long, near array<long>")
    united = C.scratch(built.select("node", F.explode("near").alias("to")).distinct().groupBy("node").agg(F.collect_list("to").alias("near")), "graph")
    whole = units.join(united, "node", "left").withColumn("near", F.coalesce("near", F.array().cast("array<long>")))
    return C.scratch(whole.groupBy(*UNIT).applyInArrow(lambda t: _search(t, threshold, SLACK, BEAM), "a long, n long, b long"), "links")


def _linked_exact(spark: SparkSession, nodes: DataFrame, count: int, overlap: int, threshold: float) -> DataFrame:
    units = _index_exact(spark, nodes, count, overlap, threshold)
    return C.scratch(units.groupBy(*UNIT).applyInArrow(lambda t: _search(t, threshold, SLACK, BEAM), "a long, n long, b long"), "links")


def audit(spark: SparkSession, nodes: DataFrame, count: int, links: DataFrame, threshold: float = THRESHOLD, most: int = AUDIT) -> tuple[int, int]:
    """Links found and links that there are, of a sample of at most about `most` nodes, by brute force over all nodes."""
    place = (F.xxhash64("node", F.lit("audit")) % 1_000_000 + 1_000_000) % 1_000_000 / 1e6
    sample = {r["node"]: r["unit"] for r in nodes.where(place < min(1.0, most / max(1, count))).select("node", "unit").collect()}
    if not sample:
        return 0, 0
    ids = np.array(sorted(sample))
    q = np.array([sample[i] for i in ids])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows and (x := _matrix(batch.column(1))).shape[1] == q.shape[1]:
                near = (x @ q.T >= threshold) & (batch.column(0).to_numpy()[:, None] != ids[None, :])
                total += (near * batch.column(2).to_numpy()[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "n"])

    there = nodes.mapInArrow(brute, "node long, n long").agg(F.sum("n")).first()[0] or 0
    found = links.where(F.col("n") > 0).join(F.broadcast(spark.createDataFrame([(int(i),) for i in ids], "a long")), "a").agg(F.sum("n")).first()[0] or 0
    return found, there


def near_duplicates(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, overlap: int = OVERLAP, recall: float = 0.95) -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id, kept."""
    C.arrow_limits(spark)
    v = F.col(vector_col).cast("array<double>")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    large = F.array_max(F.transform("v", F.abs))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))) & (large > 0)
    base = C.scratch(base.withColumn("v", F.when(fine, F.transform("v", lambda y: y / large))), "vectors")
    equal = base.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    equal = C.scratch(equal.withColumn("node", F.monotonically_increasing_id()), "equal")
    lengths = equal.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()
    found = []
    for r in lengths:
        nodes = equal.where(F.size("v") == r["n"]).select("node", F.transform("v", lambda y: y / norm).alias("unit"), "copies")
        nodes = C.scratch(nodes, "nodes")
        wide = overlap
        while True:
            links = _linked(spark, nodes, r["count"], wide, threshold)
            got, there = audit(spark, nodes, r["count"], links, threshold)
            if got >= recall * there:
                break
            if wide >= 4 * overlap:
                links = _linked_exact(spark, nodes, r["count"], overlap, threshold)
                got, there = audit(spark, nodes, r["count"], links, threshold)
                if got < recall * there:
                    raise RuntimeError(f"vectors of length {r['n']}: {got} of {there} audited links found, {recall} wanted")
                break
            wide *= 2
        found.append(links)
    if not found:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    counts = C.scratch(links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), "counts")
    named = equal.select("node", "rep")
    roots = C.scratch(components(links.where("b IS NOT NULL").select("a", "b")).join(named, "node"), "roots")
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = C.scratch(roots.select("node", "root").join(least, "root").select("node", "component_id"), "of")
    whole = equal.join(counts, "node", "left").join(of, "node", "left")
    whole = C.scratch(whole.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "whole")
    linked = base.where("v IS NOT NULL").join(whole, "v").select("vec_id", "n_links", "component_id")
    alone = base.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
