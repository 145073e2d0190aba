"""The k most similar vectors of every vector, by learned partitions with multi-probe routing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwise.session import persist_table


@dataclass(frozen=True)
class Params:
    """``sample``: most vectors the root of the tree is fitted on, ``inner``: most that any other node is fitted on (the
    only bounded parts; every row is indexed and queried). ``cell``: wished vectors per cell; the number of cells grows
    with the rows, without an upper bound. ``fan``: most parts of one node, from which the depth of the tree follows.
    ``probes``: cells a vector is compared with, ``beam``: parts of the root followed to find them. ``block``,
    ``queries``: most index rows and queries of one task unit."""

    k: int = 3
    dim: int = 64
    sample: int = 16384
    inner: int = 8192
    cell: int = 1500
    fan: int = 256
    probes: int = 5
    beam: int = 10
    graph: int = 10
    block: int = 8192
    queries: int = 32768
    seed: int = 11


def neighbour_graph(x: np.ndarray, k: int, step: int = 1024) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), step):
        s = x[i : i + step] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i : i + step] = np.argpartition(-s, k, axis=1)[:, :k]
    return out


def balanced_partition(graph: np.ndarray, parts: int, rng, rounds: int = 15) -> np.ndarray:
    """Equal parts of the graph by recursive bisection: smooth random values along the edges, split at the median."""
    n, k = graph.shape
    src, dst = np.repeat(np.arange(n), k), graph.ravel()
    label = np.zeros(n, np.int64)
    have = 1
    while have < parts:
        same = label[src] == label[dst]
        a, b = src[same], dst[same]
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1.0
        y = rng.standard_normal(n)
        for _ in range(rounds):
            y = (np.bincount(a, y[b], n) + np.bincount(b, y[a], n) + y) / degree
            y -= (np.bincount(label, y, have) / np.maximum(np.bincount(label, minlength=have), 1))[label]
            y /= np.sqrt(np.bincount(label, y * y, have) + 1e-12)[label]
        order = np.lexsort((y, label))
        sizes = np.bincount(label, minlength=have)
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        upper = np.empty(n, bool)
        upper[order] = place >= np.repeat(sizes // 2, sizes)
        label = label * 2 + upper
        have *= 2
    return label


def fit(x: np.ndarray, cells: int, p: Params, epochs: int = 10, rate: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights ``(dim, cells)`` and biases of a softmax classifier that tells a vector's part of the neighbour graph.

    Targets are soft: half the own part, half the parts of the neighbours. At the end the biases are shifted until the
    sample falls about evenly into the cells, which keeps the partition balanced for vectors not seen.
    """
    rng = np.random.default_rng(p.seed)
    if cells <= 1 or len(x) <= p.graph + 1:
        return np.zeros((x.shape[1], 1), np.float32), np.zeros(1, np.float32)
    graph = neighbour_graph(x, p.graph)
    label = balanced_partition(graph, cells, rng)
    near = label[graph]
    w = np.zeros((x.shape[1], cells), np.float32)
    np.add.at(w.T, label, x)
    w /= np.maximum(np.linalg.norm(w, axis=0), 1e-6)
    w *= 8
    b = np.zeros(cells, np.float32)
    for e in range(epochs):
        order = rng.permutation(len(x))
        lr = rate * (1 - e / epochs)
        for i in range(0, len(x), 512):
            at = order[i : i + 512]
            z = x[at] @ w + b
            z -= z.max(1, keepdims=True)
            q = np.exp(z)
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(at)), label[at]] -= 0.5
            np.add.at(q, (np.repeat(np.arange(len(at)), p.graph), near[at].ravel()), -0.5 / p.graph)
            w -= (lr / len(at)) * (x[at].T @ q) * 8
            b -= (lr / len(at)) * q.sum(0)
    for _ in range(60):
        share = np.bincount((x @ w + b).argmax(1), minlength=cells) * cells / len(x)
        b -= 0.08 * (np.minimum(share, 4) - 1).astype(np.float32)
    return w, b


def power(n: float) -> int:
    """Largest power of two that is at most ``n``, at least 1."""
    return 1 << (max(1, int(n)).bit_length() - 1)


def fans(rows: int, p: Params) -> list[int]:
    """Parts per node of each level: as many levels of at most ``p.fan`` as it takes for cells of about ``p.cell`` rows."""
    bits, most = power(rows / p.cell).bit_length() - 1, power(p.fan).bit_length() - 1
    levels = max(1, -(-bits // max(1, most)))
    return [1 << (bits // levels + (i < bits % levels)) for i in range(levels)]


def log_shares(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithms of the probabilities a classifier gives the parts."""
    z = x @ w + b
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def highest(z: np.ndarray, m: int) -> np.ndarray:
    """Positions of the ``m`` highest entries of each row, highest first."""
    if m >= z.shape[1]:
        return np.argsort(-z, axis=1, kind="stable")
    top = np.argpartition(-z, m, axis=1)[:, :m]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(z, top, 1), axis=1, kind="stable"), 1)


def route(x: np.ndarray, root: tuple, inner: dict[int, tuple], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The ``p.probes`` most probable cells of each row, most probable first, and the logarithms of their probabilities.

    With ``inner`` nodes the ``p.beam`` most probable parts of the root are followed and the products of both
    probabilities compared; a cell is then ``part * p.fan + child``. Places without a cell hold -1.
    """
    z = log_shares(x, *root)
    if not inner:
        top = highest(z, p.probes)
        return top.astype(np.int64), np.take_along_axis(z, top, 1)
    first = highest(z, p.beam)
    width = first.shape[1]
    cells = np.full((len(x), width * p.probes), -1, np.int64)
    logs = np.full(cells.shape, -np.inf, np.float32)
    for part in np.unique(first).tolist():
        at, slot = np.nonzero(first == part)
        own = z[at, part][:, None]
        z2 = own + log_shares(x[at], *inner[part]) if part in inner else own
        top = highest(z2, p.probes)
        to = slot[:, None] * p.probes + np.arange(top.shape[1])
        cells[at[:, None], to] = part * p.fan + top
        logs[at[:, None], to] = np.take_along_axis(z2, top, 1)
    order = highest(logs, p.probes)
    return np.take_along_axis(cells, order, 1), np.take_along_axis(logs, order, 1)


def usable(df: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """Rows with an id and a vector of ``dim`` finite entries (no nulls) that are not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of a list column as rows of unit length; the lists are all ``dim`` long and free of nulls."""
    x = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def unpack(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def best(queries: np.ndarray, own: np.ndarray, index: np.ndarray, k: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Positions and similarities of the ``k`` most similar index rows; ``own`` is the row to leave out or -1."""
    k = min(k, len(index))
    pos, sim = np.empty((len(queries), k), np.int64), np.empty((len(queries), k), np.float32)
    turned = np.ascontiguousarray(index.T)
    for i in range(0, len(queries), step):
        s = queries[i : i + step] @ turned
        rows = np.arange(len(s))
        o = own[i : i + step]
        s[rows[o >= 0], o[o >= 0]] = -2
        for j in range(k):
            at = s.argmax(1)
            pos[i : i + step, j], sim[i : i + step, j] = at, s[rows, at]
            s[rows, at] = -3
    return pos, sim


def compare_unit(key, left: pa.Table, right: pa.Table, p: Params) -> pa.Table:
    """One unit of work: queries of a cell against one block of its index; both sides are bounded."""
    schema = pa.schema([("vid", pa.int64()), ("nvid", pa.int64()), ("sim", pa.float32())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    vids, first = np.unique(right["ivid"].to_numpy(), return_index=True)
    index = unpack(right["ivec"], p.dim)[first]
    q, qfirst = np.unique(left["vid"].to_numpy(), return_index=True)
    queries = unpack(left["vec"], p.dim)[qfirst]
    at = np.minimum(np.searchsorted(vids, q), len(vids) - 1)
    pos, sim = best(queries, np.where(vids[at] == q, at, -1), index, p.k)
    keep = sim.ravel() > -1.5
    return pa.table({"vid": np.repeat(q, pos.shape[1])[keep], "nvid": vids[pos.ravel()][keep], "sim": sim.ravel()[keep]}, schema=schema)


def fit_part(vectors: list[bytes], rows: float, fan: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Model of one node, which stands for about ``rows`` rows, from at most ``p.inner`` of its vectors."""
    x = np.frombuffer(b"".join(sorted(set(vectors), key=xxhash.xxh3_64_intdigest)[: p.inner]), np.float32).reshape(-1, p.dim)
    return fit(x, min(fan, power(rows / p.cell), power(len(x) / 8)), p)


MODEL = "cell bigint, w binary, b binary"


def fitted(sample: DataFrame, part: float, fan: int, nodes: int, p: Params) -> DataFrame:
    """``(cell, w, b)``: a model per node from ``(cell, vec)``, a hash sample of the share ``part`` of all its rows."""

    def run(key, t):
        vectors = t["vec"].to_pylist()
        w, b = fit_part(vectors, len(vectors) / part, fan, p)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "w": [w.astype(np.float32).tobytes()], "b": [b.astype(np.float32).tobytes()]}, schema=pa.schema([("cell", pa.int64()), ("w", pa.binary()), ("b", pa.binary())]))

    return sample.repartition(nodes, "cell").groupBy("cell").applyInArrow(run, MODEL)


def model(w: bytes, b: bytes, p: Params) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(w, np.float32).reshape(p.dim, -1), np.frombuffer(b, np.float32)


def inner_models(rows: DataFrame, n: int, root: tuple, fan: int, p: Params) -> dict[int, tuple]:
    """Model per part of the root, at most ``p.fan`` of them, fitted side by side on the executors."""
    parts = root[0].shape[1]
    share = min(1.0, parts * p.inner / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(p.seed + 1)), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector")
    sent = rows.sparkSession.sparkContext.broadcast(root)

    def run(batches):
        for rb in batches:
            if rb.num_rows:
                x = matrix(rb.column(0), p.dim)
                cell = log_shares(x, *sent.value).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], ["cell", "vec"])

    made = fitted(drawn.mapInArrow(run, "cell bigint, vec binary"), share, fan, parts, p)
    return {r["cell"]: model(r["w"], r["b"], p) for r in made.collect()}  # at most p.fan rows


def encode_vectors(rows: DataFrame, root: tuple, inner: dict[int, tuple], p: Params) -> DataFrame:
    """``(id, vid, vec, cells, logs)``: ``vid`` names the vector by its content; ``vec``, ``cells`` and ``logs`` stand only
    at the first row of a vector in a task, so copies are combined before any shuffle."""
    sent = rows.sparkSession.sparkContext.broadcast((root, inner))  # at most fan + 1 models of dim x fan floats

    def run(batches):
        root, inner = sent.value
        seen: set = set()
        for rb in batches:
            if not rb.num_rows:
                continue
            x = matrix(rb.column(1), p.dim)
            cells, logs = route(x, root, inner, p)
            raw = [r.tobytes() for r in x]
            vids = np.array([xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in raw], np.int64)
            if len(seen) > 1_000_000:
                seen.clear()
            fresh = []
            for v in vids.tolist():
                fresh.append(v not in seen)
                seen.add(v)
            vec = pa.array([r if f else None for r, f in zip(raw, fresh)], pa.binary())
            cell = pa.array([[i for i in c if i >= 0] if f else None for c, f in zip(cells.tolist(), fresh)], pa.list_(pa.int64()))
            log = pa.array([v[: len(c)] if c is not None else None for v, c in zip(logs.tolist(), cell.to_pylist())], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(vids), vec, cell, log], ["id", "vid", "vec", "cells", "logs"])

    return rows.mapInArrow(run, "id string, vid bigint, vec binary, cells array<bigint>, logs array<float>")


#: Bytes of vectors that a task of a comparison reads on the average; most hot cells whose unit counts are broadcast.
TASK_BYTES, HOT_ROWS = 64 << 20, 100_000


def tasks(spark, n: int, p: Params) -> int:
    """Tasks of a comparison: in proportion to the bytes of all routed vectors, with work for all cores."""
    return max(1, -(-n * (p.probes + 1) * (4 * p.dim + 32) // TASK_BYTES), min(n // p.cell, 4 * spark.sparkContext.defaultParallelism))


def with_units(df: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``df`` with the number of index blocks ``nb`` and of query blocks ``nq`` of its cell."""
    if hot is None:
        return df.withColumns({"nb": F.lit(1), "nq": F.lit(1)})
    got = df.join(hot, "cell", "left")
    return got.withColumns({"nb": F.coalesce("nb", F.lit(1)), "nq": F.coalesce("nq", F.lit(1))})


def hot_cells(points: DataFrame, p: Params) -> DataFrame | None:
    """``(cell, nb, nq)`` of the cells that need more than one unit, None if there are none. Their number is checked
    before they are broadcast; beyond ``HOT_ROWS`` they are joined by a shuffle."""
    load = points.select(F.posexplode("cells").alias("i", "cell")).groupBy("cell").agg(F.count_if(F.col("i") == 0).alias("n"), F.count(F.lit(1)).alias("q"))
    load = load.select("cell", F.ceil(F.greatest("n", F.lit(1)) / p.block).cast("int").alias("nb"), F.ceil(F.col("q") / p.queries).cast("int").alias("nq"))
    hot = persist_table(load.where("nb > 1 OR nq > 1"), "neighbours-hot-cells")
    n = hot.count()
    return None if not n else F.broadcast(hot) if n <= HOT_ROWS else hot


def deepen(points: DataFrame, n: int, cells: int, fan: int, p: Params) -> DataFrame:
    """``points`` with their cells cut into up to ``fan`` parts each, by models fitted and applied where a cell's rows meet.

    From the third level on models are too many to be sent to every task; they are joined to the rows of their cell,
    in units of bounded rows, and only the ids and probabilities of the parts meet per vector.
    """
    share = min(1.0, cells * p.inner / max(1, n))
    first = points.select(F.col("cells")[0].alias("cell"), "vec").where(F.pmod(F.xxhash64("vec", F.lit(p.seed + cells)), F.lit(1 << 30)) < int(share * (1 << 30)))
    models = persist_table(fitted(first, share, fan, tasks(points.sparkSession, n, p), p), "neighbours-models")
    hot = hot_cells(points, p)
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    flat = with_units(points.select("vid", "vec", F.explode(F.arrays_zip("cells", "logs")).alias("c")).select("vid", "vec", "c.cells", "c.logs").toDF("vid", "vec", "cell", "log"), hot)
    flat = flat.select("cell", F.pmod(F.xxhash64("vid", F.lit(5)), F.col("nq")).cast("int").alias("qblk"), "vid", "vec", "log")
    sent = with_units(models, hot).select("cell", upto("nq").alias("qblk"), "w", "b")
    schema = pa.schema([("vid", pa.int64()), ("cell", pa.int64()), ("log", pa.float32())])

    def run(key, rows, node):
        if not rows.num_rows:
            return schema.empty_table()
        x, own = unpack(rows["vec"], p.dim), rows["log"].to_numpy()[:, None]
        z = own + log_shares(x, *model(node["w"][0].as_py(), node["b"][0].as_py(), p)) if node.num_rows else own.astype(np.float32)
        top = highest(z, p.probes)
        vid = np.repeat(rows["vid"].to_numpy(), top.shape[1])
        return pa.table({"vid": vid, "cell": (key[0].as_py() * p.fan + top).ravel().astype(np.int64), "log": np.take_along_axis(z, top, 1).ravel().astype(np.float32)}, schema=schema)

    m = tasks(points.sparkSession, n, p)
    unit = ["cell", "qblk"]
    parts = flat.repartition(m, *unit).groupBy(*unit).cogroup(sent.repartition(m, *unit).groupBy(*unit)).applyInArrow(run, "vid bigint, cell bigint, log float").distinct()
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("log"), "cell"))).where(F.col("r") <= p.probes)
    best_first = ranked.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("r", "cell", "log"))).alias("t"))
    best_first = best_first.select("vid", F.col("t.cell").alias("cells"), F.col("t.log").alias("logs"))
    return persist_table(points.select("vid", "vec").join(best_first, "vid"), "neighbours-points")


def nearest(df: DataFrame, p: Params = Params(), id_col: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """``(id, neighbour, similarity, place)``: for every usable row its ``p.k`` most similar other rows by cosine.

    Takes no part: rows with a null id, a null, all-zero, NaN- or infinity-holding, null-holding vector or one of
    another length. Rows repeated with the same id count once (the vector of any of them stands if they differ).
    Copies: rows with equal vectors are one point of the index; they are each other's neighbours at similarity 1,
    smaller ids first, found from four ids per point, so a point with a third of all rows costs nothing extra. Equal
    similarities are ordered by id. A table with fewer than ``k + 1`` points gives fewer neighbours; empty gives none.

    Balanced parts of the neighbour graph of a bounded sample train a small classifier; the parts are cut again in the
    same way, each by a classifier of its own, until cells hold about ``p.cell`` rows. So cells grow in number with the
    rows and every vector meets about as many others at any size. A vector lies in its most probable cell and is sent as
    a query to the ``p.probes`` most probable ones. Cells larger than expected are cut into units of bounded index and
    query rows, so no task grows with a hot cell. Partial results meet per vector.
    """
    spark = df.sparkSession
    rows = usable(df, p.dim, vector).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    n = rows.count()
    hashed = rows.select("vector", F.xxhash64("id", F.lit(p.seed)).alias("h"), "id")
    part = min(1.0, 1.5 * p.sample / max(1, n))  # so that tasks do not each send a whole sample
    drawn = hashed.where(F.pmod("h", F.lit(1 << 30)) < int(part * (1 << 30))).orderBy("h", "id").limit(p.sample).select("vector").toArrow()
    x = matrix(drawn["vector"].combine_chunks(), p.dim) if drawn.num_rows else np.zeros((0, p.dim), np.float32)
    levels = fans(n, p)
    root = fit(np.unique(x, axis=0), min(levels[0], max(1, len(x) // 8)), p)
    inner = inner_models(rows, n, root, levels[1], p) if len(levels) > 1 else {}
    table = persist_table(encode_vectors(rows, root, inner, p), "neighbours-vectors")
    points = table.where("vec IS NOT NULL").select("vid", "vec", "cells", "logs")
    cells = levels[0] * (levels[1] if inner else 1)
    for fan in levels[2:]:
        points = deepen(points.dropDuplicates(["vid"]), n, cells, fan, p)
        cells *= fan
    hot = hot_cells(points, p)
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    index = with_units(points.select("vid", "vec", F.col("cells")[0].alias("cell")), hot)
    index = index.select("cell", F.pmod(F.xxhash64("vid"), F.col("nb")).cast("int").alias("blk"), upto("nq").alias("qblk"), F.col("vid").alias("ivid"), F.col("vec").alias("ivec"))
    asked = with_units(points.select("vid", "vec", F.explode("cells").alias("cell")), hot)
    asked = asked.select("cell", upto("nb").alias("blk"), F.pmod(F.xxhash64("vid", F.lit(5)), F.col("nq")).cast("int").alias("qblk"), "vid", "vec")
    unit, m = ["cell", "blk", "qblk"], tasks(spark, n, p)
    index, asked = index.repartition(m, *unit), asked.repartition(m, *unit)
    partial = asked.groupBy(*unit).cogroup(index.groupBy(*unit)).applyInArrow(lambda key, a, c: compare_unit(key, a, c, p), "vid bigint, nvid bigint, sim float")
    first = Window.partitionBy("vid").orderBy(F.desc("sim"), "nvid")
    links = partial.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= p.k).drop("r")
    members = table.select("id", "vid").distinct()
    leading = members.withColumn("r", F.row_number().over(Window.partitionBy("vid").orderBy("id"))).where(F.col("r") <= p.k + 1).select(F.col("vid").alias("nvid"), F.col("id").alias("neighbour"), "r")
    shared = leading.where("r = 2").select(F.col("nvid").alias("vid"))
    copies = members.join(shared, "vid", "left_semi").select("id", F.col("vid").alias("nvid"), F.lit(1.0).cast("float").alias("sim"))
    far = links.join(members, "vid").select("id", "nvid", "sim").unionByName(copies)
    cand = far.join(leading.select("nvid", "neighbour"), "nvid").where("id <> neighbour")
    place = Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour")
    return cand.withColumn("place", F.row_number().over(place)).where(F.col("place") <= p.k).select("id", "neighbour", F.col("sim").alias("similarity"), "place")


def pairs(df: DataFrame, p: Params = Params(), id_col: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """``(chunk_id_a, chunk_id_b)``, smaller id first: at least one is among the ``p.k`` most similar of the other."""
    near = nearest(df, p, id_col, vector)
    return near.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()
