"""The k most similar vectors of every vector, by learned partitions of a neighbour graph.

1. Fit, per matrix, on at most ``sample`` rows: the exact neighbour graph of the sample is cut
   into partitions of equal size (median splits along principal directions, then moves of nodes
   to the partition of most of their neighbours while it has room), and a small two-layer
   classifier learns to predict, from a vector, the partitions of its neighbours.
2. Every row is indexed in its most probable partition. A partition with more than ``leaf``
   rows gets a model of its own and is divided again.
3. Every row is a query. It is sent to its most probable partitions, until their probability
   reaches the model's ``cover``, and reranked there with exact cosines. Neighbouring partitions form
   groups of at most ``GROUP_ROWS`` rows. A row is sent once to the task of its own group, where it is
   indexed and asks, and once to each other group that it asks. Groups with many guests are many tasks.
4. Measure: the exact neighbours of ``checked`` rows a matrix (chosen by a hash) are found by a scan
   of all rows, and it is counted how many of them lie in partitions that the rows are sent to. A
   matrix below ``least_recall`` is searched exactly, all its rows against all in blocks.

The cover of a model is calibrated, so probes grow with the partitions: of queries and indexed rows
that the model was not fitted on, the exact neighbours are looked up, and the cover is the least
probability by which the share of them that level may not lose is reached. All levels together
may lose ``1 - recall``, the first half of it, each further one half of the one before. A sample is
thinner than its node and its neighbours lie further away, so the figure errs on the safe side.

A matrix of any size has a model. Nodes are divided until they have at most ``leaf`` rows; a node
that its model does not divide (less than a tenth leaves its largest part) stays whole and is
searched in shares. Models are broadcast while they are small together; where rows are sent to is
then computed again wherever it is needed, and vectors are stored once, packed. Beyond that, models are
joined to blocks of their rows, and rows and queries are stored level by level. Tables of nodes (about
60 bytes a node of about ``rows`` rows) are held by the driver.

Exact copies: of each group of equal vectors only the ``k + 1`` smallest ids are indexed; by the
tie rule (higher cosine, then smaller id) no other copy can be among anyone's k nearest. The other
copies get the first k of their group, which is their exact result. The smallest ids are limited
before the shuffle and the others are joined with a salt, so no task holds a group of copies.

Results for unusual input: null, zero, NaN, infinite and wrong-length vectors, null ids and
matrices without a specification take no part. Repeated rows of an id count once. A matrix with
one vector has no pairs. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.durable import durable


@dataclass(frozen=True)
class Learned:
    """``sample``: rows a model is fitted on; ``rows``: aimed rows a partition; ``recall``: aimed
    share of the k nearest that is found; ``checked``, ``least_recall``: see step 4."""

    sample: int = 4096
    rows: int = 1024
    leaf: int = 8192
    fan: int = 64
    graph_k: int = 10
    hidden: int = 64
    epochs: int = 40
    recall: float = 0.98
    block: int = 4096
    checked: int = 200
    least_recall: float = 0.9
    seed: int = 5


#: Held-out neighbours below which a cover is not trusted and all partitions are searched.
LEAST_HELD = 500
#: Largest set of models that is broadcast, in bytes; a model has about 30 KB.
MODEL_BYTES = 200_000_000
#: Largest group of partitions that a task searches: rows, bytes of vectors, partitions. The fewer groups,
#: the fewer vectors are sent to several; down to ``LEAST_GROUP`` rows, groups are made for all cores.
GROUP_ROWS, GROUP_BYTES, GROUP_LEAVES = 131_072, 33_554_432, 256
LEAST_GROUP = 32_768
#: Most queries of other groups that a task searches for.
GUESTS = 262_144
#: Rows of a packed block.
PACKED = 8192
#: Largest table of repeated ids or of hashes of copies that is broadcast, in rows.
BROADCAST_ROWS = 200_000
#: Shares that the copies of a vector are spread over.
SALTS = 16


def unit(rows) -> np.ndarray:
    x = np.asarray(np.stack(list(rows)), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors_of(column) -> np.ndarray:
    """Unit rows of an Arrow list column of equal lengths, without a Python object a row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest rows of each row (itself left out), in blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    for s in range(0, len(x), 512):
        sim = x[s : s + 512] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -np.inf
        out[s : s + 512] = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 4, slack: float = 1.15) -> np.ndarray:
    """Labels 0..parts-1 (parts a power of two) of nearly equal size that cut few graph edges."""
    label = np.zeros(len(x), dtype=np.int64)
    for level in range(int(np.log2(parts))):
        new = label * 2
        for p in range(2**level):
            at = np.flatnonzero(label == p)
            if len(at) > 1:
                c = x[at] - x[at].mean(0)
                side = c @ np.linalg.eigh(c.T @ c)[1][:, -1]
                new[at[np.argsort(side, kind="stable")[len(at) // 2 :]]] += 1
        label = new
    room = int(np.ceil(slack * len(x) / parts))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1.0)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        size = np.bincount(label, minlength=parts)
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
    return label


def fit_router(x: np.ndarray, parts: int, opt: Learned) -> dict[str, np.ndarray]:
    """Two-layer classifier from a unit vector to the partitions of its neighbours."""
    rng = np.random.default_rng(opt.seed)
    graph = neighbour_graph(x, opt.graph_k)
    label = balanced_partition(x, graph, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 0.5 / graph.shape[1])
    goal[np.arange(len(x)), label] += 0.5
    w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], opt.hidden)), np.zeros(opt.hidden), rng.normal(0, np.sqrt(1 / opt.hidden), (opt.hidden, parts)), np.zeros(parts)]
    x = x * np.sqrt(x.shape[1])
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(opt.epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(x), 128):
            b = order[s : s + 128]
            h = np.maximum(x[b] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            dz = (p - goal[b]) / len(b)
            dh = (dz @ w[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[b].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= 0.004 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return {k: a.astype(np.float32) for k, a in zip(("w1", "b1", "w2", "b2"), w)}


def route(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probability of each partition, of unit vectors."""
    h = np.maximum(x * np.sqrt(x.shape[1]) @ model["w1"] + model["b1"], 0)
    z = h @ model["w2"] + model["b2"]
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def masses_before(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partitions from the most probable down, and the probability of those before each."""
    order = np.argsort(-p, axis=1, kind="stable")
    top = np.take_along_axis(p, order, 1)
    return order, np.cumsum(top, 1) - top


def calibrated_cover(model: dict[str, np.ndarray], xq: np.ndarray, iq: np.ndarray, xb: np.ndarray, ib: np.ndarray, k: int, recall: float) -> float:
    """Least cover that finds ``recall`` of the k nearest of the queries xq among the rows xb.

    Neither may hold rows of the fit. Ids are compared to leave out a query itself. Too few rows
    give a cover of 1, which is all partitions.
    """
    k = min(k, len(xb) - 1)
    if k < 1 or len(xq) * k < LEAST_HELD:
        return 1.0
    home = route(model, xb).argmax(1)
    lost = []
    for s in range(0, len(xq), 512):
        sim = xq[s : s + 512] @ xb.T
        sim[iq[s : s + 512, None] == ib[None, :]] = -np.inf
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        order, before = masses_before(route(model, xq[s : s + 512]))
        lost.append(np.take_along_axis(before, np.take_along_axis(np.argsort(order, axis=1), home[near], 1), 1).ravel())
    return float(np.quantile(np.concatenate(lost), recall, method="higher"))


def _fit_udf(opt: Learned, k: int, recall: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, by = int(pdf["n"].iloc[0]), dict(list(pdf.groupby("role")))
        fit = by.get("fit", pdf[:0])
        if len(fit) < 4:  # tiny matrices: all rows, nothing is held out
            fit, by = pdf.drop_duplicates("vec_id"), {}
        if len(fit) < 2:
            return pd.DataFrame({"node": pd.Series(dtype=str), "model": pd.Series(dtype=object)})
        x = unit(fit["v"])
        parts = 2 ** int(np.clip(np.ceil(np.log2(max(2, n / opt.rows))), 1, np.log2(opt.fan)))
        parts = min(parts, 2 ** int(np.log2(max(2, len(x) // 4))))
        model = fit_router(x, parts, opt)
        cover = 1.0
        if "base" in by and "query" in by:
            b, q = by["base"], by["query"]
            cover = calibrated_cover(model, unit(q["v"]), q["vec_id"].to_numpy(), unit(b["v"]), b["vec_id"].to_numpy(), k, recall)
        return pd.DataFrame({"node": [pdf["node"].iloc[0]], "model": [pickle.dumps(model | {"cover": cover})]})

    return run


ROUTED = "matrix_name string, vec_id long, v array<float>, node string"


def _targets(model: dict, x: np.ndarray, home: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and partitions of the rows sent on by a model (``home``: only to the most probable)."""
    order, before = masses_before(route(model, x))
    take = before <= (-1.0 if home else model["cover"] + 1e-9)
    take[:, 0] = True
    i, j = np.nonzero(take)
    return i, order[i, j]


def _sent(rows: pa.Table, node: str, i: np.ndarray, part: np.ndarray) -> pa.Table:
    names = np.array([f"{node}.{c}" for c in range(int(part.max()) + 1)], dtype=object)
    at = rows.column_names.index("node")
    return rows.take(pa.array(i)).set_column(at, "node", pa.array(names[part], pa.string()))


PACK = "matrix_name string, node string, blob binary"


def _packed(ids: np.ndarray, x: np.ndarray, *codes: np.ndarray) -> bytes:
    """Ids, vectors and other arrays in one value; the bytes of numbers are separated, which compresses them better."""
    out = []
    for a in (ids, x, *codes):
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
        out.append((a.dtype.str, a.shape, pa.compress(raw, "zstd", asbytes=True) if raw else b""))
    return pickle.dumps(out)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, shape, raw in pickle.loads(blob):
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        raw = np.frombuffer(pa.decompress(raw, decompressed_size=size, codec="zstd"), np.uint8) if size else np.empty(0, np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(shape))
    return out


def _arrays(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float32, copy=False)


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = pa.Table.from_batches([b])
        for node in pc.unique(b.column("node")).to_pylist():
            part = rows.filter(pc.equal(rows.column("node"), node))
            for s in range(0, part.num_rows, PACKED):
                some = part.slice(s, PACKED)
                blob = _packed(some.column("vec_id").to_numpy(), _arrays(some.column("v")))
                yield pa.RecordBatch.from_arrays([pa.array([some.column("matrix_name")[0].as_py()]), pa.array([node]), pa.array([blob], pa.binary())], names=["matrix_name", "node", "blob"])


def _pack(rows: DataFrame) -> DataFrame:
    """Rows of matrix_name, vec_id, v, node in packed blocks: about the bytes of their table, without the overhead of rows."""
    return rows.mapInArrow(_pack_batches, PACK)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, np.ndarray, np.ndarray]]:
    """(matrix, node, ids, vectors) of packed blocks or of rows."""
    for b in batches:
        if "blob" in b.schema.names:
            for r in range(b.num_rows):
                yield (b.column("matrix_name")[r].as_py(), b.column("node")[r].as_py(), *_unpacked(b.column("blob")[r].as_py()))
        else:
            rows = pa.Table.from_batches([b])
            for node in pc.unique(b.column("node")).to_pylist():
                part = rows.filter(pc.equal(rows.column("node"), node))
                yield part.column("matrix_name")[0].as_py(), node, part.column("vec_id").to_numpy(), _arrays(part.column("v"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _leaves(models: dict, seen: dict, node: str, x: np.ndarray, home: bool) -> Iterator[tuple[str, np.ndarray]]:
    """(node that is not divided, row numbers) of the rows x of a node, through the models of all levels."""
    todo = [(node, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if node not in models:
            yield node, at
            continue
        if node not in seen:
            seen[node] = pickle.loads(models[node])
        i, part = _targets(seen[node], _unit(x[at]), home)
        order = np.argsort(part, kind="stable")
        i, part = i[order], part[order]
        for c in np.unique(part):
            todo.append((f"{node}.{c}", at[i[np.searchsorted(part, c) : np.searchsorted(part, c, "right")]]))


def _walk(blocks: DataFrame, held, home: bool) -> DataFrame:
    """Rows with the nodes that the models held send them to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for matrix, node, ids, x in _blocks(batches):
            for leaf, at in _leaves(held.value, seen, node, x, home):
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * x.shape[1], pa.int32()), pa.array(x[at].ravel()))
                yield pa.RecordBatch.from_arrays([pa.repeat(matrix, len(at)), pa.array(ids[at]), v, pa.repeat(leaf, len(at))], names=["matrix_name", "vec_id", "v", "node"])

    return blocks.mapInArrow(run, ROUTED)


def _counted(blocks: DataFrame, held, home: bool) -> dict[str, int]:
    """Rows of each node; no row leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = {}, {}
        for _, node, _, x in _blocks(batches):
            for leaf, at in _leaves(held.value, seen, node, x, home):
                n[leaf] = n.get(leaf, 0) + len(at)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["node", "n"])

    return {r["node"]: r["n"] for r in blocks.mapInArrow(run, "node string, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()}  # one row a node


def _route_group(home: bool):
    def run(rows: pa.Table, model: pa.Table) -> pa.Table:
        rows = rows.select(["matrix_name", "vec_id", "v", "node"])
        if not rows.num_rows or not model.num_rows:
            return rows
        m = pickle.loads(model.column("model")[0].as_py())
        return _sent(rows, rows.column("node")[0].as_py(), *_targets(m, vectors_of(rows.column("v")), home))

    return run


def _routed(rows: DataFrame, models: DataFrame, counts: DataFrame, home: bool, opt: Learned) -> DataFrame:
    """One level of routing by models that are joined to blocks of rows."""
    blocks = F.ceil(F.col("n") / opt.block).cast("int")
    sized = rows.join(counts.select("node", blocks.alias("nb")), "node").withColumn("b", _block("nb", opt))
    spread = models.join(counts, "node").select("node", "model", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b"))
    done = sized.groupBy("node", "b").cogroup(spread.groupBy("node", "b")).applyInArrow(_route_group(home), ROUTED)
    return done


def _block(n: str, opt: Learned):
    return F.pmod(F.xxhash64(F.lit(opt.seed), "vec_id"), F.col(n)).cast("int")


FOUND = "matrix_name string, vec_id long, other_id long, cosine double"


def best_pairs(xq: np.ndarray, iq: np.ndarray, xb: np.ndarray, ib: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, other id, cosine) of the k best rows of each query with a cosine of at least ``least``.

    Ties with the k-th value are settled by the smaller id. ``ib`` must ascend.
    """
    out = []
    for s in range(0, len(xq), 256):
        sim = xq[s : s + 256] @ xb.T
        sim[iq[s : s + 256, None] == ib[None, :]] = -np.inf
        if len(ib) > k:
            floor = np.full((len(sim), 1), max(least, -2.0))
            many = np.flatnonzero((sim >= floor).sum(1) > k)
            if len(many):
                kth = -np.partition(-sim[many], k - 1, axis=1)[:, k - 1 : k]
                floor[many] = np.maximum(floor[many], kth - 1e-12)
        else:
            floor = max(least, -2.0)
        i, j = np.nonzero(sim >= floor)
        c = np.clip(sim[i, j], -1.0, 1.0)
        order = np.lexsort((ib[j], -c, i))
        i, j, c = i[order], j[order], c[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        out.append((iq[s + i[keep]], ib[j[keep]], c[keep]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def _order(node: str) -> list:
    """Sorts nodes so that parts of a node, and neighbouring parts, stand together; names may hold any character."""
    parts = node.split(".")
    return [(not p.isdecimal(), int(p) if p.isdecimal() else 0, p) for p in parts]


def _grouped(sizes: dict[str, dict[str, int]], dims: dict[str, int], tasks: int) -> tuple[dict[str, tuple[int, int]], list[dict]]:
    """Group and number of each node that is not divided, and the groups; sizes: matrix to nodes.

    A node above the limits has a group for itself, which is searched in ``nb`` shares."""
    where, groups = {}, []
    fair = max(LEAST_GROUP, sum(sum(nodes.values()) for nodes in sizes.values()) // max(1, tasks))
    for matrix, nodes in sorted(sizes.items()):
        most = max(1, min(GROUP_ROWS, GROUP_BYTES // (4 * dims[matrix]), fair))
        rows = most + 1
        for node in sorted(nodes, key=_order):
            if rows + nodes[node] > most or groups[-1]["leaves"] >= GROUP_LEAVES:
                groups.append({"matrix": matrix, "leaves": 0, "nb": -(-nodes[node] // most), "nq": 1})
                rows = 0
            where[node] = (len(groups) - 1, groups[-1]["leaves"])
            groups[-1]["leaves"] += 1
            rows += nodes[node]
    return where, groups


def _share(ids: np.ndarray, n: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


CELL = "g int, bb int, qb int, blob binary"


def _shipped(plan, side: str, own: bool):
    """Packed blocks of each group's cells. ``base``: indexed rows, with the partitions of their own cell
    that they ask (``own``); ``query``: rows that ask partitions of another cell; ``count``: rows a group of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, where, groups, seen, n = plan.value["models"], plan.value["where"], plan.value["groups"], {}, {}
        for matrix, node, ids, x in _blocks(batches):
            if matrix in plan.value["exact"]:
                node = matrix
            asks: dict[int, np.ndarray] = {}
            if own or side != "base":
                for leaf, at in _leaves(models, seen, node, x, False):
                    if leaf in where:  # else no row is indexed there
                        g, c = where[leaf]
                        asks.setdefault(g, np.zeros((len(ids), groups[g]["leaves"]), bool))[at, c] = True
            home_g, home_c = np.full(len(ids), -1), np.full(len(ids), -1)
            if own or side == "base":
                for leaf, at in _leaves(models, seen, node, x, True):
                    home_g[at], home_c[at] = where[leaf]
            out = []
            for g in np.unique(home_g) if side == "base" else asks:
                share, nb, nq = _share(ids, groups[g]["nb"]), groups[g]["nb"], groups[g]["nq"]
                for bb in range(nb):
                    at_home = (home_g == g) & (share == bb)
                    if side == "base":
                        i = np.flatnonzero(at_home)
                        mask = np.packbits(asks[g][i], axis=1) if own and len(i) else np.zeros((len(i), -(-groups[g]["leaves"] // 8)), np.uint8)
                        if len(i):
                            blob = _packed(ids[i], x[i], home_c[i].astype(np.int16), mask)
                            out += [(g, bb, qb, blob) for qb in range(nq)]
                        continue
                    i = np.flatnonzero(asks[g].any(1) & ~at_home)
                    if side == "count":
                        n[g] = max(n.get(g, 0), 0) + len(i) / nb
                        continue
                    q = _share(ids[i] >> 1, nq)
                    out += [(g, bb, qb, _packed(ids[i[q == qb]], x[i[q == qb]], np.packbits(asks[g][i[q == qb]], axis=1))) for qb in np.unique(q)]
            for g, bb, qb, blob in out:
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([bb], pa.int32()), pa.array([qb], pa.int32()), pa.array([blob], pa.binary())], names=["g", "bb", "qb", "blob"])
        if side == "count":
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.float64())], names=["g", "n"])

    return run


def _joined(cells: pa.Table) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*(_unpacked(b.as_py()) for b in cells.column("blob")))]


def _best(k: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, -c, a))
    a, b, c = a[order], b[order], c[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], c[keep]


def _search(plan, k: int, limits: dict[str, float], own: bool):
    """Exact cosines in the partitions of a cell, of its own rows and of guests; the best k a query."""

    def run(q: pa.Table, base: pa.Table) -> pa.Table:
        empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        found, held, name = [empty], 0, ""
        if base.num_rows:
            group = plan.value["groups"][base.column("g")[0].as_py()]
            name = group["matrix"]
            ids, x, leaf, mask = _joined(base)
            sides = [(ids, x, mask)] if own and base.column("qb")[0].as_py() == 0 else []
            sides += [_joined(q)] if q.num_rows else []
            for c in range(group["leaves"]):
                at = np.flatnonzero(leaf == c)
                at = at[np.argsort(ids[at])]
                xb = _unit(x[at])
                for iq, xq, bits in sides:
                    ask = np.flatnonzero(bits[:, c // 8] >> (7 - c % 8) & 1) if len(at) else at
                    for s in range(0, len(ask), PACKED):
                        some = ask[s : s + PACKED]
                        found.append(best_pairs(_unit(xq[some]), iq[some], xb, ids[at], k, limits.get(name, -2.0)))
                        held += len(found[-1][0])
                        if held > 2_000_000:
                            found = [_best(k, *(np.concatenate(f) for f in zip(*found)))]
                            held = -len(found[0][0])
        a, b, c = _best(k, *(np.concatenate(f) for f in zip(*found)))
        return pa.table({"matrix_name": pa.array([name] * len(a), pa.string()), "vec_id": pa.array(a, pa.int64()), "other_id": pa.array(b, pa.int64()), "cosine": pa.array(c, pa.float64())})

    return run


def _usable(vectors: DataFrame, specs: DataFrame) -> DataFrame:
    """matrix_name, vec_id, v, k, min_cosine of the rows that take part, ids repeated as they are."""
    s = F.broadcast(specs.select("matrix_name", "dims", "k", "min_cosine"))  # one row a matrix
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return (
        vectors.select("matrix_name", "vec_id", "embedding")
        .join(s, "matrix_name")
        .filter((F.size("embedding") == F.col("dims")) & F.col("vec_id").isNotNull())
        .withColumn("__norm", norm)
        .filter((F.col("__norm") > 0) & (F.col("__norm") < float("inf")))  # null and NaN fail both
        .select("matrix_name", "vec_id", F.col("embedding").alias("v"), "k", "min_cosine")
    )


def valid_vectors(vectors: DataFrame, specs: DataFrame) -> DataFrame:
    """matrix_name, vec_id, v (array of float), k, min_cosine of the rows that take part."""
    return _usable(vectors, specs).dropDuplicates(["matrix_name", "vec_id"])


def _valid_once(vectors: DataFrame, specs: DataFrame) -> DataFrame:
    """Valid rows without a shuffle of vectors, except those of repeated ids."""
    rows = _usable(vectors, specs).select("matrix_name", "vec_id", "v")
    key = ["matrix_name", "vec_id"]
    twice = durable(rows.groupBy(*key).count().filter("count > 1").select(*key))
    n = twice.count()
    if n > BROADCAST_ROWS:
        return durable(rows.dropDuplicates(key))
    if not n:
        return rows
    twice = F.broadcast(twice)  # counted
    return rows.join(twice, key, "left_anti").unionByName(durable(rows.join(twice, key, "left_semi").dropDuplicates(key)))


def _exact_sample(base: DataFrame, k: int, opt: Learned) -> DataFrame:
    """matrix_name, vec_id, other_id: exact k nearest rows of the checked rows of each matrix."""
    counts = base.groupBy("matrix_name").agg(F.count("*").alias("n"))
    chosen = base.join(F.broadcast(counts), "matrix_name")  # one row a matrix
    draw = F.pmod(F.xxhash64(F.lit(opt.seed + 77), "vec_id"), F.lit(1_000_003)) / 1_000_003
    rows = chosen.filter(draw < opt.checked / F.col("n")).select("matrix_name", "vec_id", "v").toArrow()  # about ``checked`` a matrix
    asked = {}
    for name in pc.unique(rows.column("matrix_name")).to_pylist():
        part = rows.filter(pc.equal(rows.column("matrix_name"), name))
        asked[name] = (part.column("vec_id").to_numpy(), vectors_of(part.column("v")))
    held = base.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in set(b.column("matrix_name").to_pylist()) & set(held.value):
                part = pa.Table.from_batches([b]).filter(pc.equal(b.column("matrix_name"), name)).sort_by("vec_id")
                ids, x = held.value[name]
                q, o, c = best_pairs(x, ids, vectors_of(part.column("v")), part.column("vec_id").to_numpy(), k, -2.0)
                yield pa.RecordBatch.from_arrays([pa.repeat(name, len(q)), pa.array(q), pa.array(o), pa.array(c)], names=["matrix_name", "vec_id", "other_id", "cosine"])

    w = Window.partitionBy("matrix_name", "vec_id").orderBy(F.col("cosine").desc(), "other_id")
    near = base.select("matrix_name", "vec_id", "v").mapInArrow(run, FOUND)
    return near.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn", "cosine")


@dataclass
class _Tree:
    """Packed blocks of indexed rows and of queries, the models of the levels below them, and rows a node."""

    base: DataFrame
    query: DataFrame
    models: dict[str, bytes]
    sizes: dict[str, int]

    def held(self):
        return self.base.sparkSession.sparkContext.broadcast(self.models)


def _tree(spark: SparkSession, index: DataFrame, k: int, opt: Learned) -> _Tree:
    """Divide the indexed rows, level by level.

    Rows are kept once, packed; where they are sent to is computed from the models whenever it is needed,
    so nothing of the size of queries times partitions is stored."""
    blocks = durable(_pack(index))
    t = _Tree(blocks, blocks, {}, {})
    done: set[str] = set()
    level, parents = 0, {}
    while True:
        held = t.held()
        t.sizes = sizes = _counted(t.base, held, True)
        for n, c in sizes.items():
            if c > 0.9 * parents.get(n.rpartition(".")[0], float("inf")):
                done.add(n)  # its model does not divide it
        frontier = {n: c for n, c in sizes.items() if n not in done and (c > opt.leaf or level == 0) and c > 1}
        if not frontier:
            return t
        parents = frontier
        asked = _counted(t.query, held, False) if level else frontier
        plan = [(n, c, min(opt.sample / c, 2 / 3), opt.sample / max(1, asked.get(n, c))) for n, c in frontier.items()]
        nodes = F.broadcast(spark.createDataFrame(plan, "node string, n long, fit_rate double, ask_rate double"))  # about 40 bytes a node
        # Two thirds of the sampled rows are fitted on, the rest is held out. Rows that no node takes are left out first.
        draw = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1_000_003)) / 1_000_003
        u = draw(opt.seed + level)
        role = F.when(u < F.col("fit_rate"), "fit").when(u < 1.5 * F.col("fit_rate"), "base")
        cols = lambda r: ("node", "vec_id", "v", "n", r.alias("role"))
        unsent = spark.sparkContext.broadcast({})
        rows = lambda blocks: _walk(blocks, unsent, True)
        sample = _walk(rows(t.base).filter(u < 1.5 * max(p[2] for p in plan)), held, True).join(nodes, "node").select(*cols(role)).filter("role is not null")
        asking = rows(t.query).filter((u >= min(p[2] for p in plan)) & (draw(opt.seed + level + 1000) < max(p[3] for p in plan)))
        queries = _walk(asking, held, False).join(nodes, "node").filter((u >= F.col("fit_rate")) & (draw(opt.seed + level + 1000) < F.col("ask_rate"))).select(*cols(F.lit("query")))
        keep = 1 - (1 - opt.recall) / 2 ** (level + 1)
        udf = _fit_udf(replace(opt, seed=opt.seed + level), k, keep)
        models = durable(sample.unionByName(queries).groupBy("node").applyInPandas(udf, "node string, model binary"))
        total = models.agg(F.coalesce(F.sum(F.length("model")), F.lit(0))).first()[0] + sum(map(len, t.models.values()))
        if total <= MODEL_BYTES:
            t.models = t.models | {r["node"]: bytes(r["model"]) for r in models.collect()}
        else:
            asked_counts = spark.createDataFrame([(n, asked.get(n, c)) for n, c in frontier.items()], "node string, n long")
            counts = spark.createDataFrame([(n, c) for n, c in frontier.items()], "node string, n long")
            rest = lambda df: df.join(F.broadcast(counts), "node", "left_anti").select("matrix_name", "vec_id", "v", "node")
            base, query = _walk(t.base, held, True), _walk(t.query, held, False)
            base = durable(_pack(_routed(base, models, counts, True, opt).unionByName(rest(base))))
            query = durable(_pack(_routed(query, models, asked_counts, False, opt).unionByName(rest(query))))
            t = _Tree(base, query, {}, {})
        level += 1


def _divided(spark: SparkSession, index: DataFrame, k: int, opt: Learned) -> tuple[DataFrame, DataFrame]:
    """Indexed rows with their node, and rows as queries with every node they are sent to."""
    t = _tree(spark, index, k, opt)
    held = t.held()
    return _walk(t.base, held, True), _walk(t.query, held, False)


def _measured(t: _Tree, k: int, opt: Learned) -> DataFrame:
    """matrix_name, n_queries, n_neighbours, recall: exact neighbours that the routing reaches."""
    held, unsent = t.held(), t.base.sparkSession.sparkContext.broadcast({})
    exact = durable(_exact_sample(_walk(t.base, unsent, True), k, opt))
    some = lambda blocks, key: _walk(blocks, unsent, True).join(F.broadcast(exact.select("matrix_name", F.col(key).alias("vec_id")).distinct()), ["matrix_name", "vec_id"], "left_semi").select("matrix_name", "vec_id", "v", "node")
    homes = _walk(some(t.base, "other_id"), held, True).select("matrix_name", F.col("vec_id").alias("other_id"), "node")
    sent = _walk(some(t.query, "vec_id"), held, False).select("matrix_name", "vec_id", "node").withColumn("hit", F.lit(1))
    both = exact.join(homes, ["matrix_name", "other_id"], "left").join(sent, ["matrix_name", "vec_id", "node"], "left")
    return both.groupBy("matrix_name").agg(F.countDistinct("vec_id").alias("n_queries"), F.count("*").alias("n_neighbours"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def _index(spark: SparkSession, vectors: DataFrame, specs: DataFrame, opt: Learned):
    spec = {r["matrix_name"]: (r["k"], r["min_cosine"], r["dims"]) for r in specs.select("matrix_name", "k", "min_cosine", "dims").collect()}
    k = max([v[0] for v in spec.values()], default=1)
    valid = _valid_once(vectors, specs)
    # Groups of copies are found by hashes; a group of more than k + 1 copies has a hash of as many rows.
    mark = F.xxhash64("matrix_name", "v")
    hashes = durable(valid.groupBy(mark.alias("h")).count().filter(F.col("count") > k + 1).select("h"))
    n = hashes.count()
    hot, cold = valid.filter("false"), valid
    if n:
        hashes = F.broadcast(hashes) if n <= BROADCAST_ROWS else hashes
        marked = valid.withColumn("h", mark)
        hot, cold = durable(marked.join(hashes, "h", "left_semi").drop("h")), marked.join(hashes, "h", "left_anti").drop("h")
    copies = Window.partitionBy("matrix_name", "v").orderBy("vec_id")
    # The filter makes the window a group limit: at most k + 1 copies of a task are shuffled.
    first = hot.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1)
    first = durable(first) if n else first
    index = cold.unionByName(first.drop("copy")).select("matrix_name", "vec_id", "v", F.col("matrix_name").alias("node"))
    tree = _tree(spark, index, k, opt)
    report = durable(_measured(tree, k, opt).withColumn("exact_search", F.col("recall") < opt.least_recall))
    return spec, k, hot, first, tree, report


def measured_recall(spark: SparkSession, vectors: DataFrame, specs: DataFrame, opt: Learned = Learned()) -> DataFrame:
    """Per matrix: checked queries, their exact neighbours, the share reached, and whether the
    matrix is searched exactly instead."""
    return _index(spark, vectors, specs, opt)[-1]


def nearest(spark: SparkSession, vectors: DataFrame, specs: DataFrame, opt: Learned = Learned(), only_similar: bool = False) -> DataFrame:
    """matrix_name, vec_id, other_id, cosine, rank (1 to k) of every valid vector.

    ``only_similar``: keep neighbours of at least ``min_cosine`` (applied before the k best are
    chosen, which gives the same rows and moves fewer).
    """
    spec, k, hot, first, tree, report = _index(spark, vectors, specs, opt)
    limits = {m: v[1] for m, v in spec.items()} if only_similar else {}
    exact = {r["matrix_name"] for r in report.filter("exact_search").select("matrix_name").collect()}  # at most one name a matrix
    of = lambda node: max((m for m in spec if node == m or node.startswith(f"{m}.")), key=len)
    sizes: dict[str, dict[str, int]] = {}
    for node, n in tree.sizes.items():
        m = of(node)
        node = m if m in exact else node
        sizes.setdefault(m, {})[node] = sizes.get(m, {}).get(node, 0) + n
    where, groups = _grouped(sizes, {m: v[2] for m, v in spec.items()}, 2 * spark.sparkContext.defaultParallelism)
    models = {n: b for n, b in tree.models.items() if of(n) not in exact}
    sc = spark.sparkContext
    plan = {"models": models, "where": where, "groups": groups, "exact": exact}
    own = tree.base is tree.query  # each row is indexed and asks in its own cell without being sent again
    asking = tree.query
    if exact and not own:  # of these matrices all rows ask once
        asking = tree.query.filter(~F.col("matrix_name").isin(list(exact))).unionByName(tree.base.filter(F.col("matrix_name").isin(list(exact))))
    guests = asking.mapInArrow(_shipped(sc.broadcast(plan), "count", own), "g int, n double").groupBy("g").agg(F.sum("n").alias("n"))
    for r in guests.collect():  # one row a group
        groups[r["g"]]["nq"] = max(1, int(-(-r["n"] // GUESTS)))
    held, at = sc.broadcast(plan), ["g", "bb", "qb"]
    # The blocks have few bytes for their work: a number that is given is not coalesced.
    cells = max(1, sum(g["nb"] * g["nq"] for g in groups))
    b = tree.base.mapInArrow(_shipped(held, "base", own), CELL).repartition(2 * cells, *at)
    q = asking.mapInArrow(_shipped(held, "query", own), CELL).repartition(2 * cells, *at)
    found = q.groupBy(*at).cogroup(b.groupBy(*at)).applyInArrow(_search(held, k, limits, own), FOUND)
    # Copies beyond the indexed ones: the first k of their group.
    full = first.groupBy("matrix_name", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.max("vec_id").alias("top")).filter(F.size("ids") > k)
    full = full.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rest = hot.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).join(full, ["matrix_name", "v", "salt"]).filter(F.col("vec_id") > F.col("top"))
    same = rest.select("matrix_name", "vec_id", F.explode(F.slice("ids", 1, k)).alias("other_id"), F.lit(1.0).alias("cosine"))
    ks = F.broadcast(spark.createDataFrame([(m, v[0]) for m, v in spec.items()], "matrix_name string, k int"))  # one row a matrix
    w = Window.partitionBy("matrix_name", "vec_id").orderBy(F.col("cosine").desc(), "other_id")
    return (
        found.unionByName(same)
        .dropDuplicates(["matrix_name", "vec_id", "other_id"])
        .withColumn("rank", F.row_number().over(w))
        .join(ks, "matrix_name")
        .filter(F.col("rank") <= F.col("k"))
        .drop("k")
    )


def similar_pairs(spark: SparkSession, vectors: DataFrame, specs: DataFrame, opt: Learned = Learned()) -> DataFrame:
    """vec_id_a < vec_id_b: one is among the k nearest of the other and they are similar enough."""
    near = nearest(spark, vectors, specs, opt, only_similar=True)
    return near.select(F.least("vec_id", "other_id").alias("vec_id_a"), F.greatest("vec_id", "other_id").alias("vec_id_b")).distinct()
