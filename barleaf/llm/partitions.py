"""Approximate nearest neighbours by learned partitions.

Fit, on at most ``SAMPLE`` vectors: their neighbour graph, a balanced
partitioning of it (halving along the widest direction, then moves along the
graph's edges within a capacity), and a small network that tells a vector's
partition, trained on the partitions of its neighbours.  The number of probed
partitions is the least that finds ``RECALL`` of the sample's own neighbours.

Index every row: the network names each distinct vector's partition.  A query
goes to its most probable partitions and every vector there is ranked by its
exact inner product in double precision.

Skew.  Equal vectors collapse first: only the ``k + 1`` smallest ids of a vector
can be answers, and a query vector is searched once however many rows ask it.
Queries are dealt into blocks of ``CHUNK`` and partitions into ``LANES``; a
block meets the vectors of a lane as one stream and keeps a running list of its
best, so a query leaves a lane with one row however many partitions it probes,
and a task holds a block of queries and a slice of vectors whatever the network
does.

Edge cases.  Null or zero vectors and those with null or non-finite components,
or of another length than most, take no part.  Ties go to the smaller id.  A
query's own id is never its answer.  Rows repeating an id and a vector count
once.  Empty tables give an empty result; with fewer than ``k`` candidates all
are returned.  Other columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barleaf.llm.common import parts as width
from barleaf.llm.common import stored

SAMPLE = 8192
DEGREE = 20
PARTITION = 2048
MOST_PARTITIONS = 128
RECALL = 0.97
CHUNK = 4096
LANES = 8
HIDDEN = 128
EPOCHS = 30
SEED = 11


# ---- fitting -----------------------------------------------------------------


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest others of every vector by inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 8) -> np.ndarray:
    """Part of every node, parts of about equal size, few edges between them."""
    label = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        halves = []
        for g in groups:
            y = x[g] - x[g].mean(axis=0) if len(g) else x[g]
            way = np.linalg.svd(y, full_matrices=False)[2][0] if len(g) > 1 else np.zeros(x.shape[1])
            order = g[np.argsort(y @ way, kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        groups = halves
    for i, g in enumerate(groups):
        label[g] = i
    # Edges both ways, as lists by node.
    a, b = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    a, b = np.r_[a, b], np.r_[b, a]
    order = np.argsort(a, kind="stable")
    ends, first = b[order], np.searchsorted(a[order], np.arange(len(x) + 1))
    size = np.bincount(label, minlength=len(groups))
    most = int(1.1 * len(x) / len(groups)) + 1
    rng = np.random.default_rng(SEED)
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(len(x)):
            near = np.bincount(label[ends[first[i] : first[i + 1]]], minlength=len(groups))
            own = label[i]
            near[(size >= most) & (np.arange(len(groups)) != own)] = -1
            best = int(near.argmax())
            if near[best] > near[own]:
                label[i], moved = best, moved + 1
                size[own] -= 1
                size[best] += 1
        if not moved:
            break
    return label


def _forward(net: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hidden = np.maximum(0, unit @ net["a"] + net["c"])
    return hidden, hidden @ net["b"] + net["d"]


def fit(x: np.ndarray, parts: int) -> dict:
    """Network and number of probes for partitions of the sample ``x``."""
    if len(x) < 2 or parts < 2:
        return {"a": np.zeros((x.shape[1], 1)), "c": np.zeros(1), "b": np.zeros((1, 1)), "d": np.zeros(1), "probes": np.array(1)}
    graph = neighbours(x, DEGREE)
    label = balanced_parts(x, graph, parts)
    parts = int(label.max()) + 1
    aim = np.zeros((len(x), parts))  # a node and its neighbours tell where it belongs
    np.add.at(aim, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 0.5 / graph.shape[1])
    aim[np.arange(len(x)), label] += 0.5
    rng = np.random.default_rng(SEED)
    net = {"a": rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), "c": np.zeros(HIDDEN), "b": rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), "d": np.zeros(parts)}
    mean, square, step = {k: 0 for k in net}, {k: 0 for k in net}, 0
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            hidden, out = _forward(net, x[some])
            p = np.exp(out - out.max(axis=1, keepdims=True))
            p = (p / p.sum(axis=1, keepdims=True) - aim[some]) / len(some)
            back = (p @ net["b"].T) * (hidden > 0)
            unit = x[some] / np.linalg.norm(x[some], axis=1, keepdims=True)
            grads = {"a": unit.T @ back, "c": back.sum(0), "b": hidden.T @ p, "d": p.sum(0)}
            step += 1
            for k, g in grads.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                net[k] = net[k] - 0.003 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    order = np.argsort(-_forward(net, x)[1], axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # place of each partition in a vector's order
    found = place[np.repeat(np.arange(len(x)), graph.shape[1]), order[graph.ravel(), 0]]
    share = np.cumsum(np.bincount(found, minlength=parts)) / len(found)
    net["probes"] = np.array(int(np.searchsorted(share, RECALL)) + 1)
    return net


def _usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col(embedding).cast("array<double>")
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = rows.where(fine & F.exists("v", lambda c: c != 0)).withColumn("v", F.transform("v", lambda c: c + 0.0))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("v") == (size["size"] if size else 0))


def _learn(distinct: DataFrame, parts: int) -> dict | None:
    def work(batches):
        rows = [np.stack(b["v"].to_numpy()) for b in batches if len(b)]
        if rows:
            out = io.BytesIO()
            np.savez(out, **fit(np.concatenate(rows), parts))
            yield pd.DataFrame({"net": [out.getvalue()]})

    chosen = distinct.select("v", F.xxhash64("first").alias("h"), "first").orderBy("h", "first").limit(SAMPLE)
    row = chosen.select("v").coalesce(1).mapInPandas(work, "net binary").first()
    return dict(np.load(io.BytesIO(bytes(row["net"])))) if row else None


# ---- searching -----------------------------------------------------------------


def _routed(rows: DataFrame, net: dict, probes: int) -> DataFrame:
    """Adds ``parts``: the ``probes`` most probable partitions of each row's ``v``."""

    def work(batches):
        for batch in batches:
            if not len(batch):
                continue
            column = batch.column(batch.schema.get_field_index("v"))
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            order = np.argsort(-_forward(net, x)[1], axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(order), pa.list_(pa.int32()))], [*batch.schema.names, "parts"])

    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField("parts", T.ArrayType(T.IntegerType()))]))


class Block:
    """Some queries and the best ``k`` answers that each has met so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.vectors, self.parts = k, [], [], []

    def ask(self, qid: int, vector: list[float], parts: list[int]) -> None:
        self.ids.append(qid)
        self.vectors.append(vector)
        self.parts.append(parts)

    def ready(self) -> None:
        self.x = np.array(self.vectors)
        self.best: list[list[tuple[float, int]]] = [[] for _ in self.ids]
        self.least = np.full(len(self.ids), -np.inf)  # the last of the best, once there are k
        self.by_part: dict[int, list[int]] = {}
        for q, parts in enumerate(self.parts):
            for p in parts:
                self.by_part.setdefault(p, []).append(q)

    def meet(self, part: int, vectors: np.ndarray, ids: list[list[int]]) -> None:
        asked = np.array(self.by_part.get(part, ()), np.int64)
        for at in range(0, len(asked), 512):
            some = asked[at : at + 512]
            scores = self.x[some] @ vectors.T
            low = np.partition(scores, -self.k, axis=1)[:, -self.k] if scores.shape[1] > self.k else np.full(len(some), -np.inf)
            low = np.maximum(low, self.least[some])  # equal scores may still win by a smaller id
            rows, cols = np.nonzero(scores >= low[:, None])
            for lo, hi in zip(*(np.searchsorted(rows, np.arange(len(some)), side) for side in ("left", "right"))):
                if lo == hi:
                    continue
                r = rows[lo]
                q = some[r]
                self.best[q] = sorted(self.best[q] + [(-scores[r, c], j) for c in cols[lo:hi] for j in ids[c]])[: self.k]
                if len(self.best[q]) == self.k:
                    self.least[q] = -self.best[q][-1][0]

    def answers(self) -> pa.RecordBatch:
        near = [[{"away": away, "vec_id": j} for away, j in b] for b in self.best]
        return pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64()), pa.array(near, _NEAR)], ["qid", "near"])


_NEAR = pa.list_(pa.struct([("away", pa.float64()), ("vec_id", pa.int64())]))


def _streamed(batches, k: int):
    """Answers of every (block, lane); rows come sorted by them, queries before vectors, vectors by partition."""
    at, block, started = None, None, False
    for batch in batches:
        place = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
        edges = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            cell, part = tuple(place[:2, lo]), int(place[3, lo])
            if cell != at:
                if started:
                    yield block.answers()
                at, block, started = cell, Block(k), False
            some = batch.slice(lo, hi - lo)
            if place[2, lo] == 0:
                for qid, v, parts in zip(*(some.column(i).to_pylist() for i in (4, 5, 6))):
                    block.ask(qid, v, parts)
                continue
            if not block.ids:
                continue  # nobody in this block asks this lane
            if not started:
                block.ready()
                started = True
            vectors = some.column(5).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
            block.meet(part, vectors, some.column(7).to_pylist())
    if started:
        yield block.answers()


def search(rows: DataFrame, asked, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", parts: int | None = None, probes: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for the rows where ``asked(id)`` holds."""
    usable = _usable(rows, vec_id, embedding).dropDuplicates(["vec_id", "v"])
    lowest = usable.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    distinct = stored(lowest.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("v", "ids", F.col("ids")[0].alias("first")), "vectors")
    total = distinct.count()
    if parts is None:
        parts = 1 << max(1, min(MOST_PARTITIONS, total // PARTITION) - 1).bit_length()
    net = _learn(distinct, max(8, parts)) or fit(np.ones((1, 1)), 1)
    probes = probes or int(net["probes"])

    asking = usable.where(asked(F.col("vec_id")))
    queries = stored(_routed(asking.groupBy("v").agg(F.min("vec_id").alias("qid")), net, probes), "queries")
    index = _routed(distinct, net, 1).withColumn("part", F.col("parts")[0])
    blocks = max(1, -(-queries.count() // CHUNK))
    lane = F.col("part") % LANES
    # a query goes to the lanes of its partitions, a vector to every block
    to = queries.select("qid", "v", "parts", F.explode(F.array_distinct(F.transform("parts", lambda p: p % LANES))).alias("lane"))
    to = to.select(F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"), "lane", F.lit(0).alias("side"), F.lit(-1).alias("part"), "qid", "v", "parts", F.lit(None).cast("array<long>").alias("ids"))
    held = index.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), lane.alias("lane"), F.lit(1).alias("side"), "part", F.lit(None).cast("long").alias("qid"), "v", F.lit(None).cast("array<int>").alias("parts"), "ids")
    order = ["block", "lane", "side", "part"]
    found = to.unionByName(held).repartition(max(width(rows.sparkSession), LANES), "block", "lane").sortWithinPartitions(*order)
    found = found.mapInArrow(lambda batches: _streamed(batches, k + 1), "qid long, near array<struct<away: double, vec_id: long>>")
    # at most one list for each lane
    found = found.groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    found = found.select("qid", F.transform("near", lambda n: F.struct(n["vec_id"].alias("vec_id"), (-n["away"]).alias("score"))).alias("near"))

    answers = stored(queries.select("qid", "v").join(found, "qid").select("v", "near"), "answers")
    out = asking.select(F.col("vec_id").alias("query_id"), "v").join(answers, "v")
    near = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(near).alias("i", "n"))
    return out.select("query_id", (F.col("i") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))
