"""Embedding near-duplicates with hierarchical navigable small-world graphs.

Vectors are compared with those of the same label (and length) only. Equal vectors are first folded into one class. The
classes of a label are dealt over shards by hash, ``SHARD`` classes or ``SHARD_BYTES`` of numbers each at most on average,
and one task builds each shard's graph. Then every shard is queried with the vectors of every shard of its label, a task per
pair of shards: a beam search descends the graph, and from the beam all vectors beyond the threshold are collected along
the links. Cosines are verified in double precision.

How wide the beams of a label are is found by an audit over all its shards together. The classes that hold a vector whose
id is divisible by ``ASK`` are compared with all others of the label, exactly, and asked of the graphs with a beam of
``BEAM``; while the graphs find less than ``RECALL`` of their links, or of the links of a query on average (so that a large
group does not hide lost pairs), the beam of that label doubles. A label whose audit holds fewer than ``ENOUGH`` queries
with links says little and keeps a beam of ``UNAUDITED`` at least. Only the audited vectors are answered by the exact
comparison; all others are answered by the graphs. A beam as wide as a shard would visit all of it, so that shard is then
compared whole: shards of up to ``BEAM`` classes, and labels whose graphs never pass. ``audit=True`` adds the beam and the
recall measured with it (null where the audit holds no link).

A task returns, per class, how many vectors it links to, and a spanning forest of the links, so no task emits all pairs of a
group; components are united over all shards.

Vectors that are null, empty, all zero, or hold null or non-finite numbers, and rows without id or label, link with
nothing. Repeated rows are vectors of their own and link with each other. A class is known by 128 bits of hashes of label
and vector. Very long vectors make shards of fewer classes. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from callgauge.llm.shared import components, keep

THRESHOLD, SHARD, RECALL = 0.93, 8192, 0.99
#: Bytes of a shard's numbers as doubles.
SHARD_BYTES = 64 << 20
#: Neighbours kept per node (twice as many on the ground layer), beam while building, first beam of a query.
M, BUILD, BEAM = 12, 48, 48
#: Nodes expanded at once.
STRIDE = 8
#: Ids divisible by this are audited; audited queries with links that let a beam under ``UNAUDITED`` be trusted.
ASK, ENOUGH, UNAUDITED = 100, 32, 192
#: A class is named by 32 hexadecimal digits.
NAME = "S32"


class Graph:
    """Navigable small-world layers over unit vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.x = vectors
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        self.levels = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(M)).astype(int), 6)
        self.layers = [np.full((n, 2 * M if level == 0 else M), -1, np.int32) for level in range(self.levels.max(initial=0) + 1)]
        self.entry = 0
        for node in range(1, n):
            self._insert(node)

    def _insert(self, node: int) -> None:
        q, top, own = self.x[node], int(self.levels[self.entry]), int(self.levels[node])
        entry = np.array([self.entry])
        for level in range(top, own, -1):
            entry = self.beam(q, entry, 1, level)[0]
        for level in range(min(top, own), -1, -1):
            entry, sims = self.beam(q, entry, BUILD, level)
            links = self.layers[level]
            chosen = self._diverse(entry, sims, M)
            links[node, : len(chosen)] = chosen
            for other in chosen.tolist():
                row = links[other]
                free = np.nonzero(row < 0)[0]
                if len(free):
                    row[free[0]] = node
                else:
                    near = np.append(row, node)
                    order = np.argsort(-(self.x[near] @ self.x[other]), kind="stable")
                    near = near[order]
                    kept = self._diverse(near, self.x[near] @ self.x[other], len(row))
                    row[:] = -1
                    row[: len(kept)] = kept
        if own > top:
            self.entry = node

    def _diverse(self, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of neighbours by falling similarity those nearer to the node than to one chosen before, then the nearest rest.

        Without this a group of copies would fill all links and be cut off from the rest.
        """
        if len(near) <= most // 2:
            return near
        among = self.x[near] @ self.x[near].T
        chosen: list[int] = []
        closest = np.full(len(near), -2.0)
        for i in range(len(near)):
            if sims[i] > closest[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                np.maximum(closest, among[i], out=closest)
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [i for i in range(len(near)) if i not in taken][: most - len(chosen)]
        return near[chosen]

    def beam(self, q: np.ndarray, entry: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes found from the entries on, by falling similarity."""
        links = self.layers[level]
        seen = np.zeros(len(self.x), bool)
        seen[entry] = True
        ids, sims = entry, self.x[entry] @ q
        todo = np.ones(len(ids), bool)
        while True:
            open_ = np.nonzero(todo)[0][:STRIDE]
            if not len(open_):
                return ids, sims
            todo[open_] = False
            found = links[ids[open_]].ravel()
            found = found[found >= 0]
            found = np.unique(found[~seen[found]])
            if len(found):
                seen[found] = True
                ids = np.concatenate((ids, found))
                sims = np.concatenate((sims, self.x[found] @ q))
                todo = np.concatenate((todo, np.ones(len(found), bool)))
            best = np.argsort(-sims, kind="stable")[:width]
            ids, sims, todo = ids[best], sims[best], todo[best]

    def within(self, q: np.ndarray, threshold: float, width: int) -> np.ndarray:
        """Nodes at least ``threshold`` similar: those in the beam and all that links lead to from them."""
        entry = np.array([self.entry])
        for level in range(len(self.layers) - 1, 0, -1):
            entry = self.beam(q, entry, 1, level)[0]
        ids, sims = self.beam(q, entry, width, 0)
        front = ids[sims >= threshold]
        seen = np.zeros(len(self.x), bool)
        seen[ids] = True
        out = [front]
        while len(front):
            found = self.layers[0][front].ravel()
            found = found[found >= 0]
            found = np.unique(found[~seen[found]])
            seen[found] = True
            front = found[self.x[found] @ q >= threshold]
            out.append(front)
        return np.concatenate(out)


def searched(queries: np.ndarray, asked: np.ndarray, graph: Graph, threshold: float, width: int) -> np.ndarray:
    """Matrix (query, node) of the links: of the audited queries by comparison, of all others by the graph."""
    out = np.zeros((len(queries), len(graph.x)), bool)
    exact = np.ones(len(queries), bool) if width >= len(graph.x) else asked
    for some in np.array_split(np.nonzero(exact)[0], exact.sum() // 512 + 1):
        out[some] = queries[some] @ graph.x.T >= threshold
    out[~exact] = _ask(queries[~exact], graph, threshold, width)
    return out


def audited(queries: np.ndarray, own: np.ndarray, graph: Graph, threshold: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the number of its links in a shard, and how many of them the graph finds.

    ``own`` is a query's place in the graph, -1 if it is of another shard: its match with itself needs no link.
    """
    true, found = np.zeros((2, len(queries)), np.int64)
    for some in np.array_split(np.arange(len(queries)), len(queries) // 512 + 1):
        truth = queries[some] @ graph.x.T >= threshold
        here = np.nonzero(own[some] >= 0)[0]
        truth[here, own[some][here]] = False
        true[some] = truth.sum(axis=1)
        linked = np.nonzero(truth.any(axis=1))[0]
        if width >= len(graph.x):
            found[some] = true[some]
        elif len(linked):
            found[some[linked]] = (_ask(queries[some[linked]], graph, threshold, width) & truth[linked]).sum(axis=1)
    return true, found


def _ask(queries: np.ndarray, graph: Graph, threshold: float, width: int) -> np.ndarray:
    out = np.zeros((len(queries), len(graph.x)), bool)
    for i, q in enumerate(queries):
        out[i, graph.within(q, threshold, width)] = True
    return out


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, audit: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; with ``audit`` also the label's beam and recall."""
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    name = F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), "label", "embedding")), 16, "0") for seed in (1, 2))))
    rows = embeddings.select(
        "vec_id",
        F.when(F.coalesce(usable, F.lit(False)), name).alias("key"),
        F.col("label").cast("string").alias("label"),
        "embedding",
    )
    classes = keep(
        rows.where("key is not null")
        .groupBy("key")
        .agg(
            F.first("label").alias("label"),
            F.first("embedding").alias("embedding"),
            F.min("vec_id").alias("first_id"),
            F.max(F.col("vec_id") % ASK == 0).alias("asked"),
            F.count("*").alias("n"),
        )
        .withColumn("size", F.size("embedding")),
        "vectors",
    )
    most = F.greatest(F.lit(1), F.least(F.lit(shard), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("size")))))
    counts = classes.groupBy("label", "size").agg(F.count("*").alias("n"))
    counts = counts.select("label", "size", F.ceil(F.col("n") / most).cast("int").alias("shards"))
    dealt = classes.join(counts, ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("key"), "shards").cast("int"))
    n_shards, n_pairs = counts.agg(F.sum("shards"), F.sum(F.expr("shards * (shards + 1L) div 2"))).first()
    own = ["label", "size", "shards", "shard"]
    graphs = keep(
        dealt.select(*own, "key", "n", "asked", "embedding")
        .repartition(_tasks(n_shards), *own)
        .groupBy(*own)
        .applyInPandas(_build, GRAPHS),
        "graphs",
    )
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    pairs = graphs.withColumn("other", other).select(
        "*", F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high")
    )
    beams = _beams(dealt, graphs, counts, threshold, shard)
    found = keep(
        pairs.join(beams.select("label", "size", "beam"), ["label", "size"])
        .repartition(_tasks(n_pairs), "label", "size", "low", "high")
        .groupBy("label", "size", "low", "high")
        .applyInPandas(_link(threshold), "key string, links long, root string"),
        "links",
    )
    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    united = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = (
        classes.select("key", "first_id", "n", F.col("label").alias("of"), "size")
        .join(linked, "key", "left")
        .join(united, F.col("key") == F.col("node"), "left")
        .withColumn("label", F.coalesce("component", "key"))
    )
    links = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")
    named = keep(named.select("key", "label", "first_id", links, "of", "size"), "classes")
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    result = named.join(least, "label").select("key", "links", "component_id", "of", "size")
    if audit:
        result = result.join(beams.withColumnRenamed("label", "of"), ["of", "size"])
    extra = ["beam", "recall"] if audit else []
    tied = rows.where("key is not null").select("vec_id", "key").join(result, "key").select("vec_id", "links", "component_id", *extra)
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component_id"))
    return tied.unionByName(alone, allowMissingColumns=True).select(
        "vec_id",
        F.col("links").alias("n_links"),
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
        *extra,
    )


GRAPHS = "label string, size int, shards int, shard int, keys binary, counts binary, asked binary, graph binary"


def _beams(dealt: DataFrame, graphs: DataFrame, counts: DataFrame, threshold: float, block: int) -> DataFrame:
    """(label, size, beam, recall): the first beam of each label that its audit passes, doubling from ``BEAM`` on.

    Audited vectors are packed into blocks and meet every graph of their label, a task per block and shard. A round is one
    job over the labels that have not passed; no beam exceeds a shard, so there are few rounds.
    """
    of = ["label", "size"]
    some = dealt.where("asked").join(
        dealt.where("asked").groupBy(*of).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), of
    )
    packed = keep(
        some.select(*of, "shards", "blocks", F.pmod(F.xxhash64("key", F.lit(1)), "blocks").cast("int").alias("block"), "key", "embedding")
        .groupBy(*of, "block")
        .applyInPandas(_pack, "label string, size int, shards int, blocks int, block int, names binary, vectors binary"),
        "asked",
    )
    number = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    blocks = packed.groupBy(*of).agg(F.max("blocks").alias("blocks"))
    place = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    both = (
        graphs.join(blocks, of)
        .select(*of, "shard", place, "keys", "graph")
        .unionByName(packed.select(*of, number, "block", "names", "vectors"), allowMissingColumns=True)
    )
    tasks = packed.agg(F.sum("shards")).first()[0]
    todo, beam, done = counts.select(*of), BEAM, None
    while True:
        run = (
            both.join(todo, of)
            .repartition(_tasks(tasks), *of, "shard", "block")
            .groupBy(*of, "shard", "block")
            .applyInPandas(_audit(threshold, beam), "label string, size int, key string, true long, found long, nodes int")
        )
        query = run.groupBy(*of, "key").agg(F.sum("true").alias("true"), F.sum("found").alias("found"), F.max("nodes").alias("nodes"))
        seen = query.groupBy(*of).agg(
            F.count_if(F.col("true") > 0).alias("linked"),
            F.least(F.avg(F.try_divide("found", "true")), F.try_divide(F.sum("found"), F.sum("true"))).alias("recall"),
            F.max("nodes").alias("nodes"),
        )
        # a label without audited classes has no row
        seen = todo.join(seen, of, "left").withColumn("beam", F.lit(beam))
        trusted = (F.coalesce("linked", F.lit(0)) >= ENOUGH) | (F.col("beam") >= UNAUDITED)
        passes = (trusted & (F.coalesce("recall", F.lit(1.0)) >= RECALL)) | F.coalesce(F.col("nodes") <= beam, F.lit(False))
        seen = keep(seen.withColumn("passes", passes), "audit")
        passed = seen.where("passes").select(*of, "beam", "recall")
        done = passed if done is None else done.unionByName(passed)
        todo = seen.where("not passes").select(*of)
        if todo.isEmpty():
            return done
        beam *= 2


def _tasks(groups: int | None) -> int:
    """A group is small in bytes and long in work, so nearly each gets a task of its own, whatever AQE would put together."""
    return min(4 * (groups or 1), 20_000)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("key", kind="stable")  # the same graph whatever order the rows arrive in
    graph = Graph(_unit(rows["embedding"]))
    head = rows.iloc[:1][["label", "size", "shards", "shard"]].reset_index(drop=True)
    return head.assign(
        keys=[rows["key"].to_numpy().astype(NAME).tobytes()],
        counts=[rows["n"].to_numpy(np.int64).tobytes()],
        asked=[rows["asked"].to_numpy(bool).tobytes()],
        graph=[pickle.dumps((graph.x, graph.layers, graph.entry))],
    )


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares of very large or small numbers stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    head = rows.iloc[:1][["label", "size", "shards", "blocks", "block"]].reset_index(drop=True)
    return head.assign(names=[rows["key"].to_numpy().astype(NAME).tobytes()], vectors=[_unit(rows["embedding"]).tobytes()])


def _load(data: bytes) -> Graph:
    graph = Graph.__new__(Graph)
    graph.x, graph.layers, graph.entry = pickle.loads(data)  # noqa: S301 - written by _build of this job
    return graph


def _shards(rows: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, Graph]]:
    """Keys, counts, audited and graph of the one or two shards of a task."""
    rows = rows.sort_values("shard")
    return [
        (np.frombuffer(k, NAME), np.frombuffer(c, np.int64), np.frombuffer(a, bool), _load(g))
        for k, c, a, g in zip(rows["keys"], rows["counts"], rows["asked"], rows["graph"])
    ]


def _audit(threshold: float, width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        target, asked = rows[rows["graph"].notna()].iloc[0], rows[rows["graph"].isna()].iloc[0]
        keys, names, graph = np.frombuffer(target["keys"], NAME), np.frombuffer(asked["names"], NAME), _load(target["graph"])
        place = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
        own = np.where(keys[place] == names, place, -1)
        true, found = audited(np.frombuffer(asked["vectors"]).reshape(len(names), -1), own, graph, threshold, width)
        out = {"label": target["label"], "size": target["size"], "key": names.astype(str), "true": true, "found": found}
        return pd.DataFrame(out).assign(nodes=len(keys))

    return run


def _link(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shards, width = _shards(rows), int(rows["beam"].iloc[0])
        keys, counts, asked, graphs = zip(*shards)
        if len(shards) == 1:
            matrix = searched(graphs[0].x, asked[0], graphs[0], threshold, width)
            matrix |= matrix.T
            np.fill_diagonal(matrix, False)
            links, names = matrix @ counts[0], keys[0]
            root = _roots(matrix, None)
        else:
            matrix = searched(graphs[0].x, asked[0], graphs[1], threshold, width)
            matrix |= searched(graphs[1].x, asked[1], graphs[0], threshold, width).T
            links = np.concatenate((matrix @ counts[1], matrix.T @ counts[0]))
            names = np.concatenate(keys)
            root = _roots(matrix, matrix.T)
        some = np.nonzero(links)[0]
        return pd.DataFrame({"key": names[some].astype(str), "links": links[some], "root": names[root[some]].astype(str)})

    return run


def _roots(matrix: np.ndarray, back: np.ndarray | None) -> np.ndarray:
    """A representative per connected component; with ``back``, of a graph between rows and columns (numbered on)."""
    n, m = matrix.shape
    total = n if back is None else n + m
    root = np.arange(total)
    seen = np.zeros(total, bool)
    for start in np.nonzero(matrix.any(axis=1))[0].tolist():
        if seen[start]:
            continue
        front = np.array([start])
        while len(front):
            seen[front] = True
            root[front] = start
            if back is None:
                reach = matrix[front].any(axis=0)
            else:
                own = front[front < n]
                cross = front[front >= n] - n
                reach = np.concatenate((back[cross].any(axis=0), matrix[own].any(axis=0)))
            front = np.nonzero(reach & ~seen)[0]
    return root
