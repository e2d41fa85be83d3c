"""Embedding near-dedup by navigable small-world graphs.

Equal vectors are one class. Classes are dealt to shards of bounded bytes, each shard gets a hierarchical graph, and
all classes are looked up in every shard. A task loads one shard, once, and a slice of the classes streams past it in
blocks; rows hold parts of a shard, so that neither a row nor a batch grows with it.
A beam search that comes back full of links is widened for that query, in the end to a scan of the shard. Each block's look-up is audited against brute force: a sample of its queries,
and queries planted near vectors of the shard, so that there are always links to find. All beams are widened until
the recall of these links passes, in the end to a scan; the least recall is handed to `on_recall`, and one below
`LEAST_RECALL` fails the job. Candidates count only if their cosine in double precision does. Links leave a task
contracted to (node, label) rows, at most one for each vector in it, and the labels are united over all tasks;
counts are sums.

Null, empty, zero vectors and those with null or non-finite components: linked with nothing, kept. Null
vec_id: likewise. Repeated rows: one result each, counted as one vector. Vectors of different lengths are
never compared. Ties at the threshold: links. Other columns, whatever their names, are not read. Empty table: no rows.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.components import components

from .common import few_in_a_batch, lean, shuffles_dropped, table, written

THRESHOLD = 0.95
#: Shards, and bytes that a shard, a block of queries or a task's slice of them holds at about most: beyond that there are more of them.
SHARDS, SHARD_BYTES, BLOCK_BYTES, SLICE_BYTES = 6, 128 << 20, 8 << 20, 256 << 20
#: Bytes of a row that holds a part of a shard, and of what a step of a search makes for the queries that it takes together.
PART_BYTES, STEP_BYTES = 1 << 20, 32 << 20
#: So many of these rows go to Python at a time.
PART_ROWS = 8
NEIGHBOURS, BUILD_BEAM, FIRST_BEAM, EXPAND = 16, 48, 48, 4
#: Of a look-up, queries that are audited and as many planted ones; the recall that ends the widening, and the least one.
AUDITED, RECALL, LEAST_RECALL = 128, 0.99, 0.9
#: A beam of more than this part of a shard costs more than a scan of it.
SCAN_PART = 16


def _search(links, vectors, queries, entry, beam):
    """Beam search at one level for many queries at once: (ids, similarities), best first, -1 where there are no more."""
    q, width, met = len(queries), beam, EXPAND * links.shape[1]
    step = max(1, STEP_BYTES // (met * (8 * vectors.shape[1] + 48) + 48 * width))
    if q > step:
        parts = [_search(links, vectors, queries[k : k + step], entry[k : k + step], beam) for k in range(0, q, step)]
        return tuple(np.concatenate(x) for x in zip(*parts))
    ids = np.full((q, width), -1, np.int32)
    sims = np.full((q, width), -np.inf, np.float32)
    seen = np.zeros((q, width), bool)
    k = min(entry.shape[1], width)
    ids[:, :k] = entry[:, :k]
    sims[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("qkd,qd->qk", vectors[ids[:, :k]], queries), -np.inf)
    active = np.arange(q)
    while len(active):
        own = np.where(seen[active] | (ids[active] < 0), -np.inf, sims[active])
        best = np.argpartition(-own, min(EXPAND, width - 1), axis=1)[:, :EXPAND]
        value = np.take_along_axis(own, best, 1)
        going = np.isfinite(value).any(1)
        active, best, value = active[going], best[going], value[going]
        if not len(active):
            break
        rows = np.arange(len(active))[:, None]
        mark = seen[active]
        mark[rows, best] |= np.isfinite(value)
        node = np.where(np.isfinite(value), ids[active][rows, best], -1)
        near = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(active), -1)
        both = np.sort(np.concatenate([2 * near + 1, 2 * ids[active]], 1), 1)  # what is held stands before the same that is met
        both[:, 1:][both[:, 1:] >> 1 == both[:, :-1] >> 1] = -1
        near = np.sort(np.where(both & 1, both >> 1, -1), 1)[:, ::-1]
        near = near[:, : max(1, int((near >= 0).sum(1).max()))]
        i, j = np.nonzero(near >= 0)
        near_sims = np.full(near.shape, -np.inf, np.float32)
        near_sims[i, j] = np.einsum("nd,nd->n", vectors[near[i, j]], queries[active[i]])
        all_sims = np.concatenate([sims[active], near_sims], 1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[active] = np.take_along_axis(all_sims, top, 1)
        ids[active] = np.where(np.isfinite(sims[active]), np.take_along_axis(np.concatenate([ids[active], near], 1), top, 1), -1)
        seen[active] = np.take_along_axis(np.concatenate([mark, np.zeros_like(near, bool)], 1), top, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(vectors, ids, sims, most):
    """Of candidates (best first) those that are nearer to the query than to any taken before, filled up with the best."""
    q, k = ids.shape
    step = max(1, STEP_BYTES // (4 * k * vectors.shape[1]))
    if q > step:
        parts = [_diverse(vectors, ids[j : j + step], sims[j : j + step], most) for j in range(0, q, step)]
        return tuple(np.concatenate(x) for x in zip(*parts))
    taken = np.zeros((q, k), bool)
    own = vectors[np.maximum(ids, 0)]
    worst = np.full((q, k), -np.inf, np.float32)  # nearness to what is taken
    for j in range(k):
        ok = (ids[:, j] >= 0) & (sims[:, j] >= worst[:, j]) & (taken.sum(1) < most)
        taken[:, j] = ok
        rows = np.flatnonzero(ok)
        if len(rows) and j + 1 < k:
            worst[rows, j + 1 :] = np.maximum(worst[rows, j + 1 :], np.einsum("qkd,qd->qk", own[rows, j + 1 :], own[rows, j]))
    rank = np.where(taken, 0, np.where(ids >= 0, 1, 2)) * k + np.arange(k)
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


class Graph:
    """Levels of neighbour lists over normalised vectors; a level holds the first `size` of them."""

    def __init__(self, vectors: np.ndarray, seed: int = 3):
        self.vectors = vectors.astype(np.float32)
        n = len(vectors)
        level = np.minimum(np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(NEIGHBOURS)), 5).astype(int)
        self.order = np.argsort(-level, kind="stable")  # from place in the graph to row
        self.vectors = self.vectors[self.order]
        self.sizes = [int((level >= k).sum()) for k in range(level.max() + 1)] if n else []
        self.links: list[np.ndarray] = [None] * len(self.sizes)
        for k in reversed(range(len(self.sizes))):
            self._build(k)

    def _entry(self, queries, down_to):
        entry = np.zeros((len(queries), 1), np.int32)
        for k in reversed(range(down_to + 1, len(self.sizes))):
            entry = _search(self.links[k], self.vectors, queries, entry, 8)[0][:, :4]
        return entry

    def _build(self, k):
        n, most = self.sizes[k], NEIGHBOURS * (2 if k == 0 else 1)
        self.links[k] = links = np.full((n, most), -1, np.int32)
        done = min(n, 64)
        sims = self.vectors[:done] @ self.vectors[:done].T
        np.fill_diagonal(sims, -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : max(done - 1, 0)].astype(np.int32)
        self._connect(links, np.arange(done), order, np.take_along_axis(sims, order, 1), most)
        while done < n:
            new = np.arange(done, min(n, done + max(32, done // 2), done + 2048))
            ids, sims = _search(links, self.vectors, self.vectors[new], self._entry(self.vectors[new], k), BUILD_BEAM)
            among = self.vectors[new] @ self.vectors[new].T
            np.fill_diagonal(among, -np.inf)
            best = np.argsort(-among, axis=1, kind="stable")[:, : min(NEIGHBOURS, len(new) - 1)]
            ids = np.concatenate([ids, new[best].astype(np.int32)], 1)
            sims = np.concatenate([sims, np.take_along_axis(among, best, 1)], 1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            self._connect(links, new, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), most)
            done += len(new)

    def _connect(self, links, new, ids, sims, most):
        if not ids.shape[1]:
            return
        ids, sims = _diverse(self.vectors, ids, sims, NEIGHBOURS)
        links[new, : ids.shape[1]] = ids
        back = np.repeat(new, ids.shape[1]).astype(np.int32)
        to = ids.ravel()
        back, to = back[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        back, to = back[order], to[order]
        due = np.unique(to)
        step = min(4096, max(1, STEP_BYTES // (4 * (most + 3 * NEIGHBOURS) * self.vectors.shape[1])))
        for part in np.array_split(due, max(1, len(due) // step)):  # those who got links choose anew
            if not len(part):
                continue
            here = slice(np.searchsorted(to, part[0]), np.searchsorted(to, part[-1], "right"))
            t, b = np.searchsorted(part, to[here]), back[here]
            place = np.arange(len(t)) - np.searchsorted(t, np.arange(len(part)))[t]
            fit = place < 3 * NEIGHBOURS
            fresh = np.full((len(part), int(place[fit].max()) + 1), -1, np.int32)
            fresh[t[fit], place[fit]] = b[fit]
            every = np.sort(np.concatenate([links[part], fresh], 1), 1)
            every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
            s = np.where(every >= 0, np.einsum("qkd,qd->qk", self.vectors[np.maximum(every, 0)], self.vectors[part]), -np.inf)
            order = np.argsort(-s, axis=1, kind="stable")
            chosen, _ = _diverse(self.vectors, np.take_along_axis(every, order, 1), np.take_along_axis(s, order, 1).astype(np.float32), most)
            links[part, : chosen.shape[1]] = chosen
            links[part, chosen.shape[1] :] = -1

    def nearest(self, queries, beam):
        return _search(self.links[0], self.vectors, queries, self._entry(queries, 0), beam)

    def packed(self, whole: bool = True) -> bytes:
        """With its vectors, unless they are at hand where it is unpacked."""
        out = io.BytesIO()
        np.savez(out, order=self.order, sizes=self.sizes, **({"vectors": self.vectors} if whole else {}), **{f"links{k}": x for k, x in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes, vectors: np.ndarray | None = None) -> "Graph":
        held, own = np.load(io.BytesIO(raw)), cls.__new__(cls)
        own.order, own.sizes = held["order"], held["sizes"].tolist()
        own.vectors = held["vectors"] if vectors is None else vectors.astype(np.float32)[own.order]
        own.links = [held[f"links{k}"] for k in range(len(own.sizes))]
        return own


def _normalised(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _narrowed(v: np.ndarray) -> np.ndarray:
    """The same numbers in single precision, if they all have it."""
    with np.errstate(over="ignore"):
        narrow = v.astype(np.float32)
    return narrow if (narrow == v).all() else v


def contract(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the labels of a and b, in place; each label is the place of a member."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            next_ = labels[labels]
            if (next_ == labels).all():
                break
            labels[:] = next_


def planted(vectors: np.ndarray, threshold: float, most: int, seed: int = 17) -> np.ndarray:
    """Unit vectors whose cosine with one of the given vectors is spread evenly from threshold to 1."""
    random = np.random.default_rng(seed)
    near = vectors[np.unique(random.integers(0, len(vectors), most))]
    aside = random.normal(size=near.shape)
    aside -= (aside * near).sum(1, keepdims=True) * near
    norm = np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = np.where(norm > 1e-9, random.uniform(threshold, 1.0, (len(near), 1)), 1.0)  # one dimension has nothing aside
    return cosine * near + np.sqrt(1 - cosine**2) * aside / np.maximum(norm, 1e-9)


def range_links(graph: Graph, own: np.ndarray, queries: np.ndarray, threshold: float, take) -> float:
    """Hand all links of queries into the shard to take(query places, shard rows); own: the shard's vectors in double precision.

    Returns the audited recall of the beam that was used; 1 for a scan.
    """
    n = len(own)

    def scan(places):
        for part in np.array_split(places, max(1, len(places) * n // 4_000_000 + 1)):
            if len(part):
                a, b = np.nonzero(queries[part] @ own.T >= threshold)
                take(part[a], b)

    def beam_links(asked, beam):
        """Links of these vectors, and which beams were full of them, for some vectors after others: (from, places, shard rows, full)."""
        for k in range(0, len(asked), 1024):
            part = asked[k : k + 1024]
            ids, sims = graph.nearest(part.astype(np.float32), beam)
            i, j = np.nonzero(sims >= threshold - 1e-4)
            row = graph.order[ids[i, j]]
            step = max(1, STEP_BYTES // (16 * own.shape[1]))
            near = [np.einsum("ij,ij->i", part[i[x : x + step]], own[row[x : x + step]]) for x in range(0, len(i), step)]
            good = np.concatenate([*near, np.zeros(0)]) >= threshold
            yield k, i[good], row[good], sims[:, -1] >= threshold - 1e-4

    sample = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
    audited = np.concatenate([queries[sample], planted(own, threshold, AUDITED)])
    beam, open_, reached = FIRST_BEAM, np.arange(len(queries)), 1.0
    if SCAN_PART * beam < n:
        step = max(1, STEP_BYTES // (8 * len(audited)))
        truth = sum((audited @ own[k : k + step].T >= threshold).sum(1) for k in range(0, n, step))
        while SCAN_PART * beam < n:  # the beam that the audit accepts; saturated queries are not its matter
            due = hit = 0
            for k, a, _, full in beam_links(audited, beam):
                due += truth[k : k + len(full)][~full].sum()
                hit += np.bincount(a, minlength=len(full))[~full].sum()
            reached = hit / due if due else 1.0
            if reached >= RECALL:
                break
            beam *= 2
    least = reached if SCAN_PART * beam < n else 1.0
    while len(open_) and SCAN_PART * beam < n:
        again = []
        for k, a, b, full in beam_links(queries[open_], beam):
            take(open_[k + a[~full[a]]], b[~full[a]])
            again.append(open_[k + np.flatnonzero(full)])
        open_, beam = np.concatenate(again), 4 * beam
    scan(open_)
    return float(least)


_PARTS = "dim int, shard int, seq int, ids binary, counts binary, vectors binary, graph binary"


def _parts(dim: int, shard: int, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray):
    """A shard as rows of `_PARTS`: its vectors by their ids, then its graph."""
    order = np.argsort(ids)
    ids, counts, vectors = ids[order], counts[order], vectors[order]
    graph = Graph(_normalised(vectors.astype(np.float64))).packed(whole=False)
    step = max(1, PART_BYTES // (16 + vectors.itemsize * dim))
    rows = [(x.tobytes() for x in (ids[k : k + step], counts[k : k + step], vectors[k : k + step])) for k in range(0, len(ids), step)]
    for seq, row in enumerate([*rows, *((b"", b"", b"", graph[k : k + PART_BYTES]) for k in range(0, len(graph), PART_BYTES))]):
        blobs = [*row, b""][:4]
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (dim, shard, seq)), *(pa.array([x], pa.binary()) for x in blobs)], ["dim", "shard", "seq", "ids", "counts", "vectors", "graph"])


def _index(batches):
    """Parts of all shards of rows (dim, shard, rep, n, v) that are sorted by dim and shard."""
    now, held = None, []
    for batch in batches:
        dims, shards, ids, counts = (batch.column(c).to_numpy() for c in ("dim", "shard", "rep", "n"))
        values, ends = batch.column("v").flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(dims.astype(np.int64))]
        cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(shards) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(ids)]):
            if a == b:
                continue
            if now != (key := (int(dims[a]), int(shards[a]))):
                if held:
                    yield from _parts(*now, *(np.concatenate(x) for x in zip(*held)))
                now, held = key, []
            held.append((ids[a:b], counts[a:b], _narrowed(values[ends[a] : ends[b]].reshape(b - a, -1))))
    if held:
        yield from _parts(*now, *(np.concatenate(x) for x in zip(*held)))


def _unpacked(dim: int, rows: list[tuple[bytes, bytes, bytes, bytes]]):
    """(ids, counts, normalised vectors) of parts."""
    ids, counts = (np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in (0, 1))
    vectors, at = np.empty((len(ids), dim)), 0
    for r in rows:
        if n := len(r[0]) // 8:
            kind = np.float32 if len(r[2]) == 4 * n * dim else np.float64
            vectors[at : at + n] = _normalised(np.frombuffer(r[2], kind).reshape(n, dim).astype(np.float64))
            at += n
    return ids, counts, vectors


class _Shard:
    """A shard in a task that looks up vectors in it, and what these make one so far: each label is a place in the shard."""

    def __init__(self, dim: int, rows: list[tuple[bytes, bytes, bytes, bytes]], threshold: float):
        self.dim, self.threshold, self.recall = dim, threshold, 1.0
        self.ids, self.counts, self.own = _unpacked(dim, rows)
        self.graph = Graph.unpacked(b"".join(r[3] for r in rows), self.own)
        self.labels = np.arange(len(self.ids))

    def _rows(self, src, n_links, dst):
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(n_links), pa.array(dst), pa.array(np.full(len(src), self.recall))], ["src", "n_links", "dst", "recall"])

    def look_up(self, rows: list[tuple[bytes, bytes, bytes, bytes]]) -> pa.RecordBatch:
        """A row for each vector that has links here."""
        ids, _, queries = _unpacked(self.dim, rows)
        n, found = len(self.ids), np.zeros(len(ids), np.int64)
        labels = np.r_[self.labels, n + np.arange(len(ids))]

        def take(a, b):
            apart = ids[a] != self.ids[b]
            a, b = a[apart], b[apart]
            np.add.at(found, a, self.counts[b])
            contract(labels, n + a, b)

        self.recall = min(self.recall, range_links(self.graph, self.own, queries, self.threshold, take))
        self.labels, has = labels[:n], np.flatnonzero(found)
        return self._rows(ids[has], found[has], self.ids[labels[n + has]])

    def done(self) -> pa.RecordBatch:
        """What became one by the vectors that were looked up, and at least one row, to tell the recall."""
        has = np.union1d(np.flatnonzero(self.labels != np.arange(len(self.ids))), [0])
        return self._rows(self.ids[has], np.zeros(len(has), np.int64), self.ids[self.labels[has]])


def _look_up(threshold: float):
    """Links of rows (dim, shard, slice, asked, *parts): in each slice the shard's parts, then those that are looked up in it (asked)."""

    def look_up(batches):
        now, shard, held, size = None, None, [], 0

        def flush():
            nonlocal shard, held, size
            rows, held, size = held, [], 0
            if not now[1]:
                shard = _Shard(now[0][0], rows, threshold)
            elif shard:  # there may be no vectors of this length in it
                yield shard.look_up(rows)

        for batch in batches:
            for k, (*key, asked) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("dim", "shard", "slice", "asked")))):
                if held and (now != (key, asked) or asked and size >= BLOCK_BYTES):
                    yield from flush()
                if now and now[0] != key:
                    if shard:
                        yield shard.done()
                    shard = None
                now = key, asked
                held.append(tuple(batch.column(c)[k].as_py() for c in ("ids", "counts", "vectors", "graph")))
                size += len(held[-1][0]) * (1 + key[0])  # in double precision
        if held:
            yield from flush()
        if shard:
            yield shard.done()

    return look_up


def vector_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, shards: int = SHARDS, on_recall: Callable[[float], None] | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings; on_recall is given the least audited recall."""
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = own.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: x + 0.0))
    classes = valid.dropDuplicates(["vec_id", "v"]).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    spark = embeddings.sparkSession
    with shuffles_dropped(spark):
        classes = written(classes.withColumn("dim", F.size("v")), "classes")
        # A vector stands in its shard in both precisions, beside its links.
        size = classes.agg(F.coalesce(F.sum(12 * F.col("dim") + 200), F.lit(0)).alias("shard"), F.coalesce(F.sum(8 * F.col("dim") + 16), F.lit(0)).alias("block")).first()
        shards = int(max(shards, -(-size["shard"] // SHARD_BYTES)))
        # All vectors are looked up in each shard, in so many slices that each is bounded and all cores have some.
        slices = int(max(1, -(-size["block"] // SLICE_BYTES), -(-3 * spark.sparkContext.defaultParallelism // shards)))
        dealt = classes.withColumn("shard", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(shards)).cast("int"))
        dealt = dealt.select("dim", "shard", "rep", "n", "v").repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "shard")
        index = written(dealt.mapInArrow(lean(_index), _PARTS), "graphs")
        blobs = [F.col(c) for c in ("seq", "ids", "counts", "vectors", "graph")]
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        held = index.select("dim", "shard", every(slices).alias("slice"), F.lit(False).alias("asked"), *blobs)
        asked = index.where(F.length("ids") > 0).select("dim", every(shards).alias("shard"), F.pmod(F.col("seq") + F.col("shard"), F.lit(slices)).alias("slice"), F.lit(True).alias("asked"), *blobs)
        met = held.unionByName(asked).repartitionById(shards * slices, F.col("shard") * slices + F.col("slice")).sortWithinPartitions("dim", "shard", "slice", "asked", "seq")
        with few_in_a_batch(spark, PART_ROWS):
            found = written(met.mapInArrow(lean(_look_up(threshold)), "src long, n_links long, dst long, recall double"), "vector_links")
    recall = found.agg(F.coalesce(F.min("recall"), F.lit(1.0))).first()[0]
    if recall < LEAST_RECALL:
        raise RuntimeError(f"the graphs' audited recall is {recall}")
    if on_recall:
        on_recall(recall)
    labels = components(found.where("src <> dst").select("src", "dst"), written)
    per_class = classes.join(found.groupBy("src").agg(F.sum("n_links").alias("links")).withColumnRenamed("src", "rep"), "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = valid.join(per_class, "v").select("vec_id", "n_links", "component_id").dropDuplicates(["vec_id"])
    out = own.select("vec_id").join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT r.vec_id, coalesce(any_value(k.n), 0)::BIGINT AS n_links, min(r.c) AS component_id, r.vec_id = min(r.c) AS kept FROM r LEFT JOIN k USING (vec_id) GROUP BY r.vec_id
"""
