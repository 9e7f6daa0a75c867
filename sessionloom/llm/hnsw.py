"""Embedding near-duplicates: a hierarchical navigable small-world graph per shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.base import connected_components, drop_stash, stash, table
from sessionloom.llm.vectors import matrix, usable


def diverse(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Up to m neighbours per row (-1 pads): nearest first, none closer to one already chosen than to the row.

    Places left over go to the nearest of those passed by. ``cand`` is sorted by falling similarity, -1 pads.
    """
    n, c = cand.shape
    v = x[np.maximum(cand, 0)]
    gram = v @ v.transpose(0, 2, 1)
    chosen, count = np.zeros((n, c), bool), np.zeros(n, np.int64)
    for j in range(c):
        closer = (gram[:, j, :] > sims[:, j, None]) & chosen
        ok = (cand[:, j] >= 0) & (count < m) & ~closer.any(1)
        chosen[:, j] = ok
        count += ok
    order = np.argsort(np.where(chosen, 0, np.where(cand >= 0, 1, 2)), axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(cand, order, 1)
    return out if out.shape[1] == m else np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def beam_search(x: np.ndarray, links: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best nodes found for every query (-1 pads) and their similarities, best first.

    ``entries`` has a row of nodes to start from for every query (-1 pads).
    """
    n, q = len(x), len(queries)
    seen = np.zeros((q, n), bool)
    at = np.sort(entries, axis=1)
    at[:, 1:][at[:, 1:] == at[:, :-1]] = -1
    r, k = np.nonzero(at >= 0)
    seen[r, at[r, k]] = True
    sims = np.full(at.shape, -np.inf, np.float32)
    sims[r, k] = np.einsum("ij,ij->i", queries[r], x[at[r, k]])
    done = np.zeros(at.shape, bool)
    live = np.arange(q)
    out_at, out_sims = np.full((q, beam), -1), np.full((q, beam), -np.inf, np.float32)
    while len(live):
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        at, sims, done = (np.take_along_axis(a, order, 1) for a in (at, sims, done))
        open_rank = np.cumsum(~done & (at >= 0), axis=1)
        pick = ~done & (at >= 0) & (open_rank <= step)
        ended = ~pick.any(1)
        if ended.any():
            w = at.shape[1]
            out_at[live[ended], :w], out_sims[live[ended], :w] = at[ended], sims[ended]
            keep = ~ended
            live, at, sims, done, pick = live[keep], at[keep], sims[keep], done[keep], pick[keep]
            if not len(live):
                break
        first = np.argsort(~pick, axis=1, kind="stable")[:, :step]
        valid = np.take_along_axis(pick, first, 1)
        heads = np.where(valid, np.take_along_axis(at, first, 1), -1)
        done |= pick
        new = np.where((heads >= 0)[:, :, None], links[np.maximum(heads, 0)], -1).reshape(len(live), -1)
        new = np.sort(new, axis=1)
        fresh = new >= 0
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        fresh &= ~seen[live[:, None], np.maximum(new, 0)]
        r, k = np.nonzero(fresh)
        nodes = new[r, k]
        seen[live[r], nodes] = True
        got = np.full(new.shape, -np.inf, np.float32)
        got[r, k] = np.einsum("ij,ij->i", queries[live[r]], x[nodes])
        new = np.where(fresh, new, -1)
        if at.shape[1] == beam:  # only what beats the beam's worst
            new = np.where(got > sims[:, -1:], new, -1)
            got = np.where(new >= 0, got, -np.inf)
        at, sims = np.concatenate([at, new], 1), np.concatenate([sims, got], 1)
        done = np.concatenate([done, np.zeros(new.shape, bool)], 1)
    return out_at, out_sims


def _spread(n: int, queries: int) -> np.ndarray:
    """Up to 8 evenly spaced nodes, for every query."""
    return np.tile(np.unique(np.linspace(0, n - 1, 8).astype(int)), (queries, 1))


class Graph:
    """HNSW over unit vectors: every layer holds the nodes of at least its level; built in batches from the top.

    Nodes are numbered by falling level, so a layer is a prefix of the one below. A query, and a node that is put in,
    descends on its own: its best hits of a layer are its entries to the next one.
    """

    def __init__(self, x: np.ndarray, m: int = 16, beam: int = 64, seed: int = 5) -> None:
        self.x = x.astype(np.float32)
        levels = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(x))) / np.log(m)).astype(int)
        self.nodes = np.argsort(-levels, kind="stable")
        self.sorted = self.x[self.nodes]
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # vectors, links among them by position
        for level in range(levels.max(initial=0), -1, -1):
            n = int((levels >= level).sum())
            if level and n < 2 * m:
                continue
            self.layers.append((self.sorted[:n], self._connect(self.sorted[:n], m, beam)))

    def _entries(self, queries: np.ndarray, stop: int | None = None, width: int = 8) -> np.ndarray | None:
        """Every query's ``width`` best hits in the lowest of the first ``stop`` layers (or all so far); None without layers."""
        at = None
        for x, links in self.layers[:stop]:
            at = beam_search(x, links, _spread(len(x), len(queries)) if at is None else at, queries, width)[0]
        return at

    def _connect(self, x: np.ndarray, m: int, beam: int) -> np.ndarray:
        n, wide = len(x), 2 * m
        links = np.full((n, wide), -1)
        done = 0
        while done < n:
            size = min(n - done, max(64, min(done, 512)))
            new = np.arange(done, done + size)
            own = x[new] @ x[new].T
            own[np.arange(size), np.arange(size)] = -np.inf
            near = np.argsort(-own, axis=1, kind="stable")[:, :m]
            cand, sims = new[near], np.take_along_axis(own, near, 1)
            cand = np.where(np.isfinite(sims), cand, -1)
            if done:
                starts, above = _spread(done, size), self._entries(x[new])
                if above is not None:  # those already put in
                    starts = np.concatenate([starts, np.where(above < done, above, -1)], 1)
                at, s = beam_search(x[:done], links[:done], starts, x[new], beam)
                cand, sims = np.concatenate([at, cand], 1), np.concatenate([s, sims], 1)
                order = np.argsort(-sims, axis=1, kind="stable")[:, : beam]
                cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
            chosen = diverse(x, cand, sims, m)
            links[new, :m] = chosen
            self._back(x, links, np.repeat(new, m), chosen.ravel(), wide)
            done += size
        return links

    def _back(self, x: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray, wide: int) -> None:
        """Links back to the new nodes; a node with too many keeps a diverse choice."""
        ok = target >= 0
        source, target = source[ok], target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), 256):
            part, c = nodes[lo : lo + 256], count[lo : lo + 256]
            extra = np.full((len(part), int(c.max())), -1)
            rows = np.repeat(np.arange(len(part)), c)
            cols = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            extra[rows, cols] = source[start[lo] : start[lo] + c.sum()]
            cand = np.sort(np.concatenate([links[part], extra], 1), axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            sims = np.where(cand >= 0, np.einsum("ijk,ik->ij", x[np.maximum(cand, 0)], x[part]), -np.inf)
            by = np.argsort(-sims, axis=1, kind="stable")
            cand, sims = np.take_along_axis(cand, by, 1), np.take_along_axis(sims, by, 1)
            used = (cand >= 0).sum(1)
            links[part] = np.where((used <= wide)[:, None], cand[:, :wide], -1)
            full = used > wide
            if full.any():
                most = min(cand.shape[1], 4 * wide)
                links[part[full]] = diverse(x, cand[full, :most], sims[full, :most], wide)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        x, links = self.layers[-1]
        upper = self._entries(queries, stop=len(self.layers) - 1)
        at, sims = beam_search(x, links, _spread(len(x), len(queries)) if upper is None else upper, queries, beam)
        return np.where(at >= 0, self.nodes[np.maximum(at, 0)], -1), sims


def near(graph: Graph, queries: np.ndarray, least: float, beam: int = 128, batch: int = 512, slack: float = 1e-4) -> list[tuple[np.ndarray, np.ndarray]]:
    """(query, node) positions with similarity near or over ``least``, in parts; candidates for an exact test.

    The graph gives what its beam holds. Every query is then audited against all nodes of the shard by a matrix product, and
    what the beam missed (a full beam, nodes that no path reaches) is added, so no link rests on the graph's recall.
    The audit costs queries x nodes, at most ``query_rows`` x ``shard_rows`` in a task.
    """
    n, bar, out = len(graph.x), least - slack, []
    for lo in range(0, len(queries), batch):
        part = queries[lo : lo + batch]
        hit = np.zeros((len(part), n), bool)
        if 4 * beam < n:
            at, sims = graph.search(part, beam)
            r, k = np.nonzero((at >= 0) & (sims >= bar))
            hit[r, at[r, k]] = True
        hit |= part @ graph.x.T >= bar
        r, node = np.nonzero(hit)
        out.append((lo + r, node))
    return out


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Rows of (a, b) that connect what all rows connect."""
    names, flat = np.unique(pairs, return_inverse=True)
    a, b = flat.reshape(pairs.shape).T
    label = np.arange(len(names))
    keep = np.zeros(len(a), bool)
    while True:
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        cross = np.nonzero(low != high)[0]
        if not len(cross):
            return pairs[keep]
        best = np.lexsort((low[cross], high[cross]))
        _, first = np.unique(high[cross][best], return_index=True)
        use = cross[best[first]]
        keep[use] = True
        parent = np.arange(len(names))
        parent[high[use]] = low[use]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def near_duplicates(vectors: DataFrame, least: float = 0.98, shard_rows: int = 8192, query_rows: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id, kept for (vec_id, embedding, label) rows: cosine >= ``least`` within equal labels.

    Equal vectors of a label are one node with a count. A label's nodes are dealt to shards by hash; every
    block of its nodes is searched in the graph of every shard and audited against all its nodes, candidates are tested in double
    precision, and a task returns one count per node and a spanning forest of its links, never all pairs.

    Rows with a null label or id, or a vector that is null, empty, zero or holds null or non-finite
    components, link with nothing and are their own component. Vectors of unequal lengths do not link. Repeated rows are
    vectors like any other and count as links of each other. An empty table gives an empty result.
    """
    length = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    takes_part = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(length > 0, F.lit(False))
    rows = stash(vectors.select("vec_id", "label", "embedding", takes_part.alias("live")))
    nodes = rows.where("live").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    space = F.struct("label", F.size("embedding").alias("width"))
    nodes = stash(nodes.withColumn("space", space))
    sizes = nodes.groupBy("space").agg(F.count("*").alias("n"))
    cut = nodes.join(sizes, "space").select("space", "rep", "copies", "embedding", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), F.ceil(F.col("n") / query_rows).cast("int").alias("blocks"))
    home = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = cut.withColumn("shard", home(1, "shards")).withColumn("block", every("blocks"))
    probe = cut.withColumn("block", home(2, "blocks")).withColumn("shard", every("shards"))
    probe = probe.select(*[F.col(c).alias(c) for c in probe.columns])  # columns of its own beside those of index
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])

    def unit(table: pa.Table) -> np.ndarray:
        x = matrix(table.column("embedding")).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)  # keeps squares of huge or tiny components finite
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return schema.empty_table()
        shard, block = shard.sort_by("rep"), block.sort_by("rep")
        x, q = unit(shard), unit(block)
        ids, own, copies = shard.column("rep").to_numpy(), block.column("rep").to_numpy(), shard.column("copies").to_numpy()
        counts, edges = np.zeros(len(q), np.int64), np.empty((0, 2), np.int64)
        for a, b in near(Graph(x), q.astype(np.float32), least):
            for lo in range(0, len(a), 1 << 16):
                i, j = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
                good = (np.einsum("ij,ij->i", q[i], x[j]) >= least) & (own[i] != ids[j])
                i, j = i[good], j[good]
                np.add.at(counts, i, copies[j])
                edges = _forest(np.concatenate([edges, np.stack([own[i], ids[j]], 1)]))
        u = np.concatenate([own, edges[:, 0]])
        v = np.concatenate([own, edges[:, 1]])
        return pa.table([pa.array(u), pa.array(v), pa.array(np.concatenate([counts, np.zeros(len(edges), np.int64)]))], schema=schema)

    by = ["space", "shard", "block"]
    found = stash(index.groupBy(*by).cogroup(probe.groupBy(*by)).applyInArrow(search, "u long, v long, links long"))
    counts = found.where("u = v").groupBy("u").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("u <> v"))
    known = stash(
        nodes.join(counts, nodes["rep"] == counts["u"]).join(parts, nodes["rep"] == parts["node"], "left")
        .select("label", "embedding", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    drop_stash(found, nodes)
    live = rows.where("live").join(known, ["label", "embedding"], "left").select("vec_id", "n_links", "component_id")
    idle = rows.where("not live").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return live.unionByName(idle).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e,
    vec_id IS NOT NULL AND label IS NOT NULL AND coalesce(len(embedding), 0) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS live FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.live AND b.live AND a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM reach r JOIN l ON r.v = l.u),
c AS (SELECT u, min(v) AS low FROM reach GROUP BY 1), n AS (SELECT u, count(*) AS k FROM l GROUP BY 1)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, coalesce(least(low, vec_id), vec_id) AS component_id, coalesce(low, vec_id) >= vec_id AS kept
FROM v LEFT JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id
"""
