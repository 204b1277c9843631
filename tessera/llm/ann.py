"""Approximate nearest neighbours: inverted lists with product-quantised residuals.

Coarse centroids (the best of several starts) and the codebooks of residuals are learned by
k-means on a sample of at most ``train_rows`` vectors, chosen by a hash of their id; every vector is
indexed. A query probes the lists whose centroids are nearest. Their codes give its distance to each
vector but for the vector's own error of quantisation, which is kept: a vector that may be among
the ``k`` nearest by this is scored exactly, in double precision, on the original vector. So nothing
is lost in a list that is probed, however coarse the codes are for these vectors.

How many lists to probe is measured: for at most ``tried`` of the queries, chosen by a hash, the
true neighbours among all vectors are found by brute force, and so many lists are probed
that the share ``recall`` of those lies in them.

Lists that lie side by side share a part of about ``part_rows`` vectors, or ``part_bytes``; a longer
list is dealt into several parts. A query goes to each part once, whatever number of lists it probes
there, and a part returns its ``k`` best, so what meets per query grows with the number of parts, not
of lists or codes. Where many queries meet in a part, they are dealt into shares, each with a
copy of its vectors.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no
part, nor do those of another length than the sample's most common one, nor rows with a null
vec_id; of rows that repeat a vec_id the smallest vector counts; equal distances go to the
smaller vec_id; fewer than ``k`` candidates give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessera.llm.common import released, small_batches, stored


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def best_kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, starts: int = 3) -> np.ndarray:
    """Of several starts, the centroids that lie nearest to the vectors."""
    tried = [kmeans(x, k, rounds, rng) for _ in range(starts)]
    loss = [sum(float(distances(x[i : i + 2048], c).min(axis=1).sum()) for i in range(0, len(x), 2048)) for c in tried]
    return tried[int(np.argmin(loss))]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances but for a term that is the same for all of a row."""
    return (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 2048], c).argmin(axis=1) for i in range(0, len(x), 2048)]) if len(x) else np.empty(0, np.int64)


@dataclass
class Index:
    centre: np.ndarray  # taken from all vectors, so that differences keep their digits
    coarse: np.ndarray  # lists by dimensions
    books: list[np.ndarray]  # per subspace: codes by sub-dimensions
    edges: list[int]

    @staticmethod
    def learn(x: np.ndarray, lists: int, subspaces: int, seed: int = 5) -> Index:
        rng = np.random.default_rng(seed)
        x = x - (centre := x.mean(axis=0))
        coarse = best_kmeans(x, lists, 8, rng)
        rest = x - coarse[nearest(x, coarse)]
        dims = x.shape[1]
        edges = [round(dims * i / min(subspaces, dims)) for i in range(min(subspaces, dims) + 1)]
        books = [kmeans(rest[:, a:b], 256, 6, rng) for a, b in zip(edges, edges[1:], strict=False)]
        return Index(centre, coarse, books, edges)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and error of quantisation of each vector."""
        x = x - self.centre
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        code = np.stack([nearest(rest[:, a:b], c) for (a, b), c in zip(self._spans(), self.books, strict=True)], axis=1).astype(np.uint8)
        lost = rest - np.concatenate([c[code[:, j]] for j, c in enumerate(self.books)], axis=1)
        return at, code, np.sqrt((lost * lost).sum(axis=1))

    def _spans(self):
        return list(zip(self.edges, self.edges[1:], strict=False))

    def ranked(self, q: np.ndarray) -> np.ndarray:
        """The lists of each query, nearest first."""
        return distances(q - self.centre, self.coarse).argsort(axis=1, kind="stable")

    def probe(self, q: np.ndarray, probes: int, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """Nearest lists of each query, ``probes`` of them, more until they hold ``least`` codes."""
        order = self.ranked(q)
        held = sizes[order].cumsum(axis=1)
        return [o[: max(min(probes, len(o)), int(np.searchsorted(h, least)) + 1)] for o, h in zip(order, held, strict=True)]

    def probes_for(self, q: np.ndarray, query: np.ndarray, at: np.ndarray, recall: float) -> int:
        """How many lists to probe so that this share of true neighbours (of query ``query``, in
        list ``at``) is in them."""
        ranks = np.sort(self.ranked(q).argsort(axis=1)[query, at])
        return int(ranks[max(0, math.ceil(recall * len(ranks)) - 1)]) + 1 if len(ranks) else 1

    def own(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        """What a vector's list and code add to its squared distance from any query."""
        out = np.zeros(len(at))
        for j, ((a, b), c) in enumerate(zip(self._spans(), self.books, strict=True)):
            out += ((c * c).sum(axis=1)[None, :] + 2 * (self.coarse[:, a:b] @ c.T))[at, code[:, j]]
        return out

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """What each code of each subspace adds to it for this query (without the centre)."""
        return [-2 * (c @ q[a:b]) for (a, b), c in zip(self._spans(), self.books, strict=True)]


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 0))


def _encode(index: Index):
    def of(batches):
        for batch in batches:
            if batch.num_rows:
                at, codes, error = index.encode(_vectors(batch["v"]))
                coded = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_pydict({"list": pa.array(at, pa.int32()), "vec_id": batch["vec_id"], "code": coded, "error": pa.array(error), "v": batch["v"]})

    return of


def _brute(index: Index, ids: np.ndarray, q: np.ndarray, k: int):
    """The ``k`` nearest rows of a task to each of these queries, and their lists."""
    own = q - index.centre

    def of(batches):
        best, who, where = np.full((len(q), 0), np.inf), np.empty((len(q), 0), np.int64), np.empty((len(q), 0), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, vec = _vectors(batch["v"]) - index.centre, batch["vec_id"].to_numpy()
                d = (own * own).sum(axis=1)[:, None] + distances(own, x)
                d[ids[:, None] == vec[None, :]] = np.inf
                best = np.concatenate([best, d], axis=1)
                who, where = (np.concatenate([a, np.broadcast_to(b, d.shape)], axis=1) for a, b in ((who, vec), (where, nearest(x, index.coarse))))
                if best.shape[1] > k:
                    pick = np.argpartition(best, k - 1, axis=1)[:, :k]
                    best, who, where = (np.take_along_axis(a, pick, axis=1) for a in (best, who, where))
        query = np.broadcast_to(np.arange(len(q))[:, None], best.shape)
        fine = np.isfinite(best)
        yield pa.RecordBatch.from_pydict({"query": pa.array(query[fine], pa.int32()), "d": pa.array(best[fine]), "vec_id": pa.array(who[fine], pa.int64()), "list": pa.array(where[fine], pa.int32())})

    return of


def parts_of(coarse: np.ndarray, sizes: np.ndarray, part_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first part, number of parts) of each list. Lists stand in a chain, each followed by the
    nearest that is left, and parts are cut from it."""
    first, many = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // part_rows))
    left = np.ones(len(sizes), bool)
    at, part, held = 0, 0, 0
    for _ in range(len(sizes)):
        left[at] = False
        if held and (many[at] > 1 or held + sizes[at] > part_rows):
            part, held = part + 1, 0
        first[at] = part
        if many[at] > 1:
            part += many[at]
        else:
            held += sizes[at]
        if left.any():
            d = distances(coarse[at][None], coarse)[0]
            at = int(np.where(left, d, np.inf).argmin())
    return first, many


def _probe(index: Index, probes: int, sizes: np.ndarray, first: np.ndarray, many: np.ndarray, least: int):
    def of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                part, query, lists = [], [], []
                for i, found in enumerate(index.probe(_vectors(some["v"]), probes, sizes, least)):
                    by: dict[int, list[int]] = {}
                    for x in found.tolist():
                        if sizes[x]:
                            for p in range(first[x], first[x] + many[x]):
                                by.setdefault(p, []).append(x)
                    part += by
                    lists += by.values()
                    query += [i] * len(by)
                own = pa.array(query, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), some["vec_id"].take(own), pa.array(lists, pa.list_(pa.int32())), some["v"].take(own)], names=["part", "query_id", "lists", "v"])

    return of


def _score(index: Index, k: int):
    def of(codes: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(codes) and len(queries):
            ids, at, error = (codes[x].to_numpy() for x in ("vec_id", "list", "error"))
            c = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            added, c = index.own(at, c), np.ascontiguousarray(c.T)
            flat = codes["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            size = float(np.sqrt((index.coarse**2).sum(axis=1))[at].max() + 2 * error.max())
            for batch in queries.to_batches(max_chunksize=1024):
                for q, v, lists in zip(batch["query_id"].to_pylist(), _vectors(batch["v"]), batch["lists"].to_pylist(), strict=True):
                    probed = np.zeros(len(index.coarse), bool)
                    probed[lists] = True
                    rows = np.flatnonzero(probed[at] & (ids != q))
                    rows = rows[_may_be_nearest(index, v - index.centre, k, at[rows], c[:, rows], added[rows], error[rows], size)]
                    d, rows = _nearest_rows(flat, v, rows, ids, k)
                    out.append((np.full(len(d), q), ids[rows], d))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return of


def _may_be_nearest(index: Index, q: np.ndarray, k: int, at: np.ndarray, code: np.ndarray, added: np.ndarray, error: np.ndarray, size: float) -> np.ndarray:
    """Which of these vectors may be among the ``k`` nearest: a vector is off its code's distance
    by its error at most, and by what rounding does to sums of squares of this size."""
    if len(at) <= k:
        return np.arange(len(at))
    square = distances(q[None], index.coarse)[0][at] + q @ q + added
    for t, own in zip(index.tables(q), code, strict=True):
        square += t[own]
    d = np.sqrt(np.maximum(square, 0))
    error = error + 1e-6 * (math.sqrt(q @ q) + size)
    edge = np.partition(d + error, k - 1)[k - 1]
    return np.flatnonzero(~(d - error > edge))


def _nearest_rows(vectors: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and rows of the ``k`` nearest of these rows. Squares are added in the order of the
    components, so a distance is the same wherever it is computed."""
    if len(rows) > k:
        d = np.concatenate([((vectors[rows[i : i + 4096]] - q) ** 2).sum(axis=1) for i in range(0, len(rows), 4096)])
        rows = rows[~(d > np.partition(d, k - 1)[k - 1] * (1 + 1e-9))]
    square = np.zeros(len(rows))
    for j in range(len(q)):
        square += (vectors[rows, j] - q[j]) ** 2
    d = np.sqrt(square)
    first = np.lexsort((ids[rows], d))[:k]
    return d[first], rows[first]


def search(vectors: DataFrame, is_query: Column, k: int = 10, lists: int | None = None, probes: int | None = None, recall: float = 0.98, subspaces: int = 16, train_rows: int = 20_000, tried: int = 256, part_rows: int = 1_000_000, part_bytes: int = 128 << 20, share_bytes: int = 64 << 20) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest vectors found for each row of
    ``vectors`` (vec_id, embedding) that ``is_query`` picks, itself left out.

    The number of lists to probe is the one that holds ``recall`` of the true neighbours of
    ``tried`` queries, unless ``probes`` is given. Parts hold ``part_rows`` vectors, fewer where that
    gives too few to keep the session's partitions busy. The driver gathers the sample, the queries
    that are tried with the lists of their neighbours, and one size per list (``lists`` at most 4096).
    """
    spark = vectors.sparkSession
    small_batches(spark)
    given = vectors.schema["embedding"].dataType
    kind = "float" if isinstance(given, ArrayType) and given.elementType == FloatType() else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(train_rows)
    sizes = Counter({r["d"]: r["count"] for r in drawn.groupBy(F.size("v").alias("d")).count().collect()})
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return none
    dims = max(sizes, key=lambda d: (sizes[d], -d))
    rows = stored(rows.filter(F.size("v") == dims).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-vectors")
    n, asked = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    if not asked:
        return none
    learned = np.array([np.array(r["v"]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(train_rows).select("v").toLocalIterator()])
    index = Index.learn(learned, max(1, min(4096, lists or round(n**0.5))), subspaces)
    lists = len(index.coarse)
    if probes is None:
        some = rows.filter(is_query).orderBy(F.xxhash64(F.lit(17), "vec_id"), "vec_id").limit(tried).collect()
        ids, q = np.array([r["vec_id"] for r in some]), np.array([r["v"] for r in some])
        near = rows.mapInArrow(released(_brute(index, ids, q, k)), "query int, d double, vec_id long, list int")
        near = near.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy("d", "vec_id"))).filter(F.col("at") <= k)
        true = np.array([(r["query"], r["list"]) for r in near.select("query", "list").collect()], np.int64).reshape(-1, 2)
        probes = index.probes_for(q, true[:, 0], true[:, 1], recall)
    probes = min(lists, probes)
    codes = stored(rows.mapInArrow(released(_encode(index)), f"list int, vec_id long, code binary, error double, v array<{kind}>"), "ann-codes")
    held = np.zeros(lists, np.int64)
    for r in codes.groupBy("list").count().collect():
        held[r["list"]] = r["count"]
    busy = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = dims * (4 if kind == "float" else 8)
    first, many = parts_of(index.coarse, held, max(1000, min(part_rows, part_bytes // (width + 64), -(-n // busy))))
    shares = max(1, round(asked * probes / lists * width / share_bytes))
    pick = lambda a, at: F.element_at(F.lit(a.astype(int).tolist()), at + 1)
    part = pick(first, F.col("list")) + F.pmod(F.xxhash64("vec_id"), pick(many, F.col("list")))
    dealt = codes.withColumn("part", part.cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    queries = rows.filter(is_query).mapInArrow(released(_probe(index, probes, held, first, many, 4 * k)), f"part int, query_id long, lists array<int>, v array<{kind}>")
    queries = queries.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int"))
    found = dealt.groupBy("part", "share").cogroup(queries.groupBy("part", "share")).applyInArrow(_score(index, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every(n: int) -> Column:
    return F.pmod(F.col("vec_id"), F.lit(n)) == 0
