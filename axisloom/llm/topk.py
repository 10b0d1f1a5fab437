"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are turned into an orthonormal basis fitted on the queries, which leaves inner products and distances
as they are and puts what varies most first. There a vector is cut into segments, finer at each resolution and
each of about the same share of the squared length; of each segment its mean and its deviation (the norm of
what is left after the mean) are kept. For two vectors the squared distance within a segment of length L is at
least L * (difference of means)**2 + (difference of deviations)**2. With the two norms that is an upper bound of
the inner product: sum of L * m * m' + d * d' over the segments. Bounds go from coarse to fine, each on the
survivors of the one before, against the k-th best score found so far; exact integer scores are computed
for what survives. Equal scores survive, so ties fall to the smaller id as they should. A resolution that turns
away less than a tenth of what reaches it is passed over from then on, which changes the work but no result.

Queries are sent to the executors in loads of at most ``load`` components, each with a first k-th best score
for every query. A load is one job over all candidates, which are scanned where they lie; only k + 1 rows for
each query and task are shuffled. With n rows there are n / 50 * dim / load jobs, and each compares every row
with tens of thousands of queries, so the jobs are long ones whatever n is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisloom.llm import common

#: Scores beyond this may not be exact in doubles; such pairs are scored in Python integers.
EXACT = float(1 << 53)
#: Queries and candidates compared at a time; candidates that give first scores; rows a basis is fitted on.
QUERIES, CANDIDATES, SEEDS, FITTED = 1024, 2048, 2048, 4096
#: A resolution is passed over once it keeps more than this share of at least TRIED pairs.
KEEPS, TRIED = 0.9, 1 << 20
NONE = np.iinfo(np.int64).max


def resolutions(dim: int) -> list[int]:
    """Segments at each resolution, coarse to fine."""
    return sorted({min(4, dim), min(16, dim), max(1, dim // 2)})


class Basis:
    """An orthonormal basis, and the segments of its axes at every resolution."""

    def __init__(self, x: np.ndarray):
        dim = x.shape[1]
        y = x[:FITTED] / max(1.0, np.abs(x[:FITTED]).max(initial=0))
        energy, axes = np.linalg.eigh(y.T @ y) if dim <= 1024 else (np.ones(dim), np.eye(dim))
        self.axes = axes[:, ::-1].copy()
        share = np.cumsum(np.maximum(energy[::-1], 0) + 1e-12)
        share /= share[-1]
        self.edges = [np.unique(np.append(0, np.minimum(np.searchsorted(share, np.arange(p) / p, "right"), dim - 1))) for p in resolutions(dim)]

    def statistics(self, x: np.ndarray, level: int) -> np.ndarray:
        """Per row of a table in this basis: of every segment the mean times the root of its length, and the deviation."""
        edges = self.edges[level]
        size = np.diff(np.append(edges, x.shape[1]))
        root = np.add.reduceat(x, edges, axis=1) / np.sqrt(size)
        square = np.add.reduceat(x * x, edges, axis=1)
        return np.concatenate([root, np.sqrt(np.maximum(square - root * root, 0))], axis=1).astype(np.float32)


class Block:
    """Queries of one length with their best scores so far."""

    def __init__(self, basis: Basis, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.basis, self.ids, self.x, self.k = basis, ids, x, k
        self.scale = max(1.0, np.abs(x).max(initial=0))
        turned = x / self.scale @ basis.axes
        self.stats = [basis.statistics(turned, level) for level in range(len(basis.edges))]
        self.norm = np.sqrt((turned * turned).sum(axis=1).max(initial=0))
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), NONE)
        self.twin = np.zeros((len(ids), k), bool)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        #: Pairs that reached a resolution, pairs it kept; last the pairs that were scored.
        self.reached, self.kept = np.zeros(len(basis.edges) + 1, np.int64), np.zeros(len(basis.edges) + 1, np.int64)

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(ids), CANDIDATES):
            self._offer(ids[at : at + CANDIDATES], x[at : at + CANDIDATES])

    def _offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(self.ids):
            return
        scale = max(1.0, np.abs(x).max())
        turned = x / scale @ self.basis.axes
        # what single precision may lose, and then some
        slack = x.shape[1] * 2.0**-21 * (self.norm * np.sqrt((turned * turned).sum(axis=1).max()) + 2.0**-40)
        worst = np.maximum(self.floor, self.scores[:, -1].astype(np.float64))
        floor = np.where(worst <= -(2.0**63), -np.inf, worst) / self.scale / scale - slack
        n = len(self.ids) * len(ids)
        q = c = None  # all pairs
        for level in range(len(self.basis.edges)):
            if self.reached[level] >= TRIED and self.kept[level] > KEEPS * self.reached[level]:
                continue
            fine = self.basis.statistics(turned, level)
            self.reached[level] += n if q is None else len(q)
            if q is None:
                q, c = np.nonzero(self.stats[level] @ fine.T >= floor[:, None])
            else:
                keep = self._pairs(self.stats[level], fine, q, c) >= floor[q]
                q, c = q[keep], c[keep]
            self.kept[level] += len(q)
            if not len(q):
                return
        if q is None:
            q, c = np.divmod(np.arange(n), len(ids))
        self.reached[-1] += n
        self.kept[-1] += len(q)
        if self.scale * scale * x.shape[1] >= EXACT:
            score = np.array([min(max(sum(int(a) * int(b) for a, b in zip(self.x[i], x[j], strict=True)), -(2**63)), 2**63 - 1) for i, j in zip(q, c, strict=True)], dtype=object)
        else:
            score = self._pairs(self.x, x, q, c)
            on = score >= worst[q]
            q, c, score = q[on], c[on], score[on]
        twin = self.ids[q] == ids[c]
        twin[twin] = (self.x[q[twin]] == x[c[twin]]).all(axis=1)
        self._keep(q, ids[c], score, twin)

    @staticmethod
    def _pairs(a: np.ndarray, b: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Inner products of pairs of rows: by one product of the tables where most of it is asked for."""
        if 16 * len(q) > len(a) * len(b):
            return (a @ b.T)[q, c]
        return np.concatenate([np.einsum("ij,ij->i", a[q[i : i + 65536]], b[c[i : i + 65536]]) for i in range(0, len(q), 65536)])

    def _keep(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray, twin: np.ndarray) -> None:
        """The k best of each query among those held and these; of equal rows a query's own comes first."""
        if score.dtype == object:
            self.scores = self.scores.astype(object)
        touched = np.unique(q)
        q = np.concatenate([q, np.repeat(touched, self.k)])
        ids = np.concatenate([ids, self.found[touched].ravel()])
        score = np.concatenate([score, self.scores[touched].ravel()])
        twin = np.concatenate([twin, self.twin[touched].ravel()])
        order = np.lexsort((~twin, ids, -score, q)) if score.dtype != object else np.array(sorted(range(len(q)), key=lambda i: (q[i], -score[i], ids[i], not twin[i])))
        q, ids, score, twin = q[order], ids[order], score[order], twin[order]
        head = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
        on = place < self.k
        at = q[on], place[on]
        self.scores[at], self.found[at], self.twin[at] = score[on], ids[on], twin[on]


def _vectors(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: ids and quantized vectors of the rows that take part, and these rows' places."""
    ids, col = batch.column("vec_id"), batch.column("embedding")
    flat = col.flatten().cast(pa.float64())
    size = pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    values = flat.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(ids)), size)
    good = (size > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(values)  # nulls come as NaN
    good[owner[bad]] = False
    first = np.cumsum(size) - size
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == n))
        x = np.floor(256.0 * values[first[rows][:, None] + np.arange(n)])
        fits = np.isfinite(x).all(axis=1)
        out[n] = (number[rows][fits], x[fits], rows[fits])
    return out


#: A null query: pairs and scored pairs of one task, in place of vec_id and score.
HITS = "query long, query_id long, times long, vec_id long, score long, twin boolean"


def _search(vectors: DataFrame, rows: list, first: int, k: int) -> DataFrame:
    """Hits of one load of queries (vec_id, embedding, times), numbered from ``first`` on."""
    spark = vectors.sparkSession
    table = pa.table({"vec_id": pa.array([r.vec_id for r in rows], pa.int64()), "embedding": pa.array([r.embedding for r in rows], pa.list_(pa.float64()))}).combine_chunks()
    times = np.array([r.times for r in rows], np.int64)
    load = {}
    for n, (ids, x, at) in _vectors(table.to_batches()[0]).items():
        basis, parts = Basis(x), []
        seeds = Block(basis, ids[:0], x[:0], k)
        for a in range(0, len(ids), QUERIES):
            seeds = Block(basis, ids[a : a + QUERIES], x[a : a + QUERIES], k)
            seeds.offer(ids[:SEEDS], x[:SEEDS])
            parts.append(np.array([float(s) for s in seeds.scores[:, -1]]))
        narrow = np.int32 if np.abs(x).max(initial=0) < 1 << 30 else np.float64
        load[n] = (basis, ids, x.astype(narrow), np.concatenate(parts), first + at, times[at])
    sent = spark.sparkContext.broadcast(load)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[tuple[Block, np.ndarray, np.ndarray]]] = {}
        for n, (basis, ids, x, floor, number, times) in sent.value.items():
            cuts = [slice(a, a + QUERIES) for a in range(0, len(ids), QUERIES)]
            blocks[n] = [(Block(basis, ids[s], x[s].astype(np.float64), k, floor[s]), number[s], times[s]) for s in cuts]
        for batch in batches:
            for n, (ids, x, _) in _vectors(batch).items():
                for block, *_ in blocks.get(n, ()):
                    block.offer(ids, x)
        pairs = scored = 0
        names = [c.split()[0] for c in HITS.split(", ")]
        for b, number, times in (x for some in blocks.values() for x in some):
            pairs, scored = pairs + int(b.reached[-1]), scored + int(b.kept[-1])
            q, place = np.nonzero(b.found != NONE)
            score = pa.array([int(s) for s in b.scores[q, place]], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(number[q], pa.int64()), pa.array(b.ids[q]), pa.array(times[q]), pa.array(b.found[q, place]), score, pa.array(b.twin[q, place])], names=names)
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array([pairs]), pa.array([scored]), pa.nulls(1, pa.bool_())], names=names)

    return vectors.mapInArrow(step, HITS)


def _hits(vectors: DataFrame, every: int, k: int, key: str, vector: str, load: int) -> DataFrame:
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    own = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    queries = own.where((F.col("vec_id") % every == 0) & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    queries = queries.groupBy("vec_id", "embedding").agg(F.count("*").alias("times"))
    parts, rows, size, first, done = [], [], 0, 0, False
    stream = queries.toLocalIterator()
    while not done:
        row = next(stream, None)
        done = row is None
        if not done:
            rows.append(row)
            size += len(row.embedding)
        if rows and (done or size >= load):
            found = _search(own, rows, first, k + 1)
            # several loads: each one's few results are written before the next is sent
            parts.append(found if done and not parts else common.written(found, "hits"))
            first, rows, size = first + len(rows), [], 0
    found = parts[0] if parts else spark.createDataFrame([], HITS)
    for p in parts[1:]:
        found = found.unionAll(p)
    return found


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", load: int = 4 << 20) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score``: the k best of all other rows for each query row.

    Queries are the rows whose id is divisible by ``every``; components x become floor(256 * x). Rows with a
    null id, or with a null, empty or not wholly finite vector, take no part. Vectors are compared with
    vectors of their own length. Only a query's own row is left out of its results: another row of the same id
    can be one, with an equal vector too. Query rows that repeat are each answered, with the same rows. Ties
    go to the smaller id; an id that comes twice can take two ranks. Scores outside 64 bits are set to the
    nearest bound before they are ranked.
    """
    found = _hits(vectors, every, k, key, vector, load).where("query is not null")
    # the first of a query's equals, if it is among the k + 1 best, stands for its own row
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", F.desc("twin")))
    found = found.withColumn("place", best).where(F.col("place") <= k + 1)
    own = F.min(F.when(F.col("twin"), F.col("place"))).over(Window.partitionBy("query"))
    found = found.withColumn("own", F.coalesce(own, F.lit(k + 2))).where("place <> own")
    found = found.withColumn("rank", (F.col("place") - (F.col("place") > F.col("own")).cast("int")).cast("int")).where(F.col("rank") <= k)
    return found.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select("query_id", "rank", "vec_id", "score")


def surviving_share(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", load: int = 4 << 20) -> float:
    """Which share of all pairs of a query and a row survives the bounds and is scored (0 without pairs)."""
    work = _hits(vectors, every, k, key, vector, load).where("query is null").agg(F.sum("vec_id").alias("pairs"), F.sum("score").alias("scored")).first()
    return (work.scored or 0) / max(1, work.pairs or 0)
