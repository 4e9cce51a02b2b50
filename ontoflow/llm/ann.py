"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

A table hashes a vector by ``functions`` quantized Gaussian projections. A query visits its own bucket
and perturbed ones (a projection one step up or down), in the order of the squared distances to the
steps crossed, which is that of estimated success. How many it visits is fitted on a bounded sample,
so that a neighbour at the usual distance is met with the wanted probability. All rows are indexed;
buckets are dealt to groups, large groups are split with their queries repeated, and each group
returns its best few for each query, by exact distance. Queries that met too few rows, or whose k-th
found is so far that the probes would miss too many neighbours at that distance, are scanned for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class Settings:
    k: int = 10
    tables: int = 4
    functions: int = 6
    width: float = 1.7  # of a quantization step, in usual neighbour distances
    wanted: float = 0.96  # chance of meeting a neighbour at the usual distance
    usual: float = 0.95  # the usual distance is that within which this share of rows have their k-th neighbour
    least: float = 0.9  # chance of meeting a neighbour as far as a query's k-th found; with less, it is scanned for
    sample: int = 2000  # rows that the fit looks at
    most_probes: int = 729
    group: int = 4000  # index entries in a group
    scan: int = 5000  # queries scanned for at once
    seed: int = 30


def valid(v: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite numbers."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def probe_order(up: np.ndarray, most: int) -> Iterator[tuple[tuple[int, int], ...]]:
    """Perturbations ((function, -1 or 1), ...) by rising cost; ``up`` is each projection's place in its step.

    The cost is the sum of squared distances to the steps' ends that are crossed. A set of crossings,
    by rank, is followed by that with its last moved on, and by that with the next one added.
    """
    steps = sorted([(x * x, i, -1) for i, x in enumerate(up.tolist())] + [((1 - x) ** 2, i, 1) for i, x in enumerate(up.tolist())])
    yield ()
    heap, given = [(steps[0][0], (0,))], 1
    while heap and given < most:
        cost, chosen = heapq.heappop(heap)
        moved = tuple((steps[j][1], steps[j][2]) for j in chosen)
        if len({i for i, _ in moved}) == len(moved):
            yield moved
            given += 1
        if (last := chosen[-1] + 1) < len(steps):
            heapq.heappush(heap, (cost - steps[last - 1][0] + steps[last][0], (*chosen[:-1], last)))
            heapq.heappush(heap, (cost + steps[last][0], (*chosen, last)))


class Hasher:
    """The tables' projections; ``probes`` buckets of each are visited."""

    def __init__(self, dimension: int, width: float, probes: int, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.axes = rng.normal(size=(dimension, settings.tables * settings.functions)) / width
        self.shift = rng.random(settings.tables * settings.functions)
        self.odd = rng.integers(1 << 61, 1 << 62, settings.functions) | 1
        self.probes, self.settings = probes, settings
        self.reach = 0.0  # up to this distance the chance of meeting is that of settings.least

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, tables, functions): the steps' numbers, and the places inside them."""
        at = (x @ self.axes + self.shift).reshape(len(x), self.settings.tables, self.settings.functions)
        low = np.floor(at)
        return np.clip(low, -(2.0**40), 2.0**40).astype(np.int64), at - low

    def buckets(self, cells: np.ndarray) -> np.ndarray:
        """A non-negative number for each row and table."""
        with np.errstate(over="ignore"):
            h = (cells * self.odd).sum(-1) + np.arange(cells.shape[1]) * 0x5851F42D4C957F2D
            h ^= h >> 29
            h *= 0x3F58476D1CE4E5B9
            return (h ^ (h >> 32)) & 0x7FFFFFFFFFFFFFFF

    def visited(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each row, the buckets it visits as a query, over all tables."""
        cells, up = self.cells(x)
        out = []
        for c, u in zip(cells, up):
            own = []
            for t in range(len(c)):
                for moved in probe_order(u[t], self.probes):
                    there = c[t].copy()
                    for i, s in moved:
                        there[i] += s
                    own.append((t, there))
            rows = np.stack([r for _, r in own])
            tables = np.array([t for t, _ in own])
            spread = self.buckets(np.repeat(rows[:, None], len(c), 1))
            out.append(np.unique(spread[np.arange(len(tables)), tables]))
        return out


def fit(sample: np.ndarray, rows: int, settings: Settings) -> Hasher:
    """The hasher for a table of ``rows`` vectors, from a sample of them.

    The usual distance is a high quantile over the sample's first rows of that to the neighbour whose rank
    in the sample answers to the k-th in the table; pairs at that distance, in random directions, are
    hashed to find the fewest probes that meet enough of them.
    """
    rng = np.random.default_rng(settings.seed + 1)
    heads = sample[:200]
    d = np.sqrt(np.maximum(0, (heads**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * heads @ sample.T))
    rank = min(len(sample) - 1, max(1, round(settings.k * len(sample) / max(rows, 1))))
    usual = float(np.quantile(np.sort(d, 1)[:, rank], settings.usual)) or float(np.abs(sample).max()) or 1.0
    hasher = Hasher(sample.shape[1], settings.width * usual, 1, settings)
    towards = rng.normal(size=heads.shape)
    near = heads + usual * towards / np.linalg.norm(towards, axis=1, keepdims=True)
    cells, up = hasher.cells(heads)
    there, _ = hasher.cells(near)
    # The number of probes after which each pair has met, in its best table.
    first = np.full(len(heads), settings.most_probes + 1)
    for r in range(len(heads)):
        for t in range(settings.tables):
            gap = there[r, t] - cells[r, t]
            if np.abs(gap).max() > 1:
                continue
            wanted = {(i, int(s)) for i, s in enumerate(gap.tolist()) if s}
            for n, moved in enumerate(probe_order(up[r, t], int(first[r]) - 1), 1):
                if set(moved) == wanted:
                    first[r] = n
                    break
    hasher.probes = int(min(settings.most_probes, np.sort(first)[min(len(first) - 1, int(settings.wanted * len(first)))]))
    hasher.reach = _reach(hasher, heads, usual, rng)
    return hasher


def _reach(hasher: Hasher, heads: np.ndarray, usual: float, rng: np.random.Generator) -> float:
    """The largest distance, up to four usual ones, at which probes meet a neighbour with the least chance."""
    settings = hasher.settings
    cells, up = hasher.cells(heads)
    costs = np.zeros((len(heads), settings.tables, 1))
    for i in range(settings.functions):
        step = np.stack([np.zeros(up.shape[:2]), up[..., i] ** 2, (1 - up[..., i]) ** 2], -1)
        costs = (costs[..., None] + step[:, :, None]).reshape(*up.shape[:2], -1)
    last = np.sort(costs, 2)[..., min(hasher.probes, costs.shape[2]) - 1]
    towards = rng.normal(size=(8, *heads.shape))
    towards /= np.linalg.norm(towards, axis=2, keepdims=True)
    for far in np.geomspace(4, 1 / 16, 121).tolist():
        met = []
        for t in towards:
            gap = hasher.cells(heads + far * usual * t)[0] - cells
            cost = np.where(gap < 0, up**2, np.where(gap > 0, (1 - up) ** 2, 0)).sum(2)
            met.append(((np.abs(gap).max(2) <= 1) & (cost <= last + 1e-12)).any(1))
        if np.mean(met) >= settings.least:
            return far * usual
    return 0.0


def _best(query_ids, queries, ids, x, k):
    """(query row, id, distance) of each query's k nearest ids but its own, and their ties, in double precision.

    Rows that share an id are one, as near as their nearest: neither they nor the query's own rows take
    a place from others.
    """
    order = np.argsort(ids, kind="stable")
    ids, firsts = np.unique(ids[order], return_index=True)
    x = x[order]
    at = np.minimum(np.searchsorted(ids, query_ids), len(ids) - 1)
    own = ids[at] == query_ids
    out = []
    step = max(1, 2_000_000 // max(1, x.size))
    for a in range(0, len(queries), step):
        part = queries[a : a + step]
        d = np.sqrt(((part[:, None, :] - x[None]) ** 2).sum(2))
        if len(firsts) < len(x):
            d = np.minimum.reduceat(d, firsts, axis=1)
        mine = np.flatnonzero(own[a : a + step])
        d[mine, at[a : a + step][mine]] = np.inf
        if len(ids) > k:
            d = np.where(d <= np.partition(d, k - 1, 1)[:, k - 1 : k], d, np.inf)
        r, c = np.nonzero(d < np.inf)
        out.append((r + a, ids[c], d[r, c]))
    return tuple(np.concatenate(z) for z in zip(*out))


def _matrix(column) -> np.ndarray:
    """A column of little-endian doubles in binary as a matrix."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<f8").reshape(len(column), -1)


def nearest(vectors: DataFrame, is_query: Column, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the rows found nearest to each query row, from all rows.

    ``vectors`` has vec_id and embedding. Nearness is Euclidean distance in double precision on the
    original vectors, ties go to the smaller vec_id, and a row is no neighbour of its own id. Rows
    whose vec_id is null, or whose vector is null, zero or holds a null or non-finite component, take
    no part, nor do vectors that aren't of the most frequent length. Of rows that share a vec_id the
    nearest counts. A query with fewer candidates than k in the table gets them all.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & valid(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    kind = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], kind)
    dimension, n = sizes
    rows = rows.where(F.size("v") == dimension)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) <= 1_000_003 * min(1.0, 1.5 * settings.sample / n)).limit(settings.sample)
    sample = np.array([r.v for r in drawn.select("v").collect()] or [r.v for r in rows.select("v").limit(settings.sample).collect()])
    fitted = fit(sample, n, settings)
    shared = spark.sparkContext.broadcast(fitted)
    groups = max(1, -(-n * settings.tables // settings.group))

    def entries(queries: bool):
        def run(batches):
            import pyarrow as pa

            hasher = shared.value
            for whole in batches:
                for a in range(0, whole.num_rows, 1000 if not queries else 100):
                    batch = whole.slice(a, 1000 if not queries else 100)
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    own = hasher.visited(x) if queries else list(hasher.buckets(hasher.cells(x)[0]))
                    of = np.repeat(np.arange(len(x)), [len(o) for o in own])
                    bucket = np.concatenate(own)
                    data = pa.array([r.astype("<f8").tobytes() for r in x], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(bucket % groups), pa.array(bucket), batch.column(0).take(pa.array(of)), data.take(pa.array(of))], names=["g", "bucket", "id", "data"])

        return run

    entry = "g long, bucket long, id long, data binary"
    index = rows.select("vec_id", "v").mapInArrow(entries(False), entry)
    asked = rows.where("q").select("vec_id", "v").mapInArrow(entries(True), entry)
    large = rows.select("vec_id", "v").mapInArrow(entries(False), entry).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > 2 * settings.group)
    large = materialize(large.select("g", F.ceil(F.col("n") / settings.group).cast("int").alias("parts")), "ann-groups")
    one = F.coalesce("parts", F.lit(1))
    index = index.join(large, "g", "left").select("g", F.pmod(F.xxhash64("id"), one).cast("int").alias("part"), "bucket", "id", "data")
    asked = asked.join(large, "g", "left").select("g", F.explode(F.sequence(F.lit(0), one - 1)).alias("part"), "bucket", "id", "data")
    found_kind = "query_id long, vec_id long, score double"

    def meet(left, right):
        import pyarrow as pa

        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            left, right = left.sort_by("bucket"), right.sort_by("bucket")
            lb, rb = (t.column("bucket").to_numpy() for t in (left, right))
            lid, rid = (t.column("id").to_numpy() for t in (left, right))
            lx, rx = _matrix(left.column("data")), _matrix(right.column("data"))
            for b in np.unique(rb).tolist():
                i, j = np.searchsorted(lb, [b, b + 1])
                if i < j:
                    a, c = np.searchsorted(rb, [b, b + 1])
                    q, ids, d = _best(rid[a:c], rx[a:c], lid[i:j], lx[i:j], settings.k)
                    found.append((rid[a:c][q], ids, d))
        if not found:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _few(*(np.concatenate(z) for z in zip(*found)), settings.k)

    found = index.groupBy("g", "part").cogroup(asked.groupBy("g", "part")).applyInArrow(meet, found_kind)
    ranked = materialize(_ranked(found, settings.k), "ann-found")
    short = rows.where("q").select(F.col("vec_id").alias("query_id"), "v").join(ranked.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("far")), "query_id", "left").where((F.coalesce("n", F.lit(0)) < settings.k) | (F.col("far") > fitted.reach))
    parts = -(-short.count() // settings.scan)
    if not parts:
        return ranked
    more = None
    for p in range(parts):
        few = [(r.query_id, r.v) for r in short.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).select("query_id", "v").collect()]
        if few:
            one_part = _scan(rows, few, settings.k)
            more = one_part if more is None else more.union(one_part)
    kept = ranked.join(short.select("query_id"), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score")
    return kept.union(_ranked(more, settings.k))


def _few(query, ids, d, k):
    """Each query's k nearest and their ties, of entries that may repeat."""
    import pyarrow as pa

    order = np.lexsort((ids, d, query))
    query, ids, d = query[order], ids[order], d[order]
    again = np.zeros(len(query), bool)
    own = ids != query
    again[1:] = (query[1:] == query[:-1]) & (ids[1:] == ids[:-1])
    keep = own & ~again
    query, ids, d = query[keep], ids[keep], d[keep]
    if len(query):
        starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        query, ids, d = query[place < k], ids[place < k], d[place < k]
    return pa.table({"query_id": query, "vec_id": ids, "score": d})


def _scan(rows: DataFrame, queries: list, k: int) -> DataFrame:
    """Exact search for a bounded list of queries: each task's nearest, for all to be ranked."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        ids = np.array([i for i, _ in shared.value], np.int64)
        x = np.array([v for _, v in shared.value])
        for batch in batches:
            own = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for a in range(0, len(own), 2000):
                q, c, d = _best(ids, x, batch.column(0).to_numpy()[a : a + 2000], own[a : a + 2000], k)
                yield from _few(ids[q], c, d, k).to_batches()

    return rows.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows found for every row whose vec_id is divisible by 100."""
    from .common import read

    return nearest(read(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))
