"""Benchmark decontamination: FM-indexes over training shards, searched for test phrases.

A shard is a batch of documents in a task. Its index text is made of the runs of words that occur in
some phrase and are long enough to hold one; any other word can't lie in an occurrence, and a run's
end is a separator. All phrases are searched backwards together through wavelet ranks, their
occurrences are located by sampled suffix positions, and the spans of a document are merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from itertools import repeat

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, give_back, slices, text_batches, words
from .fm_index import FMIndex


class Phrases:
    """The windows of the benchmark's items: ``window`` words, or the whole of a shorter item.

    Distinct windows are the rows of one matrix, about 40 bytes each; whose they are is an array too.
    """

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self._names: list[str] = []
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)]
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int32)
            if not len(ids):
                continue
            short = max(0, window - len(ids))
            rows.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([ids, np.zeros(short, np.int32)]), window).copy())
            owners.append(np.full(len(rows[-1]), len(self._names) if item is not None else -1, np.int32))
            if item is not None:
                self._names.append(str(item))
        every = np.concatenate(rows)
        del rows
        order = np.lexsort(every.T[::-1])
        every = every[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]).any(1)
        self.matrix = every[new]
        self.lengths = (self.matrix > 0).sum(1)
        self.shortest = int(self.lengths.min()) if len(self.matrix) else 0
        self._owners = np.concatenate(owners)[order]
        self._firsts = np.append(np.flatnonzero(new), len(every))

    def items(self, phrase: int) -> set[str]:
        """The items, by their ids as strings, that have a window."""
        own = self._owners[self._firsts[phrase] : self._firsts[phrase + 1]]
        return {self._names[k] for k in own.tolist() if k >= 0}


def search_shard(texts: Iterable[str | None], phrases: Phrases) -> list[tuple[int, int, list[str], list[tuple[int, int]]]]:
    """Of each text: words, words hit, the items found (sorted), and the merged spans of words hit."""
    get, least = phrases.vocabulary.get, phrases.shortest
    counts, pieces, owners, places = [], [], [], []
    for k, text in enumerate(texts):
        own = words(text)
        counts.append(len(own))
        if not least or len(own) < least:
            continue
        ids = np.array(list(map(get, own, repeat(0))), np.int32)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]]).astype(np.int8)))
        for a, b in edges.reshape(-1, 2)[np.diff(edges.reshape(-1, 2)).reshape(-1) >= least].tolist():
            pieces += [ids[a:b], _ZERO]
            owners.append((k, b - a))
            places.append(a)
    spans: list[list[tuple[int, int]]] = [[] for _ in counts]
    items: list[set[str]] = [set() for _ in counts]
    if pieces:
        runs = np.array([n + 1 for _, n in owners])
        starts = np.cumsum(runs) - runs
        doc_of_run = np.array([k for k, _ in owners])
        index = FMIndex(np.concatenate(pieces).astype(np.int64))
        low, high = index.search(phrases.matrix, phrases.lengths)
        hit = np.flatnonzero(high > low)
        often = (high - low)[hit]
        phrase = np.repeat(hit, often)
        rows = np.repeat(low[hit] - (np.cumsum(often) - often), often) + np.arange(int(often.sum()))
        at = index.locate(rows)
        run = np.searchsorted(starts, at, "right") - 1
        doc = doc_of_run[run]
        for d, p in np.unique(np.stack([doc, phrase]), axis=1).T.tolist() if len(doc) else []:
            items[d] |= phrases.items(p)
        cover = np.zeros(index.size + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + phrases.lengths[phrase], -1)
        covered = np.cumsum(cover) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered]).astype(np.int8))).reshape(-1, 2)
        run = np.searchsorted(starts, edges[:, 0], "right") - 1
        first = edges[:, 0] - starts[run] + np.array(places)[run]
        for d, a, n in zip(doc_of_run[run].tolist(), first.tolist(), (edges[:, 1] - edges[:, 0]).tolist()):
            spans[d].append((a, a + n))
    return [(n, sum(b - a for a, b in s), sorted(i), s) for n, s, i in zip(counts, spans, items)]


_ZERO = np.zeros(1, np.int32)
#: The phrases that a worker has last searched for, by their broadcast.
_PHRASES: dict[tuple[str, int], Phrases] = {}


class _Shared:
    """A broadcast with a name that is its own in every session."""

    def __init__(self, broadcast):
        self.id, self._broadcast = uuid.uuid4().hex, broadcast

    @property
    def value(self):
        return self._broadcast.value

_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def _phrases(shared: _Shared, window: int) -> Phrases:
    """The worker's phrases; made once, not by every task."""
    claim("decontamination", _PHRASES)
    if (shared.id, window) not in _PHRASES:
        _PHRASES.clear()
        _PHRASES[shared.id, window] = Phrases(shared.value, window)
    return _PHRASES[shared.id, window]


def find_passages(documents: DataFrame, benchmark: DataFrame, *, keep: Iterable[str] = ("doc_id",), window: int = 10, result: str = "found", most_benchmark_bytes: int = 16_000_000) -> DataFrame:
    """The columns ``keep`` of every document, and a struct: n_words, n_hit, items, spans.

    A word is hit if it lies in an occurrence of a window of ``window`` consecutive words of an item,
    or of the whole of a shorter item; spans are merged, of word numbers, the end exclusive. Items are
    the ids, as sorted strings, of all that have an occurring window; an item with a null id counts
    for the words hit only. Null and empty texts have no words. Repeated rows are searched each, an empty
    table gives none, and columns may have any name. The benchmark goes to every task if its texts have at
    most ``most_benchmark_bytes`` bytes (some 400 MB of windows at the default); a larger one is searched
    in that many parts, in a pass each, and the parts' spans are merged. A shard is a run of documents of
    about eight megabytes of text, or one longer document.
    """
    spark = documents.sparkSession
    keep = list(keep)
    texts = benchmark.select("item_id", "text").where("text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // most_benchmark_bytes) or 1
    if parts == 1:
        return _pass(spark, documents, keep, texts.collect(), window, result)
    row = "_row"
    while row in documents.columns:
        row = f"_{row}"
    numbered = documents.withColumn(row, F.monotonically_increasing_id())
    out = None
    for k in range(parts):
        items = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        one = _pass(spark, numbered, [*keep, row], items, window, result)
        out = one if out is None else out.unionByName(one)
    kept = F.first(F.struct(*[F.col(c) for c in keep])).alias("kept")
    f = F.col(result)
    parts = [F.first(f["n_words"]).alias("n"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(f["items"])))).alias("i"), F.sort_array(F.flatten(F.collect_list(f["spans"]))).alias("s")]
    grouped = out.groupBy(row).agg(kept, *parts).select("kept", "n", "i", "s")
    merged = F.expr(
        "aggregate(s, cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) -> IF(size(a) > 0 AND x.start <= element_at(a, -1).end,"
        " concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))), concat(a, array(x))))"
    )
    grouped = grouped.withColumn("s", merged)
    hit = F.expr("aggregate(s, 0L, (n, x) -> n + x.end - x.start)")
    return grouped.select("kept.*", F.struct(F.col("n").alias("n_words"), hit.alias("n_hit"), F.col("i").alias("items"), F.col("s").alias("spans")).alias(result))


def _pass(spark, documents, keep, items, window, result):
    shared = _Shared(spark.sparkContext.broadcast([(r[0], r[1]) for r in items]))
    text_batches(spark)
    at = keep.index("text") if "text" in keep else len(keep)
    chosen = documents.select(*keep) if "text" in keep else documents.select(*keep, F.col("text").alias("_searched"))
    schema = T.StructType([*documents.select(*keep).schema.fields, T.StructField(result, _FOUND)])

    def search(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        phrases = _phrases(shared, window)
        kind = to_arrow_type(_FOUND)
        for batch in slices(batches, at, 8_000_000):
            texts = batch.column(at)
            found = search_shard((x.as_py() for x in texts), phrases)
            column = pa.array([{"n_words": n, "n_hit": h, "items": i, "spans": [{"start": a, "end": b} for a, b in s]} for n, h, i, s in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], column], names=schema.names)
        give_back()

    return chosen.mapInArrow(search, schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark, windows of ten words."""
    from .common import read

    found = find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
phrases AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
windows AS (SELECT rn, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (
  SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)),
hits AS (SELECT rn, n, i, item_id FROM windows JOIN phrases USING (n, p)),
places AS (SELECT rn, count(DISTINCT j) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT rn, i, n FROM hits)) GROUP BY rn),
items AS (SELECT rn, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rn) LEFT JOIN items USING (rn)
"""
