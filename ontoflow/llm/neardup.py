"""MinHash near-duplicates: consistent weighted samples of TF-IDF shingles, banded and verified.

A text is the weighted set of its shingles of five words; a weight is (1 + ln tf) times a smoothed
idf. Document frequencies of the whole corpus are kept in a sketch of fixed size: counts by hash,
less the noise that other shingles bring to a cell on average. A cell's noise is a share of the
documents that doesn't grow with the corpus (a text of 600 shingles brings 0.06 % of one to each of
2^20 cells), far below the tenth from which a frequency lowers a weight. Improved consistent weighted sampling
draws samples that two texts share with the probability of their weighted Jaccard similarity; bands of
samples make buckets.

In each bucket every text meets the bucket's first text, and the pair is verified by its exact
weighted Jaccard similarity. Texts that aren't joined with the first one then meet each other and those
that are, in blocks of two parts of a bucket: in a task, samples are compared all with all, and likely
pairs, each in the first bucket that it shares, are verified where they are, those with the most
likely pairs first and only while they aren't joined. A block returns the links that join something,
fewer than it has texts: pairs are counted, never emitted. Links make classes by label propagation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, give_back, map_texts, materialize, text_batches, words


@dataclass(frozen=True)
class Settings:
    size: int = 5  # words in a shingle
    threshold: float = 0.8
    bands: int = 12
    rows: int = 3  # samples in a band
    cells_log2: int = 20  # of the frequency sketch
    rare: float = 0.1  # shingles in a smaller share of documents than this all have the largest idf
    unseen: int = 10_000  # documents that are taken to exist beside the corpus, so that a small one's copies don't weigh less
    likely: float = 0.55  # share of samples that makes a pair worth verifying inside a block
    block: int = 1000  # texts in a part of a bucket; a block holds two
    shingles: int = 1_000_000  # in a part, on average
    seed: int = 20

    @property
    def samples(self) -> int:
        return self.bands * self.rows


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return value


_HASHES = _Hashes()
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs; a shorter text is one shingle."""
    own = words(text)
    if not own:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(_HASHES) > 300_000:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, own), np.int64, len(own)).astype(np.uint64)
    width = min(size, len(h))
    total = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        total = total * _STEP + h[j : len(h) - width + 1 + j]
    return np.unique(_mix(total + np.uint64(width)), return_counts=True)


class Frequencies:
    """The corpus' document frequencies by hash cell, and the number of documents."""

    def __init__(self, cells: np.ndarray, documents: int, settings: Settings):
        self.shift = np.uint64(64 - settings.cells_log2)
        total = float(cells.sum())
        noise = (total - cells) / max(1, len(cells) - 1)
        often = np.maximum(1.0, cells - noise)
        most = 1 / settings.rare
        share = np.clip((documents + settings.unseen) / often, 1.0, most)
        self.weights = (1 + np.log(share) / np.log(most)).astype(np.float32)

    def weigh(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts)).astype(np.float32) * self.weights[(hashes >> self.shift).astype(np.int64)]


def count_frequencies(documents: DataFrame, settings: Settings) -> Frequencies:
    """One pass over all texts; tasks' sketches are summed in streams, and one sketch reaches the driver."""
    cells, part = 1 << settings.cells_log2, 1 << 12
    shift = np.uint64(64 - settings.cells_log2)

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        claim("neardup", _HASHES)
        own, n = np.zeros(cells, np.int64), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                found = [shingles(t, settings.size)[0] for t in batch.column(0).slice(a, 256).to_pylist()]
                n += sum(len(x) > 0 for x in found)
                own += np.bincount((np.concatenate(found) >> shift).astype(np.int64), minlength=cells)
        yield pa.RecordBatch.from_pydict({"part": pa.array([*range(cells // part), -1], pa.int32()), "spread": pa.array([TaskContext.get().partitionId() % 16] * (cells // part + 1), pa.int32()), "counts": [x.astype("<u4").tobytes() if x.max() < 1 << 32 else x.tobytes() for x in own.reshape(-1, part)] + [np.array([n], "<i8").tobytes()]})

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                x = np.frombuffer(data, "<u4" if key >= 0 and len(data) == part * 4 else "<i8").astype(np.int64)
                sums[key] = sums[key] + x if key in sums else x
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "spread": pa.array([0] * len(sums), pa.int32()), "counts": pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())})

    text_batches(documents.sparkSession)
    kind = "part int, spread int, counts binary"
    rows = documents.select("text").mapInArrow(count, kind).repartition("part", "spread").mapInArrow(add, kind).repartition("part").mapInArrow(add, kind).collect()
    total, n = np.zeros((cells // part, part), np.int64), 0
    for r in rows:
        if r.part < 0:
            n = int(np.frombuffer(r.counts, "<i8")[0])
        else:
            total[r.part] = np.frombuffer(r.counts, "<i8")
    return Frequencies(total.reshape(-1), n, settings)


class Sampler:
    """Improved consistent weighted samples; the random variables of a shingle come from tables.

    Shingles that share a table's entry share its variables, in both texts of a pair alike; only the
    heaviest of them can be drawn, so that texts of far more than 65,536 shingles are compared by a
    part of them. Every pair is verified by all shingles.
    """

    def __init__(self, settings: Settings, table_log2: int = 16):
        rng = np.random.default_rng(settings.seed)
        shape = (settings.samples, 1 << table_log2)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.beta = rng.random(shape, np.float32)
        self.odd = (rng.integers(0, 1 << 63, settings.samples, np.uint64) << np.uint64(1)) | np.uint64(1)
        self.shift = np.uint64(64 - table_log2)
        self.settings = settings
        #: Most shingles occur once and are rare: what the formulas give for their weight is looked up.
        self.usual = np.float32(np.log(np.float32(2)))
        self.usual_log_a = self._log_a(self.usual, self.r, self.log_c, self.beta)

    @staticmethod
    def _log_a(log_s, r, log_c, beta):
        return log_c - r * (np.floor(log_s / r + beta) - beta + np.float32(1))

    def samples(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row of sample hashes for each non-empty weighted set (hashes ascending, weights)."""
        hashes = np.concatenate([h for h, _ in sets])
        log_s = np.log(np.concatenate([w for _, w in sets])).astype(np.float32)
        sizes = np.array([len(h) for h, _ in sets])
        starts = np.cumsum(sizes) - sizes
        other = np.flatnonzero(log_s != self.usual)
        out = np.empty((len(sets), self.settings.samples), np.uint64)
        for i in range(self.settings.samples):
            at = ((hashes * self.odd[i]) >> self.shift).astype(np.int32)
            log_a = self.usual_log_a[i].take(at)
            few = at[other]
            log_a[other] = self._log_a(log_s[other], self.r[i, few], self.log_c[i, few], self.beta[i, few])
            hit = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, starts), sizes))
            of = np.searchsorted(starts, hit, "right")
            first = hit[np.concatenate([[True], of[1:] != of[:-1]])]
            t = np.floor(log_s[first] / self.r[i, at[first]] + self.beta[i, at[first]])
            out[:, i] = _mix(hashes[first] + t.astype(np.int64).astype(np.uint64) * _STEP)
        return out

    def buckets(self, samples: np.ndarray) -> np.ndarray:
        s = self.settings
        total = np.zeros((len(samples), s.bands), np.uint64) + np.arange(1, s.bands + 1, dtype=np.uint64)
        for j in range(s.rows):
            total = _mix(total * _STEP + samples[:, j :: s.rows])
        return total


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets with ascending hashes."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).astype(np.float64).sum())
    total = float(a[1].astype(np.float64).sum() + b[1].astype(np.float64).sum()) - shared
    return shared / total if total > 0 else 0.0


def _signatures(documents: DataFrame, shared, settings: Settings) -> DataFrame:
    """key (of the text), buckets, samples and number of shingles of every text with words."""

    def make():
        sampler, frequencies = Sampler(settings), shared.value

        def compute(texts):
            sets = [(h, frequencies.weigh(h, n)) for h, n in (shingles(t, settings.size) for t in texts)]
            some = [k for k, (h, _) in enumerate(sets) if len(h)]
            buckets: list = [None] * len(texts)
            samples: list = [None] * len(texts)
            sizes = [len(h) for h, _ in sets]
            if some:
                drawn = sampler.samples([sets[k] for k in some])
                for k, b, s in zip(some, sampler.buckets(drawn).view(np.int64).tolist(), (drawn >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()):
                    buckets[k], samples[k] = b, s
            return buckets, samples, sizes

        return compute

    rows = documents.where("text IS NOT NULL").withColumn("_key", F.md5("text"))
    return map_texts(rows, ["_key"], [("buckets", "array<bigint>"), ("samples", "array<int>"), ("size", "long")], make, owner="neardup", kept=(_HASHES,)).where("buckets IS NOT NULL").dropDuplicates(["_key"])


def _verified(pairs: DataFrame, texts: DataFrame, shared, settings: Settings) -> DataFrame:
    """``pairs`` (a, b) with whether each is similar enough."""

    def compare(batches):
        import pyarrow as pa

        claim("neardup", _HASHES)
        frequencies = shared.value
        held: dict[str, tuple] = {}

        def weighted(key, text):
            if key not in held:
                if len(held) > 8:
                    held.clear()
                h, n = shingles(text, settings.size)
                held[key] = h, frequencies.weigh(h, n)
            return held[key]

        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                a, b, s, t = (whole.column(c).slice(k, 256).to_pylist() for c in range(4))
                good = [similarity(weighted(x, u), weighted(y, v)) >= settings.threshold for x, y, u, v in zip(a, b, s, t)]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(good, pa.bool_())], names=["a", "b", "similar"])
        give_back()

    first, second = (texts.select(F.col("_key").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a string, b string, similar boolean")


def _blocks(rows: DataFrame, settings: Settings) -> DataFrame:
    """``rows`` (bucket, key, apart, size, ...) with part and block (i, j): pairs of parts of their bucket.

    Rows that aren't apart are all joined with each other: no block is made of those alone.
    """
    sums = [F.count_if("apart").alias("n"), F.count_if(~F.col("apart")).alias("m"), F.sum(F.when(F.col("apart"), F.col("size")).otherwise(0)).alias("ns"), F.sum(F.when(F.col("apart"), 0).otherwise(F.col("size"))).alias("ms")]
    sized = rows.join(rows.groupBy("bucket").agg(*sums).where("n > 0 AND n + m > 1"), "bucket")
    parts = lambda n, size: F.greatest(F.ceil(F.col(n) / settings.block), F.ceil(F.col(size) / settings.shingles)).cast("int")
    whole = (F.col("n") + F.col("m") <= settings.block) & (F.col("ns") + F.col("ms") <= settings.shingles)
    here = whole | F.col("apart")
    own, others = F.when(whole, 1).otherwise(parts("n", "ns")), F.when(whole, 0).otherwise(parts("m", "ms"))
    part = F.when(here, F.pmod(F.xxhash64("key"), own)).otherwise(own + F.pmod(F.xxhash64("key"), F.greatest(others, F.lit(1)))).cast("int")
    sized = sized.withColumn("part", part).withColumn("ends", F.sequence(F.lit(0), F.when(here, own + others).otherwise(own) - 1))
    pair = F.transform("ends", lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    return sized.withColumn("block", F.explode(pair)).drop("n", "m", "ns", "ms", "ends")


class _Block:
    """The texts of a block, and which of them are likely alike and meet here first."""

    def __init__(self, table, settings: Settings):
        table = table.drop_duplicates("key").sort_values("key")
        self.table, self.n = table, len(table)
        self.samples, self.buckets, self.part = np.stack(table.samples.to_numpy()), np.stack(table.buckets.to_numpy()), table.part.to_numpy()
        self.band = int(np.flatnonzero(self.buckets[0] == table.bucket.iloc[0])[0])
        self.two = self.part.min() < self.part.max()
        self.root = np.unique(table.label.to_numpy(), return_inverse=True)[1]
        self.least = settings.likely * settings.samples

    def likely(self, k: int) -> np.ndarray:
        """The texts that aren't joined with text k, are likely alike, and share no earlier bucket with it."""
        open_ = self.root != self.root[k]
        if self.two:
            open_ &= self.part != self.part[k]
        other = np.flatnonzero(open_)
        other = other[(self.samples[other] == self.samples[k]).sum(1) >= self.least]
        if self.band and len(other):
            other = other[~(self.buckets[other, : self.band] == self.buckets[k, : self.band]).any(1)]
        return other

    def join(self, a: int, b: int) -> None:
        self.root[self.root == self.root[b]] = self.root[a]


def _some_likely(table, settings: Settings):
    """The texts of a block that have a likely pair in it: bucket, block, key."""
    block = _Block(table, settings)
    return block.table[[len(block.likely(k)) > 0 for k in range(block.n)]][["bucket", "block", "key"]]


def _joining_links(table, weigh, settings: Settings):
    """(a, b): similar texts of a block that join what isn't joined; ``table`` has their texts."""
    import pandas as pd

    block = _Block(table, settings)
    sets = [shingles(t, settings.size) for t in block.table.text]
    weights = [weigh(h, n).astype(np.float64) for h, n in sets]
    sizes = np.array([len(h) for h, _ in sets])
    codes = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)[1]
    codes = np.split(codes, np.cumsum(sizes)[:-1])
    total = np.array([w.sum() for w in weights])
    dense = np.zeros(max(int(c.max()) for c in codes) + 1)
    keys = block.table.key.tolist()
    links = []
    # The text that many were made from goes before those: it joins them at once.
    for k in np.argsort([-len(block.likely(k)) for k in range(block.n)], kind="stable").tolist():
        other = block.likely(k)
        if not len(other):
            continue
        dense[codes[k]] = weights[k]
        shared = np.minimum(dense[np.concatenate([codes[o] for o in other])], np.concatenate([weights[o] for o in other]))
        shared = np.add.reduceat(shared, np.cumsum(sizes[other]) - sizes[other])
        dense[codes[k]] = 0
        for o in other[shared >= settings.threshold * (total[k] + total[other] - shared)].tolist():
            if block.root[o] != block.root[k]:
                block.join(k, o)
                links.append((keys[k], keys[o]))
    return pd.DataFrame(links, columns=["a", "b"], dtype=object)


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label): the smallest node of each node's component, over the nodes of ``edges`` (a, b).

    Rounds of taking the smallest label around and then the label's label, until nothing changes.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().toDF("node", "other"), f"{name}-edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), name)
    while True:
        around = both.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        nearer = labels.join(around, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jumped = nearer.join(labels.toDF("label", "far"), "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "was")
        step = materialize(jumped, name)
        labels = step.select("node", "label")
        if step.where("label <> was").isEmpty():
            return labels


def near_duplicate_classes(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(_key, _class) of every distinct text that is like another: texts are keyed by their MD5.

    Classes are the connected components of the verified links; a class is named by its smallest key.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(count_frequencies(documents, settings))
    signed = materialize(_signatures(documents, shared, settings), "signatures")
    member = signed.select(F.explode("buckets").alias("bucket"), F.col("_key").alias("key"))
    leaders = member.groupBy("bucket").agg(F.min("key").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = materialize(member.join(leaders, "bucket").where("key <> leader").select("bucket", "key", "leader"), "members")
    pairs = materialize(met.select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("_key")).union(met.select("leader")).distinct()
    texts = documents.where("text IS NOT NULL").select(F.md5("text").alias("_key"), "text").join(wanted, "_key", "left_semi").groupBy("_key").agg(F.first("text").alias("text"))
    texts = materialize(texts, "texts")
    first = materialize(_verified(pairs, texts, shared, settings), "verified")
    links = first.where("similar").select("a", "b")
    classes = components(links, "classes")
    # First texts have met their buckets. A bucket in which all are joined with its first has no open pair.
    rows = met.join(classes.toDF("key", "label"), "key", "left").join(classes.toDF("leader", "first"), "leader", "left")
    rows = rows.select("bucket", "key", F.coalesce("label", "key").alias("label"), F.coalesce("first", "leader").alias("first"))
    rows = materialize(rows.select("bucket", "key", "label", (F.col("label") != F.col("first")).alias("apart")), "members-labels")
    open_ = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("apart").alias("m")).where("m > 0 AND n > 1").select("bucket")
    signs = signed.select(F.col("_key").alias("key"), "samples", "buckets", "size")
    wide = materialize(_blocks(rows.join(open_, "bucket", "left_semi").join(signs, "key"), settings), "blocks")
    kind = f"bucket bigint, block {wide.schema['block'].dataType.simpleString()}, key string"
    chosen = materialize(wide.groupBy("bucket", "block").applyInPandas(lambda t: _some_likely(t, settings), kind), "likely")

    def verify(table):
        claim("neardup", _HASHES)
        return _joining_links(table, shared.value.weigh, settings)

    held = wide.join(chosen, ["bucket", "block", "key"], "left_semi").join(texts.toDF("key", "text"), "key")
    more = materialize(held.groupBy("bucket", "block").applyInPandas(verify, "a string, b string"), "more-links")
    if not more.isEmpty():
        classes = components(links.union(more), "classes")
    return classes.toDF("_key", "_class")


#: Copies of a text that meet its class in one task; more are dealt to several.
_COPIES = 1000


def _text_classes(documents: DataFrame, settings: Settings) -> DataFrame:
    """(_key, _class, _first, _n) of every distinct non-null text: the key its class goes by, smallest doc_id, copies."""
    from_text = near_duplicate_classes(documents, settings)
    texts = documents.where("text IS NOT NULL").groupBy(F.md5("text").alias("_key")).agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n"))
    texts = texts.join(from_text, "_key", "left").withColumn("_class", F.coalesce("_class", "_key"))
    return texts.select("_key", "_class", "_first", "_n")


def classify(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id and class_id of every row: the smallest doc_id among the texts of its class.

    Equal texts are a class, and so are texts that chains of links of weighted Jaccard similarity
    ``threshold`` or more join. A text that is null or has no words is a class of its own unless it
    equals another non-null text. Rows with a null doc_id get their class's id, if any doc_id is known.
    Rows that repeat are each returned, an empty table gives none, and other columns aren't read.
    Copies of one text are dealt to several tasks where they are many, each with its text's class.
    """
    texts = materialize(_text_classes(documents, settings), "text-classes")
    named = texts.groupBy("_class").agg(F.min("_first").alias("class_id"))
    parts = F.ceil(F.col("_n") / _COPIES).cast("int")
    by_text = texts.join(named, "_class").select("_key", "class_id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    # Written first: while texts with so many copies are few, the planner sees its size and broadcasts it.
    often = materialize(texts.where(F.col("_n") > _COPIES).select("_key", parts.alias("_parts")), "often")
    rows = documents.select("doc_id", F.md5("text").alias("_key")).join(often, "_key", "left")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.coalesce("_parts", F.lit(1))).cast("int"))
    return rows.join(by_text, ["_key", "_part"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``documents``, all columns, one for each class: that of the smallest doc_id.

    A class in which no doc_id is known keeps the row of its smallest text key. Of rows that repeat
    one doc_id and text, one stays. Rows with a null text all stay; an empty table stays empty. Columns
    may have any name.
    """
    texts = materialize(_text_classes(documents, settings), "text-classes")
    # Null ids come last: a struct orders by its first field, and false is less than true.
    first = texts.groupBy("_class").agg(F.min(F.struct(F.col("_first").isNull().alias("n"), F.col("_first").alias("i"), F.col("_key").alias("k"))).alias("m"))
    kept = first.select(F.col("m.k").alias("k"), F.col("m.i").alias("i"))
    rows = documents.where("text IS NOT NULL").select(F.md5("text").alias("k"), F.col("doc_id").alias("i"), F.struct(*[documents[c] for c in documents.columns]).alias("row"))
    # By id as well, so that the copies of a text aren't brought to one task.
    chosen = rows.join(kept, (rows.k == kept.k) & rows.i.eqNullSafe(kept.i)).select(rows.k, "row").dropDuplicates(["k"])
    return chosen.select("row.*").union(documents.where("text IS NULL"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near-duplicates."""
    from .common import read

    return classify(read(spark, sf_dir, "documents"))
