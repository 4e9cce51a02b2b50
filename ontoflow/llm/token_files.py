"""Token ids as binary shards: frequency-ranked ids in byte-aligned variable-length coding.

A shard is a run of blocks, each of whole documents and decoded on its own:

    4 bytes "OTK2", then little-endian u32: documents, ids, distinct ids, data bytes
    i64 doc_id x documents, u8 null flag x documents, u32 id count x documents
    u32 distinct ids by falling frequency in the block (the rank table)
    ceil(ids / 4) control bytes, each with four 2-bit lengths (1 to 4 bytes), low bits first
    the data bytes: ranks, little-endian
    a line feed

Shards are written by Spark's text sink, a block a row, and read as binary files, so that any Hadoop
file system, the commit protocol and the repetition of tasks are Spark's own business.

Ranks are taken per block, so that one pass suffices and a block needs nothing outside itself. All
256 control bytes are known in advance; a numpy table turns them into lengths, and four gathers into
ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

MAGIC = b"OTK2"
_HEAD = struct.Struct("<4sIIII")
#: Lengths of the four values that a control byte describes.
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode_block(doc_ids: list[int | None], counts: np.ndarray, values: np.ndarray) -> bytes:
    """One block of whole documents: their ids in a row, and how many each has."""
    if len(values) and int(values.max()) < 1 << 22:
        often = np.bincount(values)
        distinct = np.flatnonzero(often)
        order = np.lexsort((distinct, -often[distinct]))
        rank = np.zeros(len(often), "<u4")
        rank[distinct[order]] = np.arange(len(distinct), dtype=np.uint32)
        ranks = rank[values]
    else:
        distinct, inverse, often = np.unique(values, return_inverse=True, return_counts=True)
        order = np.lexsort((distinct, -often))
        rank = np.zeros(len(distinct), "<u4")
        rank[order] = np.arange(len(distinct), dtype=np.uint32)
        ranks = rank[inverse.reshape(-1)]
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    four = padded.reshape(-1, 4)
    control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8)
    used = np.arange(4, dtype=np.uint8) <= extra[:, None]
    data = ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()
    return b"".join((
        _HEAD.pack(MAGIC, len(doc_ids), len(ranks), len(distinct), len(data)),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        bytes(x is None for x in doc_ids),
        counts.astype("<u4").tobytes(),
        distinct[order].astype("<u4").tobytes(),
        control.tobytes(),
        data,
    ))


def decode_blocks(data) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every document of a shard's bytes, in its order, a block at a time."""
    data, at = memoryview(data), 0
    while at < len(data):
        magic, docs, n, distinct, size = _HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at += _HEAD.size
        body = data[at : at + docs * 13 + distinct * 4 + -(-n // 4) + size]
        at += len(body) + 1
        doc_ids = np.frombuffer(body, "<i8", docs)
        nulls = np.frombuffer(body, np.uint8, docs, docs * 8)
        counts = np.frombuffer(body, "<u4", docs, docs * 9)
        table = np.frombuffer(body, "<u4", distinct, docs * 13)
        control = docs * 13 + distinct * 4
        lengths = _LENGTHS[np.frombuffer(body, np.uint8, -(-n // 4), control)].reshape(-1)[:n]
        coded = np.frombuffer(body, np.uint8, size, control + -(-n // 4))
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        ranks = coded[starts].astype(np.uint32)
        for k in (1, 2, 3):
            if len(more := np.flatnonzero(lengths > k)):
                ranks[more] |= coded[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
        ids = table[ranks] if n else table[:0]
        ends = np.cumsum(counts, dtype=np.int64)
        for doc_id, null, a, b in zip(doc_ids.tolist(), nulls.tolist(), (ends - counts).tolist(), ends.tolist()):
            yield (None if null else doc_id), ids[a:b]


def write_shards(documents: DataFrame, folder: str, vocabulary: str, *, end_id: int = 1, block_ids: int = 2_000_000) -> None:
    """Tokenizes every text, adds ``end_id`` to each document, and writes shards in ``folder``.

    Shards ascend by doc_id (nulls first) with their number, as do the documents in them; rows that
    repeat are all written, an empty table gives no block, and other columns aren't read. A null text
    counts as empty. A task holds one block of ``block_ids`` ids (or one longer document).
    """
    from .common import text_batches

    text_batches(documents.sparkSession)
    by_id = documents.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches):
        import pyarrow as pa

        from .common import give_back, slices, tokenizer

        doc_ids, counts, values, pending = [], [], [], 0

        def block():
            return pa.RecordBatch.from_pydict({"block": pa.array([encode_block(doc_ids, np.concatenate(counts), np.concatenate(values))], pa.binary())})

        for part in slices(batches, 1):
            ids, ends = tokenizer(vocabulary).encode(part.column(1))
            doc_ids += part.column(0).to_pylist()
            counts.append(np.diff(ends, prepend=0) + 1)
            values.append(np.insert(ids, ends, end_id).astype("<u4"))
            pending += len(values[-1])
            if pending >= block_ids:
                yield block()
                doc_ids, counts, values, pending = [], [], [], 0
        if doc_ids:
            yield block()
        give_back()

    by_id.mapInArrow(write, "block binary").select(F.col("block").cast("string").alias("value")).write.text(folder)


def read_shards(spark: SparkSession, folder: str, *, with_ids: bool = True) -> DataFrame:
    """Every document of the shards in ``folder``: doc_id, start, n_tokens, ids_crc32 and, where asked, ids (u32 bytes).

    ``start`` counts the ids of all documents before it. Shards without documents add nothing. What
    is collected is a number for each shard.
    """
    kind = "shard int, doc_id long, local long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    kinds = [("shard", "int32"), ("doc_id", "int64"), ("local", "int64"), ("n_tokens", "int64"), ("ids_crc32", "int64"), ("ids", "binary")][: 6 if with_ids else 5]

    def decode(batches):
        import pyarrow as pa

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, getattr(pa, t)()) for c, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

        for batch in batches:
            for k, shard in enumerate(batch.column(0).to_pylist()):
                rows: list[tuple] = []
                start = held = 0
                for doc_id, ids in decode_blocks(batch.column(1)[k].as_buffer()):
                    data = ids.astype("<u4").tobytes()
                    rows.append((shard, doc_id, start, len(ids), zlib.crc32(data), data)[: len(kinds)])
                    start += len(ids)
                    held += len(data)
                    if len(rows) == 5000 or with_ids and held > 16_000_000:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    number = F.regexp_extract("path", r"part-([0-9]+)[^/]*$", 1).cast("int")
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select(number.alias("shard"), "content")
    found = files.mapInArrow(decode, kind)
    found = found if with_ids else materialize(found, "token-places")
    totals, before = [], 0
    for shard, n in sorted(map(tuple, found.groupBy("shard").agg(F.sum("n_tokens")).collect())):
        totals.append((shard, before))
        before += n
    import pyarrow as pa

    # An Arrow table becomes a local relation, whose size the planner knows.
    numbers = list(zip(*totals)) or [(), ()]
    starts = spark.createDataFrame(pa.table([pa.array(numbers[0], pa.int32()), pa.array(numbers[1], pa.int64())], names=["shard", "before"]))
    return found.join(starts, "shard").select("doc_id", (F.col("before") + F.col("local")).alias("start"), *(n for n, _ in kinds[3:]))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards of all documents, reads them back and returns each document's place and digest."""
    from .common import read, shared_dir, vocabulary_path

    folder = shared_dir(spark, "tokens")
    write_shards(read(spark, sf_dir, "documents"), folder, vocabulary_path())
    return read_shards(spark, folder, with_ids=False)
