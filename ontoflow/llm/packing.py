"""Order-preserving packing: documents in a row, cut into sequences by dynamic programming.

Cuts fall at document ends, sentence ends or, where those are too far apart, at any id. A sequence
costs its padding, a cut inside a document a penalty (less at a sentence's end). With ``pos`` the id
position of boundary j, the cost of ending a sequence at j is

    best[j] = penalty[j] + pos-free part + min over i with pos[j] - pos[i] <= size of best[i] + ...

Padding is ``size - (pos[j] - pos[i])``, so the minimum of ``best[i] + pos[i]`` over a sliding window
serves every j: a monotone queue finds it in constant time. A sequence whose length is a power of two
needs no padding; those few predecessors are looked up by position.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np

from pyspark.sql import DataFrame, SparkSession

DOCUMENT, SENTENCE, INSIDE = 0, 1, 2


def choose_cuts(positions: list[int], kinds: list[int], size: int, penalties: tuple[int, int, int], worth: int | None = None) -> tuple[list[int], int]:
    """The boundaries, as indexes of ``positions``, at which sequences end, and the total cost.

    ``positions`` ascend from 0, without gaps over ``size``; the last is always a cut, free of penalty.
    Lengths that are powers of two are tried where the best other predecessor leaves more padding than
    ``worth`` (a 64th of the size; -1 tries them everywhere, for the exact optimum).
    """
    n = len(positions)
    best, before = [0] * n, [-1] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    powers = [1 << k for k in range(size.bit_length()) if 1 << k < size]
    at = dict(zip(positions, range(n)))
    worth = size // 64 if worth is None else worth
    for j in range(1, n):
        p = positions[j]
        least = p - size
        while positions[queue[0][1]] < least:
            queue.popleft()
        cost, i = queue[0]
        cost += size - p
        if positions[i] - least > worth:
            for w in powers:
                if (k := at.get(p - w, -1)) >= 0 and best[k] < cost:
                    cost, i = best[k], k
        cost += penalties[kinds[j]] if j < n - 1 else 0
        best[j], before[j] = cost, i
        key = cost + p
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(j)
        j = before[j]
    return cuts[::-1], best[-1] if n else 0


def boundaries(ends: np.ndarray, sentence: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Positions and kinds of the places to cut: document ends, sentence ends, and single ids in gaps.

    Between neighbours over ``size // 8`` apart, and before a document's end, the places that let a
    sequence be filled are added: every ``size // 32`` ids, as cuts inside a sentence.
    """
    total = int(ends[-1]) if len(ends) else 0
    kind = np.full(total + 1, 255, np.uint8)
    kind[sentence] = SENTENCE
    kind[0] = kind[ends] = DOCUMENT
    places = np.flatnonzero(kind != 255)
    wide = np.flatnonzero(np.diff(places) > size // 8)
    step = max(1, size // 32)
    for a in wide.tolist():
        inner = np.arange(places[a] + step, places[a + 1], step)
        kind[inner] = INSIDE
    places = np.flatnonzero(kind != 255)
    return places.tolist(), kind[places].tolist()


class Packer:
    """Packs a stream of (doc_id, ids) in its order; ``take`` and ``finish`` yield the pieces.

    A piece is (doc_id, start, length, crc32, doc_tokens, sequence, offset, ids). Once ``hold`` ids
    wait, all their sequences but the last leave; its ids go on to the next round, so that memory is
    bounded by ``hold`` and the longest document.
    """

    def __init__(self, size: int, penalties: tuple[int, int, int], hold: int = 1 << 20):
        self.size, self.penalties, self.hold = size, penalties, hold
        self.sequence = 0
        self._docs: list[list] = []  # doc_id, its number of ids, ids already packed, the rest, sentence ends in the rest
        self._waiting = 0

    def take(self, doc_id, ids: bytes, sentence_ends: np.ndarray) -> Iterator[tuple]:
        n = len(ids) // 4
        if not n:
            return
        self._docs.append([doc_id, n, 0, ids, sentence_ends])
        self._waiting += n
        if self._waiting >= self.hold:
            yield from self._pack(False)

    def finish(self) -> Iterator[tuple]:
        if self._waiting:
            yield from self._pack(True)

    def _pack(self, last: bool) -> Iterator[tuple]:
        sizes = np.array([len(d[3]) // 4 for d in self._docs], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        sentence = np.concatenate([d[4] + s for d, s in zip(self._docs, starts.tolist())])
        places, kinds = boundaries(ends, sentence, self.size)
        if last:
            places, kinds = self._tail(places, kinds)
        cuts, _ = choose_cuts(places, kinds, self.size, self.penalties)
        stops = [places[c] for c in cuts]
        if not last and len(stops) > 1:
            stops.pop()
        k, at = 0, 0
        for stop in stops:
            offset = 0
            while at < stop:
                doc = self._docs[k]
                inside = at - int(starts[k])
                take = min(stop, int(ends[k])) - at
                piece = doc[3][inside * 4 : (inside + take) * 4]
                yield doc[0], doc[2] + inside, take, zlib.crc32(piece), doc[1], self.sequence, offset, piece
                offset += take
                at += take
                if at == int(ends[k]):
                    k += 1
            self.sequence += 1
        rest = self._docs[k:]
        if rest and (used := at - int(starts[k])) > 0:
            doc = rest[0]
            rest[0] = [doc[0], doc[1], doc[2] + used, doc[3][used * 4 :], doc[4][doc[4] > used] - used]
        self._docs = rest
        self._waiting -= at

    def _tail(self, places: list[int], kinds: list[int]) -> tuple[list[int], list[int]]:
        """At the stream's end: the places at which the last ids make sequences of powers of two."""
        total = places[-1]
        more = set()
        for length in {(total % self.size) or self.size, self.size // 2}:
            at = total
            for k in range(length.bit_length()):
                if length >> k & 1:
                    at -= 1 << k
                    if at > 0:
                        more.add(at)
        for at in sorted(more):
            k = bisect_left(places, at)
            if places[k] != at:
                places.insert(k, at)
                kinds.insert(k, INSIDE)
        return places, kinds


def pack_documents(documents: DataFrame, vocabulary: str, *, size: int = 2048, end_id: int = 1, penalties: tuple[int, int, int] = (0, 4, 24), with_ids: bool = False) -> DataFrame:
    """Packs every document, in the order of the table's files, into sequences of at most ``size`` ids.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    the ids where asked. Null and empty texts are the end id alone; a null doc_id stays null; repeated
    rows are packed each. Each input split is packed by itself without any exchange, so that a
    sequence never spans two splits; sequence ids are distinct over all splits.
    """
    import struct

    from .common import text_batches

    end = struct.pack("<I", end_id)
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .common import give_back, slices, tokenizer

        stops = [int.from_bytes(x, "little") for x in tokenizer(vocabulary).ids([".", "!", "?"]) if len(x) == 4]
        base = TaskContext.get().partitionId() << 36
        packer = Packer(size, penalties)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        rows: list[tuple] = []
        held = 0  # bytes of ids in rows
        slim = (lambda piece: piece) if with_ids else (lambda piece: piece[:7])

        def out(rows):
            columns = list(zip(*rows))
            columns[5] = [base + s for s in columns[5]]
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(c, pa.binary()) for c in columns[7:]]
            return pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

        ends_sentence = np.zeros(1 << 16, bool)
        ends_sentence[stops] = True
        for part in slices(batches, 1):
            ids, ends = tokenizer(vocabulary).encode(part.column(1))
            places = np.flatnonzero(ends_sentence.take(ids, mode="clip")) + 1
            starts = np.concatenate([[0], ends[:-1]])
            first, last = np.searchsorted(places, starts, "right").tolist(), np.searchsorted(places, ends, "right").tolist()
            for doc_id, a, b, i, j in zip(part.column(0).to_pylist(), starts.tolist(), ends.tolist(), first, last):
                for piece in packer.take(doc_id, ids[a:b].tobytes() + end, places[i:j] - a):
                    rows.append(slim(piece))
                    held += len(piece[7]) if with_ids else 0
                    if held >= 1 << 22:
                        yield out(rows)
                        rows, held = [], 0
            if len(rows) > 2000:
                yield out(rows)
                rows, held = [], 0
        for piece in packer.finish():
            rows.append(slim(piece))
            held += len(piece[7]) if with_ids else 0
            if held >= 1 << 22:
                yield out(rows)
                rows, held = [], 0
        if rows:
            yield out(rows)
        give_back()

    text_batches(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(pack, kind)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    from .common import read, vocabulary_path

    return pack_documents(read(spark, sf_dir, "documents"), vocabulary_path())
