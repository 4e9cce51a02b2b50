"""What several training-data operators share: storage, words, tokens, and work on whole texts."""

from __future__ import annotations

import posixpath
import uuid
from collections import Counter
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

from ..storage import materialize, shared_root

#: Bytes to words: A-Z lower-cased, every other ASCII byte that is not a digit or a-z becomes a space,
#: and bytes of non-ASCII characters stay.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)

__all__ = ["ChunkTokenizer", "claim", "give_back", "map_texts", "materialize", "read", "shared_dir", "slices", "text_batches", "tokenizer", "vocabulary_path", "words"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return posixpath.join(shared_root(spark), f"{name}-{uuid.uuid4().hex}")


def words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class ChunkTokenizer:
    """Token ids of whole texts, many at once.

    The vocabulary's pre-tokenizer drops white space and no token spans it, so a text's ids are those
    of its space-separated chunks in a row. Arrow cuts the texts of a batch and numbers their distinct
    chunks; those not met before go through the tokenizers library, many in one call, and are
    remembered in one array, from which all ids of the batch are then taken at once. A chunk of Latin
    letters and one full stop or comma has the ids of its lower-case letters and of the mark, as the
    vocabulary splits and lower-cases them too; such letters need no normalizer, and their last id is
    one that ends a word. At ``limit`` chunks the first ``limit // 3``, frequent words among them,
    stay; long chunks are never remembered.
    """

    def __init__(self, path: str, limit: int = 800_000, longest: int = 48, piece: int = 4_000_000):
        import numpy as np
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._plain = Tokenizer.from_file(path)
        self._plain.normalizer = normalizers.Sequence([])
        self._plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._limit, self._longest, self._piece = limit, longest, piece
        self._known: dict[str, int] = {}  # chunk: its number
        self._ids = np.zeros(1 << 16, "<u4")
        self._starts = np.zeros(1 << 14, np.int64)  # of each number's ids; the next one's start is their end
        self._marks: dict[str, bytes] = dict(zip(("", ".", ","), (b"", *self._encode([".", ","]))))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes; null has none."""
        import pyarrow as pa

        ids, ends = self.encode(pa.array(texts, pa.string()))
        data, ends = ids.tobytes(), (ends * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts) -> tuple:
        """(ids of all texts of an Arrow array in a row, end of each text's): null has none.

        Works on pieces of about ``piece`` bytes, at least a text each; a longer text is cut at white space.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        done, ends, k = [], [], 0
        while k < len(texts):
            upto = max(k + 1, int(np.searchsorted(np.cumsum(sizes[k:]), self._piece, "right")) + k)
            if upto == k + 1 and sizes[k] > self._piece:
                parts = [self._encode_piece(pa.array([x]))[0] for x in _cut(texts[k].as_py(), self._piece)]
                done += parts
                ends.append(np.array([sum(map(len, parts))], np.int64))
            else:
                ids, own = self._encode_piece(texts.slice(k, upto - k))
                done.append(ids)
                ends.append(own)
            k = upto
        if not done:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        base = 0
        for own in ends:
            own += base
            base = int(own[-1])
        return np.concatenate(done), np.concatenate(ends)

    def _encode_piece(self, texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        chunks = split.flatten().dictionary_encode()
        names = chunks.dictionary.to_pylist()
        found = list(map(self._known.get, names))
        if lacking := [k for k, v in enumerate(found) if v is None]:
            new = [names[k] for k in lacking]
            if len(self._known) + len(new) > self._limit:
                self._known = dict(islice(self._known.items(), self._limit // 3))
                found = list(map(self._known.get, names))
                lacking = [k for k, v in enumerate(found) if v is None]
                new = [names[k] for k in lacking]
            first = len(self._known)
            self._learn(first, chunks.dictionary.take(pa.array(lacking)))
            for n, k in enumerate(lacking, first):
                found[k] = n
            long = [c for c in new if len(c) > self._longest]
            if not long:
                self._known.update(zip(new, range(first, first + len(new))))
        numbers = np.array(found, np.int64)
        starts = self._starts[numbers].astype(np.int32)  # a piece and what is remembered are far below 2^31 ids
        at = chunks.indices.to_numpy()
        size = (self._starts[numbers + 1].astype(np.int32) - starts)[at]
        ends = np.cumsum(size, dtype=np.int32)
        places = np.repeat(starts[at] - ends + size, size)
        places += np.arange(len(places), dtype=np.int32)
        ids = self._ids.take(places)
        if lacking and long:
            # Numbers go by order: the short ones are learnt again, without the long ones between.
            short = [c for c in new if len(c) <= self._longest]
            data = [self._ids[self._starts[found[k]] : self._starts[found[k] + 1]] for k, c in zip(lacking, new) if len(c) <= self._longest]
            self._put(first, np.array([len(x) for x in data], np.int64), np.concatenate([*data, self._ids[:0]]))
            self._known.update(zip(short, range(first, first + len(short))))
        return ids, np.concatenate([[0], ends])[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()].astype(np.int64)

    def _put(self, first: int, sizes, ids) -> None:
        """Remembers the ids of the chunks that get the numbers from ``first``."""
        import numpy as np

        at = int(self._starts[first])
        while len(self._starts) < first + len(sizes) + 1:
            self._starts = np.concatenate([self._starts, np.zeros(len(self._starts), np.int64)])
        while len(self._ids) < at + len(ids):
            self._ids = np.concatenate([self._ids, np.zeros(len(self._ids), "<u4")])
        self._starts[first + 1 : first + 1 + len(sizes)] = at + np.cumsum(sizes)
        self._ids[at : at + len(ids)] = ids

    def _learn(self, first: int, new) -> None:
        import numpy as np
        import pyarrow.compute as pc

        stop, comma = (pc.ends_with(new, pattern=x).to_numpy(zero_copy_only=False) for x in ".,")
        low = pc.ascii_lower(pc.if_else(pc.or_(pc.ends_with(new, pattern="."), pc.ends_with(new, pattern=",")), pc.utf8_slice_codeunits(new, 0, -1), new))
        plain = pc.and_(pc.string_is_ascii(new), pc.ascii_is_alpha(low)).to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(new), np.int64)
        words = low.filter(plain).dictionary_encode()
        word_ids, word_ends = self._encode_plain(words.dictionary.to_pylist())
        word_sizes = np.diff(word_ends, prepend=0)
        word = words.indices.to_numpy()
        marked = (stop | comma) & plain
        sizes[plain] = word_sizes[word]
        others = self._encode_others(new.filter(~plain).to_pylist())
        sizes[~plain] = [len(x) // 4 for x in others]
        ends = np.cumsum(sizes + marked)
        starts = ends - sizes - marked
        out = np.zeros(int(ends[-1]), "<u4")
        out[_spans(starts[plain], sizes[plain])] = word_ids[_spans((word_ends - word_sizes)[word], sizes[plain])]
        out[_spans(starts[~plain], sizes[~plain])] = np.frombuffer(b"".join(others), "<u4")
        for mark, where in ((".", stop & plain), (",", comma & plain)):
            out[ends[where] - 1] = np.frombuffer(self._marks[mark], "<u4")
        self._put(first, sizes + marked, out)

    def _encode_others(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that aren't ASCII letters alone: Latin letters need no normalizer either."""
        latin: dict[str, tuple[str, str]] = {}
        for c in chunks:
            mark = c[-1:] if c[-1:] in (".", ",") else ""
            low = (c[:-1] if mark else c).lower()
            if low.isalpha() and max(c) < "\u0250":
                latin[c] = low, mark
        wanted = list({low for low, _ in latin.values()})
        ids, ends = self._encode_plain(wanted)
        data, cuts = ids.tobytes(), [0, *(ends * 4).tolist()]
        found = {w: data[a:b] for w, a, b in zip(wanted, cuts, cuts[1:])}
        rest = [c for c in chunks if c not in latin]
        known = dict(zip(rest, self._encode(rest)))
        return [found[x[0]] + self._marks[x[1]] if (x := latin.get(c)) else known[c] for c in chunks]

    def _encode_plain(self, chunks: list[str]) -> tuple:
        """(ids in a row, end of each chunk's) of chunks of lower-case Latin letters."""
        import numpy as np

        if not chunks:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        ids = np.array(self._plain.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(chunks):
            data = self._encode(chunks)
            ids, ends = np.frombuffer(b"".join(data), "<u4"), np.cumsum([len(x) // 4 for x in data])
        return ids, ends

    def _encode(self, chunks: list[str]) -> list[bytes]:
        import numpy as np

        found = self._tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        starts = np.array([a for a, _ in found.offsets], np.int64)
        firsts = np.zeros(len(chunks) + 1, np.int64)
        np.cumsum([len(c) + 1 for c in chunks], out=firsts[1:])
        cuts = np.searchsorted(starts, firsts)
        data, cuts = ids.tobytes(), (cuts * 4).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def slices(batches, column: int, piece: int = 4_000_000):
    """Arrow batches in slices whose texts have about ``piece`` bytes, at least a row each."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        k = 0
        while k < batch.num_rows:
            upto = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + piece, "right")))
            yield batch.slice(k, upto - k)
            k = upto


def _cut(text: str, piece: int):
    """A long text in pieces that end behind white space; without any it is one piece."""
    a = 0
    while len(text) - a > piece:
        b = a + piece
        while b < len(text) and not text[b - 1].isspace():
            b += 1
        yield text[a:b]
        a = b
    yield text[a:]


def _spans(starts, sizes):
    """The places starts[0], starts[0] + 1, ... of each span, in a row."""
    import numpy as np

    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


_TOKENIZERS: dict[str, ChunkTokenizer] = {}
#: What workers keep between tasks, by who uses it; workers are used again by other operators.
_KEPT: dict[str, list] = {}


def claim(owner: str, *kept) -> None:
    """Called where a task begins: empties what other operators keep in this worker."""
    others = [x for o, held in _KEPT.items() if o != owner for x in held]
    if any(others):
        for x in others:
            x.clear()
        give_back()
    _KEPT[owner] = list(kept)


def give_back() -> None:
    """Returns freed memory of the worker to the system; called where a task ends."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def text_batches(spark: SparkSession) -> None:
    """Whole texts are large rows: unless another number is set, Arrow batches get fewer than by default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")


def tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokenizer for a vocabulary file."""
    claim("tokenizer", _TOKENIZERS)
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def vocabulary_path() -> str:
    """The vocabulary of the production queries."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def map_texts(documents: DataFrame, keep: list[str], fields: list[tuple[str, str]], make, text: str = "text", owner: str = "", kept: tuple = ()) -> DataFrame:
    """The columns ``keep`` and one for each of ``fields`` (name, type), computed from whole texts.

    ``make()`` is called once in each task and returns a function from a list of texts to one list of
    values per field. Texts are handed over 256 at a time. ``kept`` are the containers that ``owner``
    keeps between tasks.
    """
    import pyspark.sql.types as T

    text_batches(documents.sparkSession)
    added = T.StructType([T.StructField(n, T.DataType.fromDDL(t)) for n, t in fields])
    schema = T.StructType([*documents.select(*keep).schema.fields, *added.fields])
    at = keep.index(text) if text in keep else len(keep)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        claim(owner, *kept)
        compute = make()
        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                values = compute(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(v, k) for v, k in zip(values, kinds))], names=schema.names)
        give_back()

    read = documents.select(*keep) if text in keep else documents.select(*keep, documents[text].alias("_text"))
    return read.mapInArrow(run, schema)
