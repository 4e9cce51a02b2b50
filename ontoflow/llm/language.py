"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts

UNDETERMINED = "und"
_BITS = 21
_TABLE: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Of each code point, that of the lower-case letter, or 0 for what isn't a letter."""
    if not _TABLE:
        table = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                table[c] = ord(x.lower()[0])
        _TABLE.append(table)
    return _TABLE[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of one to three letters of a whole text, as packed code points, and their counts.

    Words are runs of letters; a 0 stands for the place before and behind a word and counts in n-grams
    of two and three, none of which spans two words.
    """
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    c = np.concatenate([[0], c, [0]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = c[:-1] << _BITS | c[1:] | 1 << 62
    three = (c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:])[c[1:-1] != 0] | -(1 << 63)
    return np.unique(np.concatenate([c[c != 0], two, three]), return_counts=True)


def profile(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties to the smaller code."""
    if len(codes) > size:
        least = np.partition(counts, -size)[-size]
        few = np.flatnonzero(counts >= least)
        codes, counts = codes[few], counts[few]
    return codes[np.argsort(-counts, kind="stable")][:size]


class Profiles:
    """The languages' profiles as one table from n-gram to its rank in each."""

    def __init__(self, by_language: dict[str, list[int]], size: int):
        self.languages = sorted(by_language)
        self.size = size
        self.codes = np.unique(np.array([c for x in by_language.values() for c in x], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, np.int64)
        for k, name in enumerate(self.languages):
            own = np.array(by_language[name], np.int64)
            self.ranks[np.searchsorted(self.codes, own), k] = np.arange(len(own))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance, and 1 minus that distance as a share of the largest."""
        own = profile(*ngrams(text), self.size)
        if not len(own) or not self.languages:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        ranks = self.ranks[at]
        places = np.abs(ranks - np.arange(len(own))[:, None])
        far = np.where(ranks < 0, self.size, np.minimum(places, self.size)).sum(0)
        best = int(np.argmin(far))
        return self.languages[best], 1.0 - float(far[best]) / (self.size * len(own))


def learn_profiles(labelled: DataFrame, *, size: int = 300, per_language: int = 2000) -> Profiles:
    """Profiles from (doc_id, text, lang), from about ``per_language`` documents of each language.

    The sample is drawn by a hash of the doc_id, at each language's own rate, so that its size is
    bounded whatever the table's. Rows without text or language teach nothing.
    """
    known = labelled.where("lang IS NOT NULL")
    rates = {r.lang: min(1.0, per_language / r.n) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rates:
        return Profiles({}, size)
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in rates.items()])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < rate * 1_000_003
    sample = known.where("text IS NOT NULL").where(drawn).select("lang", "text")

    def count(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for lang, texts in batch.groupby("lang").text:
                parts = [ngrams(t) for t in texts]
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)) if len(codes) else []
                out.append(pd.DataFrame({"lang": lang, "code": codes, "n": np.asarray(counts, np.int64)}))
            if out:
                yield pd.concat(out)

    counted = sample.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    found: dict[str, list[int]] = {}
    for r in counted.withColumn("k", place).where(F.col("k") <= size).orderBy("lang", "k").collect():
        found.setdefault(r.lang, []).append(r.code)
    return Profiles(found, size)


def predict_language(documents: DataFrame, profiles: Profiles, *, keep: Iterable[str] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of every document, then the nearest language and a score from 0 to 1.

    The whole text is read and nothing else. A text that is null or has no letter is ``und`` with
    score 0; ties go to the language first in order. Repeated rows are judged each.
    """

    def make():
        return lambda texts: zip(*map(profiles.nearest, texts))

    return map_texts(documents, list(keep), [(names[0], "string"), (names[1], "double")], make)


def held_out(of: int, remainder: int):
    """Whether crc32(doc_id as text) leaves the remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == remainder, F.lit(False))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that aren't held out."""
    from .common import read

    documents = read(spark, sf_dir, "documents")
    profiles = learn_profiles(documents.where(~held_out(3, 1) & F.col("doc_id").isNotNull()))
    return predict_language(documents, profiles).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
