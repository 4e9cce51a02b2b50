"""Toxicity: a subsequence-kernel support vector machine with Nyström landmarks.

The kernel compares two short strings by their common subsequences of three and four letters, each
occurrence weighted down for every letter that lies between. With phi a string's (normalized) vector
of weighted subsequences, K(s, t) = phi(s) . phi(t). Nyström features of s are K_zz^(-1/2) K(z, s) over
landmark strings z, and a linear SVM theta over them scores

    theta . K_zz^(-1/2) K(z, s) = phi(s) . (sum over landmarks of phi(z) [K_zz^(-1/2) theta])

so that a trained model is one weight per subsequence (hashed), and scoring costs the same for any
number of landmarks. Gapped and inserted characters cost weight but keep the subsequence.

A unit is a word, without signs and in lower case, with digits and signs that stand for letters read
as those, or a run of single letters joined. A sentence's score is that of its best unit, a document's
that of its best sentence, turned into a probability by a logistic function that also sees how many
units score above 0, as a number and as a share of all, since in a long clean text a few do by chance.

The machine learns from labelled sentences, which have their document's label. Each distinct sentence
counts once, so that copies teach nothing twice. Which unit of a toxic sentence is to blame is a choice
between its instances: at first those that occur, themselves or by a four-letter part, in toxic
sentences far more often than chance explains; then, in rounds, the best units by the machine so far,
against the best units of clean sentences. Toxic units count again with a letter inserted or doubled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable
from itertools import chain, islice, repeat, zip_longest

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, map_texts, materialize, text_batches
from .language import held_out

_PAD = 5
_DECAY = 0.5
_HASH_BITS = 18
#: Offsets of a subsequence's letters from its first, with up to two letters between.
_PATTERNS = [(0, a, b) for b in range(2, 5) for a in range(1, b)] + [(0, a, b, c) for c in range(3, 6) for b in range(2, c) for a in range(1, b)]
#: Signs and digits read as letters.
_LOOKS_LIKE = str.maketrans("013457@$", "oieastas")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}[.,;:!?]*(?!\S)")
#: Behind these a sentence ends.
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_EDGE = 63


def unit(word: str) -> str:
    """A word as the model sees it; empty if no letter is left."""
    out = word.lower()
    if out.isalpha():
        return out
    if not any(c.isalpha() for c in out):
        return ""
    return "".join(c for c in out.strip(".,;:!?()[]\"'*#%&$").translate(_LOOKS_LIKE) if c.isalpha())


def spaced_units(text: str) -> list[str]:
    """Runs of three or more single characters with single spaces between, joined."""
    return [unit(re.sub(r"\s", "", m)) for m in _SPACED.findall(text)]


def _codes(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as codes from 1 to 63, each unit between edge marks and behind padding; the units' starts."""
    joined = ("\0" * _PAD).join(f"\1{u}\1" for u in units) + "\0" * _PAD
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = np.where((c >= 97) & (c <= 122), c - 96, 27 + c % 36)
    out[c == 0] = 0
    out[c == 1] = _EDGE
    sizes = np.array([len(u) + 2 + _PAD for u in units], np.int64)
    return out, np.cumsum(sizes) - sizes


def _subsequences(codes: np.ndarray):
    """(hash, whether it is one, weight) of the subsequence that begins at each place, for every pattern."""
    n = len(codes) - _PAD
    for offsets in _PATTERNS:
        packed = np.zeros(n, np.int64)
        whole = np.ones(n, bool)
        for o in offsets:
            part = codes[o : o + n]
            packed = packed << 6 | part
            whole &= part > 0
        packed |= len(offsets) << 24
        hashed = (packed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)
        yield hashed.astype(np.int64), whole, _DECAY ** (offsets[-1] + 1 - len(offsets))


def unit_scores(units: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """phi(unit) . weights + bias of each unit."""
    out = np.full(len(units), -math.inf)
    for a in range(0, len(units), 20_000):
        part = units[a : a + 20_000]
        codes, starts = _codes(part)
        value = np.zeros(len(codes) - _PAD, np.float32)
        size = np.zeros(len(codes) - _PAD, np.float32)
        for hashed, whole, weight in _subsequences(codes):
            value += np.where(whole, weights[hashed] * np.float32(weight), 0)
            size += np.where(whole, np.float32(weight * weight), 0)
        total, norm = np.add.reduceat(value, starts), np.add.reduceat(size, starts)
        out[a : a + len(part)] = total / np.sqrt(np.maximum(norm, 1e-9)) + bias
    return out


def feature_rows(units: list[str]):
    """phi of each unit as rows of (unit, hash, value)."""
    codes, starts = _codes(units)
    of = np.searchsorted(starts, np.arange(len(codes) - _PAD), "right") - 1
    rows, hashes, values = [], [], []
    norm = np.zeros(len(units))
    for hashed, whole, weight in _subsequences(codes):
        rows.append(of[whole])
        hashes.append(hashed[whole])
        values.append(np.full(int(whole.sum()), weight))
        norm += np.bincount(of[whole], minlength=len(units)) * weight**2
    rows, hashes, values = np.concatenate(rows), np.concatenate(hashes), np.concatenate(values)
    return rows, hashes, values / np.sqrt(np.maximum(norm, 1e-9))[rows]


def _landmarks(units: list[str], n: int) -> list[str]:
    """The first half of ``n`` units from the front, where the most telling are, the others evenly from the rest."""
    front, rest = units[: n // 2], units[n // 2 :]
    return front + rest[:: max(1, -(-len(rest) // max(1, n - len(front))))]


def fit_svm(positive: list[str], negative: list[str], *, landmarks: int = 768, c: float = 3.0, balance: float = 0.2, disguise: float = 0.1) -> tuple[np.ndarray, float]:
    """The weight of every hashed subsequence and the bias, from units of both kinds, most telling first.

    Positive units weigh ``balance`` times as much as all negative ones together, and count again,
    disguised, with the share ``disguise`` of their cost.
    """
    chosen = _landmarks(positive, landmarks // 2) + _landmarks(negative, landmarks // 2)
    # Only subsequences of landmarks count: columns are those, so that the matrices stay small.
    r, h, v = feature_rows(chosen)
    used, at = np.unique(h, return_inverse=True)
    phi = np.zeros((len(chosen), len(used)), np.float32)
    np.add.at(phi, (r, at), v)
    values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    hidden = list(dict.fromkeys(chain.from_iterable(map(disguised, positive))))
    units = positive + negative + hidden
    parts = []
    for a in range(0, len(units), 250):
        r, h, v = feature_rows(units[a : a + 250])
        at = np.minimum(np.searchsorted(used, h), len(used) - 1)
        known = used[at] == h
        dense = np.zeros((len(units[a : a + 250]), len(used)), np.float32)
        np.add.at(dense, (r[known], at[known]), v[known])
        parts.append((dense @ phi.T).astype(np.float64) @ whiten)
    x = np.hstack([np.concatenate(parts), np.ones((len(units), 1))])
    del parts, dense
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative)), np.ones(len(hidden))])
    each = c * max(1.0, balance * len(negative) / max(1, len(positive)))
    cost = np.concatenate([np.full(len(positive), each), np.full(len(negative), c), np.full(len(hidden), disguise * each)])
    theta = _squared_hinge(x, y, cost)
    weights = np.zeros(1 << _HASH_BITS, np.float32)
    weights[used] = (whiten @ theta[:-1]) @ phi
    return weights, float(theta[-1])


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The linear machine of least squared hinge loss and squared weights, by Newton steps that halve until they help."""
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-6
    theta = np.zeros(x.shape[1])

    def loss(w):
        return ridge @ (w * w) + cost @ np.maximum(0, 1 - y * (x @ w)) ** 2

    now = loss(theta)
    for _ in range(100):
        inside = y * (x @ theta) < 1
        xs, cs = x[inside], cost[inside, None]
        step = np.linalg.solve(np.diag(ridge) + xs.T @ (cs * xs), xs.T @ (cs[:, 0] * y[inside])) - theta
        size = 1.0
        while (then := loss(theta + size * step)) > now and size > 1e-6:
            size /= 2
        theta = theta + size * step
        if now - then <= 1e-9 * now:
            break
        now = then
    return theta


class Model:
    """Weights of subsequences, and the logistic function from a document's units to its score."""

    def __init__(self, weights: np.ndarray, bias: float, logistic: list[float]):
        self.weights, self.bias, self.logistic = weights, bias, logistic

    def scorer(self, limit: int = 500_000, longest: int = 48):
        """A function from texts to (largest unit score, units above 0, units); -inf without units."""
        known: dict[str, float] = {"": -math.inf}

        def measure(texts: list[str | None]) -> list[tuple[float, int, int]]:
            nonlocal known
            split = [t.split() if t else [] for t in texts]
            new: set[str] = set()
            for chunks in split:
                new.update(set(chunks).difference(known))
            if len(known) + len(new) > limit:  # the first third, frequent words among it, stays
                known = dict(islice(known.items(), limit // 3))
                new = {c for chunks in split for c in chunks if c not in known}
            if new:
                fresh = list(new)
                units = [unit(c) for c in fresh]
                distinct = list({u for u in units if u})
                score = dict(zip(distinct, unit_scores(distinct, self.weights, self.bias).tolist())) if distinct else {}
                score[""] = -math.inf
                known.update(zip(fresh, map(score.__getitem__, units)))
            out = []
            for text, chunks in zip(texts, split):
                scores = np.array(list(map(known.__getitem__, chunks)))
                if text and (joined := [u for u in spaced_units(text) if u]):
                    scores = np.concatenate([scores, unit_scores(joined, self.weights, self.bias)])
                out.append((float(scores.max(initial=-math.inf)), int((scores > 0).sum()), len(scores)))
            for chunk in new:
                if len(chunk) > longest:
                    known.pop(chunk, None)
            return out

        return measure

    def probability(self, measured: tuple[float, int, int]) -> float:
        z = float(features(*measured) @ np.array(self.logistic))
        return 1 / (1 + math.exp(-max(z, -500.0)))


def features(margin: float, above: int, units: int) -> np.ndarray:
    return np.array([min(max(margin, -2.0), 2.0), math.log1p(above), math.log((above + 0.5) / (units + 50)), 1.0])


def sentences(text: str | None) -> list[list[str]]:
    """The units of each sentence that has some: runs of single letters are joined, nothing else is left out."""
    out = []
    for part in _SENTENCE.split(text) if text else ():
        units = {u for u in map(unit, part.split()) if u}
        units.update(u for u in spaced_units(part) if u)
        if units:
            out.append(sorted(units))
    return out


def _parts(u: str) -> set[str]:
    """The four-letter parts of a unit, edge mark in front included."""
    edged = f"^{u}"
    return {edged[a : a + 4] for a in range(len(edged) - 3)}


def disguised(u: str) -> list[str]:
    """A unit with a letter inserted and with one doubled, each at a place that its letters decide."""
    code = zlib.crc32(u.encode())
    at = 1 + code % max(1, len(u) - 1)
    twice = code // 97 % len(u)
    return [u[:at] + chr(97 + code // 31 % 26) + u[at:], u[: twice + 1] + u[twice:]]


def labelled_sentences(known: DataFrame) -> DataFrame:
    """units and toxic of each distinct sentence of (text, toxic); one that a clean document has too is clean.

    Copies of a document, and passages that many share, thus count once.
    """

    def split(batches):
        import pandas as pd

        for batch in batches:
            found: dict[str, int] = {}
            for text, toxic in zip(batch.text, batch.toxic):
                for units in sentences(text):
                    key = " ".join(units)
                    found[key] = min(found.get(key, 1), toxic)
            yield pd.DataFrame({"units": list(found), "toxic": list(found.values())})
        give_back()

    kind = "units string, toxic int"
    return known.mapInPandas(split, kind).groupBy(F.md5("units")).agg(F.first("units").alias("units"), F.min("toxic").alias("toxic")).select("units", "toxic")


def _first_guess(known: DataFrame, most_units: int, surprise: float) -> tuple[list[str], list[str]]:
    """Units that tell toxic sentences from others by how often they, or their parts, occur in them; and others."""

    def count(batches):
        import pandas as pd

        for batch in batches:
            seen: dict[tuple[bool, str], list[int]] = {}
            for line, toxic in zip(batch.units, batch.toxic):
                units = line.split(" ")
                for key in chain(zip(repeat(False), units), zip(repeat(True), set(chain.from_iterable(map(_parts, units))))):
                    x = seen.setdefault(key, [0, 0])
                    x[0] += 1
                    x[1] += toxic
            if seen:
                own, seen = seen, None
                yield pd.DataFrame({"is_part": [k[0] for k in own], "token": [k[1] for k in own], "n": [x[0] for x in own.values()], "t": [x[1] for x in own.values()]})
        give_back()

    base = known.agg(F.avg("toxic")).first()[0] or 0.0
    if not 0 < base < 1:
        return [], []
    counts = known.mapInPandas(count, "is_part boolean, token string, n long, t long").groupBy("is_part", "token").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    z = (F.col("t") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    counts = materialize(counts.withColumn("z", z).withColumn("rate", F.col("t") / F.col("n")), "toxic-units")
    parts = [r.token for r in counts.where(F.col("is_part") & (F.col("z") >= surprise) & (F.col("rate") >= 0.75)).orderBy(F.desc("z"), "token").limit(most_units).collect()]
    units = counts.where(~F.col("is_part"))
    holds = F.exists(F.transform(F.sequence(F.lit(1), F.greatest(F.length("token") - 2, F.lit(1))), lambda i: F.substring(F.concat(F.lit("^"), "token"), i, F.lit(4))), lambda p: p.isin(*parts)) if parts else F.lit(False)
    positive = units.where((F.col("t") > 0) & (F.col("rate") >= 0.75) & ((F.col("z") >= surprise) | holds))
    positive = [r.token for r in positive.orderBy(F.desc("z"), "token").limit(most_units).collect()]
    clean = units.where("t = 0 OR rate < 0.5")
    common = [r.token for r in clean.orderBy(F.desc("n"), "token").limit(most_units // 2).collect()]
    rare = [r.token for r in clean.where("t = 0").orderBy(F.xxhash64("token"), "token").limit(most_units // 2).collect()]
    taken = set(positive)
    return positive, [u for u in dict.fromkeys(chain.from_iterable(zip_longest(common, rare))) if u and u not in taken]


def _witnesses(known: DataFrame, model: Model, most_units: int, step: float = 0.1) -> tuple[list[str], list[str]]:
    """The units that decide toxic and clean sentences, the most telling of each first.

    The witness of a sentence is its best unit. Those of clean sentences speak against themselves if
    they score above -1/2. Those of toxic ones count down to the least score above which three of four
    witnesses are of toxic sentences, at every ``step``: most sentences of a toxic document hold nothing
    toxic, and their witnesses tell nothing.
    """

    def decide(batches):
        import pandas as pd

        for batch in batches:
            split = [x.split(" ") for x in batch.units]
            distinct = sorted(set(chain.from_iterable(split)))
            if not distinct:
                continue
            score = dict(zip(distinct, unit_scores(distinct, model.weights, model.bias).tolist()))
            best = [max((score[u], u) for u in units) for units in split]
            rows = [(u, m, int(t)) for (m, u), t in zip(best, batch.toxic) if m >= -0.5]
            yield pd.DataFrame(rows, columns=["token", "margin", "t"])
        give_back()

    found = known.mapInPandas(decide, "token string, margin double, t long").groupBy("token").agg(F.max("margin").alias("margin"), F.count("*").alias("n"), F.sum("t").alias("t"))
    found = materialize(found, "toxic-witnesses")
    least = math.inf
    for r in found.groupBy(F.floor(F.col("margin") / step).alias("bin")).agg(F.sum("n").alias("n"), F.sum("t").alias("t")).orderBy(F.desc("bin")).collect():
        if r.t < 0.75 * r.n:
            break
        least = r.bin * step
    positive = found.where("t >= 0.75 * n").where(F.col("margin") >= least).orderBy(F.desc("t"), F.desc("margin"), "token").limit(most_units)
    negative = found.where("t < 0.5 * n").orderBy(F.desc("margin"), "token").limit(most_units)
    return [r.token for r in positive.collect()], [r.token for r in negative.collect()]


def fit_model(labelled: DataFrame, *, most_documents: int = 12_000, most_units: int = 6000, surprise: float = 6.0, rounds: int = 3) -> Model:
    """A model from (doc_id, text, toxic): a machine over labelled sentences, each with its document's label.

    A toxic document has a toxic sentence, and a toxic sentence a toxic unit; which they are is found in
    rounds, each of which scores all sentences, takes their best units as witnesses and fits the machine
    to them. Learns from about ``most_documents`` documents, drawn by a hash of the doc_id, and from the
    ``most_units`` most telling units of each kind and round; nothing larger reaches the driver. Rows
    without text or label teach nothing. Without toxic documents every score is near 0.
    """
    known = labelled.where("text IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL")
    text_batches(labelled.sparkSession)
    total, bad = known.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    nothing = Model(np.zeros(1 << _HASH_BITS, np.float32), 0.0, [0.0, 0.0, 0.0, -20.0])
    if not total or not bad:
        return nothing
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < min(1.0, most_documents / total) * 1_000_003)
    known = materialize(known.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")), "toxic-sample")
    lines = materialize(labelled_sentences(known), "toxic-sentences")
    positive, negative = _first_guess(lines, most_units, surprise)
    if not positive or not negative:
        return nothing
    model = Model(*fit_svm(positive, negative), nothing.logistic)
    for _ in range(rounds):
        speaking, against = _witnesses(lines, model, most_units)
        wrong = set(against)
        positive = [u for u in dict.fromkeys([*positive, *speaking]) if u not in wrong][:most_units]
        right = set(positive)
        # Those that the machine got wrong lead, so that they are among the landmarks.
        negative = [u for u in dict.fromkeys([*against, *negative]) if u not in right][: 2 * most_units]
        if not positive:
            return nothing
        model = Model(*fit_svm(positive, negative), nothing.logistic)

    def make():
        measure = model.scorer()
        return lambda texts: zip(*measure(texts))

    seen = map_texts(known, ["toxic"], [("margin", "double"), ("above", "long"), ("units", "long")], make).toPandas()
    model.logistic = _logistic(np.array([features(*x) for x in zip(seen.margin, seen.above, seen.units)]), seen.toxic.to_numpy())
    return model


def _logistic(x: np.ndarray, label: np.ndarray) -> list[float]:
    """Coefficients of the logistic fit, each label smoothed towards the other by one case."""
    good, bad = int((label == 0).sum()), int((label != 0).sum())
    target = np.where(label != 0, (bad + 1) / (bad + 2), 1 / (good + 2))
    beta = np.zeros(x.shape[1])
    ridge = 0.03 * np.eye(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (target - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def score_toxicity(documents: DataFrame, model: Model, *, keep: Iterable[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` of every document and a score from 0 to 1, from the whole text alone.

    Null and empty texts, and those without a letter, have the lowest score there is. Repeated rows
    are scored each.
    """

    def make():
        measure = model.scorer()
        return lambda texts: [[model.probability(m) for m in measure(texts)]]

    return map_texts(documents, list(keep), [(name, "double")], make)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, from a model of the labelled documents that aren't held out."""
    from .common import read

    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit_model(training_rows(documents, labels))
    scored = score_toxicity(documents, model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic of the labelled documents that aren't held out."""
    known = labels.where(~held_out(5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return documents.select("doc_id", "text").join(known, "doc_id")
