import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoflow.llm import ann, decontamination, fm_index, neardup, warc
from ontoflow.llm.common import shared_dir, words


# Decontamination


def brute_found(text, items, window):
    phrases: dict = {}
    for item, t in items:
        w = words(t)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[a : a + window]), set()).update([] if item is None else [str(item)])
    own, hit, found = words(text), set(), set()
    for n in {len(p) for p in phrases}:
        for a in range(len(own) - n + 1):
            if (p := tuple(own[a : a + n])) in phrases:
                hit.update(range(a, a + n))
                found |= phrases[p]
    return len(own), len(hit), sorted(found)


def test_search_shard_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        alphabet = "abc"[: rng.randrange(1, 4)]
        make = lambda n: " ".join(rng.choice(alphabet) for _ in range(rng.randrange(n + 1)))  # noqa: E731, B023
        texts = [make(40) for _ in range(rng.randrange(12))] + [None, "", "x y z", "a " * 300]
        items = [(rng.choice([k, k // 2, None]), make(9)) for k in range(5)]
        window = rng.randrange(1, 6)
        got = decontamination.search_shard(texts, decontamination.Phrases(items, window))
        assert [g[:3] for g in got] == [brute_found(t, items, window) for t in texts]
        assert all(sum(b - a for a, b in g[3]) == g[1] for g in got)


def test_suffix_array_and_index():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 300):
        s = np.append(rng.integers(0, 3, n - 1), 0).astype(np.int64)
        order = fm_index.suffix_array(s)
        seps = np.cumsum(s == 0) - 1
        plain = [(int(seps[i]),) if s[i] == 0 else (10**6 + int(s[i]),) for i in range(n)]
        assert order.tolist() == sorted(range(n), key=lambda i: plain[i:])
        index = fm_index.FMIndex(s)
        phrases = np.array([[1, 2, 0], [2, 0, 0], [1, 1, 2], [9, 0, 0]])
        lengths = np.array([2, 1, 3, 1])
        low, high = index.search(phrases, lengths)
        for p, m, a, b in zip(phrases, lengths, low, high):
            want = [i for i in range(n - m + 1) if (s[i : i + m] == p[:m]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_find_passages_in_parts(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, f"start {item} end", 0), (1, f"start {item} end", 0), (2, "ONE-two three four, five six seven eight nine TEN", 0), (3, None, 0), (None, "short item here", 0), (5, "clean " * 2000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found int").repartition(2)
    bench = spark.createDataFrame([(10, item), (9, "short item"), (9, None), (11, "one two three four five six seven eight nine ten")], "item_id long, text string")
    key = lambda r: str(r)
    whole = decontamination.find_passages(docs, bench)
    parts = decontamination.find_passages(docs, bench, most_benchmark_bytes=40)
    assert sorted(whole.collect(), key=key) == sorted(parts.collect(), key=key)
    got = {str(r.doc_id): r.found for r in whole.collect()}
    assert (got["1"].n_hit, got["1"].items) == (12, ["10", "11"]) and (got["2"].n_hit, got["2"].items) == (10, ["10", "11"])
    assert (got["None"].n_hit, got["None"].items) == (2, ["9"]) and (got["3"].n_words, got["5"].n_words) == (0, 2000)
    assert whole.count() == 6 and decontamination.find_passages(docs, bench.limit(0)).where("found.n_hit > 0").count() == 0
    assert decontamination.find_passages(docs.limit(0), bench).count() == 0


# Nearest neighbours


def brute_nearest(rows, queries, k):
    out = {}
    for q in queries:
        x = dict(rows)[q]
        d = sorted((float(np.sqrt(((np.array(v, float) - np.array(x, float)) ** 2).sum())), i) for i, v in rows if i != q)
        out[q] = [(i, s) for s, i in d[:k]]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = [(k, [float(np.float32(z)) for z in centres[k % 40] + 0.3 * rng.normal(size=16)]) for k in range(3000)]
    rows += [(3000 + k, rows[5][1]) for k in range(1500)]  # one very common vector
    got = ann.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0, ann.Settings(group=500)).collect()
    want = brute_nearest(rows, [i for i, _ in rows if i % 100 == 0], 10)
    found: dict = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(want)
    hit = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    exact = {i: dict(want[i]) for i in want}
    for q, own in found.items():
        assert own == sorted(own, key=lambda x: (x[1], x[0])) and len(own) == 10
        assert all(abs(s - exact[q][i]) < 1e-12 for i, s in own if i in exact[q])


@pytest.mark.parametrize("dimension", [16, 64])
def test_recall_in_sparse_regions(spark, dimension):
    rng = np.random.default_rng(2)
    centres = 1.5 * rng.normal(size=(40, dimension))
    wide = np.where(np.arange(4000) % 5 < 2, 3.0, 1.0)
    x = (centres[rng.integers(0, 40, 4000)] + 0.3 * wide[:, None] * rng.normal(size=(4000, dimension))).astype(np.float32).astype(float)
    got = ann.nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 11 == 0).collect()
    found: dict = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall: dict = {1.0: [], 3.0: []}
    for q in range(0, 4000, 11):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        recall[wide[q]].append(len(found[q] & set(np.argsort(d)[:10].tolist())) / 10)
    print({w: round(float(np.mean(r)), 3) for w, r in recall.items()})
    assert all(np.mean(r) >= 0.9 for r in recall.values())


def test_small_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [3.0, 4.0]), (8, [3.0, 4.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(vectors(spark, rows), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False))).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 2**0.5), (0, 3, 8, 20**0.5), (100, 1, 0, 2**0.5), (100, 2, 1, 2**0.5), (100, 3, 8, 18**0.5)]
    assert ann.nearest(vectors(spark, rows).limit(0), F.lit(True)).count() == 0
    assert ann.nearest(vectors(spark, [(0, [0.0])]), F.lit(True)).count() == 0


def test_probe_order():
    up = np.array([0.1, 0.6, 0.9])
    cost = lambda moved: sum(up[i] ** 2 if s < 0 else (1 - up[i]) ** 2 for i, s in moved)
    order = list(ann.probe_order(up, 1000))
    assert len(order) == 27 == len({frozenset(m) for m in order})
    costs = [cost(m) for m in order]
    assert costs == sorted(costs)


def test_repeated_rows_take_no_place(spark):
    """Thirty rows of the query and of one candidate, all in one partition: every other candidate is returned."""
    rng = np.random.default_rng(8)
    rows = [(0, [1.0, 2.0, 3.0])] * 30 + [(k, (np.array([1.0, 2.0, 3.0]) + rng.normal(size=3)).tolist()) for k in range(1, 10)]
    rows += [(5, [40.0, 40.0, 40.0])] * 30
    got = ann.nearest(vectors(spark, rows).coalesce(1), F.col("vec_id") == 0).collect()
    near = {k: math.dist(v, [1.0, 2.0, 3.0]) for k, v in rows[30:39]}
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(n, k) for n, k in enumerate(sorted(near, key=near.get), 1)]
    ids, d = ann._best(np.array([7]), np.zeros((1, 2)), np.array([7, 7, 3, 3, 1, 2]), np.array([[0, 0], [0, 0], [9, 9], [1, 0], [2, 0], [0, 3.0]]), 2)[1:]
    assert dict(zip(ids.tolist(), d.tolist())) == {3: 1.0, 1: 2.0}


# Near-duplicates


def text_of(rng, n):
    return " ".join("w%d" % rng.randrange(5000) for _ in range(n))


def test_classes_against_plain_pairs(spark):
    rng = random.Random(7)
    base = [text_of(rng, 120) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(base)]
    k = len(rows)
    for t in base[:25]:
        w = t.split()
        rows.append((k, " ".join(w[:60] + ["edit"] + w[61:])))
        rows.append((k + 1, t.upper() + "!"))
        k += 2
    common = text_of(rng, 60)
    rows += [(k + i, f"{common} {text_of(rng, 60)}") for i in range(40)]  # a passage that many share
    rows += [(900 + i, base[3]) for i in range(50)] + [(1000, None), (1001, ""), (1002, "..."), (1003, "one two"), (1004, "One, two"), (None, base[3]), (5, base[5])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int").repartition(4)
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    first: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    want = sorted((str(d), str(first.get(find(i)))) for i, (d, _) in enumerate(rows))
    got = neardup.classify(docs)
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got.collect()) == want
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({c for d, c in want})
    assert neardup.classify(docs.limit(0)).count() == 0


def test_samples_match_weighted_jaccard():
    settings = neardup.Settings(bands=100, rows=3)
    rng = np.random.default_rng(3)
    a = np.sort(rng.integers(0, 2**63, 400, np.uint64))
    w = rng.choice([1.0, 2.0, 3.0], 400).astype(np.float32)
    x, y = (a[:330], w[:330]), (a[60:], (w * rng.choice([1.0, 0.7], 400)).astype(np.float32)[60:])
    drawn = neardup.Sampler(settings).samples([x, y, x])
    assert (drawn[0] == drawn[2]).all()
    assert abs((drawn[0] == drawn[1]).mean() - neardup.similarity(x, y)) < 0.08


@pytest.mark.parametrize("block", [1000, 8])
def test_blocks_find_every_link_between_what_is_not_joined(spark, block):
    """All pairs of a bucket meet in some block, but for those joined already or met in an earlier bucket."""
    import pandas as pd

    settings = neardup.Settings(block=block, bands=2, rows=3)
    rng = random.Random(1)
    texts = {f"k{i:03d}": text_of(rng, 40) for i in range(30)}
    for name, edits in (("z1", 1), ("z2", 2), ("z3", 1)):
        w = texts["k004" if name != "z3" else "k009"].split()
        texts[name] = " ".join(w[: 40 - edits])
    sign = {k: [rng.randrange(10**6) for _ in range(6)] for k in texts}
    sign |= {"z1": sign["k004"], "z2": sign["k004"], "z3": sign["k009"]}
    label = {k: "all" if k < "k003" else k for k in texts}
    rows = [(7, k, label[k], label[k] != "all", 36, sign[k], [7, 9 + i]) for i, k in enumerate(texts)]
    kind = "bucket long, key string, label string, apart boolean, size long, samples array<int>, buckets array<bigint>"
    wide = neardup._blocks(spark.createDataFrame(rows, kind), settings).toPandas()
    wide["block"] = [tuple(x) for x in wide.block]
    found = [neardup._some_likely(t, settings) for _, t in wide.groupby("block")]
    assert set(pd.concat(found).key) == {"k004", "z1", "z2", "k009", "z3"}
    wide["text"] = wide.key.map(texts)
    weigh = lambda h, n: np.ones(len(h), np.float32)
    links = pd.concat([neardup._joining_links(t, weigh, settings) for _, t in wide.groupby("block")])
    got = {frozenset(x) for x in links.itertuples(index=False)}
    assert frozenset(("k009", "z3")) in got and got - {frozenset(("k009", "z3"))} <= {frozenset(x) for x in (("k004", "z1"), ("k004", "z2"), ("z1", "z2"))}
    assert len(got) == 3 if block == 1000 else len(got) >= 3
    wide["buckets"] = [[5, 7]] * len(wide)  # all share an earlier bucket, where they meet
    assert not sum(len(neardup._some_likely(t, settings)) for _, t in wide.groupby("block"))


def edited_copies(originals, copies, edits, words_in=300):
    """(doc_id, text): originals, and copies of each with words of their own in a few places."""
    rng = random.Random(11)
    rows = []
    for o in range(originals):
        own = [f"o{o}w{i}" for i in range(words_in)]
        rows.append((len(rows), " ".join(own)))
        for c in range(copies):
            w = list(own)
            for n, at in enumerate(rng.sample(range(4, words_in - 4, 6), edits)):
                w[at] = f"edit{o}x{c}x{n}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_texts_like_the_first_one_meet_those_that_are_not(spark):
    docs = spark.createDataFrame(edited_copies(40, 2, 6), "doc_id long, text string").repartition(3)
    assert neardup.classify(docs).select("class_id").distinct().count() == 40


def test_copies_of_one_original_meet_it_past_the_first_text(spark):
    docs = spark.createDataFrame(edited_copies(3, 10, 3), "doc_id long, text string").repartition(3)
    signed = {}
    seen = neardup.near_duplicate_classes(docs).collect()
    for r in seen:
        signed.setdefault(r._class, set()).add(r._key)
    assert sorted(map(len, signed.values())) == [11, 11, 11]


def test_chains_keep_every_link(spark):
    """Neighbours of a chain are just over the threshold, those after them under it."""
    rng = random.Random(4)
    rows, words_in = [], 300
    for c in range(8):
        w = [f"c{c}w{i}" for i in range(words_in)]
        for k in range(20):
            rows.append((len(rows), " ".join(w)))
            for n, at in enumerate(rng.sample(range(4, words_in - 4, 6), 6)):
                w[at] = f"c{c}k{k}e{n}"
    rng.shuffle(rows)
    sets = {i: frozenset(zip(*[t.split()[a:] for a in range(5)])) for i, t in rows}
    alike = [len(sets[i] & sets[i + d]) / len(sets[i] | sets[i + d]) for d in (1, 2) for i in range(160 - d) if i // 20 == (i + d) // 20]
    assert sum(x >= 0.8 for x in alike) == 8 * 19 and max(x for x in alike if x < 0.8) < 0.75
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in neardup.classify(docs).collect()}
    assert got == {i: i // 20 * 20 for i, _ in rows}


def test_any_column_name_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_COPIES", 3)
    rows = [(i, "one text of some words that many have", i, "a") for i in range(20)] + [(30, "another text of five words", 0, "b"), (31, None, 0, "c"), (31, None, 0, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept_id long, _key string")
    assert sorted((r.doc_id, r.class_id) for r in neardup.classify(docs).collect()) == [*((i, 0) for i in range(20)), (30, 30), (31, 31), (31, 31)]
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == [rows[0], rows[20], rows[21], rows[22]]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "x"), ("y", "z")], "a string, b string")
    got = {r.node: r.label for r in neardup.components(edges).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and got["z"] == "y"


# WARC


def reference(rows, least=0):
    import base64
    import hashlib

    own = [(i, (h or "").encode()) for i, _, h in rows]
    digest = [base64.b32encode(hashlib.sha1(b).digest()).decode() for _, b in own]
    out = []
    for (i, b), d in zip(own, digest):
        ids = [j for (j, c), e in zip(own, digest) if e == d and j is not None]
        most = max(ids, default=None)
        again = len(b) >= least and most is not None and i != most and len([1 for e in digest if e == d]) > 1
        out.append((str(i), len(b), d, "revisit" if again else "response", str(most if again else None)))
    return sorted(out)


@pytest.mark.parametrize("size", [700, 1_000_000])
def test_warc_with_hostile_payloads(spark, size):
    rng = random.Random(1)
    m = warc.MAGIC
    fake = m + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:9999>\r\nContent-Length: 30\r\n\r\nHTTP/1.1 200 OK\r\n\r\nfake fake fake\r\n\r\n"
    kinds = ["", None, "same", "é" * 700, fake * 3 + "é", m * 3, "WARC/1.WARC/1.1\r" + m, m + "Content-Length: 5000\r\n\r\n", "\r\n\r\n" + fake + "\r\n\r\n", "x" * 40_000]
    rows = [(i, f"http://x/{i}\r\nEvil: 1", rng.choice(kinds) if i % 3 else f"page {i}" + rng.choice([fake, m, ""])) for i in range(60)] + [(None, None, "same"), (3, "u", "page 3")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        folder = shared_dir(spark, "warc")
        warc.write_warc(warc.records_of(pages), folder)
        got = warc.read_warc(spark, folder)
        rows_got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got.collect())
        assert rows_got == reference(rows)
        assert got.where("url LIKE '%Evil%'").count() == 60
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_warc_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.is_revisit for r in warc.records_of(pages, min_revisit_bytes=3).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False}
    folder = shared_dir(spark, "warc")
    warc.write_warc(warc.records_of(pages.limit(0)), folder)
    assert warc.read_warc(spark, folder).count() == 0
