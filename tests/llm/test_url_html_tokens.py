import math
import random
import time
import zlib

import numpy as np
import pytest

from ontoflow.llm import html_text, packing, token_files, url_filter
from ontoflow.llm.common import ChunkTokenizer, shared_dir, vocabulary_path, words


def brute_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1, -1, "", ""), (len(h + p), len(h), h + p, verdict))
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q#f", "http://example.com/en/6", "x://com", "https://notexample.com/en/7", "http://a.net/de/8", "http://example.net/de/81", "http://b.org/es/#/", "http://org?/es/", "http://u@b.org:80/es/", "http://com/en/\nx", "ftp://.com/en/", "http://a..com/en/"]
    rows = [(i % 12, u, i) for i, u in enumerate(urls * 2)] + [(None, "http://com/en/1", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict int")
    got = url_filter.judge_urls(pages, url_filter.rules_frame(spark, url_filter.RULES))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = sorted((str(i), *map(str, brute_verdict(u, url_filter.RULES))) for i, u, _ in rows)
    assert sorted(tuple(map(str, r)) for r in got.collect()) == want
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_frame(spark, url_filter.RULES)).count() == 0
    none = url_filter.judge_urls(pages, url_filter.rules_frame(spark, []), default="block")
    assert none.where("verdict = 'block' AND rule IS NULL").count() == len(rows)


def test_url_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/1")], "page_id long, url string")
    plan = url_filter.judge_urls(pages, url_filter.rules_frame(spark, url_filter.RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body><header><p>Site name</p></header>
<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div id="cookie-notice">We use cookies, and this text is rather long to be a notice.</div>
<div class="layout"><div class=content><h1>Title &lt;1&gt;</h1><p>First   paragraph,
with white&nbsp;space &amp; a <b>bold</b> word<br>and a break.<p>Hi.</p><ul><li>one item of a list<li>another</ul><p class="ad">Buy this now</p>
<form><p>Name</p></form><p>The last paragraph is long enough again to be taken for content.</p></div><aside>Related things</aside></div>
<section class="comments"><p>A reader wrote a comment that is as long as a paragraph, or longer than that.</p></section><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n") == ["Title <1>", "First paragraph, with white space & a bold word and a break.", "Hi.", "one item of a list", "another", "The last paragraph is long enough again to be taken for content."]
    assert html_text.main_text(PAGE[: PAGE.index("</footer>")]) == html_text.main_text(PAGE)
    assert [html_text.main_text(x) for x in (None, "", "<nav>a</nav>", "plain", "<p>a", "<article><p>x</p></article><p>y")] == ["", "", "", "plain", "a", "x"]
    long = html_text.main_text("<article>" + "<p>word " * 20000 + "</article>")
    assert long.count("\n") == 19999


def test_heading_and_lede_outside_the_body_stay():
    body = "".join(f"<p>{'word ' * 60}{k}.</p>" for k in range(40))
    side = "<div><div>short</div><div>links</div></div>"
    lede = "A lede that is a sentence of its own and belongs to the article."
    for between in ("", "<div>12 May</div>"):
        text = html_text.main_text(f"<body>{side}<div class=content><h1>The heading</h1>{between}<p>{lede}</p><div class=body>{body}</div></div>{side}</body>").split("\n")
        assert "The heading" in text and lede in text and len([t for t in text if t.startswith("word")]) == 40
    text = html_text.main_text(f"<body><div>off</div><div class=content><h2>Second</h2><div class=body>{body}</div></div></body>").split("\n")
    assert text[0] == "Second" and len(text) == 41


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", "z")], "page_id long, url string, html string, text string")
    got = html_text.extract_text(pages)
    assert got.columns == ["page_id", "url", "text"] and got.count() == 4 and got.where("text = ''").count() == 2
    assert html_text.extract_text(pages.limit(0)).count() == 0


LINES = [f"Sentence {k} of the article goes on for a while, with words enough to count as text." for k in range(6)]
ARTICLE = "<h1>Heading</h1>" + "".join(f"<p>{t}</p>" for t in LINES)
MENU = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>About us</a></li></ul>"


def test_marks_do_not_veto_the_article():
    want = ["Heading", *LINES]
    for page in (
        f'<body>{MENU}<div class="content has-sidebar">{ARTICLE}</div><div class="sidebar">Links and more</div>',
        f'<body><nav>{MENU}</nav><article class="entry search-result-page">{ARTICLE}</article>',
        f"<body><nav>{MENU}<article>{ARTICLE}</article><footer>Imprint</footer>",
        f"<body><nav>{MENU}{ARTICLE}",
        f"<body><ul><li class=menu><a href=a>Home</a><li class=menu><a href=b>News</a><div>{ARTICLE}</div>",
        f"<body><div class=sidebar>{ARTICLE}</div>",
        f"<body>{ARTICLE}<section id=comments>" + "".join(f"<div class=comment><p>I, reader {k}, say what I think of it here, and at length.</p></div>" for k in range(3)) + "</section>",
    ):
        assert html_text.main_text(page).split("\n") == want, page[:60]
    inner = html_text.main_text('<article><p>Some text<script>var x = "<p>";</script> of a <span class="share">Share</span>block<button>ok</button>.<p hidden>no</article>')
    assert inner == "Some text of a block."


def test_the_method_selects():
    """Without its threshold the text is another one; the smoothing is that of its definition."""
    page = f"<body><nav>{MENU}</nav><div class=ad>Buy this now</div><div><article>{ARTICLE}{MENU}</article></div><footer>Imprint</footer>"
    assert html_text.main_text(page).split("\n") == ["Heading", *LINES]
    assert {"Home", "Imprint", "Buy this now"} & set(html_text.main_text(page, threshold=-1, part=2).split("\n")) == {"Home", "Imprint", "Buy this now"}
    plain = f"<body>{MENU}<div>{ARTICLE}</div>{MENU}"
    assert html_text.main_text(plain).split("\n") == ["Heading", *LINES] != html_text.main_text(plain, threshold=-1).split("\n")
    rng = random.Random(2)
    ratios = [rng.random() * 100 for _ in range(40)]
    weight = lambda d: math.exp(-d * d / 4.5) if abs(d) <= 3 else 0.0
    want = [sum(weight(i - j) * r for j, r in enumerate(ratios)) / sum(weight(i - j) for j in range(40)) for i in range(40)]
    assert html_text.smooth(ratios, 1.5) == pytest.approx(want)


def test_deep_and_unclosed_pages_are_linear():
    for piece in ("<div>x", "<p>x<b>", "</div>x", "<li>x", "<ul><li>x", "<a href=x>", "<table><tr><td>x", "<nav>x", "<span class=ad>x", "&amp;<br>"):
        began = time.perf_counter()
        html_text.main_text(piece * (400_000 // len(piece)))
        assert time.perf_counter() - began < 6, piece


def test_words():
    assert words("Ab-1É x_y\u00a0z") == ["ab".encode(), b"1\xc3\x89", b"x", b"y\xc2\xa0z"] and words(None) == words("") == []


@pytest.mark.parametrize("limit", [700_000, 300])
def test_chunks_have_the_library_ids(limit):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path())
    rng = random.Random(1)
    alphabet = "aAbBé.,'sStT\u0301ΣσİıK \n\t\u00a0ß１2中ก<|>#-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(800)]
    texts += [None, "", "<|endoftext|>. a<|startoftext|>, <|ENDOFTEXT|>", "x" * 5000 + " y " + "z" * 100 + ".", "word " * 4000]
    own = ChunkTokenizer(vocabulary_path(), limit)
    for _ in range(2):
        for text, ids in zip(texts, own.ids(texts)):
            assert ids == np.array(whole.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, top, n).astype("<u4") for top, n in ((5, 0), (2**32, 7), (70_000, 1000), (300, 1), (2**24, 50))]
    small = [d % 60_000 for d in docs]
    for own in (docs, small, [docs[0]], []):
        ids = [None if k == 1 else k * 10 for k in range(len(own))]
        data = token_files.encode_block(ids, np.array([len(d) for d in own], np.int64), np.concatenate([*own, docs[0]]))
        back = list(token_files.decode_blocks((data + b"\n") * 2))
        assert [i for i, _ in back] == ids * 2
        assert all((a == b).all() for (_, a), b in zip(back, own * 2))
    with pytest.raises(ValueError):
        list(token_files.decode_blocks(b"x" * 40))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


ROWS = [(k, f"document {k} says hello. " * (k % 40), "x") for k in range(60)] + [(7, "again the same id.", "y"), (100, None, "z"), (101, "", "z"), (None, "no id", "n"), (102, "very long " * 9000, "l")]


def reference():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path())
    return [(i, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t, _ in ROWS]


def test_token_files(spark):
    folder = shared_dir(spark, "tokens")
    token_files.write_shards(documents(spark, ROWS), folder, vocabulary_path(), block_ids=500)
    got = token_files.read_shards(spark, folder).orderBy("start").collect()
    key = lambda i: (i is not None, i or 0)
    assert [r.doc_id for r in got] == sorted((i for i, _, _ in ROWS), key=key)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(i), b) for i, b in reference())
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    folder = shared_dir(spark, "tokens")
    token_files.write_shards(documents(spark, ROWS).limit(0), folder, vocabulary_path())
    assert token_files.read_shards(spark, folder).count() == 0 == token_files.read_shards(spark, folder, with_ids=False).count()


def test_packing(spark):
    got = packing.pack_documents(documents(spark, ROWS), vocabulary_path(), with_ids=True).collect()
    pieces: dict = {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        pieces.setdefault(r.sequence_id, []).append(r)
    want = sorted((str(i), b) for i, b in reference())
    docs: dict = {}
    for r in got:
        if r.start == 0:
            docs.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
    assert sorted((k[0], k[1]) for k, v in docs.items() for _ in v) == sorted((i, len(b) // 4) for i, b in want)
    assert sum(r.length for r in got) == sum(len(b) // 4 for _, b in want)
    for own in pieces.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert sum(r.length for r in own) <= 2048
    assert packing.pack_documents(documents(spark, ROWS).limit(0), vocabulary_path()).count() == 0


def brute_cuts(places, kinds, size, penalties):
    best = [0.0] + [float("inf")] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            n = places[j] - places[i]
            if n <= size:
                pad = 0 if n & (n - 1) == 0 else size - n
                best[j] = min(best[j], best[i] + pad + (penalties[kinds[j]] if j < len(places) - 1 else 0))
    return best[-1]


def test_cuts_are_the_best():
    rng = random.Random(4)
    for _ in range(300):
        size = rng.choice([8, 16, 32])
        places = [0]
        for _ in range(rng.randrange(1, 25)):
            places.append(places[-1] + rng.randrange(1, size // 2 + 1))
        kinds = [rng.randrange(3) for _ in places]
        cuts, cost = packing.choose_cuts(places, kinds, size, (0, 2, 5), -1)
        assert cost == brute_cuts(places, kinds, size, (0, 2, 5))
        assert cuts[-1] == len(places) - 1 and all(places[b] - places[a] <= size for a, b in zip([0, *cuts], cuts))


def test_packer_streams():
    rng = random.Random(2)
    docs = [(k, np.arange(n, dtype="<u4").tobytes(), np.array(sorted(rng.sample(range(1, n + 1), n // 9)), np.int64)) for k, n in enumerate(rng.choices([1, 5, 60, 700], k=200))]
    p = packing.Packer(64, (0, 4, 24), hold=1000)
    out = [x for d in docs for x in p.take(*d)] + list(p.finish())
    assert b"".join(x[7] for x in out) == b"".join(d[1] for d in docs)
    total = sum(len(d[1]) // 4 for d in docs)
    lengths: dict = {}
    for x in out:
        lengths[x[5]] = lengths.get(x[5], 0) + x[2]
    padding = sum(0 if n & (n - 1) == 0 else 64 - n for n in lengths.values())
    assert max(lengths.values()) <= 64 and padding < 0.05 * total
