"""Embedding links, HTML text and quality rules against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from fixtures import docs, empty, rows

from ephyra.llm import embedding_dedup, html_text, quality_rules

VEC = "vec_id long, embedding array<float>, label int"


def vectors(seed=0):
    g = np.random.default_rng(seed)
    out = [(i, g.standard_normal(16).astype("f4").tolist()) for i in range(150)]
    for c in range(6):
        base = g.standard_normal(16)
        out += [(1000 + 100 * c + i, (base + g.standard_normal(16) * 0.12).astype("f4").tolist()) for i in range(25)]
    out += [(3000 + i, out[3][1]) for i in range(30)] + [(3100, [x * 2 for x in out[3][1]])]
    out += [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [1.0] * 15 + [None]), (4004, [1.0] * 15 + [float("nan")]), (4005, [float("inf")] * 16), (4006, [1.0, 2.0]), (4007, [1.0, 2.0])]
    return [(i, v, 0) for i, v in out + out[-1:] + out[:1]]


def brute_links(data, threshold=0.95):
    ok = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / np.linalg.norm(v) if ok(v) else None for _, v, _ in data]
    n, root = Counter(), list(range(len(data)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(unit):
        for j, b in enumerate(unit):
            if i != j and a is not None and b is not None and len(a) == len(b) and float(a @ b) >= threshold:
                n[i] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (v, *_) in enumerate(data):
        least[find(i)] = min(v, least.get(find(i), v))
    return Counter((v, n[i], least[find(i)], v == least[find(i)]) for i, (v, *_) in enumerate(data))


@pytest.mark.parametrize("chunk", [4, 1024])
def test_embedding_links_equal_brute_force(spark, chunk):
    data = vectors()
    got = embedding_dedup.near_duplicates(spark.createDataFrame(data, VEC), chunk=chunk, miss=1e-9).collect()
    assert Counter(tuple(r) for r in got) == brute_links(data)


def test_embedding_links_default_plan_and_edge_tables(spark):
    data = [(i, v, l) for i, v, l in vectors(1) if v and None not in v]
    got = Counter(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, VEC).withColumn("raw", F.lit(1)).withColumn("n_links", F.lit(2))).collect())
    assert sum((got & brute_links(data)).values()) >= 0.98 * len(data)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VEC)).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1), (5, None, 1)], VEC)).count() == 2


def test_embedding_links_of_planted_pairs_at_the_default_plan(spark):
    """64 dimensions, 6,000 vectors, of which 900 have others at cosines from 0.93 to 1, and a cluster of 700."""
    g = np.random.default_rng(3)
    x = g.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(900):
        c, side = g.uniform(0.93, 0.999), g.standard_normal(64)
        side -= side @ x[i] * x[i]
        x[2000 + i] = c * x[i] + math.sqrt(1 - c * c) * side / np.linalg.norm(side)
    x[4000:4700] = x[5000] + g.standard_normal((700, 64)) * 0.02
    x = x.astype("f4")
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC)).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= want).all() and links.sum() >= 0.999 * want.sum() and (links[:900] >= want[:900]).mean() >= 0.995
    assert len({got[i]["component_id"] for i in range(4000, 4700)}) == 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h2>Site</h2><p>Welcome, to, the, site, with, commas, and, more, and, more.</p></header><nav><ul><li><a href=/x>Menu</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, and, and, and, and.</p></div><div class='ad banner'>Buy, buy, buy</div>
<div id=content><div class="article-body"><h1>Head &amp; line</h1><p>First   para&shy;graph, with &eacute;, and more, to be long enough to count as something.<p>Second one, <a href="#">a link</a>,
with a line break.<br>After it.<p>Ok.<blockquote>A quote, here.</blockquote><ul><li>item one<li>item two</ul><!-- no --><form><p>Your mail, please, now, here</p></form></div>
<aside><p>Side, bar, text, with, many, commas, in, it, really, many.</p></aside><div class="comments"><p>First!, said, a, reader, with, commas.</p></div></div>
<footer><p>&copy; all, rights</p></footer></body></html>"""


def test_html_article():
    assert html_text.main_text(PAGE) == "Head & line First para\xadgraph, with é, and more, to be long enough to count as something. Second one, a link, with a line break. After it. Ok. A quote, here. item one item two"


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a b"), ("<p>x &lt;b&gt; &#233; &am", "x <b> é &am"), ("<article><p>one, two</p>cut <b off", "one, two cut"), ("<div><script>x", ""), ("<!-- open", ""), ("<article>" + "<p>a, b</p>" * 2000 + "</article>", " ".join(["a, b"] * 2000)), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep")])
def test_html_odd_pages(html, text):
    assert html_text.main_text(html) == text


def test_html_layout_names_and_unseen_parts():
    body = "<p>Some words, of an article, that are long enough to be one, surely, and then some more.</p>"
    page = f'<div class="wrap no-sidebar"><div class="has-comments"><h1>T</h1>{body}<p style="display: none">gone</p></div><div id="comment-3"><p>I, too, say, so, and, so.</p></div></div>'
    assert html_text.main_text(page).startswith("T Some words") and "gone" not in html_text.main_text(page) and "say" not in html_text.main_text(page)


@pytest.mark.parametrize("inner", ['<svg class="i"/>', "<math/>", "<svg><svg><path/></svg><text>no</text></svg>", '<svg><path d="m"/></svg>', "<svg>"])
def test_html_foreign_elements_end_where_they_end(inner):
    assert html_text.main_text(f"<article><p>One.</p>{inner}<p>Three.</p></article>") == "One. Three."


PARAGRAPH = "<p>Some words, of an article, that are long enough to be one, surely, and then some more.</p>"


@pytest.mark.parametrize("name", ["post tag-news", "entry comments-open", "story share", "post tag-river", "entry category-notice", "content related-topics", "page-with-share-buttons", "story search-result", "js nav-open"])
@pytest.mark.parametrize("tag", ["div", "article", "body"])
def test_html_names_dont_drop_the_article(name, tag):
    rest = '<div class="sidebar"><p>Side, bar</p></div><section id="comments"><p>Reader, says, so, too</p></section>'
    got = html_text.main_text(f'<body><nav>Home</nav><{tag} class="{name}"><h1>T</h1>{PARAGRAPH * 4}</{tag}>{rest}</body>')
    assert got == " ".join(["T"] * (tag != "body" or got.startswith("T")) + [PARAGRAPH[3:-4]] * 4)


def test_html_readers_words_go_whatever_their_element():
    page = f'<main><article class="post">{PARAGRAPH * 2}</article><article class="comment"><p>Reader, says, this, and, that</p></article></main>'
    assert html_text.main_text(page) == " ".join([PARAGRAPH[3:-4]] * 2)
    assert html_text.main_text(f"<!-->{PARAGRAPH}") == html_text.main_text(f"<!--->{PARAGRAPH}") == html_text.main_text(f"<!-- a > b -->{PARAGRAPH}") == PARAGRAPH[3:-4]


def test_html_several_posts_with_marked_names_all_stay():
    page = "".join(f'<article class="post tag-{i}"><h2>N{i}</h2>{PARAGRAPH * 2}</article>' for i in range(7))
    assert html_text.main_text(f"<body><div>{page}</div></body>").count("Some words") == 14


@pytest.mark.parametrize("bad", ['<a "x ', "<svg>", "<header>", '<p x="', "</x>", '<div class="ad">', '<div class="ad"><p>a', "<!--", "<", "<body>", "<script>", "<b></i>", "<p><b>", "<x><div></x>", "<svg><x>"])
def test_html_time_is_linear_in_bad_pages(bad):
    import time

    html_text.main_text(bad * 1000)
    took = []
    for n in (1, 4):
        began = time.process_time()
        html_text.main_text(bad * (n * 200_000 // len(bad)))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def built_page(r):
    """(html, text) of a page that is put together from an article and what is none."""
    word = lambda: r.choice(["alpha", "beta", "R&amp;D", "d&eacute;j&agrave;", "x&lt;y", "na\u00efve"])
    plain = lambda s: s.replace("&amp;", "&").replace("&eacute;", "\xe9").replace("&agrave;", "\xe0").replace("&lt;", "<")
    say = lambda n: ", ".join(" ".join(word() for _ in range(6)) for _ in range(n))
    blocks, text = [], []
    for _ in range(r.randrange(3, 9)):
        own = say(r.randrange(3, 6))
        text.append(plain(own))
        kind = r.randrange(5)
        own = own.replace(" ", r.choice([" ", "\n\t", "  "]))
        blocks.append([f"<p>{own}</p>", f"<p>{own}", f"<blockquote><p>{own}</p></blockquote>", f"<P CLASS=lead>{own.replace('alpha', '<b>alpha</b>')}</P>", f"<p>{own}</p><!-- <p>no</p> -->"][kind])
        if r.random() < 0.3:
            blocks.append(r.choice(['<div class="ad"><p>Buy, this, now</p></div>', "<aside><p>By the way, this</p></aside>", "<script>if (a < b) document.write('<p>no</p>')</script>", '<form><p>Your mail, please</p><input></form>', '<svg viewBox="0 0 1 1"><title>i</title><path d="m"/></svg>', '<div class="share"><a href="#">Share</a></div>']))
    inner = "".join(blocks)
    name = r.choice(["", ' class="post"', ' id=content', ' class="entry tag-x"', ' class="story no-sidebar"'])
    body = r.choice([f"<article{name}>{inner}</article>", f"<main><div{name}>{inner}</div></main>", f"<div{name}>{inner}</div>"])
    before = r.choice(["", "<header><h1>Site</h1><p>Slogan, of, it</p></header>", "<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>", '<div id="cookie-banner"><p>Cookies, and so on, ok</p></div>'])
    after = r.choice(["", "<footer><p>&copy; some, rights</p></footer>", '<div class="sidebar"><ul><li><a href=x>More</a></ul></div>', '<section class="comments"><div class="comment"><p>I, too, say, so</p></div></section>', "<style>p{}</style>"])
    return f"<!doctype html><html><head><title>t</title></head><body>{before}{body}{after}</body></html>", " ".join(" ".join(text).split())


def test_html_of_built_pages_is_their_article(spark):
    r = random.Random(11)
    pages = [built_page(r) for _ in range(400)]
    got = {x["page_id"]: x["text"] for x in html_text.extract(spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string")).collect()}
    for i, (html, text) in enumerate(pages):
        assert got[i] == text, html


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("Text", F.lit(1))
    got = html_text.extract(pages).collect()
    assert sorted(r["n_chars"] for r in got)[:3] == [0, 0, 0] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_counts_equal_brute_force(spark):
    got = quality_rules.quality_rules(docs(spark).withColumn("KEPT", F.lit("x")).withColumn("n_words", F.lit("y"))).collect()
    c = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter((r["doc_id"], *[r[x] for x in c]) for r in got) == Counter((i, *base(t)) for i, t, *_ in rows())
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_quality_counts_on_random_texts():
    r = random.Random(2)
    texts = ["".join(r.choice(["a ", "b ", "c\n", "a b c d e f g h ", "#", "\x0b", "\x85", "é "]) for _ in range(r.randrange(200))) for _ in range(300)]
    for batch in (1, 50, 10**6):
        cols = quality_rules.TextStats(batch)(texts)
        assert list(zip(*cols[:5])) == [base(t) for t in texts]


def test_quality_limits_follow_their_group(spark):
    r = random.Random(4)
    words = lambda n, extra: " ".join(r.choice("alpha beta gamma delta rho sigma tau".split()) + extra + str(r.randrange(999)) for _ in range(n))
    data = [(i, words(60, ""), "en", "plain", 1) for i in range(200)] + [(1000 + i, words(60, "#"), "en", "hash", 1) for i in range(200)] + [(5000, words(60, "#"), "en", "plain", 1), (5001, words(60, "#"), "xx", "tiny", 1), (5002, words(60, ""), None, None, 1)]
    got = quality_rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    kept, limit = {x["doc_id"]: x["kept"] for x in got}, {x["source"]: x["max_mark_rate"] for x in got}
    assert limit["plain"] == 0 and limit["hash"] > 1000 and 0 <= limit["tiny"] == limit[None]
    assert all(kept[i] for i in range(200)) and all(kept[1000 + i] for i in range(200)) and not kept[5000] and kept[5002]


def test_quality_limits_have_no_constant_in_them(spark):
    """Twice the marks in every text of a group give twice its limit, and the same verdicts."""
    r = random.Random(5)
    data = []
    for g, k in (("one", 1), ("two", 2), ("three", 3)):
        own = random.Random(9)
        for i in range(120):
            n = own.choice([2, 3, 3, 4, 4, 5, 6]) if i else 40
            words = [f"w{r.randrange(10**6):06d}" for _ in range(200)]
            data.append((len(data), " ".join(words) + "!" * (k * n), "en", g, 1))
    got = quality_rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    limit = {x["source"]: x["max_mark_rate"] for x in got}
    assert limit["one"] < limit["two"] < limit["three"] and abs(limit["three"] / limit["one"] - 3) < 0.5
    assert [x["doc_id"] % 120 for x in got if not x["kept"]] == [0, 0, 0]


def test_sketch_quantiles_are_within_their_bound(spark):
    from ephyra.llm.common import quantiles, sketch

    r = random.Random(6)
    data = [(k, int(r.expovariate(1 / 500))) for k in "aab" for _ in range(2000)]
    df = spark.createDataFrame(data, "k string, m long")
    got = {x["k"]: x["q"] for x in quantiles(sketch(df, ["k"], ["m"]), ["k"], {"q": 0.9}).collect()}
    for k in "ab":
        v = sorted(m for g, m in data if g == k)
        exact = v[math.ceil(0.9 * len(v)) - 1]
        assert exact - exact / 32 - 1 <= got[k] <= exact


LONG = "<p>" + "Some words of a long paragraph, with commas, and enough of them to count as text, so that it has points. " * 2 + "</p>"


@pytest.mark.parametrize("name", ["post tag-river", "tag-river", "content related-topics", "entry comments-open share-bar"])
def test_html_a_marked_article_beats_one_unmarked_block(name):
    got = html_text.main_text(f'<body><div class="{name}">{LONG * 4}</div><div>{LONG}</div></body>')
    assert got.count("Some words") >= 8


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_html_paragraphs_in_wrappers_stay_together(depth):
    inner = ("<div>" * depth + LONG + "</div>" * depth) * 6
    got = html_text.main_text(f'<body><nav>Home</nav><div>{inner}</div><div class="sidebar">{LONG}</div><footer>f</footer></body>')
    assert got.count("Some words") == 12 and "Home" not in got


def test_html_marked_boxes_beside_an_article_still_go():
    boxes = "".join(f'<div class="{n}">{LONG}</div>' for n in ("cookie-notice", "post-share", "ad", "content sponsored"))
    assert html_text.main_text(f"<body><div>{LONG * 4}</div>{boxes}</body>").count("Some words") == 8


def test_html_stray_end_tags_take_linear_time():
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.time()
        html_text.main_text("<i><div>" + "<b>" * n + "</i>" * n)
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] * 2.5 + 0.5


def russian(spark, extra):
    r = random.Random(1)
    words = ["дом", "река", "город", "весна", "книга", "слово", "время", "человек", "дорога", "песня", "утро", "сад"]

    def text(n):
        out = [r.choice(words)]
        while len(out) < n:
            w = r.choice(words)
            out += [w] if w != out[-1] else []
        return out

    rows = [(i, " ".join(text(r.randrange(80, 300))) + ".", "ru", "s") for i in range(99)]
    return text, spark.createDataFrame(rows + [(1000 + i, " ".join(f(text)), "ru", "s") for i, f in enumerate(extra)], "doc_id long, text string, lang string, source string")


def test_rules_where_all_documents_are_alike(spark):
    """Quartiles of 0: six capitals in a short text and five doubled words in a long one stay, many doubled words go."""
    few = lambda text: [*text(196), "UNESCO"]

    def long(text):
        w = text(20_000)
        return [x for i, x in enumerate(w) for _ in range(2 if i % 4000 == 1 else 1)]

    doubled = lambda text: [x for x in text(100) for _ in range(2)]
    shouted = lambda text: [x.upper() if i % 2 else "ABCDEFGH" for i, x in enumerate(text(200))]
    _, df = russian(spark, [few, long, doubled, shouted])
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert not any(got[i]["base_failed"] for i in (1000, 1002, 1003)) and got[1000]["kept"] and not got[1002]["kept"] and not got[1003]["kept"]
    assert got[1001]["kept"] or got[1001]["base_failed"]  # words of so few kinds repeat by chance
    assert all(got[i]["kept"] or got[i]["base_failed"] for i in range(99))
