"""Whitening, page text and periodic runs against brute force, planted cases and awkward rows."""

import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pytest

from estatelens.llm import html, periods, queries, whitening


# ---- periodic runs ----------------------------------------------------------------------------------------------


def brute_runs(words):
    """Every maximal stretch with period q whose smallest period is q."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(6, 4 * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_block_mismatch_is_exact(size):
    rng = np.random.default_rng(size)
    block, window = rng.integers(0, 10**6, (3, size)), rng.integers(0, 10**6, (3, 2 * size - 1))
    for prime, root in periods.PRIMES:
        got = periods.mismatch(block, window, prime, root)
        want = [[int(((block[r] - window[r, s : s + size]) ** 2).sum()) % prime for s in range(size)] for r in range(3)]
        assert got.tolist() == want


def test_runs_of_random_texts(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        words = list(map(str, rng.integers(0, rng.choice([1, 2, 3, 6, 30]), rng.integers(0, 130))))
        for _ in range(rng.integers(0, 4)):
            if len(words) > 8:
                s = int(rng.integers(0, len(words)))
                p = int(rng.integers(1, 2 + (len(words) - s) // 3))
                for i in range(s, min(len(words), s + p * int(rng.integers(3, 12)))):
                    words[i] = words[s + (i - s) % p]
        rows.append((k, rng.choice([" ", "\n", " \t\x0b"]).join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs]) for r in periods.collapse(docs).collect()}
    assert got == {k: (len(t.split()), brute_runs(t.split())) for k, t in rows}
    assert sum(len(r) for _, r in got.values()) > 200


def test_periodic_report(spark, awkward, nothing):
    for docs in (awkward, nothing, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        got = sorted(map(tuple, periods.digests(periods.collapse(periods.plant(docs))).collect()), key=str)
        want = sorted((brute_report(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=str)
        assert got == want


@pytest.mark.parametrize("text", [["a"] * 60_000, (["a"] * 3000 + ["c"]) * 20, ["x"] + ["a", "b", "a"] * 20_000 + ["y"]], ids=["one word", "long periods", "three"])
def test_long_periodic_texts(spark, text):
    """Nested and very long runs: what a slower method would compare in quadratic time."""
    row = periods.collapse(spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")).collect()[0]
    runs = [tuple(r) for r in row.runs]
    if text[1] == "a" and "c" in text:
        assert (0, 60_020, 3001) in runs and len(runs) == 21
    else:
        assert runs == ([(0, 60_000, 1)] if text[0] == "a" else [(1, 60_000, 3)])
    assert len(row.collapsed.split()) == len(set(text)) + ("x" in text and 1) if "c" not in text else True


# ---- whitening --------------------------------------------------------------------------------------------------


def test_cross_products_are_exact():
    rng = np.random.default_rng(3)
    for top in (1, 10**4, 10**9, 2**52):
        x = rng.integers(-top, top + 1, (130, 5))
        sums, products = whitening.cross_products(x)
        wide = x.astype(object)
        assert sums.tolist() == wide.sum(axis=0).tolist() and products.tolist() == wide.T.dot(wide).tolist()


def test_whitened_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = queries.op11_embedding_whitening(spark, "/root/testdata/sf0.001").toPandas()
    source = rows.toPandas().set_index("vec_id").embedding
    x = np.floor(np.array(source.tolist(), np.float64) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(x.T.astype(np.float64), bias=True))
    assert len(got) == 8 * n and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() <= 1e-9
    for component, part in got.groupby("component"):
        part = part.set_index("vec_id").loc[source.index]
        want = (x - sums / n) @ vectors[:, -component] / np.sqrt(values[-component])
        sign = np.sign((want * part.whitened).sum())
        assert np.allclose(part.whitened * sign, want, atol=1e-8)
        assert np.allclose(part.explained, values[-component] / values.sum(), rtol=1e-10)
        assert part.deviation.tolist() == ((n * x - sums) ** 2).sum(axis=1).tolist()


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (None, [3.0, -1.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, []), (8, [1.0]),
        (9, [1e200, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, "n") for r in rows], "vec_id long, embedding array<double>, component string")
    got = whitening.whitened(frame).toPandas()
    assert len(got) == 8 and set(got.n) == {4} and sorted(got.vec_id.dropna()) == [1] * 4 + [2] * 2 and got.identity_error.max() < 1e-9
    # One direction only: the second component has nothing to scale.
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], "vec_id long, embedding array<float>")
    flat = whitening.whitened(line).toPandas()
    assert flat[flat.component == 2].whitened.isna().all() and flat[flat.component == 1].whitened.notna().all()
    same = whitening.whitened(spark.createDataFrame([(1, [1.0]), (2, [1.0])], "vec_id long, embedding array<double>")).toPandas()
    assert same.whitened.isna().all() and set(same.deviation.astype(int)) == {0}
    assert whitening.whitened(frame.where("vec_id between 3 and 7")).count() == 0 and whitening.whitened(frame.limit(0)).count() == 0


def test_deviation_beyond_a_long():
    x = np.array([[0, 0], [2**50, 1]])
    assert whitening.deviations(x, 2, np.array([2**50, 1], object)) == [2**100 + 1, 2**100 + 1]


# ---- pages ------------------------------------------------------------------------------------------------------

BODY = ["A long first paragraph, with commas, and stops. It says much about the matter; more than a menu would.", "Short one.", "The end of it all comes here, after some more words, in the last paragraph."]


def page(before="", after="", start="<article>", end="</article>", parts=BODY):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{before}{start}<h1>Head &amp; tail</h1>{''.join(f'<p>{p}</p>' for p in parts)}{end}{after}</body></html>"


CLUTTER = (
    '<header class="site"><h2>Site, of all sites.</h2></header><nav><ul><li><a href="/">Home</a><li><a href="/b">News, and more</a></ul></nav>'
    '<div class="cookie-notice">We use cookies, and other things. Do you agree?</div><script>var t="</p><p>no</p>";</script><form><label>Name</label><input><button>Go</button></form>',
    '<aside><p>Read also this, and that.</p></aside><div id="sidebar-2"><p>Side, by side.</p></div><div class="ad banner"><p>Buy now, pay later. Really!</p></div>'
    '<section class="comments"><article><p>A reader says, at length, that this is a good article. Thanks, all!</p></article></section>'
    "<!-- <p>hidden</p> --><footer><p>&copy; all, rights reserved.</p></footer>",
)
TEXT = "\n\n".join(["Head & tail", *BODY])
PAGES = {
    "marked": (page(*CLUTTER), TEXT),
    "main only": (page(*CLUTTER, start='<main id="main-menu-content">', end="</main>"), TEXT),
    "plain divs": (page(*CLUTTER, start='<div class="page"><div class="text">', end="</div></div>"), TEXT),
    "link menu of divs": (page('<div class="x"><div><a href="/">Home page</a></div><div><a href="/n">News page</a></div></div>', start="<div>", end="</div>"), TEXT),
    "nested": (page(start='<div><div class="intro"><p>A first word, by the editor, to start with.</p></div><div class="rest">', end="</div></div>"),
               "A first word, by the editor, to start with.\n\n" + TEXT),
    "header in article": (page(*CLUTTER, start="<article><header><p>Kicker</p></header>"), "Kicker\n\n" + TEXT),
    "comments in article": (page(start="<article>", end='<div class="reader-comments"><p>Nice, very nice. I agree.</p></div></article>'), TEXT),
    "unclosed": ("<body><nav><a>Home</a></nav><article><h1>Head<p><b>One, two.<br>three<p>Four</b>, five.<ul><li>six<li>seven</ul><table><tr><td>8<td>9</table>",
                 "Head\n\nOne, two. three\n\nFour, five.\n\nsix\n\nseven\n\n8\n\n9"),
    "cut off": ('<article><p>One &lt;b&gt; &#233;&nbsp; x &am</p><p>Two</p><p class="a', "One <b> é x &am\n\nTwo"),
    "quotes": ('<article><p title="a > b">One <a href=\'x">y\'>link</a>.</p></article>', "One link."),
    "hidden": ('<article><p>One.</p><p hidden>No.</p><p style="display: none">No.</p><div aria-hidden="true">No.</div></article>', "One."),
    "no tags": (" just  some\n words ", "just some words"),
    "white": ("<article><p>a\t\n b c</p></article>", "a b c"),
    "menu only": ("<nav><a>Home</a></nav><footer>x</footer>", ""), "links only": ("<ul><li><a href=x>One</a><li><a href=y>Two</a></ul>", ""),
    "null": (None, ""), "empty": ("", ""), "blank": (" \n", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    given, want = PAGES[name]
    assert html.main_text(given) == want


@pytest.mark.parametrize("given", ["<" * 3000, "<p" * 3000, '<a "' * 2000, "</div>" * 3000, "<div>" * 3000 + "x", "<!--" * 3000, "&" * 3000])
def test_broken_pages_end(given):
    assert isinstance(html.main_text(given), str)


def test_paths_decide_where_nothing_is_marked():
    """The article's path scores above short lines elsewhere, and smoothing lifts its heading."""
    found = html.blocks(page("<div><span>Top</span></div><div>Menu</div>", "<div>Bottom</div>", start='<div class="t">', end="</div>"))
    scores = dict(zip([b.path for b in found], html.path_scores(found), strict=True))
    assert max(scores, key=scores.get) == "html/body/div.t/p" and scores["html/body/div.t/h1"] > scores["html/body/div"]


def test_extract_rows(spark, small):
    rows = [(1, "u", PAGES["marked"][0], 7), (1, "u", PAGES["marked"][0], 7), (None, None, None, 7), (3, "v", "", 7), (4, "w", "<article>" + "<p>word, word</p>" * 20_000, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html.extract(pages).collect()}
    long = "\n\n".join(["word, word"] * 20_000)
    assert got == {(1, "u"): (TEXT, len(TEXT)), (None, None): ("", 0), (3, "v"): ("", 0), (4, "w"): (long, len(long))}
    assert html.extract(pages).count() == 5 and html.extract(pages.limit(0)).count() == 0
    every = html.extract(small("pages"))
    assert every.count() == small("pages").count() and every.where("n_chars = 0").count() == 0 and math.isfinite(every.selectExpr("avg(n_chars)").first()[0])
