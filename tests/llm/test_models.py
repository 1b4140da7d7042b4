import html
import re

import numpy as np
import pytest

from spindrift.llm import html_extract, html_pages, langid, quality
from spindrift.llm.html_tree import Tree

SF = "/root/testdata/sf0.01"


def test_bundles_follow_the_definition():
    e = langid.Encoder(64)
    total = np.zeros(64)
    letters = [0, *map(ord, "abc"), 0, ord("d"), 0]
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        total += np.roll(e.letter(a), 2) * np.roll(e.letter(b), 1) * e.letter(c)
    assert np.allclose(e.encode("Abc, 9 D!"), total)
    assert e.encode("12 .") is None and e.encode(None) is None and e.encode("") is None


def test_pieces_of_long_texts_add_up(monkeypatch):
    text = "the quick brown fox " * 50
    whole = langid.Encoder(32).encode(text)
    monkeypatch.setattr(langid, "_PIECE", 7)
    monkeypatch.setattr(langid, "CACHE", 5)
    assert np.allclose(langid.Encoder(32).encode(text), whole)


def test_language_id_edges(docs):
    rows = [(i, ("uno dos tres que es la casa " if i % 2 else "the of and that house with ") * 3, "es" if i % 2 else "en") for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !", "en"), (None, "the of and", "en"), (103, "the that " * 50_000, None), (103, "the that " * 50_000, None)]
    out = langid.language_id(docs(*rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id in (100, 101, 102):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == ("es" if (r.doc_id or 0) % 2 and r.doc_id < 50 else "en") and 0 < r.score <= 1
        assert r.held_out == (r.doc_id is None or __import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0)
    assert langid.language_id(docs()).collect() == []
    assert {r.lang_pred for r in langid.language_id(docs((1, "abc"), (2, "def"))).collect()} == {"und"}


def test_language_id_on_held_out_rows(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.language_id(table).where("held_out").join(table.select("doc_id", "lang"), "doc_id")
    rows = found.collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(0)
    net = quality.Network()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    chunks = rng.integers(0, 256, (5, quality.CHUNK_BYTES)).astype(np.uint8)
    args = chunks, np.array([0, 0, 1, 2, 2]), np.array([1, 0, 1]), np.array([2.0, 1.0, 1.0])
    slopes = net.gradients(*args)[1]
    for name, value in net.weights.items():
        at = (int(chunks[0, 3]), 1) if name == "embed" else tuple(rng.integers(0, s) for s in value.shape)
        value[at] += 1e-5
        high = net.gradients(*args)[0]
        value[at] -= 2e-5
        low = net.gradients(*args)[0]
        value[at] += 1e-5
        assert slopes[name][at] == pytest.approx((high - low) / 2e-5, rel=1e-3, abs=1e-7)


def brute_score(net, text):
    """Chunk by chunk, position by position."""
    w, hop = net.weights, quality.HOP * quality.STRIDE
    n = max(-(-len(text) // hop), 1)
    padded = text + b"\0" * (2 * hop + quality.KERNEL)
    rows = []
    for c in range(n):
        part = padded[c * hop : c * hop + quality.CHUNK_BYTES]
        best = [max(float(w["embed"][list(part[p : p + quality.KERNEL])].ravel() @ w["kernel"][:, f]) for p in range(0, quality.CHUNK * quality.STRIDE, quality.STRIDE)) for f in range(3)]
        rows.append([max(b + float(w["bias"][f]), 0) for f, b in enumerate(best)])
    return np.array(rows)


def test_scores_cover_the_whole_text(monkeypatch):
    net = quality.Network(3)
    text = bytes(np.random.default_rng(1).integers(32, 127, 700).astype(np.uint8))
    rows = brute_score(net, text)
    out = net.weights["out"].copy()
    net.weights["out"][:] = 0
    for f in range(3):
        net.weights["out"][f], net.weights["out"][quality.FILTERS + f] = 0.5, -0.25
    want = 1 / (1 + np.exp(-(rows.mean(0) * 0.5 - rows.max(0) * 0.25).sum()))
    assert net.score(text) == pytest.approx(want, rel=1e-4)
    monkeypatch.setattr(quality, "_PIECE", quality.HOP)
    assert net.score(text) == pytest.approx(want, rel=1e-4)
    net.weights["out"] = out
    changed = bytearray(text * 30)
    before = net.score(bytes(changed))
    changed[-40:] = b"\xff\xfe" * 20
    assert net.score(bytes(changed)) != before


def test_quality_on_held_out_rows(spark):
    table, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(table, labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert good and bad and np.mean(np.array(good)[:, None] > np.array(bad)[None, :]) > 0.8
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1, "x"), (2, None, "x"), (None, 0, "x"), (3, 0, "x"), (3, 0, "x")], "doc_id long, quality int, score string")
    rows = [(1, "good text"), (2, None), (3, "!!! $$$"), (None, ""), (4, "word " * 100_000), (4, "word " * 100_000)]
    out = quality.quality(docs(*rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert quality.quality(docs(), labels).collect() == []
    assert len(quality.quality(docs(*rows), labels.limit(0)).collect()) == len(rows)


# --- html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h1>My Site</h1><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a><li><a href=/c>Sport</a></ul></nav></header>
<div class="cookie-notice">We use cookies on this site. <button>OK</button></div><div class=ad>Buy now, the best of all.</div>
<article><h1>Title &eacute; &#233; &am &lt;b&gt;</h1><p><b>First
   part<br>goes   on.<p>Second <a href="/x">link</a> part.</p><ul><li>One thing that is listed.<li>Another thing is listed.</ul>
<!-- <p>hidden</p> --><p>To.</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this a lot, thank you.</p></div></section>
<form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2024 My Site, all rights.</footer>"""


def test_extraction_of_a_page():
    assert html_extract.trained().text(PAGE).split("\n") == [
        "Title é é &am <b>", "First part goes on.", "Second link part.", "One thing that is listed.", "Another thing is listed.", "To.",
    ]


@pytest.mark.parametrize(
    "source", ["", "<", "<p", "a < b", "<p>x", "</p></div>", "<a <b <c>", "<script>", "<!--", "<p title='it's>x</p>", "<div>" * 6000 + "x", "<li>a" * 3000, "<p class=\"a" * 50, "\x00<p>퟿</p>"]
)
def test_broken_markup_is_read(source):
    tree = Tree(source)
    assert all(p < i for i, p in enumerate(tree.parent))
    html_extract.trained().text(source)


def test_sum_product_gives_exact_marginals():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = int(rng.integers(2, 9))
        parent = [-1, *(int(rng.integers(0, i)) for i in range(1, n))]
        kinds, unary = [int(k) for k in rng.integers(0, html_extract.EDGES, n)], rng.normal(size=n).tolist()
        coupling = rng.normal(size=(html_extract.EDGES, 2, 2)).tolist()
        mass = np.zeros((n, 2))
        for state in range(2**n):
            x = [state >> i & 1 for i in range(n)]
            weight = np.exp(sum(u * b for u, b in zip(unary, x, strict=True)) + sum(coupling[kinds[i]][x[parent[i]]][x[i]] for i in range(1, n)))
            for i in range(n):
                mass[i, x[i]] += weight
        belief = html_extract.sum_product(parent, kinds, unary, coupling)[0]
        assert np.allclose(1 / (1 + np.exp(-np.array(belief))), mass[:, 1] / mass.sum(1))


def test_extraction_of_pages_that_were_not_learned():
    model, runs, wrong = html_extract.trained(), 0, 0
    for source, is_content in html_pages.labelled_pages(120, 77):
        tree = Tree(source)
        for tag, text, p in zip(tree.tag, tree.text, model.marginals(tree), strict=True):
            if tag == "#text":
                runs += 1
                wrong += is_content(text) != (p > 0.5)
    assert runs > 1000 and wrong / runs < 0.03


def test_extract_edges(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (1, "u", PAGE, "x"), (3, "u", "<article><p>" + "Long text goes on. " * 60_000, "x")]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert {r.n_chars for r in out if r.page_id in (2, None)} == {0}
    assert [r.n_chars for r in out if r.page_id == 3] == [60_000 * 19 - 1]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_no_length_changes_what_a_tag_or_element_is():
    for size in (9, 9_000, 900_000):
        for quote in "\"'":
            tree = Tree(f"<div data-x={quote}{'v' * size}<b>leak</b> words{quote}>real</div>")
            assert [t for t in tree.text if t] == ["real"]
    for depth in (9, 5_000, 100_000):
        tree = Tree("<div>" + "<i>" * depth + "<svg>drawn</svg><a>link</a>" + "</i>" * depth + " end</div><p>after</p>")
        assert [t for t in tree.text if t] == ["link end", "after"] and sum(tree.linked) == 4


def test_unclosed_tags_take_linear_time():
    import time

    started = time.process_time()
    for part in ("<a '>' ", '<a ">', "<a", "<ul><b><li></li>"):
        Tree(part * 30_000)
    assert time.process_time() - started < 30


def article_text(source):
    """What the markup of the pages table says: the blocks of its article element."""
    body = re.search(r"<article[^>]*>(.*?)</article>", source, re.S)
    blocks = re.split(r"</?(?:h\d|p|ul|ol|li|blockquote|div|section)\b[^>]*>", body[1] if body else "")
    texts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_extraction_of_the_pages_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: article_text(r.html) for r in pages.collect()}
    found = html_extract.extract(pages).collect()
    assert len(found) == len(want) and sum(map(len, want.values())) > 10_000
    assert {r.page_id: r.text for r in found} == want
    assert all(r.n_chars == len(r.text) for r in found)
