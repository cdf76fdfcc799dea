import html
import re

import numpy as np
import pytest

from blockatlas.llm import html_text as H


def main_text(page):
    """The article's text by tags alone; good for pages that have one article element."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", article)
    return " ".join(" ".join(" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", "\n"))).split()) for p in parts).split())


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    return H.train([r.html for r in rows if len(r.html) < H.SAMPLE_CHARS])


def test_every_page_of_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = H.op3_html_lstm(spark, sf_dir).collect()
    assert len(got) == len(pages)
    same = [" ".join(r.text.split()) == main_text(pages[r.page_id].html) for r in got]
    assert np.mean(same) > 0.98 and all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)


def test_pages_of_other_layouts(model):
    rng = np.random.default_rng(77)
    built = [H.build_page(rng, [f"w{k}" for k in range(300)]) for _ in range(150)]
    marks = model.label([H.inputs(b) for b, _ in built])
    assert np.mean(np.concatenate(marks) == np.concatenate([y for _, y in built])) > 0.95


def test_blocks():
    page = """<html><head><title>no</title><style>p{}</style></head><body><!-- <p>no</p> --><ul><li>a<li>b <b>bo</b>ld</ul>
    <p>one<br>two&nbsp;three &amp;lt; &#233;<p>next <a href=x>link</a><script>var s="</p><p>no";</script> end<div>in</div>tail</body>"""
    got = H.blocks_of(page)
    assert [t for _, t, _ in got] == ["a", "b bold", "one two three &lt; é", "next link end", "in", "tail"]
    assert [len(p) for p, _, _ in got][:2] == [4, 4] and got[3][2] > 0


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<p><", "</p></div>", "<!-- x", "<script>x", "text only", "<b>" * 3000 + "x", "<div>" * 3000 + "x" + "</div>" * 10, "\x00<p>\ud800</p>".encode("utf-8", "replace").decode(), "<p class='a" + "b" * 5000])
def test_broken_pages(model, page):
    blocks = H.blocks_of(page)
    assert len(model.label([H.inputs(blocks)])[0]) == len(blocks)


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    m = H.BiLstm(3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, mask, y = H._pad([rng.normal(size=(4, H.INPUT)), rng.normal(size=(2, H.INPUT))], [np.array([1, 0, 1, 1.0]), np.array([0, 1.0])])
    loss, grad = m.gradients(x, mask, y)
    for name in m.p:
        flat = m.p[name].reshape(-1)
        for k in rng.integers(0, flat.size, 4):
            was = flat[k]
            flat[k] = was + 1e-4
            up = m.gradients(x, mask, y)[0]
            flat[k] = was - 1e-4
            down = m.gradients(x, mask, y)[0]
            flat[k] = was
            assert grad[name].reshape(-1)[k] == pytest.approx((up - down) / 2e-4, rel=0.05, abs=2e-4)
    assert loss > 0


def test_padding_does_not_change_labels(model):
    rng = np.random.default_rng(5)
    pages = [H.inputs(H.build_page(rng, ["a", "b"])[0]) for _ in range(20)]
    together = model.label(pages)
    assert all((a == model.label([p])[0]).mean() > 0.99 for a, p in zip(together, pages) if len(p))


def test_hostile_table(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, None, "<article><h1>T</h1><p>Some text of a page here.</p></article>"), (3, "u", "<p>" + "word " * 60_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = {r.page_id: r for r in H.extract(df, model=model).collect()}
    assert got[1].text == got[2].text == "" and got[1].n_chars == 0 and len(got) == 4
    assert H.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("first", ["col-lg-4 col-md-4 col-sm-12 col-xs-12", "post-123 type-post status-publish format-standard"])
def test_names_behind_long_class_lists(first):
    paths = [H.blocks_of(f'<div class="{first} {name}">x</div>')[0][0] for name in ("sidebar", "comments", "article")]
    assert len({H._path_vector(p).tobytes() for p in paths}) == 3


def test_pages_of_long_class_lists(model, monkeypatch):
    plain = H.blocks_of
    monkeypatch.setattr(H, "blocks_of", lambda page: plain(page.replace('class="', 'class="col-lg-4 col-md-4 col-sm-12 col-xs-12 ')))
    rng = np.random.default_rng(77)
    built = [H.build_page(rng, [f"w{k}" for k in range(300)]) for _ in range(150)]
    marks = model.label([H.inputs(b) for b, _ in built])
    assert np.mean(np.concatenate(marks) == np.concatenate([y for _, y in built])) > 0.93


def test_every_word_of_a_long_block_counts():
    words = [f"w{k}" for k in range(5000)]
    one = H.inputs([(("p",), " ".join(words), 0.0)])[0]
    want = np.zeros(H.WORD_DIM)
    for w in words:
        at, sign = H._slot(w, H.WORD_DIM)
        want[at] += sign / (4 * len(words) ** 0.5)
    assert one[H.PATH_DIM : H.PATH_DIM + H.WORD_DIM] == pytest.approx(want, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("page,want", [
    ("<p class=it's>Hello I don't know</p>", ["Hello I don't know"]),
    ("<a href=/o'neil>link</a> text <p>we can't</p>", ["link text", "we can't"]),
    ("""<p title="a>b" data-x='"'>x</p><p class = main >y""", ["x", "y"]),
    ('<p a="never closed>x</p><p>y</p>', ["x", "y"]),
    ("<p>mass <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>E=mc^2</annotation></math> holds</p>", ["mass E=mc2 holds"]),
    ("<p>a<!-->b<!-- c --!>d<br/>e<img src=x alt='>'>f", ["abd ef"]),
])
def test_attributes_comments_and_formulas(page, want):
    assert [t for _, t, _ in H.blocks_of(page)] == want


def test_only_named_attributes_tell_of_a_path():
    plain, other, named = (H.blocks_of(p)[0][0].vector for p in ("<div>x", "<div data-class=sidebar title='class=menu'>x", "<div class=sidebar>x"))
    assert (plain == other).all() and (plain != named).any()


@pytest.mark.parametrize("piece", ["<div>x", "<div class=c{}>x", "<b><div></b>x", "<ul><li>x", "x</i>"])
def test_deep_nesting_is_linear(piece):
    import time

    times = []
    for n in (4000, 32_000):
        page, start = "".join(piece.format(k) for k in range(n)), time.process_time()
        assert H.blocks_of(page)
        times.append(time.process_time() - start)
    assert times[1] < 40 * times[0] + 0.5  # eight times the page; 64 times if it were quadratic


def test_long_pages_are_learned_from():
    page = "<nav>menu</nav><article>" + "<p>text of it</p>" * 500 + "</article>"
    blocks = H.blocks_of(page)
    assert H.weak_labels(blocks).sum() == 500 and H.train([page], built=5).p["out"].any()
