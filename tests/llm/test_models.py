"""The additive model and the block labeller: learning, held-out accuracy, and odd rows."""

import random

import numpy as np
import pytest

from panelcast.llm import gam, html_extract
from tests.llm.conftest import prose

# --- additive model --------------------------------------------------------------------------


def junk(seed: int, n: int) -> str:
    words = prose(seed, n).split()
    kind = seed % 3
    return " ".join([words[0]] * n) if kind == 0 else " ".join(w + "###" for w in words) if kind == 1 else " ".join(w.upper() + "!!" for w in words)


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    rng = random.Random(4)
    rows = [(i, (prose if i % 3 else junk)(i, rng.randrange(20, 120)), "a") for i in range(900)]
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(600)] + [(5, None), (None, 1), (10**6, 1)], "doc_id long, quality int")
    return make_docs(rows), labels


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = gam.fit_on(docs, labels)
    scored = {r.doc_id: r.score for r in gam.score(docs, model).collect()}
    held = [(scored[i] >= 0.7) == bool(i % 3) for i in range(600, 900)]
    assert sum(held) / len(held) > 0.97 and all(0 <= s <= 1 for s in scored.values())


def test_scores_are_sums_of_table_entries(labelled):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # an interaction only
    model = gam.fit(x, y)
    assert model.pairs[0] in ((0, 1), (1, 0)) and ((model.scores(x) > 0.5) == (y > 0.5)).mean() > 0.9
    for row, got in zip(x[:20], model.logits(x[:20])):
        total = model.intercept + sum(t[sum(e <= v)] for e, t, v in zip(model.edges, model.tables, row))
        coarse = [sum(e <= v) for e, v in zip(model.pair_edges, row)]
        total += sum(t[coarse[a], coarse[b]] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert abs(total - got) < 1e-9


def test_degenerate_labels_and_odd_rows(spark, make_docs, odd_rows, labelled):
    none = gam.fit_on(make_docs(odd_rows), spark.createDataFrame([], "doc_id long, quality int"))
    assert none.scores(np.zeros((2, len(gam.FEATURES)))).tolist() == [0.5, 0.5]
    one = gam.fit_on(make_docs(odd_rows), spark.createDataFrame([(4, 1), (5, 1)], "doc_id long, quality int"))
    assert one.scores(np.zeros((1, len(gam.FEATURES))))[0] == pytest.approx(4 / 5)  # id 5 occurs twice
    model = gam.fit_on(*labelled)
    scores = [r.score for r in gam.score(make_docs(odd_rows), model).collect()]
    assert len(scores) == len(odd_rows) and None not in scores
    assert gam.score(make_docs([]).limit(0), model).count() == 0


def test_the_sample_is_bounded(labelled, monkeypatch):
    docs, labels = labelled
    seen = []
    monkeypatch.setattr(gam, "fit", lambda x, y: seen.append(len(y)))
    gam.fit_on(docs, labels, max_rows=40)
    gam.fit_on(docs, labels)
    assert seen == [40, 600]
    again = docs.filter("doc_id = 3").unionByName(docs.filter("doc_id = 3"))
    for _ in range(6):
        again = again.unionByName(again)
    gam.fit_on(docs.unionByName(again), labels, max_rows=100)
    assert seen[-1] <= 100


# --- block labeller --------------------------------------------------------------------------


def texts_of(html: str) -> list[str]:
    return [b.text for b in html_extract.read_blocks(html)]


def test_blocks_of_broken_and_quoted_markup():
    assert texts_of("<p>a<b>b</b>\n c<br>d<p>e &amp; f &#233;&nbsp;g") == ["ab c d", "e & f é g"]
    assert texts_of('<head><title>t</title></head><script>var a="<p>x</p>";</script><style>p{}</style><!-- <p>y</p> --><div>z<ul><li>1<li>2</ul>w') == ["z", "1", "2", "w"]
    assert texts_of("a < b and c > d") == ["a < b and c > d"]
    assert texts_of("") == [] and texts_of("<<<>>><p") is not None
    assert texts_of("<main><p>Energy is <math><mi>E</mi></math> <svg><text>s</text></svg> here.<noscript>turn it on</noscript>more") == ["Energy is E s here.", "turn it on", "more"]
    assert texts_of("<p>a<object>b</object>c<video>d</video><iframe>e</iframe><audio>f</audio><canvas>g</canvas>") == list("abcdefg")
    assert texts_of("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(2)
    model = html_extract.Labeller(rng)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = (rng.random((5, 3, html_extract.INPUTS)) < 0.05).astype(np.float32)
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], np.float32)
    y = (rng.random((5, 3)) < 0.5).astype(np.float32)

    def loss():
        p = html_extract.sigmoid(model.logits(x, mask)[0])
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    grads = model.gradients(x, mask, y)
    for name, value in model.p.items():
        at = tuple(rng.integers(0, n) for n in value.shape) if name[0] != "w" else (int(np.flatnonzero(x.sum((0, 1)))[0]), 3)
        old, eps = value[at], 1e-2
        value[at] = old + eps
        up = loss()
        value[at] = old - eps
        down = loss()
        value[at] = old
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 2e-3, name


@pytest.fixture(scope="module")
def pages(spark):
    rows = []
    for i in range(80):
        paragraphs = "".join(f"<p>{prose(1000 * i + k, 30)}.</p>" for k in range(1 + i % 6))
        side = f'<aside class="sidebar"><p>{prose(77 * i, 12)}</p></aside>' if i % 3 == 0 else ""
        talk = f'<section id="comments"><div class="comment"><p>{prose(91 * i, 25)}</p></div></section>' if i % 4 == 0 else ""
        rows.append((i, f"u{i}", f"<html><body><nav><ul><li><a>home</a><li><a>{prose(i, 1)}</a></ul></nav><div class=ad>{prose(3 * i, 9)}</div>"
                                 f"<article><h1>{prose(5 * i, 6)}</h1>{paragraphs}</article>{side}{talk}<footer>&copy; {prose(7 * i, 5)}</footer>", "x", 1))
    rows += [(None, None, None, "x", 1), (900, "e", "", "x", 1), (901, "f", "<p>", "x", 1), (0, "u0", rows[0][2], "x", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_main long").repartition(3)


def test_extraction_keeps_the_article_only(pages):
    model = html_extract.train_labeller(pages)
    rows = html_extract.extract(pages, model).collect()
    found = {r.page_id: r.text for r in rows}
    assert len(rows) == 84 and found[None] == found[900] == found[901] == ""
    right = 0
    for i in range(80):
        want = [prose(5 * i, 6)] + [prose(1000 * i + k, 30) + "." for k in range(1 + i % 6)]
        right += found[i] == "\n\n".join(want)
    assert right >= 78
    long_page = "<main><h1>t</h1>" + "".join(f"<p>{prose(i, 20)}</p>" for i in range(3000)) + "</main><footer>f</footer>"
    blocks = html_extract.read_blocks(long_page)
    kept = model.label([blocks])[0]
    assert len(blocks) == 3002 and kept[:-1].mean() > 0.95


def test_slices_of_inputs_do_not_change_labels_and_memory_stays_low(pages, monkeypatch):
    import tracemalloc

    model = html_extract.train_labeller(pages)
    several = [html_extract.read_blocks(r.html or "") for r in pages.limit(30).collect()]
    whole = model.label(several)
    monkeypatch.setattr(html_extract, "STRIDE", 3)
    assert all((a == b).all() for a, b in zip(whole, model.label(several)))
    monkeypatch.undo()
    many = html_extract.read_blocks("<p>w" * 60_000)
    tracemalloc.start()
    assert len(model.label([many])[0]) == 60_000
    assert tracemalloc.get_traced_memory()[1] < 90e6
    tracemalloc.stop()


def test_null_ids_do_not_fill_the_sample_and_nested_blocks_are_not_taught(spark, monkeypatch):
    rows = [(None, f"<main><p>{prose(i, 8)}</p><aside><p>side</p></aside><div class=comments><p>talk</p></div></main>") for i in range(300)]
    rows += [(i, f"<main><p>known {i}</p></main>") for i in range(300)] + [(1, "<main>" + "<p>w" * 100_000)]
    seen = []
    monkeypatch.setattr(html_extract.Labeller, "train", lambda self, lessons, rng: seen.extend(lessons))
    monkeypatch.setattr(html_extract, "layouts", lambda texts, rng, n: seen.append(texts) or [])
    html_extract.train_labeller(spark.createDataFrame(rows, "page_id long, html string"))
    texts = [t for page in seen[0] for t in page]
    assert len(seen[0]) == 300 and sum(t.startswith("known") for t in texts) > 100 and not {"side", "talk", "w"} & set(texts)


def test_no_pages(pages):
    model = html_extract.train_labeller(pages.limit(0))
    assert html_extract.extract(pages.limit(0), model).count() == 0
