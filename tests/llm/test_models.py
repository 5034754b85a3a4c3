import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from messy import documents, nothing, texts
from tidemark.llm import extraction, language, quality

SF = "/root/testdata/sf0.01"


def held_out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 4 == 2


# Language


def tiny_model():
    pieces = ["▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "▁ab"]
    r = np.random.default_rng(1)
    probability = r.random((len(pieces) + 1, 2))
    probability /= probability.sum(axis=0)
    return language.PieceModel(["x", "y"], {p: k for k, p in enumerate(pieces)}, probability)


def every_segmentation(word):
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        at, out = 0, []
        for k, cut in enumerate(cuts, 1):
            if cut:
                out.append(word[at:k])
                at = k
        yield [*out, word[at:]]


@pytest.mark.parametrize("word", ["a", "abc", "cabab", "zabz", "bbbbbb"])
def test_forward_sums_all_segmentations(word):
    model = tiny_model()
    want = np.zeros(2)
    for parts in every_segmentation("▁" + word):
        rows = [model.pieces.get(p, len(model.pieces) if len(p) == 1 else None) for p in parts]
        if None not in rows:
            want += model.probability[rows].prod(axis=0)
    assert np.allclose(np.exp(model.log_likelihood([word])[0]), want)
    assert np.allclose(model.long_word("▁" + word), np.log(want))


def test_long_words_do_not_underflow():
    model = tiny_model()
    value = model.log_likelihood(["abc" * 400])[0]
    assert np.isfinite(value).all() and value[0] < -100


@pytest.mark.parametrize("n", [*range(34, 46), 300])
def test_runs_outside_the_vocabulary_do_not_underflow(n):
    counts = {"x": {"ab": 5, "\u1200" * n: 2, "abc" * 20: 1}, "y": {"bc": 5}}
    model = language.fit(counts, ["\u2581", "a", "b", "c", "ab", "bc", "abc"])
    assert np.isfinite(model.probability).all() and (model.probability > 0).all()
    ab, bc = (model.pieces[p] for p in ("abc", "bc"))
    assert model.probability[ab, 0] > model.probability[bc, 0]
    value = model.log_likelihood(["\u1200" * n, "ab"])
    assert np.allclose(value[0], n * math.log(language.UNKNOWN) + np.log(model.probability[0]))
    assert np.allclose(value[0], model.long_word("\u2581" + "\u1200" * n))


def test_training_takes_runs_of_any_length():
    pieces = ["\u2581", "a", "b", "ab"]
    counts = {"x": {"ab" * 60: 1}}
    uses = language.fit(counts, pieces, rounds=1).probability[:-1, 0]
    assert uses[pieces.index("ab")] > 10 * uses[pieces.index("\u2581")]


def test_fitting_raises_the_likelihood():
    counts = {"x": {"ab": 5, "abc": 9, "bc": 1}}
    pieces = ["▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "▁ab"]
    values = []
    for rounds in (1, 3, 8):
        model = language.fit(counts, pieces, rounds, prior=1e-6)
        values.append(sum(n * model.log_likelihood([w])[0, 0] for w, n in counts["x"].items()))
    assert values[0] <= values[1] + 1e-9 <= values[2] + 2e-9


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    rows = language.identify(docs, model).join(docs.select(F.col("doc_id").alias("k"), "lang"), F.col("doc_id") == F.col("k")).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.lang_pred in model.languages for r in rows)
    right = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert sum(right) / len(right) > 0.97
    # Neither lang nor source nor id is read when predicting.
    blind = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("q"))
    assert {(r.doc_id, r.lang_pred) for r in language.identify(blind, model).collect()} == {(r.doc_id, r.lang_pred) for r in rows}


def test_language_of_messy_texts(spark):
    model = language.train(documents(spark))
    rows = language.identify(documents(spark), model).collect()
    assert len(rows) == len(texts())
    no_letter = {k for k, t in texts() if k is not None and not any(map(str.isalpha, t or ""))}
    assert {r.doc_id for r in rows if r.lang_pred == "und" and r.doc_id is not None} == no_letter
    assert language.train(nothing(spark)) is None
    assert {r.lang_pred for r in language.identify(documents(spark), None).collect()} == {"und"}
    assert language.identify(nothing(spark), None).count() == 0


# Quality


def test_discriminant_equals_the_densities():
    r = np.random.default_rng(2)
    stats = {}
    for label in (0, 1):
        a = r.normal(size=(40, 3)) @ r.normal(size=(3, 3)) + label
        stats[label] = (len(a), a.mean(axis=0), np.cov(a.T, bias=True))
    model = quality.fit(stats, to_pooled=0.1, to_diagonal=0.3, floor=0.01)
    pooled = (stats[0][2] + stats[1][2]) / 2
    x = r.normal(size=(7, 3))
    logs = []
    for label in (0, 1):
        _, mean, cov = stats[label]
        cov = 0.9 * cov + 0.1 * pooled
        cov = 0.7 * cov + 0.3 * np.diag(np.diag(cov)) + 0.01 * np.eye(3)
        d = x - mean
        logs.append(math.log(0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels.select(F.col("doc_id").alias("k"), "quality"), F.col("doc_id") == F.col("k")).collect()
    assert all(r.held_out == held_out(r.doc_id) and r.predicted == (r.score >= 0.7) for r in rows)
    right = [r.predicted == r.quality for r in rows if r.held_out]
    assert sum(right) / len(right) > 0.97
    # Labels of held-out rows teach nothing.
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r.doc_id, r.predicted) for r in quality.classify(docs, flipped).collect()} >= {(r.doc_id, r.predicted) for r in rows}


def test_quality_of_messy_texts(spark):
    labels = spark.createDataFrame([(7, 1), (8, 1), (10, 1), (13, 0), (4, 0), (4, 0), (None, 0), (5, None), (6, 9)], "doc_id long, quality int")
    rows = quality.classify(documents(spark), labels).collect()
    assert len(rows) == len(texts()) and all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep_good(documents(spark), labels)
    assert kept.columns == documents(spark).columns
    good = sorted(r.doc_id or -1 for r in rows if r.predicted)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == good
    assert quality.classify(nothing(spark), labels).count() == 0
    assert {r.score for r in quality.classify(documents(spark), labels.filter("quality = 1")).collect()} == {0.5}


# Extraction


@pytest.fixture(scope="module")
def labeller():
    return extraction.trained()


def found(page):
    return [(b.path[-1][0] if b.path else "", b.text) for b in extraction.blocks(page)]


def test_blocks_of_broken_markup():
    assert found(None) == found("") == found(" \n") == found("<!-- a > b") == found("<div><!-- x --!></div>") == []
    assert found("<p>a<p>b<b>c</p>d") == [("p", "a"), ("p", "bc"), ("", "d")]
    assert found('<script>var t="</p>";if(a<b)x</script><p>k') == [("p", "k")] and found("<script>never ends <p>x") == []
    assert found("<p>a&amp;b &copy; &#65;&nbsp;&zzz; 1 < 2<br>x\n\t y<") == [("p", "a&b © A &zzz; 1 < 2 x y<")]
    assert found("<ul><li>a<ul><li>b</ul><li>c</ul>") == [("li", "a"), ("li", "b"), ("li", "c")]
    assert found("<table><tr><td>a<td>b<tr><td>c</table>x") == [("td", "a"), ("td", "b"), ("td", "c"), ("", "x")]
    assert found('<p title="a>b" class=x>y</p>') == [("p", "y")] and found("<p>cut <a href='x") == [("p", "cut")]
    assert extraction.blocks('<div id="Main-Menu" class="a b"><a href=x>link</a></div>')[0].linked == 1.0
    assert len(extraction.blocks("<div>" * 3000 + "deep")) == 1 and len(extraction.blocks("<p>" + "word " * 200_000)) == 1


def test_blocks_keep_text_of_formulas_and_of_what_never_ends():
    assert found("<p>Let <math><mi>x</mi></math> be</p>") == [("p", "Let x be")]
    assert found("<p>a <object data=x>other</object> <canvas>text</canvas> b</p>") == [("p", "a other text b")]
    assert found("<p>a<svg><text>s</text></svg>b<noscript>n</noscript>c<template><p>t</template>d") == [("p", "abcd")]
    for name in ("svg", "math", "object", "canvas", "noscript", "template"):
        assert found(f"<p>a</p><{name}><p>b</p>") == [("p", "a"), ("p", "b")]
    for name in ("script", "style", "textarea", "title", "iframe"):
        assert found(f"<p>a</p><{name}><p>b</p>") == [("p", "a")]


def test_training_gradient_is_the_slope(labeller):
    model = extraction.Labeller(seed=3)
    for k, w in model.weights.items():
        model.weights[k] = w.astype("float64")
    r = np.random.default_rng(1)
    x = (r.random((4, 2, extraction.INPUTS)) < 0.05).astype(float)
    mask, y = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float), r.integers(0, 2, (4, 2)).astype(float)
    grads, loss = model.gradients(x, mask, y)
    for name in ("hf", "hb", "cf", "xb", "out"):
        w = model.weights[name].reshape(-1)
        at = int(np.abs(np.asarray(grads[name]).reshape(-1)).argmax())
        w[at] += 1e-4
        up = model.gradients(x, mask, y)[1]
        w[at] -= 2e-4
        down = model.gradients(x, mask, y)[1]
        w[at] += 1e-4
        assert np.asarray(grads[name]).reshape(-1)[at] == pytest.approx((up - down) / 2e-4, rel=0.05, abs=1e-5)


def slots_of(path):
    """Slots of a path by the plain rule: a tag and the parts of its names, each by its hash."""
    tokens = [[f"t:{tag}", *[f"n:{p.lower()}" for p in extraction.PARTS.findall(named)]] for tag, named in path]
    whole, inner = ({zlib.crc32(t.encode()) % extraction.PATH for part in some for t in part} for some in (tokens, tokens[-2:]))
    return whole, inner


def block_by_block(model, page):
    """Probabilities of one page by plain loops over steps and units, no batch, no padding, no shared paths."""
    if not page:
        return []
    size, w = extraction.HIDDEN, {k: v.astype(float) for k, v in model.weights.items()}
    squash = lambda v: 1 / (1 + math.exp(-v))
    plain, states = extraction.plain_vectors(page).astype(float), {}
    for d in ("f", "b"):
        h, c, states[d] = [0.0] * size, [0.0] * size, {}
        for t in range(len(page)) if d == "f" else reversed(range(len(page))):
            whole, inner = slots_of(page[t].path)
            g = w[f"c{d}"] + sum(w[f"x{d}"][s] for s in whole) + sum(w[f"x{d}"][extraction.PATH + s] for s in inner)
            for k, v in enumerate(plain[t]):
                g = g + v * w[f"x{d}"][2 * extraction.PATH + k]
            for k, v in enumerate(h):
                g = g + v * w[f"h{d}"][k]
            for k in range(size):
                i, f, o, z = squash(g[k]), squash(g[size + k]), squash(g[2 * size + k]), math.tanh(g[3 * size + k])
                c[k] = f * c[k] + i * z
                h[k] = o * math.tanh(c[k])
            states[d][t] = list(h)
    return [squash(sum(a * b for a, b in zip(states["f"][t] + states["b"][t], w["out"][:-1])) + w["out"][-1]) for t in range(len(page))]


def test_labels_of_batches_equal_plain_loops(labeller):
    r = random.Random(31)
    pages = [extraction.labelled(extraction.sample_page(r))[0] for _ in range(6)]
    pages += [[], extraction.blocks("no element at all"), extraction.blocks("<ul class='nav Main-Menu'><li>a<li>b</ul><p>" + "A long text. " * 50)]
    assert len({len(p) for p in pages}) > 4
    for cells in (1, 64, 16_384):
        for page, got in zip(pages, labeller.label(pages, cells)):
            assert np.allclose(got, block_by_block(labeller, page), atol=1e-4)


def test_pages_of_deep_elements_take_time_in_proportion(labeller):
    """Unclosed, unmatched and scoped elements by tens of thousands; a step for every pair of them would take hours."""
    n = 40_000
    deep = extraction.blocks("<div class=x>t" * n)
    assert len(deep) == n and deep[-1].node.depth == n and deep[0].path == (("div", "x"),) and len(labeller.label([deep[:2000]])[0]) == 2000
    assert len(extraction.blocks("<svg>t" * n)) == 1 and len(extraction.blocks("<b>" * n + "t</q>" * n)) == 1
    assert len(extraction.blocks("<li><ul>" + "<div>" * n + "<li>t</li>" * n)) == n
    assert len(extraction.blocks("<p><button>" + "<div>" * n + "t")) == 1


def test_held_out_blocks(labeller):
    r = random.Random(77)
    wrong = total = 0
    for _ in range(200):
        page, y = extraction.labelled(extraction.sample_page(r))
        if page:
            wrong += int(((labeller.label([page])[0] >= 0.5) != (y > 0)).sum())
            total += len(y)
    assert wrong / total < 0.03


def test_pages_with_article_elements_give_exactly_their_articles(spark, labeller):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = extraction.extract(pages, labeller).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(rows) == len(html)
    for r in rows:
        want = [b.text for b in extraction.blocks(html[r.page_id]) if any(t == "article" for t, _ in b.path)]
        assert r.text == "\n\n".join(want) and r.n_chars == len(r.text)


def test_other_layouts(labeller):
    page = """<body><div class="cookie-banner"><p>We use cookies. Read more.</p><button>OK</button></div><header class="site-header"><a href="/">Name</a>
    <nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav></header><div class="wrapper"><main><h1>The title of it</h1><p>First words of the text, and more of them.</p>
    <div class="advert"><p>Buy this now, cheap.</p></div><p>Second words, with <a href=x>a link</a> inside.</p><ul><li>A point to make.</li></ul></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=y>Other story</a></ul></aside></div><section id="comments"><h2>Comments</h2><div class="comment"><b>Ann</b><p>I like it.</p></div></section>
    <form class="newsletter"><label>Mail</label><button>Go</button></form><footer>&copy; 2020 Name. All rights.</footer>"""
    want = "The title of it\n\nFirst words of the text, and more of them.\n\nSecond words, with a link inside.\n\nA point to make."
    assert extraction.main_text([page, None], labeller) == [want, ""]


def test_extraction_of_messy_pages(spark, labeller):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<article><p>x</article>"), (2, "u", "<article><p>x</article>"), (3, "v", "plain words")]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extraction.extract(pages, labeller).collect()
    assert len(got) == 5 and [r.text for r in got if r.page_id == 2] == ["x", "x"] and [r.text for r in got if r.page_id in (1, None)] == ["", ""]
    assert extraction.extract(pages.limit(0), labeller).count() == 0
