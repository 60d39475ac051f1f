import html
import itertools
import random
import re

import numpy as np

from ledgershield.llm import html_extract as H


def test_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(1)
    emit, move, ends = rng.standard_normal((5, 2)), rng.standard_normal((2, 2)), rng.standard_normal((2, 2))
    labels = np.array([0, 1, 1, 0, 1])

    def score(e, m, z, y):
        return e[range(5), y].sum() + sum(m[a, b] for a, b in zip(y, y[1:])) + z[0, y[0]] + z[1, y[-1]]

    def likelihood(e, m, z):
        return score(e, m, z, labels) - np.log(sum(np.exp(score(e, m, z, list(y))) for y in itertools.product((0, 1), repeat=5)))
    value, *grads = H.gradients(emit, labels, move, ends)
    assert np.isclose(value, likelihood(emit, move, ends))
    for k, g in enumerate(grads):
        for at in np.ndindex(g.shape):
            parts = [emit.copy(), move.copy(), ends.copy()]
            parts[k][at] += 1e-6
            assert np.isclose((likelihood(*parts) - value) / 1e-6, g[at], atol=1e-4)


def test_viterbi_against_all_sequences():
    rng = random.Random(3)
    for _ in range(50):
        blocks = [H.Block(" ".join(["word"] * rng.randint(1, 40)) + rng.choice(["", "."]), (rng.choice(["p", "div ad", "li"]),), 0) for _ in range(rng.randint(0, 6))]
        feats = [H.path_features(b.path) + H.text_features(b, i, len(blocks)) for i, b in enumerate(blocks)]
        names = sorted({f for x in feats for f in x})
        chain = H.Chain({f: (rng.gauss(0, 1), rng.gauss(0, 1)) for f in names}, np.array([[rng.gauss(0, 1)] * 2, [0.3, -0.2]]), np.array([[0.1, 0.2], [0.3, -0.4]]))

        def score(y):
            s = sum(chain.weights[f][v] for x, v in zip(feats, y) for f in x) + sum(chain.move[a, b] for a, b in zip(y, y[1:]))
            return s + chain.ends[0, y[0]] + chain.ends[1, y[-1]]
        got = chain.decode(blocks)
        if blocks:
            assert np.isclose(score(got), max(score(y) for y in itertools.product((0, 1), repeat=len(blocks))))
        else:
            assert got == []


def test_leaf_blocks():
    page = """<!DOCTYPE html><head><title>T</title><style>p{a:'</p>'}</style><script>var t="</p>";</script></head><body><!-- <p>no</p> -->
    <p>One&amp;two &lt;b&gt;<p>Three <b>bold<br>x</b></p>tail<ul><li>a<li><a title="1>0" href='x'>b</a></ul><p>c&nbsp; d <script>never closed"""
    assert [(b.text, b.path[-1].split()[0]) for b in H.leaf_blocks(page)] == [
        ("One&two <b>", "p"), ("Three bold x", "p"), ("tail", "body"), ("a", "li"), ("b", "li"), ("c d", "p")]
    assert H.leaf_blocks(page)[4].link > 0
    for odd in ("", "plain", "<", "<p", "<p class=", '<p class="x', "</p></p>", "<a><b><i>x", "&amp;" * 50_000, "<div>" * 20_000 + "x", "<p>" + "'" * 50_000, "<x " * 20_000):
        H.leaf_blocks(odd)


def test_custom_elements_formulas_and_stray_quotes_lose_no_text():
    def texts(page):
        return [b.text for b in H.leaf_blocks(page)]
    for tag in ("svg-icon", "template-card", "select-menu", "object-view", "style-guide", "script-box"):
        assert texts(f"<p>One</p><{tag}></{tag}><p>Two</p><{tag} class='a'>in<p>Three</p>") == ["One", "Two", "in", "Three"], tag
    assert texts("<p>One</p><svg width=1><text>no</text></svg><style\n>no</style><SCRIPT>no</script><template>no</template><p>Two") == ["One", "Two"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><xmp>a <b> &amp; c</xmp><p>end") == ["so x=2 holds", "a <b> &amp; c", "end"]
    assert texts("""<p class=x">One</p><p>Two "q" three</p>""") == ["One", 'Two "q" three']
    assert texts("""<p '>One's</p><p class=a'b title="1>0">Two</p><p a=b="c>Three</p><p id = 'x>y'>Four""") == ["One's", "Two", "Three", "Four"]


def truth(page):
    inside = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1].replace("<br>", " ")
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(p for p in parts if p)


def test_table_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: truth(r["html"]) for r in pages.collect()}
    rows = H.main_text(pages).collect()
    assert {r["page_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_other_layouts_with_comments_forms_and_notices(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    chain = H.train(H.labelled_pages(pages[:150]))
    rng, right, total = random.Random(77), 0, 0
    for p in pages[150:]:
        blocks = H.leaf_blocks(H.rendered([("p", x) for x in truth(p).split("\n")], ["A reader thinks that this is a fine text, and says so."], rng))
        right += sum(b.label == y for b, y in zip(blocks, chain.decode(blocks)))
        total += len(blocks)
    assert right / total > 0.97


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Some text here.</p></article>", "x"), (1, "u", "<article><p>Some text here.</p></article>", "x"), (2, None, None, "x"),
                                (None, "v", "", "x")], "page_id long, url string, html string, text string")
    rows = H.main_text(df).collect()
    assert len(rows) == 4 and [r["text"] for r in rows if r["page_id"] == 1] == ["Some text here."] * 2
    assert [(r["text"], r["n_chars"]) for r in rows if r["page_id"] != 1] == [("", 0)] * 2
    assert H.main_text(df.limit(0)).count() == 0
