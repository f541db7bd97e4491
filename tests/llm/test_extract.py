import html
import re

import pytest

from statweave.llm import extract
from statweave.llm.labelled_pages import LAYOUTS

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return extract.train(pages)


def article(page):
    """Main text of the test pages, whose layout is known."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1].replace("<br>", " ")
    blocks = [html.unescape(re.sub(r"<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1)[^>]*>", inside)]
    return "\n\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def test_given_pages(pages, model):
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = extract.extracted(pages, model).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_layouts_and_unmarked_pages(pages, model):
    for layout in LAYOUTS:
        blocks = extract.blocks_of(layout)
        assert model.decode(blocks) == [b[3] for b in blocks]
    # The same pages without the article element: the other evidence has to do.
    right = total = 0
    for r in pages.limit(60).collect():
        blocks = extract.blocks_of(r.html)
        path = model.decode(extract.blocks_of(r.html.replace("<article>", "<div>").replace("</article>", "</div>")))
        right += sum(a == extract._main_by_markup(b[1]) for a, b in zip(path, blocks, strict=True))
        total += len(blocks)
    assert right / total > 0.9


@pytest.mark.parametrize(("page", "want"), [
    (None, []), ("", []), ("  \n ", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a<br>b<p>c <b>d</b>e", ["a b", "c de"]),
    ("<script>var t='</p>';</script><p>x</p><style>p{}</style>", ["x"]), ("<ul><li>one<li>two</ul>three", ["one", "two", "three"]),
    ("<p>&lt;tag&gt; &#233;&nbsp;z</p>", ["<tag> é z"]), ("<div><p>un<i>closed", ["unclosed"]), ("<!-- a <p>no</p> --><p>yes", ["yes"]),
    ("</div></p>odd<table><tr><td>1<td>2</table>", ["odd", "1", "2"]), ("<p>1 < 2 & 3 > 2</p>", ["1 < 2 & 3 > 2"]),
])
def test_blocks(page, want):
    assert [b[0] for b in extract.blocks_of(page)] == want


def test_viterbi_is_the_best_path(model):
    import itertools

    blocks = extract.blocks_of(LAYOUTS[1])[:9]
    emit = [sum(model.weights.get(x, 0.0) for x in f) for f in extract.features(blocks)]

    def score(path):
        return path[0] * model.start + sum(e for e, s in zip(emit, path, strict=True) if s) + sum(model.moves[a][b] for a, b in zip(path, path[1:]))

    best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
    assert list(map(bool, best)) == model.decode(blocks)


def test_edge_cases(spark, model):
    rows = [(1, "u", None, "c"), (1, None, "", "c"), (None, "u", "<article>" + "<p>word word.</p>" * 5000, "c"), (2, "u", "<nav><a href=x>y</a></nav>", "c")]
    found = extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert [(r.page_id, r.n_chars) for r in found] == [(1, 0), (1, 0), (None, 5000 * 12 - 2), (2, 0)]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract.extracted(empty, extract.train(empty)).count() == 0


@pytest.mark.parametrize(("page", "want"), [
    ("<html><head><title>t</title><body><p>one</p><p>two</p></body></html>", ["one", "two"]),
    ("<head><meta charset=utf-8><title>t</title><p>one<p>two", ["one", "two"]), ("<head><title>t</title>bare text", ["bare text"]),
    ("<head><noscript><p>no script</p></noscript><title>t</title></head><body>x", ["x"]), ("<head><noscript><body><p>x", ["x"]),
    ("<body><head><p>stray</p></head><p>x", ["stray", "x"]), ("<div><button>go<p>rest</p></div><p>x", ["go", "rest", "x"]),
    ("<button>go</button><p>x", ["x"]), ("<button>a<button>b</button><p>x", ["x"]), ("<div><noscript><p>rest</div>x", ["rest", "x"]),
    ("<select><option>a<option>b</select><p>x", ["x"]), ("<select><option>a<input><p>x</p><select><option>b</select>", ["x"]),
    ("<datalist><option>a<option>b</datalist>x", ["x"]), ("<div><select><option>a</div><p>x", ["a", "x"]),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds", ["so x=2 holds"]), ("<svg><text>no</text></svg><svg/><p>x", ["x"]),
    ("<math><semantics><mi>x</mi><annotation>\\x</annotation></semantics></math>", ["x"]),
])
def test_elements_without_end_tags(page, want):
    assert [b[0] for b in extract.blocks_of(page)] == want


def test_long_blocks_and_pages_are_judged_as_a_whole():
    text = "word " * 100 + "2024 " * 400 + "copyright"
    (found,) = extract.features(extract.blocks_of(f"<p>{text}</p>"))
    assert "copyright" in found and "digits3" in found
    for count in (1, 200, 201, 1000):
        at = extract.spread(count)
        assert at[0] == 0 and at[-1] == count - 1 and sorted(set(at)) == at and len(at) == min(count, 200)
