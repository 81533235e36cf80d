"""HTML extraction: the query against plain cuts, classes against occurrence vectors, templates against planted pages."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from landstream.llm import html_text as H

PAGES = "page_id long, url string, html string, text string, tokens int"


def plain(page):
    """The article of pages as the test tables have them: headline and paragraphs."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
    return "\n".join(b for b in blocks if b)


def text(page):
    return H.main_text(H.parse(page))


def extracted(spark, rows):
    df = spark.createDataFrame([(i, u, h, "old", 3) for i, u, h in rows], PAGES)
    out = H.extract_text(df)
    assert out.columns == ["page_id", "url", "tokens", "text", "n_chars"]
    return [(r.page_id, r.text) for r in out.orderBy("page_id", "text").collect()]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_by_plain_cuts(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in H.op12_html_text(spark, f"/root/testdata/{sf}").collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].url == r.url and got[r.page_id].n_chars == len(got[r.page_id].text)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain words\n only", "plain words only"),
        ("<article>a&amp;b &lt;p&gt; &#233;&eacute; &amp</article>", "a&b <p> éé &"),
        ("<article><p>one<p>two<br>more<b> x</b>  y<div>three</article>", "one\ntwo more x y\nthree"),
        ("<article><h1>T</h1><script>var a='</p><p>no';</script><style>p{}</style><p>x<!-- <p>no --> y</p></article>", "T\nx y"),
        ("<article><p title=\"a>b\">x</p><p class='it's>y</p></article>", "x\ny"),
        ("<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table></article>", "a\nb\nc\n1\n2\n3"),
        ("<article><p>a</p></p></div><p>b</article><p>after", "a\nb"),
        ("<header>h</header><nav>n</nav><aside>s</aside><form>f<input></form><main><p>m</p></main><footer>c</footer>", "m"),
        ("<div class='Cookie-Notice'>c</div><div id=sidebar>s</div><div role=complementary>x</div><article><p>a</p><div class='user-comments'><p>c</p></div><section id='commentList'>d</section></article>", "a"),
        ("<article><header><h1>Head</h1><p>by me</p></header><p>body</p><footer>foot</footer></article>", "Head\nbody"),
        ("<div class='content with-sidebar'><article><p>a</p></article></div><article class='comment'><p>c</p></article>", "a"),
        ("<form id=f><article><p>a</p><select><option>o</select></article></form>", "a"),
        ("<article><p>a</p><div hidden>h</div><div style='display : none'>i</div><p>b <span class='ad'>x</span>c</p></article>", "a\nb c"),
        ("<article><p>a &lt; b <3 c < d</p></article>", "a < b <3 c < d"),
        ("<article><p>a</p><p>b", "a\nb"),
        ("<title>t</title><textarea><p>no</p></textarea><article>x</article", "x"),
        ("<ARTICLE><P>A</P></ARTICLE>", "A"),
        ("<article></article>", ""),
        ("<article><p>😀 &#x1F600;</p></article>".encode("utf-16", "surrogatepass").decode("utf-16"), "😀 😀"),
    ],
)
def test_pages(page, want):
    assert text(page) == want


def test_no_article():
    page = "<body><div><a href=x>home</a> <a href=y>news</a></div><div><h2>Head</h2>" + "<p>long enough text here</p>" * 4 + "</div><div>short</div></body>"
    assert text(page) == "Head\n" + "\n".join(["long enough text here"] * 4)


def test_long_and_deep_pages():
    page = "<article>" + "<div>" * 30_000 + "<p>x</p>" * 100_000 + "</article>"
    assert text(page) == "\n".join(["x"] * 100_000)
    assert text("<a <b " * 50_000 + "'" * 100_000 + "<p x='" * 50_000) is not None


def soup(i, rng, notice="We use cookies. All rights reserved."):
    """A page without any telling name; its notice stands inside the text."""
    words = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 7) for _ in range(n))
    said = [words(30) for _ in range(rng.randint(2, 6))]
    page = f"<html><body><div><a href=/>Start</a> <a href=/n>News {i}</a></div><div><div><p>{'</p><p>'.join(said)}</p><p>{notice}</p></div></div><div>Imprint</div>"
    return page, "\n".join(said)


def test_template_text_goes_and_copies_stay(spark):
    rng = random.Random(3)
    rows, want = [], []
    for i in range(40):
        page, said = soup(i, rng)
        rows.append((i, f"http://soup.example/{i}", page))
        want.append((i, said))
    # Another host's pages are copies of one article: nothing of it is template.
    page, said = soup(99, rng, "A passage that all copies have.")
    rows += [(100 + i, f"http://copies.example/{i}", page) for i in range(40)]
    want += [(100 + i, f"{said}\nA passage that all copies have.") for i in range(40)]
    # Few pages, a page by itself, no host, no url, no html, repeated rows.
    few, few_said = soup(1, rng)
    rows += [(200, "http://few.example/", few), (201, None, few), (202, "nothing", few), (203, "http://soup.example/x", None), (204, "http://one.example", few), (204, "http://one.example", few)]
    notice = "\nWe use cookies. All rights reserved."
    want += [(200, few_said + notice), (201, few_said + notice), (202, few_said + notice), (203, ""), (204, few_said + notice), (204, few_said + notice)]
    assert extracted(spark, rows) == want


def test_empty_table(spark):
    assert extracted(spark, []) == []


def test_classes_are_equal_occurrence_vectors(spark):
    rng = random.Random(8)
    rows = [(i, "http://soup.example/x", soup(i, rng, "")[0]) for i in range(25)]
    df = spark.createDataFrame([(i, u, h, "", 0) for i, u, h in rows], PAGES)
    tokens = H.page_tokens(H.with_host(df, "url"), "html").cache()
    vectors = {}
    for n, r in enumerate(sorted(tokens.collect(), key=lambda r: r.page)):
        for t in r.tokens:
            vectors.setdefault(t, [0] * 25)[n] += 1
    want = {}
    for t, v in vectors.items():
        pages = sum(x > 0 for x in v)
        if pages >= 13 and (t % 2 == 0 or pages >= 23):
            want.setdefault(tuple(v), set()).add(t)
    (found,) = H.equivalence_classes(tokens).collect()
    assert sorted(map(sorted, found.classes)) == sorted(map(sorted, want.values()))
    (made,) = H.templates(tokens).collect()
    held = {n["class"]: n for n in made.nodes}
    assert all(n["around"] == -1 or n["around"] in held for n in made.nodes)
    # The frame of the page, once on each, holds the paragraphs' class in one of its slots.
    frame = max(made.nodes, key=lambda n: len(n.tokens))
    assert frame.around == -1 and any(n.around == frame["class"] and n.slot > 0 for n in made.nodes)


def test_sweep_tells_order_and_crossing():
    of = {10: (0, 0), 12: (0, 1), 14: (0, 2), 20: (1, 0), 22: (1, 1), 31: (2, 0)}
    assert H.sweep([10, 20, 22, 20, 22, 12, 31, 14], of, [3, 2, 1]) == ({0: (-1, 0), 1: (0, 1), 2: (0, 2)}, set())
    assert H.sweep([10, 20, 12, 22, 14], of, [3, 2, 1])[1] == {1}
    assert H.sweep([12, 10, 14], of, [3, 2, 1])[1] == {0}
    assert H.sweep([20, 10, 12, 14, 22], of, [3, 2, 1])[0] == {1: (-1, 0), 0: (1, 1)}


def test_one_host_in_many_tasks(spark):
    """A host's sums are combined before they are dealt out by token."""
    df = spark.range(500).select("id", F.lit("http://hot.example/").alias("url"), F.concat(F.lit("<article><p>"), F.col("id").cast("string"), F.lit("</p></article>")).alias("html"))
    got = H.extract_text(df).orderBy("id").collect()
    assert [r.text for r in got] == [str(i) for i in range(500)]
