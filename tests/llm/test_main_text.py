import html
import math
import random
import re
import time

import pytest

from basketry.llm import main_text as main_text_module
from basketry.llm.main_text import extract, main_text, op9_text_density

LINE = "A sentence of the article that says something, at some length. "


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>one<p>two<br>three", "one\ntwo three"),
        ("<ul><li>a b c d<li>e f g h</ul>", "a b c d\ne f g h"),
        ("<!-- x --><script>var a='<p>no</p>'</script><p>yes &lt;b&gt; &eacute;&nbsp;!</p><!-- open", "yes <b> é !"),
        ("<style>p{}</style><title>t</title>", ""),
        ("<article><h1>T</h1><b>x<p>y</b> z</p></article></div></p>", "T\nx\ny z"),
        ("<p title='a > b'>q</p>", "q"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
    ],
)
def test_small_pages(source, text):
    assert main_text(source) == text


def test_boilerplate_goes():
    page = (
        "<header><h1>Site</h1></header><div id='main-menu'><a href=/>Home</a><a href=/b>News</a></div>"
        "<div class='cookie-notice'>We use cookies to make this site better for you.</div>"
        f"<div class='content has-sidebar'><h2>Head</h2><p>{LINE * 5}</p><p>{LINE * 3}</p>"
        "<form>Mail <input> <button>Send</button></form></div>"
        f"<aside>{LINE}</aside><section class='comments'><p>{LINE * 9}</p></section>"
        "<div class='sidebar'><ul><li><a href=1>Link one</a><li><a href=2>Link two</a></ul></div>"
        "<footer>Footer of the page</footer>"
    )
    assert main_text(page) == "\n".join(["Head", (LINE * 5).strip(), (LINE * 3).strip()])


def test_sections_without_hints():
    links = "".join(f"<li><a href={i}>Some link number {i}</a></li>" for i in range(30))
    parts = "".join(f"<div><h3>Part {i}</h3><p>{LINE * 4}</p><p>{LINE * 2}</p></div>" for i in range(3))
    text = main_text(f"<body><ul>{links}</ul><div>{parts}</div><ul>{links}</ul></body>")
    assert text.count(LINE.strip()) == 18 and "link number" not in text
    assert [x for x in text.split("\n") if x.startswith("Part")] == ["Part 0", "Part 1", "Part 2"]


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + LINE + "</div>" * 5000) == LINE.strip()
    assert main_text("<b>" * 20_000 + "deep") == "deep"
    assert len(main_text(f"<p>{LINE * 20_000}</p>")) == len((LINE * 20_000).strip())


def test_query_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = op9_text_density(spark, folder)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == len(pages)
    for r in rows:
        # These pages hold their text in one article, of headings, paragraphs and line ends.
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.DOTALL)[1]
        blocks = [re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        blocks = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_columns_and_odd_rows(spark):
    rows = [(1, None, "old", "z"), (1, None, "old", "z"), (None, "<p>x", "old", "z")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, tag string")
    out = extract(df)
    assert out.columns == ["page_id", "tag", "text", "n_chars"]
    assert sorted(r.text for r in out.collect()) == ["", "", "x"]
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content-sidebar-wrap'><main>{}</main><div class='sidebar'><p>x y z</div></div>",
        "<div class='layout-sidebar-right'><article>{}</article></div><p>Some other line.</p>",
        "<div class='page right-sidebar'>{}</div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul>",
        "<article class='post comments-open'>{}</article>",
        "<main><article class='post comments-open'>{}</article><div id='comments'><ol><li class='comment'>"
        "<article class='comment-body'><p>" + LINE * 40 + "</p></article></ol></div></main>",
        "<div id='sidebar'>{}</div>",
        "<div title='The hidden cost'>{}</div>",
        "<div data-x='display: none'>{}</div><div hidden><p>" + LINE * 40 + "</p></div>",
        "<article>{}</article><div class='related'><article><p>" + LINE * 40 + "</p></article></div>",
        "<article>{}</article><div style='display:none' class='a'>" + LINE * 40 + "</div>",
    ],
)
def test_words_of_a_wrapper_do_not_drop_the_article(page):
    body = f"<p>{LINE * 5}</p><p>{LINE * 3}</p>"
    assert main_text(page.format(body)) == "\n".join([(LINE * 5).strip(), (LINE * 3).strip()])


@pytest.mark.parametrize(
    ("part", "text"),
    [
        ("<section id='discussion'><h2>Discussion</h2><p>{}</p></section>", "Discussion\n{}"),
        ("<section id='related-work'><h2>Related work</h2><p>{}</p></section>", "Related work\n{}"),
        ("<p class='follow-up'>{}</p>", "{}"),
        ("<h2 id='comments'>Comments</h2><p>{}</p>", "Comments\n{}"),
        ("<h2 id='search'>Search</h2><p>{}</p>", "Search\n{}"),
        ("<section id='comments'><h2>9 comments</h2><ol><li class='comment'><p>{}</p></ol></section>", ""),
        ("<div class='ad'>{}</div>", ""),
        ("<div id='share'><a href=1>Share</a> <a href=2>Tweet</a></div>", ""),
    ],
)
def test_names_of_parts_inside_the_text(part, text):
    body = f"<p>{LINE * 5}</p><p>{LINE * 3}</p>"
    line = (LINE * 4).strip()
    want = [(LINE * 5).strip(), (LINE * 3).strip(), *([text.format(line)] if text else [])]
    for page in ("<article>{}</article>", "<main><h1>T</h1>{}</main><footer>F</footer>", "<div>{}</div>"):
        got = main_text(page.format(body + part.format(line))).split("\n")
        assert [x for x in got if x != "T"] == "\n".join(want).split("\n")


@pytest.mark.parametrize(
    "piece",
    ["<a \"", "<a x=\"", "<a x='>", "<!", "<script ", "<", "<!-", "<b>", "<b></i>", "<h2>x</h2>", "<a b", "</script ", "&", "<p><i>"],
)
def test_damaged_markup_takes_linear_time(piece):
    for source in (piece * (65_536 // len(piece)), "<p>q</p>" + piece * (65_536 // len(piece)) + ">x"):
        start = time.process_time()
        main_text(source)
        assert time.process_time() - start < 1.5


def test_unbalanced_quotes_lose_no_text():
    assert main_text("<p title=\"x>one</p><p>two</p>") == "one\ntwo"
    assert main_text("<p title=\"a > b\" x='>'>one</p>") == "one"
    assert main_text("<p>it's <b>\"so\"</b></p>") == "it's \"so\""


def test_densities_by_their_definition():
    rng = random.Random(4)

    def page(depth):
        out = ""
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.4 or depth == 0:
                out += rng.choice(["word ", "some words here ", LINE])
            else:
                tag = rng.choice(["div", "b", "section", "a", "i"])
                out += f"<{tag}>{page(depth - 1)}</{tag}>"
        return out

    for _ in range(60):
        tree = main_text_module._parse(page(4))
        density, total = main_text_module._densities(tree)
        count = len(tree.tag)

        def below(i):
            return [j for j in range(count) if j != i and i in ancestors(j)]

        def ancestors(j):
            while tree.parent[j] >= 0:
                j = tree.parent[j]
                yield j

        def in_link(j):
            return tree.tag[j] == "a" or any(tree.tag[k] == "a" for k in ancestors(j))

        def counts(i):
            nodes = [i, *below(i)]
            texts = [j for j in nodes if not tree.tag[j]]
            tags = [j for j in nodes if tree.tag[j] and j != i]
            size = {j: len("".join(tree.text[j].split())) for j in texts}
            return (
                sum(size.values()),
                len(tags),
                sum(size[j] for j in texts if in_link(j)),
                sum(in_link(j) for j in tags),
            )

        c_body, _, lc_body, _ = counts(0)
        want = []
        for i in range(count):
            c, t, lc, lt = counts(i)
            if not c:
                want.append(0.0)
                continue
            base = math.log(c / max(c - lc, 1) * max(lc, 1) + lc_body / max(c_body, 1) * c + math.e)
            ratio = max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)
            want.append(max(c / max(t, 1) * math.log(ratio) / math.log(base), 0.0))
        assert density == pytest.approx(want)
        for i in range(count):
            assert total[i] == pytest.approx(sum(want[j] for j in range(count) if tree.parent[j] == i))
