"""Main text of web pages by composite text density.

A page becomes a tree. For every node, C is its number of characters, T of tags below it, LC and LT those in
links, and its density

    C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LC_body / C_body * C + e))

is high for text with little markup and few links (counts of 0 stand as 1). Text that stands directly in a node is
a child of its own. The node with the largest sum of child densities heads the main text; the least density
on the path from it up to the body is the threshold that any other part of the page has to reach to be added.
An ``article`` or ``main`` around the head takes in what else stands in it.

Parts that are no text by their element (scripts, forms, navigation) and hidden parts are left out before all this.
The words of a class, id or role (adverts, notices, comments) come second to density: they decide where the head
is looked for, and what is left out around the text. They never drop an ``article`` or ``main``, or what is around
one, if no other has fewer such words on it and around it; nor, where a word of ``BODIES`` stands beside them ("page
right-sidebar"), the part that holds the head. Inside the text (the ``article`` or ``main`` nearest to the head, or
the head) they drop a division, section or list whose sum of densities is under the threshold, and any part of which
a whole class or role says so, on it or on what it holds (a list of comments); an id alone is most often the name
of a section. Headings go with the text they head, whatever they are called. If no running text is left, the page is read without these words.

The tree is built by the rules that matter for damaged pages: open paragraphs, list items and cells end where
the next one begins, ends without a beginning are ignored, comments and scripts may be unclosed.

Blocks are trimmed, white space in them is one blank, references are decoded, blocks are joined by a line end.

Edge cases: null or empty html, and pages without text, give an empty text; repeated pages get a row each; nesting of
any depth; other columns are kept by the operator.
"""

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from basketry.llm import tables

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no running text of an article.
LEFT_OUT = frozenset(
    "script style noscript template svg math canvas object iframe audio video head title nav footer aside "
    "form button select option textarea input label fieldset dialog menu".split()
)
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr "
    "caption blockquote pre figure figcaption address header footer nav aside form fieldset hr details "
    "summary hgroup center search".split()
)
#: Words of a class, id or role that mark a part as no part of the article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs sidebar side rail widget widgets aside complementary "
    "footer foot bottom masthead topbar toolbar cookie cookies consent gdpr notice notices notification "
    "alert alerts popup modal overlay dialog paywall comment comments commentlist disqus reply replies "
    "respond discussion share sharing social follow related recommended recommendations newsletter subscribe "
    "subscription signup login search form contentinfo skip copyright disclaimer pagination pager tags".split()
)
#: Words that, beside such a word, leave open whether the part is the article or around it.
BODIES = frozenset(
    "article blog body column columns container content contents entry hentry layout main page pages post story "
    "text wrap wrapper".split()
)
_CLOSED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
_SCOPES = frozenset("ul ol dl table body article section div blockquote".split())
#: Elements whose content is no markup.
_RAW = {
    name: re.compile(rf"</{name}\s*>", re.IGNORECASE)
    for name in ("script", "style", "noscript", "template", "textarea", "svg", "title")
}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"""[>"']""")
#: Elements that hold parts of a page; others hold running text.
_PARTS = frozenset("div section ul ol dl table details center hgroup search span".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: "has-sidebar" is said of a page around a sidebar, not of the sidebar.
_ABOUT = re.compile(r"\b(?:has|with|no|without|hide)[-_][\w-]*", re.IGNORECASE)


def _hidden(attributes: str) -> bool:
    """Whether an attribute says so: ``hidden``, ``aria-hidden`` or a style; other attributes' values do not count."""
    for match in _ATTRIBUTE.finditer(attributes):
        name, value = match[1].lower(), match[2] or match[3] or match[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True
        if name == "style" and _NOT_SHOWN.search(value):
            return True
    return False


def _hinted(attributes: str) -> tuple[int, bool]:
    """How far the words of class, id and role mark a part, and whether a whole class or role does.

    2 for a part that such a word marks, 1 where a word of ``BODIES`` speaks against it.
    """
    marked = body = certain = False
    for match in _ATTRIBUTE.finditer(attributes):
        name = match[1].lower()
        if name in ("class", "id", "role"):
            value = _ABOUT.sub("", match[2] or match[3] or match[4] or "")
            words = {w.lower() for w in _WORD.findall(value)}
            marked = marked or not HINTS.isdisjoint(words)
            body = body or not BODIES.isdisjoint(words)
            certain = certain or (name != "id" and not HINTS.isdisjoint(value.lower().split()))
    return ((1 if body else 2) if marked else 0), certain and not body


def _tags(source: str):
    """(start, end, closing, name, attributes) of all markup in page order; no name for comments and the like.

    Every character is looked at a bounded number of times: what can end nowhere is text or runs to the end.
    """
    place, last, quotes = 0, source.rfind(">"), True

    def end_of_tag(at):
        nonlocal quotes
        first = source.find(">", at)
        while quotes:
            mark = _MARK.search(source, at)
            if not mark:
                # A value that is never closed properly: from here on, quotes mean nothing.
                quotes = False
            elif mark[0] == ">":
                return mark.start()
            else:
                # A quote opens a value only behind an equals sign, and if it is closed.
                opens = source[max(at - 1, mark.start() - 8) : mark.start()].rstrip().endswith("=")
                close = source.find(mark[0], mark.end()) if opens else -1
                if opens and close < 0:
                    quotes = False
                at = close + 1 if close >= 0 else mark.end()
        return first

    while True:
        at = source.find("<", place)
        if at < 0:
            return
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = len(source) if end < 0 else end + 3
            yield at, end, False, "", ""
            place = end
            continue
        if at > last:
            return
        tag = _TAG.match(source, at)
        if tag:
            end = end_of_tag(tag.end())
            name = tag[2].lower()
            if not tag[1] and name in _RAW:
                close = _RAW[name].search(source, end + 1)
                place = close.end() if close else len(source)
                yield at, place, False, "", ""
            else:
                place = end + 1
                yield at, place, bool(tag[1]), name, source[tag.end() : end]
        elif source[at + 1 : at + 2] in ("!", "?"):
            place = source.find(">", at) + 1
            yield at, place, False, "", ""
        else:
            place = at + 1


class _Page:
    """Nodes in page order; a text is a node without a tag name."""

    def __init__(self):
        self.tag, self.parent, self.text, self.linked, self.out = ["body"], [-1], [""], [False], [False]
        self.hinted, self.certain, self.block = [0], [False], [0]

    def add(self, tag, parent, text="", out=False, hinted=(0, False)):
        self.tag.append(tag)
        self.parent.append(parent)
        self.text.append(text)
        self.linked.append(self.linked[parent] or tag == "a")
        self.out.append(out or self.out[parent])
        self.hinted.append(hinted[0])
        self.certain.append(hinted[1])
        self.block.append(len(self.block) if tag in BLOCKS else self.block[parent])
        return len(self.tag) - 1


class _Open:
    """The open elements, and the depths at which those of each name and all blocks stand."""

    def __init__(self):
        self.nodes, self.names, self.at, self.blocks = [0], ["body"], {}, [0]

    def push(self, node, name):
        self.at.setdefault(name, []).append(len(self.nodes))
        if name in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.names.append(name)

    def close_to(self, depth):
        while len(self.nodes) > depth:
            self.nodes.pop()
            name = self.names.pop()
            self.at[name].pop()
            if name in BLOCKS:
                self.blocks.pop()

    def deepest(self, names):
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)


def _parse(source: str) -> _Page:
    page, stack, last = _Page(), _Open(), 0

    def text(piece):
        if piece:
            page.add("", stack.nodes[-1], piece)

    for start, stop, end, name, attributes in _tags(source):
        text(source[last:start])
        last = stop
        if not name or name in ("html", "body"):
            continue
        if end:
            depth = stack.deepest((name,))
            # The end of an inline element does not reach beyond the block it stands in.
            if depth and (name in BLOCKS or depth > stack.blocks[-1]):
                stack.close_to(depth)
            elif name == "p":
                page.add("p", stack.nodes[-1])
            continue
        if name in BLOCKS and stack.names[stack.blocks[-1]] == "p":
            # A new block ends an open paragraph, with what is open in it.
            stack.close_to(stack.blocks[-1])
        if name in _CLOSED_BY:
            depth = stack.deepest(_CLOSED_BY[name])
            if depth and depth > stack.deepest(_SCOPES):
                stack.close_to(depth)
        if name == "header":
            # A header within an article is its head; that of the page is left out.
            out = not stack.deepest(("article", "main"))
        else:
            out = name in LEFT_OUT
        hinted = (0, False)
        if attributes and name != "main":
            out = out or _hidden(attributes)
            if name not in _HEADINGS:
                hinted = _hinted(attributes)
        node = page.add(name, stack.nodes[-1], "", out, hinted)
        if name not in VOID and not attributes.endswith("/"):
            stack.push(node, name)
    text(source[last:])
    return page


def _densities(page: _Page):
    count = len(page.tag)
    chars, tags, link_chars, link_tags = ([0] * count for _ in range(4))
    for i in range(count - 1, -1, -1):
        if page.out[i]:
            continue
        if not page.tag[i]:
            chars[i] = len("".join(page.text[i].split()))
            if page.linked[i]:
                link_chars[i] = chars[i]
        up = page.parent[i]
        if up >= 0:
            own = 1 if page.tag[i] else 0
            chars[up] += chars[i]
            tags[up] += tags[i] + own
            link_chars[up] += link_chars[i]
            link_tags[up] += link_tags[i] + (own if page.linked[i] else 0)
    share = link_chars[0] / max(chars[0], 1)
    density, total = [0.0] * count, [0.0] * count
    for i in range(count - 1, -1, -1):
        c = chars[i]
        if c:
            t, lc, lt = max(tags[i], 1), max(link_chars[i], 1), max(link_tags[i], 1)
            base = math.log(c / max(c - link_chars[i], 1) * lc + share * c + math.e)
            density[i] = max(c / t * math.log(max(c / lc * t / lt, 1)) / math.log(base), 0.0)
        if page.parent[i] >= 0:
            total[page.parent[i]] += density[i]
    return density, total


def _head(total) -> int:
    return max(range(len(total)), key=lambda i: (total[i], -i))


def _leave_out_hinted(page: _Page) -> None:
    if not any(page.hinted):
        return
    plain, count = list(page.out), len(page.tag)
    full = [bool(not page.tag[i] and not page.out[i] and page.text[i].strip()) for i in range(count)]
    for i in range(count - 1, 0, -1):
        full[page.parent[i]] = full[page.parent[i]] or full[i]
    marks, inside, outermost = [0] * count, [False] * count, []
    for i in range(1, count):
        up = page.parent[i]
        marks[i], inside[i] = marks[up] + page.hinted[i], inside[up]
        if page.tag[i] in ("article", "main"):
            if full[i] and not inside[i]:
                outermost.append(i)
            inside[i] = True
    least = min((marks[i] for i in outermost), default=0)
    holds = [False] * count
    for i in outermost:
        if marks[i] == least:
            holds[i] = True
    for i in range(count - 1, 0, -1):
        holds[page.parent[i]] = holds[page.parent[i]] or holds[i]

    # A whole class or role on a part, or on something in it.
    sure = list(page.certain)
    for i in range(count - 1, 0, -1):
        sure[page.parent[i]] = sure[page.parent[i]] or sure[i]

    def leave_out(drops):
        for i in range(1, count):
            page.out[i] = plain[i] or page.out[page.parent[i]] or (not holds[i] and drops(i))

    def within(roots):
        found = [False] * count
        for i in range(count):
            up = page.parent[i]
            found[i] = i in roots or (up >= 0 and found[up])
        return found

    articles = within({i for i in outermost if marks[i] == least})
    leave_out(lambda i: page.hinted[i] == 2 and (sure[i] or not articles[i]))
    total = _densities(page)[1]
    head = _head(total)
    if total[head] <= 0:
        page.out = plain
        return
    up, home = head, None
    while up >= 0:
        if home is None and page.tag[up] in ("article", "main"):
            home = up
        holds[up] = holds[up] or page.hinted[up] == 1
        up = page.parent[up]
    inside_text = within({head if home is None else home})
    leave_out(lambda i: page.hinted[i] and (sure[i] if inside_text[i] else True))
    density, total = _densities(page)
    limit = _least_on_path(page, density, head)

    def drops(i):
        thin = page.tag[i] in _PARTS and total[i] < limit
        return page.hinted[i] and (not inside_text[i] or sure[i] or thin)

    leave_out(drops)


def _least_on_path(page: _Page, density, node) -> float:
    """The threshold: the least density from this node up to the body."""
    least = density[node]
    while node >= 0:
        least = min(least, density[node])
        node = page.parent[node]
    return least


def _chosen(page: _Page) -> list[bool]:
    _leave_out_hinted(page)
    density, total = _densities(page)
    count = len(page.tag)
    head = _head(total)
    keep = [False] * count
    if total[head] <= 0:
        # Texts of a letter or two have no density; all that is no link is kept.
        return [bool(not page.out[i] and not page.linked[i]) for i in range(count)]
    limit, up, around = _least_on_path(page, density, head), head, head
    while up >= 0:
        if page.tag[up] in ("article", "main"):
            around = up
        up = page.parent[up]
    keep[around] = True
    # Of every other part that reaches the threshold, the node with the largest sum is added.
    best = list(range(count))
    for i in range(count - 1, 0, -1):
        up = page.parent[i]
        if total[best[i]] > total[best[up]]:
            best[up] = best[i]
    if page.tag[around] not in ("article", "main"):
        for i in range(count):
            if page.tag[i] and density[i] >= limit and total[best[i]] > 0:
                keep[best[i]] = True
    inside = [False] * count
    for i in range(count):
        up = page.parent[i]
        inside[i] = not page.out[i] and (keep[i] or (up >= 0 and inside[up]))
    last_kept = [0] * count
    for i in range(1, count):
        if keep[i] and not page.out[i]:
            last_kept[page.parent[i]] = i
    for i in range(1, count):
        # A heading belongs to the kept part that follows it in the same node.
        if page.tag[i] in _HEADINGS and not page.out[i] and not inside[i]:
            if last_kept[page.parent[i]] > i:
                inside[i] = True
                for j in range(i + 1, count):
                    if page.parent[j] < i:
                        break
                    inside[j] = not page.out[j]
    return inside


def main_text(source: str | None) -> str:
    """The text of one page."""
    if not source:
        return ""
    page = _parse(source)
    inside = _chosen(page)
    blocks, now, current = [], [], None

    def flush():
        joined = " ".join(entities.unescape("".join(now)).split())
        if joined:
            blocks.append(joined)
        now.clear()

    for i in range(len(page.tag)):
        if page.tag[i] in BLOCKS:
            flush()
            continue
        if not inside[i]:
            continue
        if page.tag[i] in ("br", "td", "th"):
            now.append(" ")
        elif not page.tag[i]:
            block = page.block[i]
            if block != current:
                flush()
                current = block
            now.append(page.text[i])
    flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html."""
    kept = [c for c in pages.columns if c.lower() not in (column.lower(), "text", "n_chars")]
    schema = StructType(
        [pages.schema[c] for c in kept]
        + [StructField("text", StringType()), StructField("n_chars", LongType())]
    )

    def of_batches(batches):
        for batch in batches:
            texts = [main_text(cell.as_py()) for cell in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(len(kept))],
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=[f.name for f in schema.fields],
            )

    return pages.select(*kept, column).mapInArrow(of_batches, schema)


def op9_text_density(spark, folder):
    return extract(tables.read(spark, folder, "pages").select("page_id", "url", "html"))


QUERIES = {"op9_text_density": op9_text_density}
