"""Main text of web pages by tree scoring.

A page's tags become a tree.  Paragraphs pass points for their length and commas to their ancestors, all of them to the parent,
and half as many to every further one; an element's points are discounted by the share of its text inside
links.  The best container and those of its siblings that score alike or read like text are kept, and their blocks joined.

What is not part of an article by its kind goes before scoring: elements whose tag, role or class says menu, header, footer,
sidebar, notice, advert, form, script, style or comment.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import new_name

#: Elements without content.
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements that never hold an article's words.
DROPPED = set("aside applet audio button canvas datalist dialog fieldset footer form frameset head iframe input map menu nav noframes noscript object optgroup option script search select style svg template textarea title video".split())
#: Elements that end a run of words; all others are part of one.
BLOCKS = set("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that hold paragraphs or words of their own.
HOLDERS = {"article", "div", "html", "main", "section", "td"}
HEADINGS = {f"h{k}" for k in range(1, 7)}
#: A start tag ends an open element of these kinds, unless one of the stops lies between them.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
    "thead": ({"thead", "tbody"}, {"table"}), "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"optgroup"}, {"select"}),
}
STOPS = {"body", "html", "table", "td", "th", "article", "section", "div", "li"}
#: Points of an element for its tag alone.
TAGS = {"article": 25, "main": 15, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "address": -3, "th": -5} | dict.fromkeys(HEADINGS, -5)
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of classes and ids of what surrounds an article.
AROUND = set(
    "ad ads adsense advert advertisement adverts advertising adslot adbox banner breadcrumb breadcrumbs captcha consent cookie cookies disclaimer footer gdpr header login masthead menu menus modal nav navbar navigation navi newsletter notice notification overlay pager pagination paginator "
    "paywall popup popover promo promoted promotion recommended related rail search share sharing sharebar sidebar sidenav signin signup skip skyscraper social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split()
)
#: And of what readers write below it.
READERS = set("comment comments commentlist commentary disqus discussion livefyre reply replies respond responses reviews".split())
#: Points of a paragraph: one for a start, one for each comma, one for each so many characters up to three, and a share of one if it is short.
SHORT, PER, MOST = 25, 100, 3
COMMAS = re.compile("[,،、，]")
#: A sibling of the best container is kept at this share of its points, or as text: longer than LONG with few links.
SHARE, LEAST, LONG, FEW = 0.2, 10, 80, 0.25
#: A list or division inside the article is a menu from this share of its text in links on, with so many links.
MENU, LINKS = 0.8, 3

#: Comments, declarations, and tags (slash, name, attributes).  As in browsers, a quote opens a value only after an equals sign, and
#: what is not closed reaches to the end of the page, so that no text is scanned twice.
MARKUP = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/[^a-zA-Z][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z))""", re.S)
#: Elements whose content is no markup; all of them are dropped.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "textarea", "title", "iframe", "noframes")}
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]++)))?+""")
_word = re.compile("[a-z]+")


class Node:
    """An element: its tag, its parent, and its children, which are elements and pieces of text in order."""

    __slots__ = ("tag", "parent", "children", "around", "hidden", "points", "size", "linked", "links")

    def __init__(self, tag: str, parent: Node | None, around: bool = False, hidden: bool = False) -> None:
        self.tag, self.parent, self.around, self.hidden = tag, parent, around, hidden
        self.children: list[Node | str] = []
        self.points = 0.0
        self.size = self.linked = self.links = 0


def _surrounds(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is not of an article by its class, id or role; and whether it isn't shown."""
    names, hidden, role = set(), False, ""
    for found in ATTRIBUTE.finditer(attrs):
        name, value = found[1].lower(), unescape(found[2] or found[3] or found[4] or "").lower()
        if name in ("class", "id"):
            for part in value.split():
                names.update((part, "".join(_word.findall(part))), *([w] for w in _word.findall(part)))
        elif name == "role":
            role = value.strip()
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in "".join(value.split())):
            hidden = True
    if tag in ("html", "body"):
        return False, False
    # "has-sidebar", "with-comments" or "no-ads" say what a container has, not what it is
    what = AROUND if tag not in ("main", "article") and names.isdisjoint({"has", "with", "no", "without", "open", "closed"}) else set()
    return bool(role in ROLES or not names.isdisjoint(what) or (not names.isdisjoint(READERS) and names.isdisjoint({"has", "with", "no", "open", "closed"}))), hidden


class Tree:
    """The tree of a page.  Any text gives some tree, in time linear in it: tags that are missing are implied, ends without a
    start are passed over, and what is open at the end of the page closes there."""

    def __init__(self, html: str) -> None:
        self.root = self.at = Node("html", None)
        self.open: Counter[str] = Counter()
        at = 0
        while True:
            found = MARKUP.search(html, at)
            text = html[at : found.start() if found else len(html)]
            if text:
                self.at.children.append(unescape(text))
            if not found:
                return
            at = found.end()
            if found[2] and found[1]:
                self._end_tag(found[2].lower())
            elif found[2]:
                tag = found[2].lower()
                self._start_tag(tag, found[3])
                if tag in RAW:
                    end = RAW[tag].search(html, at)
                    at = end.start() if end else len(html)

    def _start_tag(self, tag: str, attrs: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCKS:
            self._end({"p"}, {"table", "td", "th", "button"})
            self._end({"head"}, set())
        if tag in ENDS:
            self._end(*ENDS[tag])
        node = Node(tag, self.at, *_surrounds(tag, attrs))
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def _end_tag(self, tag: str) -> None:
        if tag == "br":
            self._start_tag(tag, "")
        elif tag in ("p", "li"):
            self._end({tag}, {"table", "td", "th"})
        else:
            self._end({tag}, set() if tag in BLOCKS or tag in DROPPED else STOPS)

    def _end(self, tags: set[str], stops: set[str]) -> None:
        """Closes the nearest open element of these tags, and all inside it."""
        if not any(self.open[t] for t in tags):
            return
        node = self.at
        while node.tag not in tags:
            if node.tag in stops:
                return
            node = node.parent
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[node.tag] -= 1
        self.at = node.parent


def _elements(root: Node) -> list[Node]:
    """All elements, each before its children."""
    out = [root]
    for node in out:
        out.extend(c for c in node.children if isinstance(c, Node))
    return out


def _article(node: Node) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


def prune(root: Node) -> None:
    """Removes what is not of an article by its kind.  An article's own header keeps its headings."""
    for node in _elements(root):
        kept: list[Node | str] = []
        for child in node.children:
            if isinstance(child, str):
                kept.append(child)
            elif child.tag == "form" and any(x.tag in ("article", "main") for x in _elements(child)):
                kept.append(child)  # the whole page is one form
            elif child.tag in DROPPED or child.around or child.hidden:
                kept.append(Node("hr", node)) if child.tag in BLOCKS or child.tag in DROPPED - {"button", "script", "style", "template"} else None
            elif child.tag == "header":
                titles = [x for x in _elements(child) if x.tag in HEADINGS] if _article(node) else []
                for title in titles:
                    title.parent = node
                kept += titles or [Node("hr", node)]
            else:
                kept.append(child)
        node.children = kept


def measure(root: Node) -> list[Node]:
    """Sets every element's size, linked size and number of links, and passes paragraphs' points up.  Returns all elements, parents first."""
    all_ = _elements(root)
    for node in reversed(all_):
        for child in node.children:
            if isinstance(child, str):
                node.size += len("".join(child.split()))
            else:
                node.size += child.size
                node.linked += child.linked
                node.links += child.links
        if node.tag == "a":
            node.linked, node.links = node.size, 1
    for node in all_:
        # a paragraph is a block that directly holds words
        if node.tag in BLOCKS and node.tag not in HEADINGS and any(_inline(c) for c in node.children):
            text = _words(node)
            if text:
                points = min(len(text) / SHORT, 1) + len(COMMAS.findall(text)) + min(len(text) / PER, MOST)
                (node if node.tag in HOLDERS or node.parent is None else node.parent).points += points
    for node in reversed(all_):
        if node.parent is not None:
            node.parent.points += node.points / 2
    return all_


def _inline(child: Node | str) -> bool:
    return (bool(child.strip()) if isinstance(child, str) else child.tag not in BLOCKS and child.size > 0)


def _words(node: Node) -> str:
    """The words of a block outside the blocks in it."""
    out, stack = [], list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append(" ")
        elif x.tag not in BLOCKS:
            stack.extend(reversed(x.children))
    return " ".join("".join(out).split())


def density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def score(node: Node) -> float:
    return (node.points + TAGS.get(node.tag, 0) * (node.points > 0)) * (1 - density(node))


def choose(root: Node) -> list[Node]:
    """The best container, or the article that it is part of, and its kept siblings, in page order.  The page itself if nothing scores."""
    best = max((n for n in measure(root) if n.tag in BLOCKS and n.points > 0), key=score, default=root)
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    best = next((n for n in reversed(above) if n.tag == "article"), None) or next((n for n in above if n.tag == "main"), best)
    if best.parent is None or best.tag in ("article", "main"):
        rivals = [c for c in best.parent.children if isinstance(c, Node) and c.tag == best.tag] if best.parent else [best]
    else:
        rivals = [c for c in best.parent.children if isinstance(c, Node)]
    least = max(LEAST, SHARE * score(best))

    def kept(c: Node) -> bool:
        return c is best or score(c) >= least or c.tag in HEADINGS or (c.tag in ("p", "pre", "blockquote") and (c.size > LONG and density(c) < FEW))

    return [c for c in rivals if kept(c)]


def blocks(nodes: list[Node]) -> list[str]:
    """The text of every block in page order, white space as one space, without empty ones and without menus."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = []
    for top in reversed(nodes):
        stack += [None, top, None]
    tops = set(map(id, nodes))
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif x.tag in BLOCKS:
            close()
            if x.tag in ("ul", "ol", "div", "section", "table", "p") and id(x) not in tops and x.links >= LINKS and density(x) >= MENU:
                continue
            stack.append(None)
            stack.extend(reversed(x.children))
        else:
            stack.extend(reversed(x.children))
    close()
    return out


def main_text(html: str | None) -> list[str]:
    """The blocks of the main text of one page; none for null, empty, or a page without words."""
    if not html:
        return []
    root = Tree(html).root
    prune(root)
    return blocks(choose(root))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with `text`, the main text of the whole html with one newline between blocks, and `n_blocks`.

    Null and empty pages, and pages without words, have empty text and no block.  Broken markup gives what a lenient parser
    reads in it.  Repeated rows are each extracted; columns of the same names are replaced; an empty table gives no rows.
    Nothing is shuffled, and a task holds one page at a time.
    """
    count = new_name("n_blocks", pages)
    kept = [c for c in pages.columns if c.lower() not in (text.lower(), "n_blocks")]
    pages = pages.withColumn(source := new_name("html", pages), F.col(f"`{html}`")).select(*[f"`{c}`" for c in kept], source)
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != source], f"`{text}` string, `{count}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [main_text(x.as_py()) for x in rows.column(len(kept))]
            columns = [*[rows.column(k) for k in range(len(kept))], pa.array(["\n".join(x) for x in found], pa.string()), pa.array([len(x) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, text, count])

    return pages.mapInArrow(run, fields).withColumnRenamed(count, "n_blocks")
