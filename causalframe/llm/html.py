"""Main text of web pages by tree scoring.

A page is read into a tree by one pass over its tags. Every block of text gives points for its length and its commas,
less the share of it that is link text, to the elements around it: all to the nearest, half to the next, and half of
that to each further one, however deep. The element of most points, discounted by its own link density, is the container, or
the article or main around it; siblings that score well enough are kept with it, but for those of a main. Parts that are no article by their element or class are left out beforehand, but for
classes that would take the article with them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalframe.llm.scratch import table

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRS = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[\s_\-]+")
_OTHER = re.compile(
    r"(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|comments?|commentlist|disqus|respond|repl(?:y|ies)|sidebar|aside|widgets?|notices?|alert|cookies?|cookiebar"
    r"|consent|gdpr|popup|modal|overlay|menu|menubar|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|toolbar|shar(?:e|ing)|social|related|recommended"
    r"|recommendations|newsletter|subscribe|signup|login|search|searchbox|pagination|pager|form|hidden|skip|complementary|contentinfo|dialog|rail|disclaimer|warning|outbrain|taboola)$"
)
_OWN = {"content", "main", "article", "post", "entry", "story"}
_WHOLE = {"html", "body", "article", "main"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_DROP = _RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "input", "label", "fieldset", "template", "object", "embed", "svg", "math", "canvas", "audio", "video", "dialog", "menu", "applet", "map"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "keygen", "frame"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TEXT = {"p", "pre", "li", "blockquote", "td", "th", "dd", "dt", "figcaption", "caption", "address", "summary"} | _HEADING
_BLOCK = _TEXT | {"html", "body", "article", "main", "section", "div", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "figure", "details", "center", "hr", "hgroup", "nav", "header", "footer", "aside", "form", "fieldset", "head"}
_ENDS_P = _BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: What a start tag closes when it is open, down to an element of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
_SCOPE = {"td", "th", "table", "html", "body", "article", "section", "div"}
_COMMA = re.compile("[,،、，;]")


#: What an element's name and attributes say of it: part of the page, no part by a piece of a class, by a whole one, no part.
STAYS, PIECE, CLASS, OUT = range(4)


def _unlikely(tag: str, attrs: str) -> int:
    """Whether an element is no part of an article, by its name, being hidden, or its class, id or role."""
    if tag in _DROP:
        return OUT
    if not attrs or tag in _WHOLE:
        return STAYS
    known: dict[str, str] = {}
    for name, *value in _ATTR.findall(attrs):
        known.setdefault(name.lower(), "".join(value))
    if "hidden" in known or known.get("aria-hidden", "").strip().lower() == "true" or _NONE.search(known.get("style", "")):
        return OUT
    found = STAYS
    for key in ("class", "id", "role"):
        names = known.get(key, "").lower().split()
        if not _OWN & set(names):
            for name in names:
                if _OTHER.match(name):
                    return CLASS
                if any(_OTHER.match(part) for part in _PARTS.split(name)):
                    found = PIECE
    return found


def _points(text: str, link: int, heading: bool) -> float:
    """Points of a block: for its length and commas, less the share of it that is link text."""
    points = min(1.0, len(text) / 25) + len(_COMMA.findall(text)) + min(3.0, len(text) / 100)
    return points * (1 - link / len(text)) * (0.1 if heading else 1)


class _Tree:
    """Elements in page order: of element i the subtree is i to end[i]. runs: (block, text, length of link text)."""

    def __init__(self, page: str):
        self.tags, self.parents, self.blocks, self.dropped, self.links = ["#"], [-1], [0], [False], [False]
        self.unlikely: dict[int, int] = {}
        self.events: list[tuple[int, str]] = []
        stack, open_tags = [0], {}
        at = 0

        def start(tag: str, attrs: str) -> None:
            up = stack[-1]
            i = len(self.tags)
            self.tags.append(tag)
            self.parents.append(up)
            self.blocks.append(i if tag in _BLOCK else self.blocks[up])
            kind = _unlikely(tag, attrs)
            self.dropped.append(self.dropped[up] or kind == OUT)
            if kind in (PIECE, CLASS):
                self.unlikely[i] = kind
            self.links.append(self.links[up] or tag == "a")
            if tag not in _VOID:
                stack.append(i)
                open_tags[tag] = open_tags.get(tag, 0) + 1
            elif tag in ("br", "hr"):
                self.events.append((i, " "))

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                open_tags[self.tags[stack.pop()]] -= 1

        def close(names: set[str], scope: set[str]) -> None:
            if any(open_tags.get(n) for n in names):
                for depth in range(len(stack) - 1, 0, -1):
                    tag = self.tags[stack[depth]]
                    if tag in names:
                        return close_to(depth)
                    if tag in scope:
                        return None
            return None

        quotes = True  # until a quote has no end: from there on a tag ends at the first >
        while (lt := page.find("<", at)) >= 0:
            if lt > at:
                self.events.append((stack[-1], page[at:lt]))
            named = _NAME.match(page, lt)
            if not named:
                if page.startswith("<!--", lt):
                    end = page.find("-->", lt + 4)
                    at = end + 3 if end >= 0 else len(page)
                elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                    end = page.find(">", lt)
                    at = end + 1 if end >= 0 else len(page)
                else:
                    self.events.append((stack[-1], "<"))
                    at = lt + 1
                continue
            found = _ATTRS.match(page, named.end()) if quotes else None
            quotes = bool(found)
            end = found.end() if found else page.find(">", named.end()) + 1
            if not end:
                at = lt
                break
            at, slash, tag, attrs = end, page[lt + 1] == "/", named[1], page[named.end() : end - 1]
            tag = tag.lower()
            if slash:
                if tag == "p" and not open_tags.get("p"):
                    continue
                close({tag}, _SCOPE - {tag} if tag not in _BLOCK else set())
                continue
            if tag in _ENDS_P:
                close({"p"}, _SCOPE)
                if tag in _HEADING:
                    close(_HEADING, _SCOPE)
            if tag in _CLOSES:
                close(*_CLOSES[tag])
            if tag in _RAW and not attrs.rstrip().endswith("/"):
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
                end = page.find(">", at)
                at = end + 1 if end >= 0 else len(page)
                continue
            start(tag, attrs)
        if at < len(page):
            self.events.append((stack[-1], page[at:]))
        self.end = [i + 1 for i in range(len(self.tags))]
        for i in range(len(self.tags) - 1, 0, -1):
            up = self.parents[i]
            self.end[up] = max(self.end[up], self.end[i])
        self.runs = list(self._runs())

    def leave_out(self) -> bool:
        """Drops elements by their classes. Whether any was dropped.

        A piece of a class name does not drop what has an article or main with text, nor, where the page has none, what
        has over half of its points.
        """
        if not self.unlikely:
            return False
        n = len(self.tags)
        points, texts = [0.0] * n, [0] * n
        for block, text, link in self.runs:
            points[block] += _points(text, link, self.tags[block] in _HEADING)
            texts[block] += 1
        for i in range(n - 1, 0, -1):
            points[self.parents[i]] += points[i]
            texts[self.parents[i]] += texts[i]
        whole = [False] * n  # has an article or main with text, or is one
        for i in range(n - 1, 0, -1):
            whole[i] = whole[i] or (self.tags[i] in ("article", "main") and texts[i] > 0)
            whole[self.parents[i]] = whole[self.parents[i]] or whole[i]
        out = {i for i, kind in self.unlikely.items() if kind == CLASS or not (whole[i] if whole[0] else points[i] > points[0] / 2)}
        for i in range(1, n):
            self.dropped[i] = self.dropped[i] or self.dropped[self.parents[i]] or i in out
        if out:
            self.runs = list(self._runs())
        return bool(out)

    def _runs(self) -> Iterator[tuple[int, str, int]]:
        block, texts, linked = -1, [], 0

        def done():
            text = " ".join(unescape("".join(texts)).split())
            return (block, text, min(linked, len(text))) if text else None

        for i, text in self.events:
            if self.dropped[i]:
                if self.blocks[i] != block and texts:
                    if run := done():
                        yield run
                    block, texts, linked = -1, [], 0
                continue
            if self.blocks[i] != block:
                if run := done():
                    yield run
                block, texts, linked = self.blocks[i], [], 0
            texts.append(text)
            if self.links[i]:
                linked += len(text)
        if run := done():
            yield run

    def container(self) -> list[int]:
        """The elements whose text is the article: the best container and its siblings that score well, in page order."""
        if not self.runs:
            return []
        n = len(self.tags)
        score, size, linked = [0.0] * n, [0] * n, [0] * n
        for block, text, link in self.runs:
            score[self.parents[block] if self.tags[block] in _TEXT else block] += _points(text, link, self.tags[block] in _HEADING)
            size[block] += len(text)
            linked[block] += link
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            score[up] += score[i] / 2
            size[up] += size[i]
            linked[up] += linked[i]
        prior = {"article": 2.0, "main": 1.5}
        real = {i: score[i] * (1 - linked[i] / max(1, size[i])) * prior.get(self.tags[i], 1.0) for i in range(1, n) if score[i] > 0}
        if not real:
            return [0]
        best = min(real, key=lambda i: (-real[i], i))
        for whole in ("article", "main"):
            up = best
            while up > 0 and self.tags[up] != whole:
                up = self.parents[up]
            if up > 0:
                best = up
                break
        if self.tags[best] == "main":
            return [best]
        least = max(10.0, 0.2 * real.get(best, 0.0))
        kept = [best]
        direct = {}
        for block, text, link in self.runs:
            if self.parents[block] == self.parents[best] and self.tags[block] == "p":
                direct[block] = len(text) > 80 and link < 0.25 * len(text)
        for i, s in real.items():
            if i != best and self.parents[i] == self.parents[best] and s >= least:
                kept.append(i)
        if self.tags[best] != "article":
            kept += [i for i, good in direct.items() if good]
        return sorted(set(kept))


def main_text(page: str | None) -> str:
    """The article of an html page: its blocks in page order, two line ends between them. Empty if there is none.

    If nothing is left without what classes make unlikely, classes do not count.
    """
    if not page:
        return ""
    tree = _Tree(page)
    return (_text(tree) or _text(_Tree(page))) if tree.leave_out() else _text(tree)


def _text(tree: _Tree) -> str:
    kept = tree.container()
    ends = [tree.end[i] for i in kept]  # siblings, so that at most one holds a block
    return "\n\n".join(text for block, text, _ in tree.runs if (k := bisect_right(kept, block)) and block < ends[k - 1])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages. A null or empty page has an empty text; repeated rows stay."""
    kinds = dict(pages.select("page_id", "url").dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op2_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
