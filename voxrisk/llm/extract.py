"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z][-\w:]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no article text, wherever they stand.
NEVER = RAW | frozenset("head nav footer aside form button select option input menu dialog canvas object audio video label fieldset".split())
#: An opening tag ends an open element of the same family.
FAMILY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl div article section main body html td th blockquote".split())
PARAGRAPHS = frozenset("p pre blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words of class and id that name what surrounds an article, and those that name the article.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar rail nav navbar navigation menu breadcrumb "
    "breadcrumbs footer header masthead topbar comment comments commentlist disqus respond replies discussion cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup social share sharing related recommended recommendations widget widgets toolbar pagination pager skip "
    "login search form outbrain taboola tags".split())
#: Whole names of <article> elements that are none.
NO_ARTICLE = frozenset("comment comments reply related promo advert".split())
WITHIN = frozenset("article body content main post entry story text page".split())
PREFIXES = frozenset("with has no is js".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


def _surrounds(tag: str, rest: str) -> bool:
    """Whether an element's attributes say that it is not part of an article."""
    if not rest or rest.isspace():
        return False
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    if tag == "article" and not NO_ARTICLE.isdisjoint(f"{found.get('class', '')} {found.get('id', '')}".lower().split()):
        return True
    if tag in ("html", "body", "article", "main", "p", "a", "span", "b", "i", "em", "strong") and tag not in ("p", "span"):
        return False
    if found.get("role", "").lower() in ROLES:
        return True
    for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        parts = [x for x in re.split(r"[-_:]+", name) if x]
        if not parts or parts[0] in PREFIXES:
            continue
        if parts[0] in AROUND or parts[0].startswith("comment") or any(x in AROUND for x in parts) and not any(x in WITHIN for x in parts):
            return True
    return False


#: Share of the best article's points from which an article beside it belongs to the same text.
SIBLING = 0.2


class Page:
    """A page as arrays in document order: tag and parent of each element, and its runs of text between block limits."""

    def __init__(self, source: str):
        self.tags: list[str] = ["#root"]
        self.parent: list[int] = [0]
        self.out: list[bool] = [False]  # the element itself is no article text
        #: (element, text), or (-1, "") where a block begins or ends
        self.runs: list[tuple[int, str]] = []
        self._read(source)

    def _open(self, tag: str, rest: str, at: int) -> int:
        self.tags.append(tag)
        self.parent.append(at)
        self.out.append(tag in NEVER or _surrounds(tag, rest))
        return len(self.tags) - 1

    def _read(self, source: str) -> None:
        at, place = 0, 0
        open_count: dict[str, int] = {}

        def close_to(element: int) -> None:
            """Close everything inside ``element`` and itself."""
            nonlocal at
            while True:
                done, at = at, self.parent[at]
                open_count[self.tags[done]] -= 1
                if done == element:
                    return

        def nearest(names, limit=frozenset()) -> int | None:
            i = at
            while i and self.tags[i] not in names:
                if self.tags[i] in limit:
                    return None
                i = self.parent[i]
            return i or None

        def text(piece: str) -> None:
            if piece:
                self.runs.append((at, html.unescape(piece)))

        while token := TOKEN.search(source, place):
            text(source[place:token.start()])
            place = token.end()
            tag = token["tag"]
            if tag is None:
                if token[0].startswith("<![CDATA["):
                    text(token[0][9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            tag = tag.lower()
            if token["end"]:
                if tag in BLOCK:
                    self.runs.append((-1, ""))
                if open_count.get(tag):
                    close_to(nearest({tag}))
                continue
            if tag in BLOCK or tag == "br":
                self.runs.append((-1, "") if tag in BLOCK else (at, " "))
            if tag in VOID:
                continue
            if tag in BLOCK and open_count.get("p") and (p := nearest({"p"}, SCOPE)):
                close_to(p)
            if tag in FAMILY and (x := nearest(FAMILY[tag], SCOPE - FAMILY[tag])):
                close_to(x)
            here = self._open(tag, token["rest"] or "", at)
            if token[0].endswith("/>") and tag in RAW:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, place)
                close = source.find(">", end.start()) if end else -1
                place = close + 1 if close >= 0 else len(source)
                continue
            at = here
            open_count[tag] = open_count.get(tag, 0) + 1
        text(source[place:])

    def main_text(self) -> str:
        """Text of the best container and of the siblings that belong to it, one line per block."""
        n = len(self.tags)
        block, article = list(range(n)), [False] * n
        gone, links = self.out, [False] * n
        for i in range(1, n):  # parents come before their children
            up, tag = self.parent[i], self.tags[i]
            article[i] = article[up] or tag in ("article", "main")
            if tag == "header" and not gone[i]:
                gone[i] = not article[up]
            gone[i] = gone[i] or gone[up]
            links[i] = links[up] or tag == "a"
            if tag not in BLOCK:
                block[i] = block[up]
        length, linked, commas = [0] * n, [0] * n, [0] * n
        for i, run in self.runs:
            if i >= 0 and not gone[i]:
                size = len(run) - run.count(" ")
                own = block[i]
                length[own] += size
                linked[own] += size * links[i]
                commas[own] += run.count(",") + run.count("、") + run.count("，")
        whole, in_links = length[:], linked[:]
        for i in range(n - 1, 0, -1):
            if block[i] == i or whole[i]:
                whole[self.parent[i]] += whole[i]
                in_links[self.parent[i]] += in_links[i]
        score, mass = [0.0] * n, [0.0] * n
        for i in range(n):
            if length[i] and not gone[i]:
                points = (1 + commas[i] + min(length[i] / 100, 3)) * (1 - linked[i] / length[i])
                if self.tags[i] in HEADINGS:
                    points /= 4
                mass[i] = points
                up, share = (self.parent[i] if self.tags[i] in PARAGRAPHS else i), 1.0
                for level in range(2, 8):
                    score[up] += points * share
                    if not up:
                        break
                    up, share = self.parent[up], 1 / level / (1 if level == 2 else 1.5)
        final = [s * (1 - in_links[i] / whole[i]) if whole[i] else 0.0 for i, s in enumerate(score)]
        best = max(range(n), key=lambda i: (final[i], -i))
        if final[best] <= 0:
            # nothing but links or nothing at all
            return ""
        top = best
        while top and self.tags[top] not in ("article", "main"):
            top = self.parent[top]
        best = top or best  # the marked article, where the best container lies in one
        keep = [False] * n
        keep[best] = True
        # a text may be spread over articles side by side: those with a like share of all points inside them belong to it
        for i in range(n - 1, 0, -1):
            mass[self.parent[i]] += mass[i]
        home = self.parent[best] if self.tags[best] == "article" else best
        beside = [i for i in range(1, n) if self.tags[i] == "article" and self.parent[i] == home and not gone[i] and whole[i]]
        worth = {i: mass[i] * (1 - in_links[i] / whole[i]) for i in beside}
        slight = {i for i in beside if worth[i] < SIBLING * max(worth.values())}
        for i in beside:
            keep[i] = keep[i] or i not in slight
        if best and not article[best]:
            side = max(10.0, final[best] * 0.2)
            for i in range(1, n):
                if i != best and self.parent[i] == self.parent[best] and not gone[i] and whole[i]:
                    dense = in_links[i] / whole[i]
                    plain = self.tags[i] in PARAGRAPHS and dense < 0.25 and (whole[i] > 60 or self.tags[i] in HEADINGS)
                    keep[i] = final[i] >= side or plain
        for i in range(1, n):
            keep[i] = keep[i] or keep[self.parent[i]] and i not in slight
        lines, line = [], []
        for i, run in [*self.runs, (-1, "")]:
            if i < 0:
                joined = " ".join("".join(line).split())
                if joined:
                    lines.append(joined)
                line = []
            elif keep[i] and not gone[i]:
                line.append(run)
        return "\n".join(lines)


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page: its main text and the code points of that.

    The page is read into a tree, forgiving what browsers forgive (open paragraphs, missing ends, a page cut off in a tag). What
    names itself menu, header, footer, sidebar, notice, advert, form, comment, script or style is out. Every block of text gives points,
    one and more for commas and length, less the share of its text in links, to the elements around it, fewer the further
    out. The element with most points, less its own share of links, is the container; it and siblings of like
    score or with running text are kept, or the whole <article> or <main> that it lies in, with the articles beside
    each other there that hold SIBLING of the best one's points or more. Of equal scores the first container is taken. Blocks are joined by one line
    break, white space in them is one space. A null or empty page, or one of links only, has an empty text; repeated rows give repeated
    results, null ids and urls stay; other columns are not read. One pass, no shuffle."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(read, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
