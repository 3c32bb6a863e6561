"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one per block.  The text of a line that is not inside links is summed over sliding windows of
lines.  The sums surge where the text begins and dive where it ends; both are judged against the page's own mean, inside
the element that holds most of the text.  Where a page names its article, the text between is that of the article.
Elements whose tag or class says what they are (menus, adverts, comments) are taken out before, unless they hold the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

WINDOW = 3
# A surge or dive takes a window of this share of the page's mean window, and a line of its part of that or a sentence.
LEVEL = 0.25
# The text lies in the innermost element that holds this share of all text outside links.
MOST = 0.6

_NEVER = frozenset("script style noscript template iframe svg canvas object select textarea title head".split())
_ASIDE = frozenset("nav footer aside form button menu dialog fieldset".split())
_MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies footer header login menu modal nav navbar navigation newsletter notice pagination popup promo promoted "
    "related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget "
    "complementary contentinfo search alert".split()
)
# Words beside a marked one in a class that leave its meaning: "site-footer" is a footer, "notice-of-death" no notice.
_PLAIN = frozenset(
    "area articles bar block bottom box btn button buttons col column container content form global inner item items js left "
    "links list main mobile outer overlay page pane panel post posts primary right row secondary section site slot small "
    "story sub tag tags text title top unit wrap wrapper".split()
)
# Marks that may also be the class of what holds the text: they are void where it does.
_DOUBTFUL = frozenset("search header alert notice banner related".split())
# Marks that mean something else inside an article.
_OUTSIDE = frozenset("header search".split())
_ARTICLE = frozenset("article article-body article-content content entry entry-content main main-content post post-content story".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose end tag may be left out: they end where one of these begins, or where the element around them ends.
_OPEN_ENDED = {
    "p": _BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"]),
}
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
# A short line that is one of the text nonetheless: it ends as a sentence does, or has six words.
_SENTENCE = re.compile(r"""[.!?…。！？:]["'»”’)]*$|(?:\S+\s+){5}\S""")
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z0-9]+")


def _mark(word: str) -> str | None:
    """The marked word that a class means, if all the rest of it is plain."""
    parts = [x for x in _TOKEN.findall(word) if not x.isdigit()]
    marked = [x for x in parts if x in _MARKED]
    return marked[0] if marked and all(x in _MARKED or x in _PLAIN for x in parts) else None


def _set_aside(name: str, attributes: str, inside: bool) -> str | None:
    """Why an element is taken out: ``out``, ``doubtful``, or nothing."""
    if name in _NEVER or name in _ASIDE or (name == "header" and not inside):
        return "out"
    if not attributes or name in ("html", "body", "main", "article"):
        return None
    if _HIDDEN.search(attributes):
        return "out"
    doubtful = None
    for found in _MARK.finditer(attributes):
        for word in (found[1] or found[2] or found[3] or "").lower().split():
            mark = _mark(word)
            if mark is None or inside and mark in _OUTSIDE:
                continue
            if mark not in _DOUBTFUL or inside:
                return "out"
            doubtful = "doubtful"
    return doubtful


def _holds_article(attributes: str) -> bool:
    return any(
        word in _ARTICLE for found in _MARK.finditer(attributes) for word in (found[1] or found[2] or found[3] or "").lower().split()
    )


@dataclass
class Line:
    """A block of text: characters outside links, numbers of the elements around it, and of its outermost article (0: none)."""

    text: str
    prose: int
    inside: tuple[int, ...]
    article: int
    doubtful: int
    heading: bool


def lines_of(page: str) -> tuple[list[Line], dict[int, str]]:
    """The blocks of a page in order without what is set aside, and the sort (tag and classes) of each article."""
    lines: list[Line] = []
    piece: list[str] = []
    linked = [0]
    stack: list[tuple[str, int, int, int]] = []  # name, number, article and doubtful element it is in
    sorts: dict[int, str] = {}
    number, skipped, place, links = 0, None, 0, 0

    def end_line(heading: bool = False) -> None:
        if piece:
            text = _SPACE.sub(" ", html.unescape("".join(piece))).strip()
            piece.clear()
            if text:
                _, _, article, doubtful = stack[-1] if stack else ("", 0, 0, 0)
                heading = heading or any(x[0] in _HEADINGS for x in stack)
                lines.append(Line(text, max(0, len(text) - linked[0]), tuple(x[1] for x in stack), article, doubtful, heading))
        linked[0] = 0

    def leave(depth: int) -> None:
        nonlocal skipped, links
        while len(stack) > depth:
            links -= stack.pop()[0] == "a"
            if skipped is not None and len(stack) <= skipped:
                skipped = None

    while True:
        found = _PIECE.search(page, place)
        if skipped is None:
            part = page[place : found.start() if found else len(page)]
            piece.append(part)
            if links:
                linked[0] += len(html.unescape(part).strip())
        if found is None:
            break
        place = found.end()
        if found[2] is None:
            continue
        name, attributes = found[2].lower(), found[3]
        if found[1]:
            if name in _BLOCKS and skipped is None:
                end_line()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    leave(depth)
                    break
                if skipped is not None and depth <= skipped and stack[depth][0] not in _OPEN_ENDED and name not in ("article", "main", "body", "html"):
                    break  # a stray end tag inside a set-aside element does not end what is around it
            continue
        if name in _BLOCKS:
            if skipped is None:
                end_line()
            while stack and stack[-1][0] in _OPEN_ENDED and name in _OPEN_ENDED[stack[-1][0]]:
                leave(len(stack) - 1)
        elif name == "br" and skipped is None:
            piece.append(" ")
        if name in _VOID or attributes.endswith("/"):
            continue
        if name in _RAW_END:
            ending = _RAW_END[name].search(page, place)
            place = ending.end() if ending else len(page)
            continue
        _, _, article, doubtful = stack[-1] if stack else ("", 0, 0, 0)
        number += 1
        if skipped is None:
            why = _set_aside(name, attributes, bool(article))
            if why == "out":
                end_line()
                skipped = len(stack)
            elif why and not doubtful:
                doubtful = number
            if skipped is None and not article and (
                name in ("article", "main") or name in ("div", "section", "td") and _holds_article(attributes)
            ):
                article = number
                marks = sorted(w for m in _MARK.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split())
                sorts[number] = f"{name} {' '.join(x for x in marks if x in _ARTICLE)}"
        links += name == "a"
        stack.append((name, number, article, doubtful))
    end_line()
    return lines, sorts


def _between(lines: list[Line]) -> list[Line]:
    """The lines from the first surge to the last dive, in the innermost element that holds most of the text."""
    weight: dict[int, int] = {}
    for line in lines:
        for element in line.inside:
            weight[element] = weight.get(element, 0) + line.prose
    whole = sum(line.prose for line in lines)
    around = [e for e, w in weight.items() if w >= MOST * whole]
    home = max(around) if around else 0  # elements are numbered as they open, so the innermost has the largest
    if home:
        lines = [line for line in lines if home in line.inside]
    sums = [sum(line.prose for line in lines[i : i + WINDOW]) for i in range(len(lines))]
    level = LEVEL * sum(sums) / max(len(sums), 1)
    ends = [sum(line.prose for line in lines[max(0, i - WINDOW + 1) : i + 1]) for i in range(len(lines))]
    own = [line.prose >= level / WINDOW or line.prose and (line.heading or _SENTENCE.search(line.text)) for line in lines]
    surge = next((i for i in range(len(lines)) if own[i] and sums[i] >= level), None)
    dive = next((i for i in range(len(lines) - 1, -1, -1) if own[i] and ends[i] >= level), None)
    return lines[surge : dive + 1] if surge is not None and dive is not None and whole else []


def main_text(page: str | None) -> str:
    """The text of the article where a page names one, else what lies between surge and dive, joined by line feeds.

    Of several articles side by side all of the sort of the heaviest are kept, nested ones with what is around them.  A
    doubtful mark is void on an element that holds more than half of the text.
    """
    lines, sorts = lines_of(page or "")
    whole, doubtful = sum(line.prose for line in lines), {}
    for line in lines:
        if line.doubtful:
            doubtful[line.doubtful] = doubtful.get(line.doubtful, 0) + line.prose
    lines = [line for line in lines if not line.doubtful or doubtful[line.doubtful] > whole / 2]
    weight: dict[int, int] = {}
    for line in lines:
        if line.article:
            weight[line.article] = weight.get(line.article, 0) + line.prose
    if any(weight.values()):
        sort = sorts[max(weight, key=lambda a: weight[a])]
        kept = [line for line in lines if line.article and sorts[line.article] == sort]
    else:
        kept = _between(lines)
    return "\n".join(line.text for line in kept)


def extract(pages: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``carry`` with ``text`` and ``n_chars`` (code points) of each page, one row per input row.

    Null and empty pages have the empty text, as have pages without text outside set-aside elements.
    """
    fields = {f.name: f.dataType for f in pages.schema.fields}
    slim = pages.select(*[F.col(c) for c in carry], F.col(html_col).alias("html__"))
    schema = ", ".join([f"`{c}` {fields[c].simpleString()}" for c in carry] + ["text string", "n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(len(carry)).to_pylist()]
            columns = [batch.column(i) for i in range(len(carry))]
            columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, "text", "n_chars"])

    return slim.mapInArrow(run, schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
