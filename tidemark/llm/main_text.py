"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block. Elements that never hold the article (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments) leave no line of text; outside of an ``article``
or ``main`` element they, and the bounds of these elements, leave ``LINES`` empty lines. Each line counts the characters
of its text outside of links (in headings and inside an ``article`` or ``main`` element, links too: what stands there is
text, unless its markup says otherwise), ``WEIGHT`` times as many inside such an element and a ``WEIGHT``-th on the rest
of a page that has one: the page says where to expect the text, the distribution decides. The lengths of ``LINES`` lines from each line on are summed. Where the sums surge to ``SURGE`` (or to the
page's largest sum, if that is less) a text begins; where they dive to nothing it ends, and all lines between are kept,
short ones too. A text may surge and dive again: an advert may stand in its middle.

Cases: a null or empty page, or one without text, gives an empty text; unclosed and crossed tags are taken as they
come; a tag that no ``>`` ends outside of quotes ends at the next one, a comment without an end goes on to the end of
the page; very long pages are read whole, in time proportional to their length; repeated rows each get their row; an
empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import scratch, tokens

#: Lines of a window; characters of a window's sum at which a text begins; how much more a line of an article counts.
LINES, SURGE, WEIGHT = 3, 86, 16
# Element names of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "select", "object", "canvas", "audio", "video"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head", "fieldset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | ASIDE | HEADINGS
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ARTICLE = {"article", "main"}
#: Words in class, id or role that mark what is no part of an article.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|sidebar|aside|comments?|commentlist|disqus|respond|replies|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|search|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
_NAME = re.compile(r"/?([a-zA-Z][^\s/><]*+)")
#: The rest of a tag, quoted values whole; possessive, so that a tag without an end is given up at once.
_REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_HINT = re.compile(r"""(?:^|\s)(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*+=\s*+["']?true|display\s*+:\s*+none""", re.I)
_SPACE = re.compile(r"\s+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_LONG_NUMBER = re.compile(r"&#(?:0*+[1-9][0-9]{7,}|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{6,});?")


def decoded(text: str) -> str:
    """Character references as characters, white space as single spaces, trimmed."""
    if "&" in text:
        text = html.unescape(_LONG_NUMBER.sub("�", text))  # numbers beyond Unicode, of any number of digits
    return _SPACE.sub(" ", text).strip()


class Tags:
    """The tags of a page from a place on, one after the other; each place is read a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.quotes, self.ends = page, True, True

    def after(self, at: int) -> tuple[int, int, str, bool, str]:
        """Where the next tag begins and ends, its name (lower case; empty: a comment or the like), whether it closes, and
        the rest of it. At the end of the page both places are its length."""
        page = self.page
        while self.ends and (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", False, ""
            if page.startswith("<![CDATA[", start):
                end = page.find("]]>", start)
                return start, end + 3 if end >= 0 else len(page), "", False, page[start + 9 : end if end >= 0 else len(page)]
            if page[start + 1 : start + 2] in ("!", "?"):
                end = page.find(">", start)
                return start, end + 1 if end >= 0 else len(page), "", False, ""
            if name := _NAME.match(page, start + 1):
                if self.quotes and (rest := _REST.match(page, name.end())):
                    return start, rest.end(), name[1].lower(), page[start + 1] == "/", rest[1]
                self.quotes = False  # a quote stays open to the end: no use to try again
                if (end := page.find(">", name.end())) >= 0:
                    return start, end + 1, name[1].lower(), page[start + 1] == "/", page[name.end() : end]
                self.ends = False  # no tag has an end any more
                return start, len(page), "", False, ""
            at = start + 1
        return len(page), len(page), "", False, ""


_ADDRESS = re.compile(r"(?i)(?:^|[\s\"'])href\s*=")
#: A slash that closes its own tag, and is no end of an address without quotes.
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")


def lines(page: str) -> list[tuple[str, int, bool]]:
    """The lines of a page: text, characters that count, whether in an article. Empty ones part what must not meet."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = article = heading = 0
    links = False
    skipped: list[str] = []  # open elements since the outermost that is left out
    held: Counter[str] = Counter()  # their names
    tags = Tags(page)

    def close() -> None:
        nonlocal linked
        text = decoded("".join(parts))
        if text:
            out.append((text, len(text) if article else max(0, len(text) - linked), article > 0))
        parts.clear()
        linked = 0

    def gap() -> None:
        out.extend([("", 0, False)] * LINES)

    def skip(name: str) -> None:
        skipped.append(name)
        held[name] += 1

    at, end = 0, len(page)
    while at < end:
        stop, after, name, closing, more = tags.after(at)
        if stop > at and not skipped:
            piece = page[at:stop]
            parts.append(piece)
            if links and not heading:
                linked += len(_SPACE.sub(" ", piece))
        at = after
        if not name:
            if more and not skipped:
                parts.append(html.escape(more, quote=False))
            continue
        if name in RAW:
            if not closing and not _CLOSED.search(more):
                found = _ENDS[name].search(page, at)
                tail = page.find(">", found.end()) if found else -1
                at = tail + 1 if tail >= 0 else end
            continue
        if skipped:
            if closing and held[name]:
                while True:
                    last = skipped.pop()
                    held[last] -= 1
                    if last == name:
                        break
            elif closing and name in {"article", "main", "body", "html"}:  # an element that was never closed
                skipped.clear()
                held.clear()
                close()
                if name in ARTICLE and article:
                    article -= 1
                    gap()
            elif not closing and name not in VOID and not more.endswith("/") and (name in BLOCKS or held[name]):
                if name in ARTICLE and not article and skipped[0] not in ARTICLE:
                    skipped.clear()  # the article itself: what stood open was never closed
                    held.clear()
                    gap()
                    article += 1
                else:
                    skip(name)
            continue
        if name in BLOCKS:
            close()
            links = links and not closing  # an anchor left open ends with its block
        elif name == "br":
            parts.append(" ")
        if closing:
            if name in ARTICLE and article:
                article -= 1
                gap()
            links = links and name != "a"
            heading -= name in HEADINGS and heading > 0
            continue
        hinted = name not in {"html", "body", "main"} and more and not (name == "article" and not article) and any(MARKED.search(next(filter(None, h.groups()), "")) for h in _HINT.finditer(more))
        left_out = name in ASIDE or hinted or (more and name not in {"html", "body"} and _HIDDEN.search(more))
        if left_out and name not in VOID and not more.endswith("/"):
            if name not in BLOCKS:
                parts.append(" ")
            elif not article:
                gap()
            skip(name)
            continue
        if name in ARTICLE:
            article += 1
            gap()
        if name == "a":  # one ends the one before; without an address it is no link
            links = bool(_ADDRESS.search(more))
        heading += name in HEADINGS
    close()
    return out


def distribution(found: list[tuple[str, int, bool]], window: int = LINES) -> tuple[list[int], list[int]]:
    """The length each line counts, in ``WEIGHT``-ths of a character, and the sum over the window from each line on."""
    marked = any(inside for _, _, inside in found)
    weights = {True: WEIGHT**2, False: 1 if marked else WEIGHT}
    length = [n * weights[inside] for _, n, inside in found]
    sums, total = [0] * len(length), 0
    for i in range(len(length) - 1, -1, -1):
        total += length[i] - (length[i + window] if i + window < len(length) else 0)
        sums[i] = total
    return length, sums


def between(found: list[tuple[str, int, bool]], window: int = LINES, surge: int = SURGE) -> list[str]:
    """The lines from each surge of the distribution to the dive that follows."""
    length, sums = distribution(found, window)
    limit = min(surge * WEIGHT, max(sums, default=0))
    out, inside = [], False
    for (text, _, _), n, total in zip(found, length, sums, strict=True):
        if not total:
            inside = False
        elif total >= limit and n:  # a window surges by what follows its first line: a text begins with a line that counts
            inside = True
        if inside and text:
            out.append(text)
    return out


def main_text(page: str | None) -> str:
    return "\n".join(between(lines(page or "")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars (its code points) of every page, from the whole html."""
    scratch.importable(pages.sparkSession)
    rows = pages.select("page_id", "url", pages["html"].cast("string").alias("html"))
    schema = rows.drop("html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches, 64):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)
