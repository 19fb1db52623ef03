"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block of the page. A line weighs as much as its text is long. Names of elements,
roles, classes and ids only change that weight: what they call a menu, header, footer, sidebar, notice, advert, form, comment or code weighs
nothing; links outside of articles count against their line; and on a page that marks its article (``article``, ``main`` or an equivalent
attribute) lines within weigh more, and the others nothing. Weights are summed over sliding windows of lines; on every page the
text starts where the sum surges and ends where it dives to nothing, and every line with a weight between surge and dive is kept, short ones as well.

Pages are read once, forward: a tag ends at the first ``>`` outside of its quoted values, open elements are found by name, so time is
in proportion to the page whatever its markup.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textwords import pieces

# Lines in a window, weight in it that makes a surge, and empty lines that part two texts.
WINDOW, SURGE, GAP = 3, 40, 6
# Weight of a character in a marked article.
MARKED = 40

# Elements of HTML by their role on a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea title select option canvas audio video".split())
APART = frozenset("nav footer aside form button dialog menu fieldset head".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An open element of the first kind ends where one of the second begins.
ENDS_AT = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
           "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|masthead|topbar|footer|copyright|"
    r"side-?bar|aside|widgets?|related|recommend\w*|comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|search|share|sharing|social|toolbar|pagination|pager|tags?)(?:$|[\s_-])", re.IGNORECASE)
# Hints that count outside of articles only, those that make an article one of a reader or an advert, and layouts named by what they hold.
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.IGNORECASE)
FOREIGN = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|related|promo\w*|ads?|advert\w*|sponsor\w*)(?:$|[\s_-])", re.IGNORECASE)
LAYOUT = re.compile(r"(?:^|\s)(?:has|with|no|layout)[_-](?:left-|right-)?(?:side-?bar|nav|menu|header)(?=$|\s)", re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
# What follows a tag's name up to its end; quotes count behind an equals sign only, and if they are closed.
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
ATTRIBUTE = re.compile(r"([\w:-]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")


@dataclass
class Line:
    text: str
    boiler: bool
    inside: bool  # of an article
    linked: int  # characters in links
    heading: bool = False


class Page:
    """Blocks of a page as lines, with what is open at the place that has been read."""

    def __init__(self):
        self.lines: list[Line] = []
        self.stack: list[tuple[str, bool, bool]] = []  # element, whether it is boilerplate, whether it is an article
        self.places: dict[str, list[int]] = {}  # of each name, where it stands in the stack
        self.blocks: list[int] = []  # where blocks stand in the stack
        self.parts: list[str] = []
        self.boiler = self.article = self.headings = self.links = self.linked = 0

    def text(self, text: str) -> None:
        if text:
            self.parts.append(text)
            if self.links > 0:
                self.linked += len(text.strip())

    def end_line(self) -> None:
        text = " ".join(entities.unescape("".join(self.parts)).split())
        if text:
            self.lines.append(Line(text, self.boiler > 0, self.article > 0, self.linked, self.headings > 0))
        self.parts.clear()
        self.linked = 0

    def _count(self, name: str, is_boiler: bool, is_article: bool, by: int) -> None:
        self.boiler += by * is_boiler
        self.article += by * is_article
        self.links += by * (name == "a")
        self.headings += by * (name in HEADINGS)

    def push(self, name: str, is_boiler: bool, is_article: bool) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((name, is_boiler, is_article))
        self._count(name, is_boiler, is_article, 1)

    def pop(self) -> None:
        name, was_boiler, was_article = self.stack[-1]
        if name in BLOCKS or was_boiler:
            self.end_line()
        self.stack.pop()
        self.places[name].pop()
        if name in BLOCKS:
            self.blocks.pop()
        self._count(name, was_boiler, was_article, -1)

    def end(self, name: str) -> None:
        """An end tag; that of an inline element closes nothing beyond its own block."""
        at = self.places.get(name)
        if at and (name in BLOCKS or not self.blocks or self.blocks[-1] < at[-1]):
            for _ in range(len(self.stack) - at[-1]):
                self.pop()
        elif name in BLOCKS:
            self.end_line()

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.end_line()
            # the innermost block, with inline elements that are open in it, ends where this one begins
            while self.blocks and name in ENDS_AT.get(self.stack[self.blocks[-1]][0], ()):
                for _ in range(len(self.stack) - self.blocks[-1]):
                    self.pop()
        if name not in VOID and not attributes.endswith("/"):
            self.push(name, *_kind(name, attributes, self.article > 0))


def lines_of(page: str) -> list[Line]:
    """Blocks of a page in order, their white space made single.

    A ``<`` that begins no tag is text, as is one whose tag does not end, but for the last one, which ends the page. If a tag would end
    at none of the ends left because quotes hold them, quotes are ordinary characters from there on.
    """
    out, at, size, last_end, last_start, quotes = Page(), 0, len(page), page.rfind(">"), page.rfind("<"), True
    while at < size:
        open_at = page.find("<", at)
        out.text(page[at:open_at if open_at >= 0 else size])
        if open_at < 0:
            break
        at = open_at + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith(("!", "?"), at) and at < last_end:
            at = page.find(">", at) + 1
            continue
        ends = page.startswith("/", at)
        letter = page[at + ends:at + ends + 1]
        if not (letter.isascii() and letter.isalpha()) or open_at > last_end:
            if open_at == last_start and letter.isascii() and letter.isalpha():
                break  # cut off in a tag
            out.text("<")
            continue
        named = NAME.match(page, at + ends)
        rest = REST.match(page, named.end()) if quotes else None
        quotes = rest is not None
        stop = rest.end() if rest else page.find(">", named.end()) + 1
        name, attributes, at = named[0].lower(), page[named.end():stop - 1].rstrip(), stop
        if name == "br":
            out.parts.append(" ")
        elif ends:
            out.end(name)
        elif name in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*+>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            if name == "title":
                out.end_line()
        else:
            out.start(name, attributes)
    out.end_line()
    return out.lines


def _kind(name: str, attributes: str, within: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it is an article."""
    values = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    role = values.get("role", "").lower()
    if name in ("html", "body"):
        return False, False
    is_article = name in ("article", "main") or role in ("main", "article") or "articlebody" in values.get("itemprop", "").lower()
    hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
    hints = LAYOUT.sub(" ", f"{values.get('class', '')} {values.get('id', '')}")
    apart = name in APART or name == "header" and not within or role in ROLES or hidden
    if name in ("article", "main"):
        return apart or bool(FOREIGN.search(hints)), is_article
    if name in ("h1", "h2", "h3", "a", "span", "b", "i", "em", "strong"):
        return apart, is_article
    return apart or bool(BOILER.search(hints)) or not within and bool(HEADER.search(hints)), is_article


def weights(lines: list[Line]) -> list[int]:
    """What each line weighs: its characters, as marks and links have them count."""
    marked = any(x.inside and not x.boiler for x in lines)
    return [0 if x.boiler or marked and not x.inside else MARKED * len(x.text) if x.inside else max(0, len(x.text) - 2 * x.linked) for x in lines]


def main_text(page: str | None) -> str:
    """The main text: blocks in page order, parted by an empty line; empty if there is none."""
    lines = lines_of(page or "")
    counts = weights(lines)
    return "\n\n".join(lines[k].text for start, end in _texts(lines, counts) for k in range(start, end) if counts[k])


def _texts(lines: list[Line], counts: list[int]) -> list[tuple[int, int]]:
    """Ranges of lines from a surge to the dive after it.

    Known boilerplate inside a text does not part it, and headings right before a text belong to it. A page that never surges has
    its heaviest line with what stands around it up to the first empty line.
    """
    sums = [sum(counts[k:k + WINDOW]) for k in range(len(counts))]
    found, k = [], 0
    while k < len(counts):
        if not counts[k] or sums[k] < SURGE:
            k += 1
            continue
        start = before = k
        while before > (found[-1][1] if found else 0) and (lines[before - 1].boiler or lines[before - 1].heading and counts[before - 1]):
            before -= 1
            if counts[before]:
                start = before
        last, empty = k, 0
        while k < len(counts) and empty <= GAP:
            if counts[k]:
                last, empty = k, 0
            else:
                empty += not lines[k].boiler
            k += 1
        found.append((start, last + 1))
    if found or not any(counts):
        return found
    start = end = counts.index(max(counts))
    while start > 0 and (counts[start - 1] or lines[start - 1].boiler):
        start -= 1
    while end < len(counts) and (counts[end] or lines[end].boiler):
        end += 1
    return [(start, end)]


def extract_main_text(pages: DataFrame, html: str = "html", keep=("page_id", "url")) -> DataFrame:
    """Columns ``keep`` of all ``pages``, then ``text`` and ``n_chars``; a null page has no text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, whole.num_columns - 1):
                texts = [main_text(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                                 names=[*keep, "text", "n_chars"])

    source = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html}`"))
    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
