"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html as references
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import per_text, table

STOP_WORDS = frozenset(
    # English, German, French, Spanish
    "a an and are as at be by for from has he in is it of on or she that the they this to was were will with you not but have had "
    "der die das den dem des ein eine einer und oder ist war sind mit von zu im in auf für als auch nicht sich es er sie wir ich bei "
    "le la les un une des du de et ou est était sont avec pour dans sur par qui que ne pas il elle nous vous ce cette au aux "
    "el los las una unos de del y o es era son con para por en que no se su lo al como más pero".split()
)
GOOD_DENSITY = 0.2
SHORT = 70
LINKS = 0.4
#: Pages with a smaller share of stop words are in a language the list does not know.
KNOWN = 0.03

_BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
_NESTED = frozenset(
    "article aside blockquote details dialog div dl fieldset figure footer form head header main menu nav ol section select table title ul".split()
)
#: Elements skipped up to their end tag, or to the end of the page without one; the others then lose their tag alone.
_RAW = frozenset("script style noscript textarea iframe".split())
_LOST = frozenset("template svg math object canvas audio video".split())
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW | _LOST}
#: Parts of forms beside the forms themselves.
_PARTS = frozenset("button label option optgroup datalist output".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CELLS = frozenset("tbody thead tfoot tr td th".split())
#: Blocks without an end tag of their own end where one of these begins.
_ENDED_BY = {
    "p": _BREAKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "tr": _CELLS - {"td", "th"}, "td": _CELLS, "th": _CELLS,
}
_NEVER = frozenset("nav footer aside form menu head title select dialog fieldset".split())
_CONTENT = frozenset(("article", "main"))
_HINTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice alert newsletter subscribe subscription signup popup modal "
    "overlay share sharing social related recommended comment comments respond replies disqus login search widget toolbar pagination pager "
    "copyright disclaimer contentinfo complementary hidden".split()
)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: Quotes count as the first character of a value only.
_INSIDE = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)|\Z))*+")
#: What a class name begins with if it tells of its page, not of its element.
_STATES = ("has-", "has_", "with-", "with_", "no-", "no_", "without-", "without_")
_ATTRIBUTE = re.compile(r"([^\s=>/\"']+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    excluded: bool
    content: int  # number of the article or main element around it, 0 outside
    label: str = ""


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)

    def close(self, excluded: bool, content: int) -> None:
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            linked = sum(len("".join(t.split())) for t, link in self.parts if link)
            self.blocks.append(Block(text, linked, excluded, content))
        self.parts = []


def _hidden(attrs: str) -> bool:
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _hinted(attrs: str, whole: bool = False, named: tuple[str, ...] = ("class", "id", "role")) -> bool:
    """Whether an element names itself as something beside the main text, by a ``whole`` name or a part of one."""
    for m in _ATTRIBUTE.finditer(attrs):
        if m[1].lower() in named:
            names = [v for v in (m[2] or m[3] or m[4] or "").lower().split() if not v.startswith(_STATES)]
            if not _HINTS.isdisjoint(names if whole else re.split(r"[\s_-]+", " ".join(names))):
                return True
    return False


def _tokens(page: str):
    """``(text before, name, whether an end tag, attributes)`` of each tag in order, and the last text with an empty name.

    The scan only moves forward: comments, declarations and raw elements are passed over, and what the end of the page cuts
    off is dropped, so a page of any broken tags takes time in proportion to its length.
    """
    at, start, endless = 0, 0, set()
    while (i := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), i):
            close, skip = ("-->", 4) if page.startswith("<!--", i) else ("]]>", 9) if page.startswith("<![CDATA[", i) else (">", 2)
            end = page.find(close, i + skip)
            yield page[start:i], "", False, ""
            if end < 0:
                return
            at = start = end + len(close)
            continue
        if not (m := _NAME.match(page, i)):
            at = i + 1
            continue
        inside = _INSIDE.match(page, m.end())
        # it stops before the end of the tag only at a quote that never closes; then the tag ends at once
        end = inside.end() if page.startswith(">", inside.end()) else page.find(">", inside.end())
        if end < 0:
            yield page[start:i], "", False, ""
            return
        tag, attrs = m[2].lower(), page[m.end() : end]
        at = start_of_next = end + 1
        if not m[1] and tag in _ENDS and tag not in endless and (tag in _RAW or not attrs.endswith("/")):
            if closing := _ENDS[tag].search(page, at):
                at = start_of_next = closing.start()
            elif tag in _RAW:
                yield page[start:i], "", False, ""
                return
            else:
                endless.add(tag)
        yield page[start:i], tag, bool(m[1]), attrs
        start = start_of_next
    yield page[start:], "", False, ""


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order; unclosed and misnested tags are taken as they come.

    Any element can exclude what it holds, by its kind, its names or by being hidden; text in excluded elements inside a
    block (``span``, ``button``) is left out of it.  Names of elements around an article or main element do not
    exclude it, unless they lie in another article.  Names of headings count by class only, as their ids repeat their text.
    """
    out, links, count = _Page(), 0, 0
    excluded, wrapped, articles = 0, 0, 0  # open elements that exclude all they hold, all but articles, and articles
    silent = 0  # open elements inside a block whose text is left out
    content, breaks = [], 0
    several = page.lower().count("<article") > 1  # the only article of a page is kept whatever it is called
    stack, open_tags = [], Counter()
    # blocks and marked inline elements open inside the innermost nested element
    small: list[tuple[str, int, int, int]] = []
    small_tags: Counter = Counter()

    def close() -> None:
        out.close(excluded + wrapped > 0, content[-1] if content else 0)

    def leave(tag: str) -> None:
        """End the innermost small element of the name, and all that began in it."""
        nonlocal excluded, wrapped, silent
        while small_tags[tag]:
            name, excluded, wrapped, silent = small.pop()
            small_tags[name] -= 1
            if name == tag:
                return

    for chunk, tag, ends, attrs in _tokens(page):
        if chunk and not silent:
            decoded = references.unescape(chunk) if "&" in chunk else chunk
            if decoded.strip():
                breaks = 0
            out.parts.append((decoded, links > 0))
        if not tag or tag in _ENDS:
            continue
        if tag == "a":
            links = 0 if ends else 1
        if tag == "br":
            breaks += 1
            if breaks > 1:
                close()
            out.parts.append((" ", False))
            continue
        if tag in _BREAKS:
            close()
            breaks = 0
            if not ends:
                for name, enders in _ENDED_BY.items():
                    if small_tags[name] and tag in enders:
                        leave(name)
        if tag in _NESTED:
            links = 0
            if not ends:
                if attrs.endswith("/") and tag == "div":
                    continue
                stack.append((tag, excluded, wrapped, articles, silent, small, small_tags))
                open_tags[tag] += 1
                small, small_tags = [], Counter()
                # a header inside an article holds its title
                excluded += tag in _NEVER or (tag == "header" and not content) or _hidden(attrs if tag != "main" else "")
                if tag in _CONTENT:
                    wrapped = 0
                    excluded += tag == "article" and several and _hinted(attrs, whole=not articles)
                    articles += tag == "article"
                    count += 1
                    content.append(count)
                elif _hinted(attrs):
                    excluded += articles > 0
                    wrapped += not articles
            elif open_tags[tag]:
                while stack:
                    name, excluded, wrapped, articles, silent, small, small_tags = stack.pop()
                    open_tags[name] -= 1
                    if name in _CONTENT:
                        content.pop()
                    if name == tag:
                        break
        elif tag in _VOID or tag in ("html", "body"):
            continue
        elif ends:
            leave(tag)
        elif tag in _BREAKS and tag not in _PARTS:
            if tag == "li":
                links = 0
            small.append((tag, excluded, wrapped, silent))
            small_tags[tag] += 1
            excluded += _hidden(attrs)
            if _hinted(attrs, named=("class", "role") if tag[0] == "h" else ("class", "id", "role")):
                excluded += articles > 0
                wrapped += not articles
        else:
            mark = tag in _PARTS or bool(attrs) and (_hidden(attrs) or _hinted(attrs, named=("class", "role")))
            if (mark or small_tags[tag]) and not attrs.endswith("/"):
                small.append((tag, excluded, wrapped, silent))
                small_tags[tag] += 1
                silent += mark
    close()
    return out.blocks


def classify(blocks: list[Block], good_density: float = GOOD_DENSITY, short: int = SHORT, links: float = LINKS) -> None:
    """Label blocks ``good`` or ``bad``: first by density and length, then the undecided by their neighbours.

    First pass: blocks of excluded elements, with a copyright sign or mostly of links are bad; blocks of at
    least ``short`` characters with enough stop words, or mostly of letters on a page that has hardly any stop words,
    are good; the rest is undecided.  Second pass: an undecided
    block takes the label of the nearest decided block of its own article or main element (the earlier one
    wins a tie; excluded blocks do not count, lists of links only for blocks with a link); without a decided one there it is good.  Outside such elements it is the
    nearest decided block of all, a bad one on a tie, and a page without any decided block has no main text.
    """
    counts = []
    for b in blocks:
        if b.excluded or "©" in b.text[:40] or b.linked > links * len(b.text.replace(" ", "")):
            b.label = "bad"
            continue
        words = [w.lower() for w in _WORDS.findall(b.text)]
        counts.append((b, sum(w in STOP_WORDS for w in words), len(words), sum(map(len, words))))
    foreign = sum(c[1] for c in counts) < KNOWN * sum(c[2] for c in counts)
    for b, stops, words, letters in counts:
        if len(b.text) >= short and (2 * letters >= len(b.text) if foreign else stops >= good_density * max(1, words)):
            b.label = "good"
    decided = [i for i, b in enumerate(blocks) if b.label]
    at, final = 0, [b.label for b in blocks]
    for i, b in enumerate(blocks):
        while at < len(decided) and decided[at] < i:
            at += 1
        if b.label:
            continue
        left, right = at - 1, at
        if b.content:
            def apart(k: int, b: Block = b) -> bool:
                other = blocks[decided[k]]
                return other.content != b.content or other.excluded or (other.label == "bad" and not b.linked)

            while left >= 0 and apart(left):
                left -= 1
            while right < len(decided) and apart(right):
                right += 1
            near = [(i - decided[left], 0, decided[left])] if left >= 0 else []
            near += [(decided[right] - i, 1, decided[right])] if right < len(decided) else []
            final[i] = blocks[min(near)[2]].label if near else "good"
        else:
            near = [(abs(i - decided[s]), blocks[decided[s]].label) for s in (left, right) if 0 <= s < len(decided)]
            final[i] = min(near)[1] if near else "bad"  # of two as near, "bad" sorts first
    for b, label in zip(blocks, final):
        b.label = label


def main_text(page: str | None) -> str:
    """The good blocks of a whole page, joined by line ends; empty for null, empty or boilerplate pages."""
    if not page:
        return ""
    blocks = blocks_of(page)
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract(html: Column) -> Column:
    """``struct(text, n_chars)`` of whole pages; the length counts code points."""

    def run(pages: list) -> list:
        return [(t, len(t)) for t in map(main_text, pages)]

    return per_text("text string, n_chars long", run, html)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", extract(F.col("html")).alias("_t")).select("page_id", "url", "_t.*")
