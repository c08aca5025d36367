"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which with you
als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat im in ist mit nach nicht sich sie sind so und von war wie wird zu zum zur über
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui se son sont sur un une vous
al como con de del desde el ella en entre era es esta este fue ha hay la las lo los más no para pero por que se sin sobre su sus un una y ya
""".split()
)
#: Elements that start a new block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never main text.
CHROME = frozenset("nav footer aside form menu dialog button select fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class and id values that mark what is not the article: as the whole value or its last part ("site-nav"), or as its
# first part before a word that says only where or in what it stands ("footer-left"). Words that may as well name a subject count as a whole value only.
CUES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr popup newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs "
    "pagination pager sidebar disqus footer masthead skiplink toolbar".split()
)
WHOLE_CUES = frozenset(
    "promo promos promotion promotions banner banners notice alert modal overlay widget related related-posts related-articles recommended share sharing share-buttons social social-links "
    "replies site-header page-header siteheader pageheader skip-link side-bar".split()
)
COMMENTS = frozenset("comment comments disqus".split())
PLACES = frozenset("area banner bar block body box button buttons close container content form group holder inner item items left link links list main meta modal module notice outer overlay panel popup primary right secondary section slot thread toggle top unit widget widgets wrap wrapper bottom".split())
#: First parts of values that say something about what an element has, not what it is.
HAVING = frozenset("has have no not non with without is hide show".split())
_ADVERT = re.compile(r"ads?\d*|adsbygoogle|adslot|adunit|adbox|adcontainer")
_HIDDEN = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
#: A block of at least this many characters is judged by its own density; a shorter one may look at its neighbours.
LONG = 70
#: Share of stop words from which a long block is text, and below which it is not.
STOP_HIGH, STOP_LOW = 0.25, 0.1
#: Share of a page's long text that is dense if the stop words cover its language.
COVERED = 0.2
#: Mean length of a word up to which a run of letters is natural.
WORD = 20
#: Share of characters inside links from which a block is a list of links.
LINKS = 0.5

_RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|title|canvas|audio|video"
_TOKEN = re.compile(
    rf"(?is)<!--.*?(?P<over>-->|\Z)|<(?P<raw>{_RAW})(?=[\s/>])[^>]*+>.*?(?P<closed></(?P=raw)\s*>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?P<done>\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
)
_ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+|["']""")
#: Elements that a start of the same kind ends, and inside which of their ancestors.
ENDED_BY = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table")}
ENDED_BY = {k: (frozenset(x.split()), frozenset(y.split())) for k, (x, y) in ENDED_BY.items()}
#: Elements inside which an open paragraph of the outside goes on.
P_SCOPE = frozenset("td th table caption button body html".split())
#: Elements that may stand around a whole page, and that an article in them ends.
WRAPS = frozenset("form fieldset".split())
_P = frozenset(["p"])
_EDGE = re.compile(r"^\W+|\W+$")


@dataclass
class Block:
    """A run of text between block boundaries."""

    text: str
    linked: int
    chrome: bool
    main: bool
    heading: bool
    cued: int | None = None  # the innermost element around it whose class or id names what is no article

    def stop_density(self) -> float:
        """Share of its words that are function words."""
        words = self.text.lower().split()
        return sum(w in STOP_WORDS or (not w.isalpha() and _EDGE.sub("", w) in STOP_WORDS) for w in words) / len(words)

    def foreign(self) -> bool:
        """Whether most of its letters are of a script that no stop word has."""
        letters = [c for c in self.text if c.isalpha()]
        return 2 * sum(c > "\u024f" for c in letters) > len(letters)

    def figures(self) -> bool:
        """Whether it is numbers, and words of a natural length."""
        solid = len(self.text) - self.text.count(" ")
        return 3 * sum(c.isdigit() for c in self.text) >= solid and solid <= WORD * (self.text.count(" ") + 1)

    def reads(self) -> bool:
        """Whether it is words of a natural length, mostly letters; scripts without blanks have no such length."""
        marks = sum(c.isalpha() or unicodedata.category(c)[0] == "M" for c in self.text)
        solid = len(self.text) - self.text.count(" ")
        return 2 * marks > solid and (self.foreign() or solid <= WORD * (self.text.count(" ") + 1))


def _cue(value: str) -> str:
    """What one class or id value says of its element: ``comment`` or ``advert`` (never the article), ``cue``, or nothing."""
    parts = re.split("[_-]+", value.replace("__", "-"))
    if parts[0] in HAVING:
        return ""
    named = {parts[-1]} | ({parts[0]} if len(parts) > 1 and (parts[-1] in PLACES or parts[-1].isdigit() or "x" in parts[-1] and parts[-1][0].isdigit()) else set())
    if named & COMMENTS:
        return "comment"
    if any(_ADVERT.fullmatch(x) for x in named) or value == "adsbygoogle":
        return "advert"
    return "cue" if named & CUES or value.replace("_", "-") in WHOLE_CUES else ""


@lru_cache(1 << 16)
def _standing(tag: str, attrs: str, in_main: bool) -> str:
    """``chrome`` if the element is no part of an article whatever it holds, ``cue`` if its class or id says so, else nothing."""
    if tag in CHROME or (tag == "header" and not in_main):
        return "chrome"
    if tag in ("body", "html", "main"):
        return ""
    cued, seen = "", set()
    for m in _ATTR.finditer(attrs):
        name, value = (m[1] or "").lower(), entities.unescape(m[2] or m[3] or m[4] or "").lower()
        if name in seen:
            continue  # the first one counts
        seen.add(name)
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.strip() in ROLES) or (name == "style" and _HIDDEN.search(value)):
            return "chrome"
        if name in ("class", "id"):
            found = {_cue(x) for x in value.split()}
            if found & {"comment", "advert"}:
                return "chrome"
            cued = "cue" if "cue" in found else cued
    return cued


def _tokens(page: str) -> tuple[list[re.Match], int]:
    """Tags, comments and the like, and where the text goes on after the last. Linear: where no ``>`` follows there is no tag."""
    last = page.rfind(">") + 1
    out = list(_TOKEN.finditer(page, 0, last))
    if out and out[-1].end() == last and "" in (out[-1]["over"], out[-1]["closed"], out[-1]["done"]):
        return out, len(page)  # a comment or script that is never closed
    return out, out[-1].end() if out else 0


def _closed(tokens: list[re.Match]) -> set[int]:
    """Where the elements start that have an end tag of their own."""
    open_at: dict[str, list[int]] = {}
    out = set()
    for m in tokens:
        tag = (m["tag"] or m["tag2"] or "").lower()
        if m["end"] or m["end2"]:
            if open_at.get(tag):
                out.add(open_at[tag].pop())
        elif tag:
            open_at.setdefault(tag, []).append(m.start())
    return out


@dataclass
class _Open:
    """An element that is not closed yet."""

    tag: str
    chrome: bool
    main: bool
    cued: int | None
    loose: bool  # whether an article may end it
    muted: bool = False  # an element inside a line that is no part of the text
    closes: bool = True  # it has an end tag


def split_blocks(page: str) -> tuple[list[Block], dict[int, int | None]]:
    """Blocks of a page in order, and for each element with a cue the next one around it.

    A block's start ends an open paragraph, and list items, table cells and the like end their own kind; other unclosed
    elements end with what encloses them. An article ends chrome that is never closed, and forms.
    """
    out: list[Block] = []
    text: list[str] = []
    stack: list[_Open] = []
    tokens, rest = _tokens(page)
    closed = _closed(tokens)
    open_tags: Counter[str] = Counter()
    around: dict[int, int | None] = {}
    linked = links = muted = 0
    heading = False

    def close() -> None:
        nonlocal linked
        flat = " ".join("".join(text).split())
        if flat:
            top = stack[-1] if stack else None
            out.append(Block(flat, linked, bool(top and top.chrome), bool(top and top.main), heading, top.cued if top else None))
        text.clear()
        linked = 0

    def add(s: str) -> None:
        nonlocal linked
        if muted:
            return
        s = entities.unescape(s)
        text.append(s)
        if links:
            linked += sum(map(len, s.split()))

    def drop(i: int) -> None:
        nonlocal muted
        for x in stack[i:]:
            open_tags[x.tag] -= 1
            muted -= x.muted
        del stack[i:]

    def end_own(kinds: frozenset, scope: frozenset) -> None:
        """End the outermost open element of the kinds inside the nearest one of the scope."""
        if not any(open_tags[k] for k in kinds):
            return
        at = None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in scope:
                break
            if stack[i].tag in kinds:
                at = i
        if at is not None:
            drop(at)

    at = 0
    for m in tokens:
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        ends, attrs = bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
        if tag == "br":
            text.append(" ")
        if tag == "a":
            links = max(0, links - 1) if ends else links + 1
        if tag in BLOCKS:
            close()
            links = 0
            while stack and stack[-1].muted and not stack[-1].closes:
                drop(len(stack) - 1)
            if tag in HEADINGS:
                heading = not ends
        if tag in VOID or attrs.endswith("/"):
            continue
        if ends:
            if open_tags[tag]:
                drop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
        elif tag in BLOCKS or tag in CHROME:
            if tag in ("article", "main"):
                while stack and stack[-1].chrome and stack[-1].loose and not stack[-1].main:
                    drop(len(stack) - 1)  # a menu that was never closed
            end_own(_P, P_SCOPE)
            if tag in ENDED_BY:
                end_own(*ENDED_BY[tag])
            top = stack[-1] if stack else None
            chrome, main, cued = (top.chrome, top.main, top.cued) if top else (False, False, None)
            own = _standing(tag, attrs, main)
            if own == "cue":
                around[m.start()], cued = cued, m.start()
            open_tags[tag] += 1
            stack.append(_Open(tag, chrome or own == "chrome", main or (tag in ("article", "main") and not chrome and not own), cued, m.start() not in closed or tag in WRAPS))
        elif tag not in ("a", "b", "i", "em", "strong") and _standing(tag, attrs, True):
            top = stack[-1] if stack else None
            chrome, main, cued = (top.chrome, top.main, top.cued) if top else (False, False, None)
            muted += 1
            open_tags[tag] += 1
            stack.append(_Open(tag, chrome, main, cued, False, True, m.start() in closed))
    if rest < len(page):
        add(page[rest:])
    close()
    return out, around


def without_cued(blocks: list[Block], around: dict[int, int | None]) -> list[Block]:
    """Blocks with what their class and id cues say as chrome, but for those of elements that hold most of the page's long text.

    Such a value is about the page ("sidebar" on a wrapper), and the cues inside the element decide. What stands around an
    element holds no less, so the innermost one tells.
    """
    if not around:
        return blocks
    held: Counter[int | None] = Counter()
    for b in blocks:
        if not b.chrome and not b.heading and len(b.text) >= LONG and 2 * b.linked <= len(b.text):
            held[b.cued] += len(b.text)
    total = sum(held.values())
    for e in sorted(around, reverse=True):
        if around[e] is not None:
            held[around[e]] += held[e]
    return [replace(b, chrome=True) if b.cued is not None and 2 * held[b.cued] <= total else b for b in blocks]


def label_blocks(blocks: list[Block]) -> list[bool]:
    """Which blocks are main text.

    First pass: chrome and lists of links are not; long blocks are judged by stop word density. Where the stop words do not
    cover the language (the block's script, or next to no dense text on the page) length and links decide, if the block
    reads as text. Articles and main elements are the page's region if most of its long text stands there; in it, links or a low
    density leave a block undecided, and so do figures anywhere. Second pass: what is left, short blocks and middling densities, takes the label of the
    nearest decided block of the same side (the region, or what is outside it); of two equally near ones with different
    labels text wins. With none decided, blocks of the region stay, those outside it go, and on a page without a region
    all stay that are no chrome and no links.
    """
    few = [b.linked <= LINKS * (len(b.text) - b.text.count(" ")) for b in blocks]
    plain = [not b.chrome and x for b, x in zip(blocks, few, strict=True)]
    long = [p and len(b.text) >= LONG and not b.heading for p, b in zip(plain, blocks, strict=True)]
    density = [b.stop_density() if x else 0.0 for x, b in zip(long, blocks, strict=True)]
    dense = sum(len(b.text) for b, x, d in zip(blocks, long, density, strict=True) if x and d >= STOP_HIGH)
    reads = [x and (d >= STOP_HIGH or b.reads()) for b, x, d in zip(blocks, long, density, strict=True)]
    covered = dense > 0 and dense >= COVERED * sum(len(b.text) for b, r in zip(blocks, reads, strict=True) if r and not b.foreign())
    inside = sum(len(b.text) for b, r in zip(blocks, reads, strict=True) if r and b.main)
    has_main = any(b.main and not b.chrome for b in blocks) and 2 * inside >= sum(len(b.text) for b, r in zip(blocks, reads, strict=True) if r)
    label: list[bool | None] = []
    for i, b in enumerate(blocks):
        region = has_main and b.main
        if b.chrome or not (plain[i] or region):
            label.append(False)
        elif not long[i]:
            label.append(None)
        elif density[i] >= STOP_HIGH or (reads[i] and (not covered or b.foreign())):
            label.append(True)
        else:
            label.append(False if density[i] < STOP_LOW and not region and not b.figures() else None)
    out = [bool(x) for x in label]
    for side in (True, False):
        region = [i for i, b in enumerate(blocks) if not b.chrome and (has_main and b.main) == side]
        before, after, last = {}, {}, None
        for i in region:
            before[i] = last
            if label[i] is not None:
                last = i
        last = None
        for i in reversed(region):
            after[i] = last
            if label[i] is not None:
                last = i
        for i in region:
            if label[i] is None:
                near = [(abs(j - i), not label[j]) for j in (before[i], after[i]) if j is not None]
                if near:
                    out[i] = not min(near)[1]
                else:
                    out[i] = side or not has_main
    return out


def main_text(page: str | None) -> str:
    """Main text of one page, blocks joined by an empty line; empty for a null or empty page."""
    if not page:
        return ""
    blocks = without_cued(*split_blocks(page))
    return "\n\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks), strict=True) if keep)


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` without the html column and with its main text as ``out_col``, whole, in page order.

    Character references are decoded once, white space inside a block becomes one blank. Null and empty html give an empty
    text; repeated rows stay rows; other columns are kept, but for an older ``out_col``. One scan, no shuffle: a page is
    the unit of work, and nothing is kept between pages.
    """
    rest = [c for c in pages.columns if c not in (html_col, out_col)]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest), f"`{out_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(x.as_py()) for x in batch.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], text], [*rest, out_col])

    return pages.select(F.col(html_col), *[F.col(c) for c in rest]).mapInArrow(run, schema)
