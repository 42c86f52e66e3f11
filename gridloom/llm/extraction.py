"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. First pass: stop-word density, length, link
density and the elements around a block make it content, boilerplate or undecided (short, or of
middling density). Second pass: undecided blocks take the label of the nearest decided neighbours in
their section; where the two sides differ, a heading or a block of middling density goes with
the content and other short blocks with the nearer side. Within an article the section's default
is content, elsewhere boilerplate.

Defined cases: null and empty pages give the empty text; unclosed tags end with their parent or the
page; an unclosed comment, script or style reaches to the end; repeated rows are extracted
each; an empty table gives an empty result; other columns are ignored by ``extract``."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a all an and are as at be been but by for from had has have he her his in is it its not of on or she that the their they this to was were which will with you
    als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nicht sich sie sind so und von war wie wird zu zum zur
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour que qui sa se ses son sur un une vous
    al como con de del el ella en es esta este están ha la las lo los más no o para pero por que se si sin su sus un una y""".split()
)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
# Elements and class, id or role words that never hold an article's own text.
DROPPED = frozenset("head nav footer aside form noscript template select button svg canvas object dialog menu".split())
DROPPED_WORDS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus gdpr menu modal nav navbar navigation newsletter notice popup promo promoted related respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
OUTER_WORDS = frozenset("footer header masthead topbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("text", "linked", "tag", "section", "dropped", "label")

    def __init__(self, text: str, linked: int, tag: str, section: int, dropped: bool):
        self.text, self.linked, self.tag, self.section, self.dropped, self.label = text, linked, tag, section, dropped, None


def _drops(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    words = {w for m in NAMED.finditer(attributes) for w in SPLIT.split((m[1] or m[2] or m[3] or "").lower())}
    return bool(words & DROPPED_WORDS) or (not in_article and bool(words & OUTER_WORDS))


def blocks(html: str) -> list[Block]:
    """Blocks in page order. ``section`` is 0 outside articles, else the article's number."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # tag, dropped, section
    parts: list[str] = []
    linked = links = sections = 0
    tag = "body"

    def state():
        return (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                dropped, section = state()
                found.append(Block(text, linked, tag, section, dropped))
            parts.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        if raw:
            parts.append(raw)
            if links:
                linked += len(" ".join(unescape(raw).split()))

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS or any(name == s[0] for s in stack):
                if name in BLOCKS:
                    flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        if name not in BLOCKS and any(s[0] in BLOCKS for s in stack[i:]):
                            break  # an inline end tag closes no block
                        del stack[i:]
                        break
                if name in BLOCKS:
                    tag = stack[-1][0] if stack else "body"
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            if name in BLOCKS:
                flush()
            at = stop.end() if stop else n
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name == "a":
            links += 1
            continue
        attributes = m[3] or ""
        if name not in BLOCKS:
            dropped, section = state()
            if name in DROPPED or _drops(name, attributes, section > 0):
                flush()
                stack.append((name, True, section))
            continue
        flush()
        links = 0
        if name in ("article", "main", "body"):
            while stack and stack[-1][0] in ("head", "nav", "header", "ul", "ol", "li", "p"):
                stack.pop()
        elif name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name in HEADINGS:
            # These end an open one of their kind (a paragraph ends at any of them).
            if stack and stack[-1][0] in ("p", name):
                stack.pop()
        dropped, section = state()
        if name in ("article", "main") and not section:
            sections += 1
            section = sections
        stack.append((name, dropped or _drops(name, attributes, section > 0), section))
        tag = name
    flush()
    return found


def label_blocks(found: list[Block], short: int = 70, long: int = 200, low: float = 0.12, high: float = 0.25, link: float = 0.4) -> None:
    """Sets ``label`` of every block: True for content."""
    articles = any(b.section and not b.dropped for b in found)
    middling = set()
    for b in found:
        if b.dropped:
            b.label = False
            continue
        size = len(b.text)
        if b.linked > link * size:
            b.label = False
            continue
        words = WORD.findall(b.text.lower())
        density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        if articles and not b.section:
            b.label = False  # a page with an article has its text there
        elif size < short:
            b.label = None
        elif density >= high or (b.section and size >= long):
            b.label = True
        elif density >= low or b.section:
            b.label = True if size >= long else None
            middling.add(id(b))
        else:
            b.label = False
    decided = [b.label for b in found]
    before: list[tuple[bool, int] | None] = []
    last: dict[int, tuple[bool, int]] = {}
    for i, b in enumerate(found):
        before.append(last.get(b.section))
        if decided[i] is not None and not b.dropped:
            last[b.section] = (decided[i], i)
    last = {}
    for i in range(len(found) - 1, -1, -1):
        b = found[i]
        if decided[i] is None:
            left, right = before[i], last.get(b.section)
            if left is None and right is None:
                b.label = b.section > 0
            elif left is None or right is None:
                b.label = (left or right)[0] or b.section > 0
            elif left[0] == right[0]:
                b.label = left[0]
            elif b.tag in HEADINGS:
                b.label = right[0]
            elif id(b) in middling or b.section:
                b.label = True
            else:
                b.label = left[0] if i - left[1] <= right[1] - i else right[0]
        if decided[i] is not None and not b.dropped:
            last[b.section] = (decided[i], i)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found = blocks(html)
    label_blocks(found)
    return "\n".join(b.text for b in found if b.label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
