"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a binary variable (content or not).  Its unary potential multiplies learned ratios of its features (tag, words
of class, id and role, length of its own text, share of linked text); a pairwise potential joins it to its parent.  Messages
pass upward from the leaves and downward from the root, and give each element's exact marginal.  The text that stands
directly in an element whose marginal is at least ``THRESHOLD`` is main text.

All potentials are trained from labelled pages: a few written ones (``LABELLED``, whose ``data-main`` attributes are the
labels), and a bounded sample of the given pages whose only ``article`` element labels its inside, save nested page parts.
"""

from __future__ import annotations

import dataclasses
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import ship

THRESHOLD = 0.5
SIZE_WEIGHT = 0.3
#: About so many pages, picked by a hash of the id, add to the written ones.
MAX_TRAINING_PAGES = 400

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)([^>]*)>|<[!?][^>]*>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|data-main|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style".split())
UNSEEN = frozenset("head title script style noscript template svg math iframe object canvas audio video select option datalist textarea button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img input".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES_ALIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_PAGE_PARTS = (
    "nav", "menu", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "ad", "ads", "advert", "advertisement",
    "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login",
    "search", "share", "social", "related", "recommended", "tags", "pagination", "pager", "comment", "comments", "reply", "respond", "discussion", "form",
    "copyright", "legal", "disclaimer", "toolbar", "skip",
)
_MAIN_PARTS = ("article", "content", "main", "post", "entry", "story", "body", "text", "prose")


def _written() -> list[str]:
    long = "A long sentence of the piece that tells what happened, who was there, and why it mattered to them. " * 3
    short = "Some words that stand here"
    link = '<li><a href="/x">Elsewhere</a></li>'
    pages = []
    for part in _PAGE_PARTS:
        pages.append(
            f'<body><div class="{part}"><ul>{link * 3}</ul><p>{short}</p><div>{short}</div></div><div class="wrap" data-main="1"><h1>{short}</h1><p>{long}</p>'
            f'<p>{short}</p><p>Brief.</p><h2>{short}</h2><p>{long}</p><ul><li>{short}</li><li>Brief.</li></ul><p>{short}</p><div><p>{long}</p><p>Brief.</p></div><section class="{part}" data-main="0"><p>{long}</p><div>{short}</div></section></div><div id="{part}"><p>{long}</p></div></body>'
        )
    for part in _MAIN_PARTS:
        pages.append(
            f'<body><header><h1>{short}</h1><nav><ul>{link * 4}</ul></nav></header><div class="{part}" data-main="1"><h2>{short}</h2><p>{long}</p><blockquote><p>{long}</p></blockquote>'
            f"<ul><li>{short}</li><li>{long}</li></ul><p>{short}</p><p>Brief.</p><div><p>{short}</p><p>{long}</p></div><table><tr><td>{short}</td></tr></table><pre>{short}</pre>"
            f'<figure><figcaption>{short}</figcaption></figure><form data-main="0"><label>{short}</label><p>{short}</p></form><aside data-main="0"><p>{long}</p></aside></div>'
            f"<aside><p>{long}</p><ul>{link * 3}</ul></aside><footer><p>{long}</p>{short}</footer></body>"
        )
    for tag in ("article", "main") * 6:
        pages.append(
            f'<body><header><h1>{short}</h1></header><nav>{link * 3}</nav>{short}<{tag} data-main="1"><header><h1>{short}</h1></header><p>{long}</p>{long}<section><h2>{short}</h2><p>{short}</p><div><p>{long}</p></div></section>'
            f'<nav data-main="0"><a href="/x">{short}</a></nav><footer data-main="0"><p>{short}</p></footer></{tag}><header><h2>{short}</h2><p>{short}</p></header><form><p>{short}</p></form><dialog><p>{short}</p></dialog><footer>{short}</footer></body>'
        )
    return pages * 8


@dataclasses.dataclass
class Element:
    tag: str
    words: tuple[str, ...]
    label: str | None
    parent: int
    unseen: bool
    own: int = 0  # characters of text directly inside
    linked: int = 0  # of these and of inline children, inside links
    total: int = 0


Piece = tuple[int, str]  # element, decoded text


def parse(page: str) -> tuple[list[Element], list[list[Piece]]]:
    """Elements in page order (0 is the root) and blocks of text pieces; inline elements belong to their block's element."""
    elements = [Element("#root", (), None, -1, False)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open tags and the element their text belongs to
    links = 0
    blocks: list[list[Piece]] = [[]]
    at, n = 0, len(page)

    def text(raw: str) -> None:
        if not raw:
            return
        e = stack[-1][1]
        if elements[e].unseen:
            return
        value = html.unescape(raw) if "&" in raw else raw
        blocks[-1].append((e, value))
        size = len(value.strip())
        elements[e].own += size
        if links:
            elements[e].linked += size

    def cut() -> None:
        if blocks[-1]:
            blocks.append([])

    def close(down_to: int) -> None:
        nonlocal links
        while len(stack) > down_to:
            tag, _ = stack.pop()
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE:
                cut()

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break  # a stray inline end tag ends nothing outside its block
            continue
        if tag in ("br", "hr"):
            cut()
            continue
        if tag in VOID:
            continue
        if tag in ENDS_PARAGRAPH:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in CLOSES_ALIKE:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in LISTS[tag]:
                    break
                if stack[k][0] in CLOSES_ALIKE[tag]:
                    close(k)
                    break
        if tag in INLINE:
            if tag == "a":
                links += 1
            hidden = False
            if not attributes.endswith("/"):
                stack.append((tag, stack[-1][1]))
        else:
            cut()
            names, label, hidden = [], None, False
            if attributes and attributes != "/":
                for key, x, y, z in _ATTRIBUTE.findall(attributes):
                    key, value = key.lower(), x or y or z
                    if key == "data-main":
                        label = value
                    elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                        hidden = True
                    elif value:
                        names += _WORD.findall(_CAMEL.sub(" ", value).lower())
            parent = stack[-1][1]
            elements.append(Element(tag, tuple(sorted(set(names))), label, parent, hidden or tag in UNSEEN or elements[parent].unseen))
            if not attributes.endswith("/") or tag in RAW:
                stack.append((tag, len(elements) - 1))
            if tag in RAW:
                end = re.compile(f"</{tag}\\b[^>]*>|\\Z", re.I).search(page, at)
                at = end.end()
                close(len(stack) - 1)
    return elements, blocks


def features(e: Element) -> list[str]:
    out = ["tag:" + e.tag, *("word:" + w for w in e.words)]
    out.append(f"own:{min(e.own.bit_length() // 2, 5)}" if e.own else "own:none")
    if e.own:
        out.append(f"linked:{4 * e.linked // e.own}")
    return out


def labelled(elements: list[Element], written: bool) -> list[int] | None:
    """1 or 0 for each element, or None where the page does not tell."""
    if not written and sum(e.tag == "article" for e in elements) != 1:
        return None
    out: list[int] = []
    for e in elements:
        above = out[e.parent] if e.parent >= 0 else 0
        if written:
            out.append(int(e.label) if e.label in ("0", "1") else above)
        elif e.tag == "article":
            out.append(1)
        else:
            out.append(int(above and e.tag not in ("nav", "aside", "footer", "form", "dialog") and not any(w in _PAGE_PARTS for w in e.words)))
    return out


@dataclasses.dataclass(frozen=True)
class Model:
    unary: dict[str, float]  # log ratio content : other of a feature, given the parent is not told
    pair: tuple[tuple[float, float], tuple[float, float]]  # probability of child given parent


def counted(page: str, written: bool) -> Counter[tuple[str, int]]:
    """Counts of (feature, label) and (parent label, label) of a page; none if it is not labelled."""
    elements, _ = parse(page)
    labels = labelled(elements, written)
    out: Counter[tuple[str, int]] = Counter()
    if labels is None:
        return out
    for e, y in zip(elements[1:], labels[1:], strict=True):
        if not e.unseen:
            out[f"pair:{labels[e.parent]}", y] += 1
            for f in features(e):
                out[f, y] += 1
    return out


def combined(written: Counter[tuple[str, int]], seen: Counter[tuple[str, int]]) -> Counter[tuple[str, int]]:
    """Both counts, the given pages weighing at most a quarter of the written ones: they may all share one template."""
    weight = min(1.0, sum(written.values()) / 4 / max(sum(seen.values()), 1))
    out: Counter[tuple[str, int]] = Counter(written)
    for k, n in sorted(seen.items()):
        out[k] += n * weight
    return out


def model_of(counts: Counter[tuple[str, int]]) -> Model:
    """Potentials from summed counts: smoothed ratios, so what was never seen says nothing."""
    total = [sum(c for (f, y), c in counts.items() if f.startswith("tag:") and y == s) + 1 for s in (0, 1)]
    unary = {}
    for f in {f for f, _ in counts}:
        if not f.startswith("pair:"):
            one, other = counts[f, 1] / total[1], counts[f, 0] / total[0]
            least = 0.5 / min(total)
            ratio = max(-6.0, min(6.0, math.log((one + least) / (other + least))))
            # sizes go along with tags and with each other, so they count less than a full independent witness
            unary[f] = ratio * (SIZE_WEIGHT if f.startswith(("own:", "linked:")) else 1.0)
    pair = []
    for parent in (0, 1):
        zero, one = counts[f"pair:{parent}", 0] + 1, counts[f"pair:{parent}", 1] + 1
        share = min(0.97, max(0.03, one / (zero + one)))
        pair.append((1 - share, share))
    return Model(unary, (pair[0], pair[1]))


def marginals(elements: list[Element], model: Model) -> list[float]:
    """P(content) of every element by one upward and one downward pass of sum-product messages."""
    n, pair = len(elements), model.pair
    local = []
    for e in elements:
        s = sum(model.unary.get(f, 0.0) for f in features(e)) if e.parent >= 0 else -4.0
        p = 1 / (1 + math.exp(-max(-12.0, min(12.0, s))))
        local.append((1 - p, p))
    below = [list(x) for x in local]  # local potential times messages from children
    message = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):  # children come after their parents
        b0, b1 = below[i]
        m0, m1 = pair[0][0] * b0 + pair[0][1] * b1, pair[1][0] * b0 + pair[1][1] * b1
        z = m0 + m1
        message[i] = (m0 / z, m1 / z)
        up = below[elements[i].parent]
        up[0] *= message[i][0]
        up[1] *= message[i][1]
        z = up[0] + up[1]
        up[0], up[1] = max(up[0] / z, 1e-300), max(up[1] / z, 1e-300)
    belief = [(0.0, 0.0)] * n
    z = below[0][0] + below[0][1]
    belief[0] = (below[0][0] / z, below[0][1] / z)
    for i in range(1, n):
        p0, p1 = belief[elements[i].parent]
        m0, m1 = message[i]
        p0, p1 = p0 / max(m0, 1e-300), p1 / max(m1, 1e-300)  # the parent's belief without this child
        d0, d1 = p0 * pair[0][0] + p1 * pair[1][0], p0 * pair[0][1] + p1 * pair[1][1]
        b0, b1 = below[i][0] * d0, below[i][1] * d1
        z = b0 + b1
        belief[i] = (b0 / z, b1 / z)
    return [b[1] for b in belief]


def main_text(page: str, model: Model) -> str:
    elements, blocks = parse(page)
    content = [p >= THRESHOLD for p in marginals(elements, model)]
    out = []
    for block in blocks:
        words = "".join(t for e, t in block if content[e]).split()
        if words:
            out.append(" ".join(words))
    return " ".join(out)


def fit(pages: DataFrame, max_pages: int = MAX_TRAINING_PAGES) -> Model:
    """Potentials from the written pages and a bounded sample of ``pages`` (page_id, html); counts are added up by feature."""
    ship(pages.sparkSession)
    share = max_pages / max(pages.count(), 1)
    sample = pages.select("page_id", "html").where("html is not null")
    if share < 1:
        sample = sample.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for page in batch.column("html"):
                total.update(counted(page.as_py(), False))
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], ["f", "y", "n"])

    written: Counter[tuple[str, int]] = Counter()
    for page in _written():
        written.update(counted(page, True))
    # features of a bounded sample
    seen = sample.select("html").mapInArrow(run, "f string, y int, n long").groupBy("f", "y").agg(F.sum("n").alias("n")).collect()
    return model_of(combined(written, Counter({(r["f"], r["y"]): r["n"] for r in seen})))


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the main text of its whole html.

    A null or empty html, and a page without main text, give the empty text.  Broken markup is read as far as it goes;
    repeated rows give equal results.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # features of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                out = [main_text(page or "", own) for page in part.column("html").to_pylist()]
                columns = [part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
