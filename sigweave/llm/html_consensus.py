"""Main text of web pages by consensus of each host's pages.

Pass 1 scores the containers of every page and votes, in Spark, on the generalised path (tags
and classes, digits levelled) that holds a host's articles. Pass 2 extracts again from every
container on its host's winning path where these hold all of the page's own best container;
another page uses its own.

Nulls: a null html gives an empty text, a null url the host ``''``. Empty pages have no vote.
Repeated rows are kept and vote each; of paths with equal votes the one of the higher score, then the
later in order wins. Tags with unmatched quotes end at the next ``>``. A very long page is parsed whole,
alone, in memory of a few times its size. An empty table gives no rows. Extra columns pass by; only
page_id, url and html are read. Boilerplate is told by tags and names, never by its length, where a page
has an article, main or h1 element.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small
from .url_cascade import host_of

#: Their content is no markup; an open one takes the rest of the page, as in browsers.
RAW = frozenset("script style textarea title iframe".split())
#: Dropped with what they hold if they are closed anywhere; else only the tag is.
INLINE = frozenset("noscript template svg object select button canvas audio video math".split())
DROPPED = frozenset("nav header footer aside form menu dialog head".split()) | RAW | INLINE
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary fieldset center hr nav header footer aside form menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body main article section div td blockquote center".split())
#: Elements that end an open one of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words in a class, id or role that mark what is not the article; the last group also with more letters behind.
BOILERPLATE = re.compile(
    r"nav|navbar|navigation|menu|sidebar|side|footer|header|masthead|banner|notices?|alert|gdpr|ads?|promo|respond|disqus|share|sharing|social|related|recommended|subscribe|subscription|signup|popup|modal|overlay|pagination|pager|widget|toolbar|search|login|complementary|contentinfo"
    r"|(?:cookie|consent|advert|sponsor|comment|newsletter|breadcrumb)\w*",
    re.I,
)
#: Words that may stand beside those without naming anything else.
NEUTRAL = re.compile(r"box|area|list|block|container|wrapper|wrap|section|bar|top|bottom|left|right|main|primary|secondary|inner|outer|", re.I)
#: Elements that tell where the article is.
ANCHORS = frozenset("article main h1".split())
#: How an element is named: like boilerplate among other words, or like nothing else.
PARTLY, WHOLLY = 1, 2
#: A comment or declaration; a tag with whole attributes; a tag whose quotes don't match, up to the next ``>``.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+|[^>]*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")


class Block(NamedTuple):
    path: tuple[str, ...]  # labels of the containers around it, from the root
    nodes: tuple[int, ...]  # their numbers in the page
    text: str
    linked: int  # characters inside links
    marks: tuple[int, ...] = ()  # numbers of the elements around it that are named like boilerplate
    wholly: bool = False  # whether one of them is named like nothing else
    holders: tuple[int, ...] = ()  # those of ``marks`` that hold an anchor around it, or are one
    anchored: bool = False  # whether there is an anchor around it


def named(marks: str) -> int:
    """Whether the words of class, id and role name boilerplate: 0, ``PARTLY`` or ``WHOLLY``."""
    parts = [[re.sub(r"\d+", "", x) for x in re.split(r"[_-]+", token)] for token in marks.split()]
    hits = [any(BOILERPLATE.fullmatch(x) for x in token) for token in parts]
    if not any(hits):
        return 0
    return WHOLLY if all(h and all(BOILERPLATE.fullmatch(x) or NEUTRAL.fullmatch(x) for x in token) for h, token in zip(hits, parts)) else PARTLY


def label(tag: str, attributes: str) -> tuple[str, bool, int]:
    """Generalised name of an element, whether its tag is dropped, and how it is named like boilerplate."""
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    marks = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    name = ".".join([tag, *sorted(set(re.sub(r"\d+", "0", found.get("class", "")).lower().split()))])
    return name, tag in DROPPED, named(marks) if marks.strip() and tag not in ("html", "body") else 0


def in_article_header(stack: list) -> bool:
    """Whether what is dropped around the open elements is the header of an article alone."""
    tags = [x[0] for x in stack]
    return "header" in tags and any(t in ("article", "main") for t in tags[: tags.index("header")])


def blocks(page: str) -> list[Block]:
    """Blocks of text outside boilerplate, in page order (see ``kept``). Of an article's own header the headings stay."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, int, int]] = []  # tag, label, dropped, number, how it is named
    words: list[str] = []
    linked, links, dropped, numbers, at = 0, 0, 0, 0, 0
    last_end: dict[str, int] = {}  # where each inline element that is dropped is closed last
    spared = 0  # open headings of an article's header

    def flush():
        nonlocal linked
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                around = [(x[1], x[3]) for x in stack if x[0] in CONTAINERS]
                last = max((i for i, x in enumerate(stack) if x[0] in ANCHORS), default=-1)
                marks = [(i, x[3]) for i, x in enumerate(stack) if x[4]]
                wholly = any(x[4] == WHOLLY for x in stack)
                out.append(Block(tuple(x for x, _ in around), tuple(n for _, n in around), text, linked, tuple(n for _, n in marks), wholly, tuple(n for i, n in marks if i <= last), last >= 0))
        linked = 0

    def close(to: int):
        nonlocal dropped, links, spared
        while len(stack) > to:
            tag, name, drop, _, _ = stack.pop()
            dropped -= drop
            links -= tag == "a"
            if spared and tag in HEADINGS:
                spared = 0
                dropped += 1

    while True:
        m = TOKEN.search(page, at)
        if not dropped and (m.start() if m else len(page)) > at:
            text = entities.unescape(page[at : m.start() if m else len(page)])
            words.append(text)
            linked += len(text) * (links > 0)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if (k := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)) >= 0:
                if tag in BLOCKS or tag in DROPPED - INLINE or any(x[4] for x in stack[k:]):
                    flush()
                close(k)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in BLOCKS:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CONTAINERS or stack[i][0] in ("ul", "ol", "dl", "table"):
                    break
                if stack[i][0] in CLOSES.get(tag, ()) or stack[i][0] == "p":
                    close(i)
                    break
        elif tag == "br" and not dropped:
            words.append(" ")
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            if not dropped:
                words.append(" ")
            continue
        name, drop, mark = label(tag, m[3])
        if tag in INLINE:
            if tag not in last_end:
                ends = [x.start() for x in re.finditer(rf"</{tag}\s*>", page, re.I)]
                last_end[tag] = ends[-1] if ends else -1
            drop = last_end[tag] >= at
        if tag in INLINE and not dropped:
            words.append(" ")
        elif (drop or mark) and tag not in BLOCKS:
            flush()
        stack.append((tag, name, drop, numbers, mark))
        numbers += 1
        dropped += drop
        links += tag == "a"
        if tag in HEADINGS and dropped == 1 and not spared and in_article_header(stack):
            spared = 1
            dropped = 0
    flush()
    return kept(out)


def kept(found: list[Block]) -> list[Block]:
    """``found`` without what is named like boilerplate, whatever its length.

    If an article, main or h1 element outside elements named wholly so holds text, an element named so is
    spared only if it holds such a one. On other pages what is named partly so is spared if it
    holds most of the text that is not named wholly so; and if nothing is left, what is in an article or main.
    """
    told = [b for b in found if b.anchored and not b.wholly]
    if told:
        spared = {n for b in told for n in b.holders}
        return [b for b in found if all(n in spared for n in b.marks)]
    free = [b for b in found if not b.wholly]
    held: dict[int, int] = {}
    for b in free:
        for n in b.marks:
            held[n] = held.get(n, 0) + max(0, len(b.text) - b.linked)
    half = sum(max(0, len(b.text) - b.linked) for b in free) / 2
    out = [b for b in free if all(held[n] > half for n in b.marks)]
    if out:
        return out
    spared = {n for b in found for n in b.holders}
    return [b for b in found if in_main(b) and all(n in spared for n in b.marks)]


def in_main(block: Block) -> bool:
    return any(x.split(".")[0] in ("main", "article") for x in block.path)


def best_container(found: list[Block]) -> tuple[int, str, float] | None:
    """Number, path and score of the smallest container that holds all blocks that are not mostly links.

    Where main or article elements hold such blocks, those outside them don't count.
    """
    own = [b for b in found if len(b.text) > 2 * b.linked] or found
    own = [b for b in own if in_main(b)] or own
    if not own:
        return None
    depth = 0
    while all(len(b.nodes) > depth and b.nodes[depth] == own[0].nodes[depth] for b in own):
        depth += 1
    if not depth:
        return None
    return own[0].nodes[depth - 1], ">".join(own[0].path[:depth]), float(sum(len(b.text) - 2 * b.linked for b in found if own[0].nodes[depth - 1] in b.nodes))


def extract(found: list[Block], path: str | None) -> str:
    """Text of all blocks under containers on ``path`` if these hold the page's best container, else under that."""
    best = best_container(found)
    mine = [best is None or best[0] in b.nodes for b in found]
    if path:
        want = tuple(path.split(">"))
        wide = [b.path[: len(want)] == want for b in found]
        if all(w or not m for w, m in zip(wide, mine)):
            mine = wide
    return "\n".join(b.text for b, m in zip(found, mine) if m)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            if best := best_container(blocks(page.as_py() or "")):
                rows.append((host, *best[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, (pa.string(), pa.string(), pa.float64()))], names=["host", "path", "score"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        texts = [extract(blocks(page.as_py() or ""), path) for page, path in zip(batch.column(2), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path with the most votes, then the highest score. Votes are summed before the shuffle."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, score double")
    tally = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.round(F.sum("score"), 0).alias("score"))
    return tally.groupBy("host").agg(F.max(F.struct("votes", "score", "path"))["path"].alias("path"))


def op9_consensus_paths(pages: DataFrame) -> DataFrame:
    winners = materialize(winning_paths(pages), "paths")
    asked = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    chosen = asked.join(small(winners, winners.count()), "host", "left").select("page_id", "url", "html", "path")
    return chosen.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
