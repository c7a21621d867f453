"""HTML extraction by tag-path ratios.

A page is read into blocks of text, each with its path of block elements from the root.  For each
path of the page, the length and the punctuation of its texts, less those of links, are added up and divided by the number of
its blocks.  The ratios are laid along the page, smoothed with their neighbours, and fused: a block counts by its path, its
surroundings, how far its path agrees with the best one, and the marks of the elements around it.  A mark is a tag, role, class or id that
speaks of something else than the article: a plain one leaves a twentieth of the score, a doubtful one (``discussion``, ``related-work``) half.
An element that wraps the page has no mark: one that holds half of the text outside links or more, with an article or a heading in it and no
article beside it.

Blocks above a threshold are content.  The smallest container that holds all content is the article.  Of its other blocks those
go that are marked (doubtful marks do not count within an ``article`` or ``main``) or mostly links; a heading stays if content follows before the next one of its rank.  Inline elements are never cut out
of their sentence, unless they are hidden.

Pages are independent, so tasks read them where they lie, and nothing is shuffled.  A path's sums are those of one page.

Special cases.  A null or empty page, or one without text, gives an empty text.  Broken markup is read as browsers do where that is
simple: unclosed elements end with their parents, paragraphs at the next block, unclosed comments and scripts at the
end of the page; a lone ``<`` is text.  Text without any markup is one block.  Repeated rows give repeated results; page_id
and url are carried along, null or not; other columns are not used.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from gleanery.llm.common import longs, with_made

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul noscript template button textarea object video audio canvas svg math "
    "script style iframe label".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that are never part of an article's text.
DROPPED = frozenset(
    "head script style noscript template button select option textarea input iframe svg math canvas object "
    "video audio label title".split())
#: Elements and roles that are something else than the article, unless they hold most of the page.
MARKED = frozenset("nav footer aside form dialog menu search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words that mark something else than the article wherever they stand in a class or id.
OTHER = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar nav navbar navigation menu "
    "submenu breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus "
    "cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login widget widgets pagination pager".split())
#: Words that do so as the whole name of a class, and are doubtful elsewhere: an article may speak of them.
DOUBTFUL = frozenset(
    "banner notice notices notification alert overlay side rail foot respond replies reply share sharing social related recommended "
    "recommendations search skip legal copyright disclaimer form poll tags tagcloud trending popular".split())
#: Words that are doubtful even alone.
WEAK = frozenset(("discussion",))
#: What a marked element leaves of the score of its text.
PLAIN_MARK, DOUBTFUL_MARK = 0.05, 0.5
#: Words that mark a page header, unless they stand in the article.
HEADER = frozenset(("header", "head", "topheader", "siteheader"))
#: Elements whose open child of the same kind is closed by a new one, and what stops the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
          "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
CONTAINERS = frozenset("html body article main section div td center tbody table tr form".split())
PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？]")
#: How far the neighbours of a block count, and how much of the best score is content.
SMOOTH = (0.1, 0.2, 0.4, 0.2, 0.1)
THRESHOLD = 0.15

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "path", "parent", "depth", "dropped", "mark", "wrap", "chars", "holds", "out", "in_article", "has_heading", "content")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, mark: float = 1.0) -> None:
        self.tag, self.parent, self.mark = tag, parent, mark
        self.path = f"{parent.path}/{tag}" if parent else tag
        self.depth = parent.depth + 1 if parent else 0
        self.dropped = dropped
        #: The nearest marked element, itself or around it; of a marked one: its text outside links, whether it holds an
        #: article or a heading, and whether its mark counts.
        self.wrap: Node | None = self if mark < 1 else parent.wrap if parent else None
        self.chars, self.holds, self.out = 0, False, mark < 1
        self.in_article = tag in ("article", "main") or bool(parent and parent.in_article)
        self.has_heading = False
        self.content = 0


class Block:
    __slots__ = ("node", "text", "linked", "weight")

    def __init__(self, node: Node, text: str, linked: int) -> None:
        self.node, self.text, self.linked = node, text, linked
        #: What the marks around it leave of its score.
        self.weight = 1.0


def drops(tag: str, attrs: str) -> bool:
    """Whether an element is never seen as text."""
    if tag in DROPPED:
        return True
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def mark(tag: str, attrs: str, parent: Node) -> float:
    """What the marks of an element leave of the score of its text: 1 without any."""
    if tag in MARKED or tag == "header" and not parent.in_article:
        return PLAIN_MARK
    left = 1.0
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in ROLES:
            return PLAIN_MARK
        # The id of a heading is what links point to.
        if name not in ("class", "id") or tag in HEADINGS or tag in ("html", "body", "article", "main"):
            continue
        for one in value.split():
            words = {w.lower() for w in NAME_WORDS.findall(one)}
            whole = name == "class" and len(words) == 1
            if words & OTHER or whole and words & DOUBTFUL:
                return PLAIN_MARK
            if words & HEADER and not parent.in_article and "entry" not in words and "article" not in words:
                return PLAIN_MARK
            if words & DOUBTFUL or words & WEAK:
                left = DOUBTFUL_MARK
    return left


def wraps(node: Node | None):
    """The marked elements around a node, from within."""
    at = node.wrap if node else None
    while at:
        yield at
        at = at.parent.wrap if at.parent else None


def weigh(blocks: list[Block]) -> None:
    """Weigh the blocks by the marked elements around them, but for those elements that wrap the page."""
    marked: dict[Node, None] = {}
    total = 0
    for b in blocks:
        chars = len(b.text) - b.linked
        total += chars
        for w in wraps(b.node):
            marked[w] = None
            w.chars += chars
            w.holds = w.holds or b.node.tag in HEADINGS or b.node.in_article and not (w.parent and w.parent.in_article)
    if not marked:
        return
    left = lambda: [b for b in blocks if not any(w.out for w in wraps(b.node))]
    for w in sorted(marked, key=lambda w: w.depth):  # outer ones first
        if w.chars and 2 * w.chars >= total and w.holds and not any(w.out for w in wraps(w.parent)):
            w.out = any(b.node.in_article and w not in wraps(b.node) for b in left()) and not (w.parent and w.parent.in_article)
    while not left():  # nothing is unmarked: those that hold most of the page have no mark, from without
        wrapping = [w for w in marked if w.out and 2 * w.chars >= total > 0]
        if not wrapping:
            break
        min(wrapping, key=lambda w: w.depth).out = False
    for b in blocks:
        b.weight = min((w.mark for w in wraps(b.node) if w.out), default=1.0)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text, in order and weighed; those of dropped elements are left out."""
    root = Node("html", None, False)
    stack = [root]
    out: list[Block] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            at = stack[-1]
            # Of a header in the article the headings count.
            if at.tag in HEADINGS or at.tag == "hgroup" or not any(n.tag == "header" and n.mark == 1 for n in chain(at)):
                out.append(Block(at, text, min(linked, len(text))))
            if at.tag in ("h1", "h2") and at.parent:
                at.parent.has_heading = True
        linked = 0

    def chain(node: Node | None):
        while node:
            yield node
            node = node.parent

    at, size = 0, len(page)
    while at < size:
        open_at = page.find("<", at)
        if open_at < 0:
            open_at = size
        if open_at > at and not stack[-1].dropped:
            parts.append(page[at:open_at])
            if links:
                linked += open_at - at
        if open_at == size:
            break
        m = TOKEN.match(page, open_at)
        if m is None:
            if not stack[-1].dropped:
                parts.append("<")
            at = open_at + 1
            continue
        at = m.end()
        end, tag = m["end"], m["start"]
        if end:
            end = end.lower()
            if end == "a":
                links = max(0, links - 1)
            if end == "p" and not any(n.tag == "p" for n in stack):
                flush()
            if end in BLOCKS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == end:
                        flush()
                        del stack[i:]
                        links = 0
                        break
                    if stack[i].tag in ("td", "th", "table") and end not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "td", "th"):
                        break
            continue
        if not tag:
            continue
        tag, attrs = tag.lower(), m["attrs"] or ""
        if tag in RAW and not attrs.endswith("/"):
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            inside = page[at:close.start() if close else size]
            at = page.find(">", close.start()) + 1 if close and page.find(">", close.start()) >= 0 else size
            if tag not in DROPPED and not stack[-1].dropped:
                parts.append(inside)
            continue
        if tag == "br":
            parts.append(" ")
        if tag == "a":
            links += 1
        if tag in ("html", "body"):
            continue
        if tag not in BLOCKS:
            if tag == "input" or stack[-1].dropped:
                continue
            if tag not in VOID and attrs.strip() and drops(tag, attrs):  # skipped up to its end
                at = past(page, at, tag)
            continue
        if tag == "hr":
            flush()
            continue
        flush()
        for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag not in HEADINGS and stack[i].tag != "label":
                break
        if tag in CLOSES:
            same, stop = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stop:
                    break
                if stack[i].tag in same:
                    del stack[i:]
                    break
        if attrs.endswith("/") and tag in ("svg", "math", "object", "video", "audio", "canvas"):
            continue
        parent = stack[-1]
        gone = parent.dropped or drops(tag, attrs)
        stack.append(Node(tag, parent, gone, 1.0 if gone else mark(tag, attrs, parent)))
    flush()
    weigh(out)
    return out


def past(page: str, at: int, tag: str) -> int:
    """Where an inline element that opened before ``at`` ends; at the next end tag of a block, if it is never closed."""
    depth = 1
    for m in re.compile(rf"<(/?)({tag}|p|div|li|td|article|section|body)\b[^>]*>", re.I).finditer(page, at):
        if m[2].lower() != tag:
            return m.start()
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return len(page)


def scores(blocks: list[Block]) -> tuple[list[float], list[float]]:
    """How much each block is content, and the share of links in the texts of its path.

    Path ratios, smoothed along the page and fused with the paths' likeness and with the marks.  Blocks of one path with other marks have
    sums of their own.
    """
    sums: dict[tuple[str, float], list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for b in blocks:
        s = sums[b.node.path, b.weight]
        s[0] += len(b.text) - b.linked
        s[1] += len(PUNCTUATION.findall(b.text)) * (1 - b.linked / len(b.text))
        s[2] += 1
        s[3] += len(b.text)
    # Length by number of marks grows with the square of a text's length, hence the root.
    ratio = {key: math.sqrt(chars / n * (1 + punct / n)) for key, (chars, punct, n, _) in sums.items()}
    keys = [(b.node.path, b.weight) for b in blocks]
    half = len(SMOOTH) // 2
    smooth = []
    for i in range(len(keys)):
        near = [(ratio[keys[j]], SMOOTH[j - i + half]) for j in range(max(0, i - half), min(len(keys), i + half + 1))]
        smooth.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    best = max(ratio, key=lambda key: ratio[key] * sums[key][0] * key[1])[0].split("/")
    likeness = {}
    for path, _ in sums:
        own = path.split("/")
        same = next((i for i, (a, b) in enumerate(zip(own, best)) if a != b), min(len(own), len(best)))
        likeness[path] = same / max(len(own), len(best))
    # The words of a block outside links, too: a link alone is no sentence of its path.
    score = [s * likeness[b.node.path] * b.weight * (1 - b.linked / len(b.text)) for s, b in zip(smooth, blocks)]
    return score, [1 - sums[key][0] / sums[key][3] for key in keys]


def rank(b: Block) -> int:
    """1 to 6 for headings, 0 for others."""
    return int(b.node.tag[1]) if b.node.tag in HEADINGS else 0


def article(page: str | None) -> str:
    """The main text of a page."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    score, links = scores(blocks)
    limit = THRESHOLD * max(score)
    content = [s >= limit > 0 and not rank(b) for s, b in zip(score, blocks)]
    if not any(content):  # nothing but headings, or nothing but links
        content = [s >= limit > 0 for s in score]
    total = sum(content)
    if not total:
        return ""
    at_children: dict[Node, set[Node]] = defaultdict(set)
    root = None
    for b, chosen in zip(blocks, content):
        node: Node | None = b.node
        while node:
            node.content += chosen
            if node.parent:
                at_children[node.parent].add(node)
            else:
                root = node
            node = node.parent
    here = root
    while True:
        below = [n for n in at_children[here] if n.tag in CONTAINERS and n.content == total]
        if not below or here.has_heading or here.tag in ("article", "main"):
            break
        here = below[0]

    def within(node: Node | None) -> bool:
        while node and node.depth > here.depth:
            node = node.parent
        return node is here

    kept = []
    # From the end: the nearest text below that stays, the nearest that goes, and by rank the nearest heading.
    stays_from, dropped_from, headings = -1, len(blocks), [len(blocks)] * 7
    for i in range(len(blocks) - 1, -1, -1):
        b, level = blocks[i], rank(blocks[i])
        free = b.weight == 1 or b.weight > PLAIN_MARK and b.node.in_article
        if level:
            end = min(headings[1:level + 1])
            followed = 0 <= stays_from < end
            bare = b.node.in_article and dropped_from >= end  # a heading without any text below it
            stays = free and (followed or bare)
            headings[level] = i
        else:
            listed = links[i] >= 0.5 and (not b.node.in_article or b.node.tag in ("li", "dd", "dt"))
            alone = 2 * b.linked >= len(b.text) and not b.node.in_article
            stays = content[i] or free and not listed and not alone
            stays = stays and within(b.node)
            if stays:
                stays_from = i
            else:
                dropped_from = i
        if (stays or content[i]) and within(b.node):
            kept.append(b.text)
    return "\n\n".join(reversed(kept))


MADE = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    def make(_, texts):
        out = [article(t.decode() if t is not None else None) for t in texts]
        return {"text": pa.array(out, pa.string()), "n_chars": longs([len(t) for t in out])}

    made = with_made(pages, ["page_id", "url"], "html", MADE, make)
    return made.select("row.page_id", "row.url", F.col("made.text").alias("text"), "made.n_chars")
