"""HTML extraction (operator 7): two passes of rules over the blocks of a page.

A page is cut into blocks at block-level tags. First pass, each block by itself: text in a menu, header, footer, sidebar,
notice, advert, form, comment section, script or style (by tag, role or class words) is out; so is text with many links, and,
where the page marks its article, everything outside that. Text within the marked article is in. What is left is judged by
length, stop-word and link density: in, out, or undecided. Second pass: undecided short
blocks take the label of the nearest decided blocks before and after, in if both are in; if they
differ, the nearly good ones are in; headings go with what follows.

Class, id and role words are weak evidence. What only says how a container is laid out (has-sidebar, no-ads, social-enabled) and
the id of a section or heading say nothing. A container around the marked article, or around more than half of the page's text, is
never out by its words (but for a single short block); a comment section around so much is, if there is good text outside it. The marked article is the article
or main with the most text of its own, one outside comment sections first. Within an article, words that sections of articles also have (legal, related,
notice ...) count only for containers with many links. A link is an anchor with a target; one that is not closed ends at the next block tag.

Defined cases: missing and empty pages have empty text; text outside any tag is a block; an unclosed script, style or
comment reaches to the end of the page; repeated rows give equal texts. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on
    one or our out she so than that the their there they this to up was we were what when which who will with you your
    au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui mais ne nous par pas pour qu que qui sa se ses son
    sur un une vous
    als am auch auf aus bei bin bis das dass dem den der die durch ein eine einen einer es für hat ich im ist mit nach nicht noch nur
    oder sich sie sind und unter vom von vor war wie wir zu zum zur
    al como con del desde donde el ella entre era esta este ha hay la las lo los más muy o para pero por se sin sobre son su sus también
    y ya""".split()
)
# Tags whose text is never the article's, and words of classes, ids and roles that say the same.
_OUT_TAGS = frozenset("nav footer aside form button select option label fieldset dialog menu iframe svg object canvas audio video noscript template head".split())
_RAW_TAGS = frozenset("script style textarea title noscript iframe template xmp".split())
_OUT_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners
    cookie cookies consent gdpr notice notices alert popup popups modal overlay newsletter subscribe subscription signup login share
    sharing social sidebar sidebars complementary menu menus nav navbar navigation breadcrumb breadcrumbs footer footers contentinfo masthead
    comment comments commentlist disqus reply replies discussion related recommended recommendations widget widgets pagination pager
    copyright legal disclaimer search toolbar""".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies discussion".split())
# Words that real sections of articles have too, and first and last words of names that only tell the layout.
_SECTION_WORDS = frozenset(
    "alert consent discussion disclaimer copyright legal notice notices promo promotion recommended recommendations related search share sharing social sponsor sponsors subscription toolbar".split()
)
_LAYOUT_FIRST = frozenset("has have with without no not non hide show".split())
_LAYOUT_LAST = frozenset("enabled disabled open opened closed on off active inactive visible hidden true false".split())
_NAMED_TAGS = frozenset("section h1 h2 h3 h4 h5 h6".split())
_HEADER_WORDS = frozenset(["header", "headers", "topbar"])
_ARTICLE_TAGS = frozenset(["article", "main"])
_BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5
    h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul""".split()
)
_VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SPACE_TAGS = frozenset(["br", "img", "input", "wbr"])
_CLOSED_BY = {"p": _BLOCK_TAGS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_TARGET = re.compile(r"(?:^|\s)href\s*=", re.I)
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)

SHORT, LONG = 70, 200  # characters
LOW_STOP, HIGH_STOP = 0.30, 0.32  # shares of the words
MOST_LINKS = 0.33


@dataclass
class Block:
    text: str
    links: int  # characters within links
    out: bool
    article: bool
    heading: bool
    place: int = -1  # innermost container that is out by its words, if any
    story: int = -1  # innermost article


@dataclass
class Container:
    """An element that may be out by the words of its class, id or role."""

    parent: int
    comments: bool
    by_links: bool  # within an article, by words that its sections have too
    chars: int = 0
    links: int = 0
    blocks: int = 0
    out: bool = True


def _class_words(tag: str, attributes: str) -> set[str]:
    words: set[str] = set()
    for name, *values in _NAMES.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden":
            words.add("hidden")
        elif name != "id" or tag not in _NAMED_TAGS:
            for token in value.split():
                parts = [w.lower() for w in _WORD.findall(token)]
                if len(parts) < 2 or not (parts[0] in _LAYOUT_FIRST or parts[-1] in _LAYOUT_LAST):
                    words.update(parts)
                    words.add(token.lower())
    return words


def _good(b: Block) -> bool:
    """Whether a block is in by itself."""
    return len(b.text) > LONG and b.links <= MOST_LINKS * len(b.text) and _stops(b.text) >= HIGH_STOP


def _judge(found: list[Block], containers: list[Container], stories: list[tuple[int, bool]]) -> None:
    """Settle which containers are out by their words, and mark the blocks in them."""
    own = [0] * len(stories)
    for b in found:
        if not b.out:
            if b.story >= 0:
                own[b.story] += len(b.text)
            if b.place >= 0:
                containers[b.place].chars += len(b.text)
                containers[b.place].links += b.links
                containers[b.place].blocks += 1
    commented: list[bool] = []
    for c in containers:
        commented.append(c.comments or (c.parent >= 0 and commented[c.parent]))
    for c in reversed(containers):
        if c.parent >= 0:
            containers[c.parent].chars += c.chars
            containers[c.parent].links += c.links
            containers[c.parent].blocks += c.blocks
    good_outside = any(_good(b) for b in found if not b.out and (b.place < 0 or not commented[b.place]))
    total = sum(len(b.text) for b in found if not b.out)
    for c, within in zip(containers, commented):
        leaf = c.blocks < 2 and c.chars <= LONG
        if (2 * c.chars > total and not leaf and not (within and good_outside)) or (c.by_links and c.links <= MOST_LINKS * c.chars):
            c.out = False
    ranked = [(not (place >= 0 and commented[place]), own[k], -k) for k, (place, out) in enumerate(stories) if not out]
    if ranked:
        outside, _, k = max(ranked)
        place = stories[-k][0] if outside or not good_outside else -1
        while place >= 0:
            containers[place].out = False
            place = containers[place].parent
    for c in containers:
        c.out = c.out or (c.parent >= 0 and containers[c.parent].out)
    for b in found:
        b.out = b.out or (b.place >= 0 and containers[b.place].out)


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order, with references decoded and white space made single."""
    found: list[Block] = []
    parts: list[str] = []
    links = 0
    stack: list[tuple[str, bool, bool, int, int]] = []  # tag, out, article, container, innermost article
    containers: list[Container] = []
    stories: list[tuple[int, bool]] = []  # container and out of each article
    open_tags: dict[str, int] = {}
    in_link, link_closed = 0, False
    heading = False

    def end_block() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, min(links, len(text)), *(stack[-1][1:3] if stack else (False, False)), heading, *(stack[-1][3:] if stack else ())))
        parts, links = [], 0

    def add(text: str) -> None:
        nonlocal links
        if text:
            text = entities.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                links += len(" ".join(text.split()))

    def close(tag: str) -> None:
        while stack:
            name = stack.pop()[0]
            open_tags[name] -= 1
            if name == tag:
                return

    at = 0
    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        if at == len(page) and not m[0].endswith(">"):  # an open quote ran on: read the tag without its quotes
            loose = _LOOSE.match(page, m.start())
            if loose is not None:
                m = loose
                at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in _BLOCK_TAGS:
            end_block()
            in_link = in_link and link_closed
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not closing
        elif tag in _SPACE_TAGS:
            parts.append(" ")
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if open_tags.get(tag):
                if stack[-1][0] == tag and (stack[-1][1] or stack[-1][3] != (stack[-2][3] if len(stack) > 1 else -1)):
                    end_block()
                close(tag)
            continue
        if tag == "a":
            in_link = int(bool(_TARGET.search(attributes)))
            following = _ANCHOR.search(page, at) if in_link else None
            link_closed = following is not None and bool(following[1])
        if tag in _RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _VOID_TAGS:
            continue
        while stack and tag in _CLOSED_BY.get(stack[-1][0], ()):
            close(stack[-1][0])
        out, article, place, story = stack[-1][1:] if stack else (False, False, -1, -1)
        around = place
        if tag in _ARTICLE_TAGS:
            article = True
            stories.append((place, out))
            story = len(stories) - 1
        elif tag in _OUT_TAGS or (tag == "header" and not article):
            out = True
        elif tag not in ("html", "body") and attributes.strip():
            words = _class_words(tag, attributes)
            out = out or "hidden" in words
            said = words & _OUT_WORDS or (not article and words & _HEADER_WORDS)
            if said and not out:
                by_links = article and said <= _SECTION_WORDS
                containers.append(Container(place, bool(said & _COMMENT_WORDS) and not by_links, by_links))
                place = len(containers) - 1
        if tag in _BLOCK_TAGS or out or place >= 0:
            if (out and not (stack and stack[-1][1])) or place != around:
                end_block()
            stack.append((tag, out, article, place, story))
            open_tags[tag] = open_tags.get(tag, 0) + 1
    end_block()
    _judge(found, containers, stories)
    return found


def _stops(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


IN, OUT, NEAR, UNDECIDED = "in", "out", "near", "short"


def first_pass(found: list[Block]) -> list[str]:
    marked = any(b.article and not b.out for b in found)
    labels = []
    for b in found:
        share = b.links / len(b.text)
        if b.out or (marked and not b.article):
            labels.append(OUT)
        elif marked:
            labels.append(OUT if share > 0.8 and len(b.text) < LONG and not b.heading else IN)
        elif share > MOST_LINKS or "\xa9" in b.text[:40]:
            labels.append(OUT)
        elif len(b.text) < SHORT:
            labels.append(OUT if share > 0 else UNDECIDED)
        else:
            stops = _stops(b.text)
            if stops >= HIGH_STOP:
                labels.append(IN if len(b.text) > LONG else NEAR)
            else:
                labels.append(NEAR if stops >= LOW_STOP else OUT if stops < 0.05 else UNDECIDED)
    return labels


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    n = len(labels)
    before, after = [OUT] * n, [OUT] * n
    last = None
    for k in range(n):
        before[k] = last
        last = labels[k] if labels[k] in (IN, OUT) else last
    last = None
    for k in range(n - 1, -1, -1):
        after[k] = last
        last = labels[k] if labels[k] in (IN, OUT) else last
    keep = []
    for k, label in enumerate(labels):
        if label in (IN, OUT):
            keep.append(label == IN)
        elif before[k] is None and after[k] is None:  # nothing decided on the page
            keep.append(label == NEAR or len(found[k].text) >= SHORT or n == 1)
        elif found[k].heading:
            keep.append(after[k] == IN)
        elif before[k] == after[k]:
            keep.append(before[k] == IN)
        else:
            keep.append(label == NEAR and IN in (before[k], after[k]))
    return keep


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, second_pass(found, first_pass(found))) if keep)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per page (page_id, url, text, n_chars)."""
    rows = pages.select(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").alias("url"), F.col(f"`{html_column}`").cast("string").alias("html"))
    schema = type(rows.schema)(rows.schema.fields[:2]).add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return rows.mapInArrow(run, schema)
