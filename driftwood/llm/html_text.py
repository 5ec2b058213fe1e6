"""Main text of web pages by composite text density.

A page is read into a tree of elements. Every element has its characters, tags, link characters and link tags; its
density is characters per tag, adjusted by the share of links in it and in the page. The densities of an element's children
are summed, and the element with the greatest sum holds the main text. The smallest density on the way from it up to
the body is the threshold that an element beside that way must reach to belong to the main text too, where the page has no
article element around it. Elements that are never main text (scripts, menus, forms, adverts, comments) are left out before. Where only a
part of a name says so (share-price, newsletter-archive), the element's density decides: below the threshold or mostly links, it goes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROP = _RAW | {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "object", "audio", "video", "canvas", "label", "input"}
_BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What a start tag ends, up to the element that bounds it.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: By tag, the lists of _ENDS that it is in: what the list's tags end, and what bounds them.
_KINDS: dict[str, list[str]] = {}
for _tag, (_ended, _bound) in _ENDS.items():
    for _x in _ended | _bound:
        _KINDS.setdefault(_x, []).append(f"#{_tag}")
_NOISE = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side-bar widget comment comments disqus respond reply replies cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended menu navbar nav navigation breadcrumb breadcrumbs pagination pager footer header masthead toolbar contentinfo complementary".split())
_WHOLE = {"html", "body", "article", "main"}


#: Names that say what an element has or lacks, not what it is.
_ABOUT = re.compile(r"(?:has|no|with|without)[-_]|.*[-_]free$")
_TALK = {"comment", "comments", "disqus", "respond", "reply", "replies"}


#: Parts of names that say nothing of what an element holds.
_NEUTRAL = set("area articles bar block body bottom box btn button buttons col column container content entry form group header icon icons inner item items left link links list message module outer page panel post posts primary right row secondary section site slot strip text title top unit view wrap wrapper".split())


def _noisy(attributes: str) -> int:
    """2 if a name is noise as a whole (all its parts are noise or say nothing) or of readers' comments, 1 if only a part of a
    name is, else 0."""
    most = 0
    for names in _NAMES.findall(attributes):
        for name in names.strip("\"'").lower().split():
            parts = {x for x in re.split(r"[-_]+|(?<=[a-z])[0-9]+$", name) if x and not x.isdigit()}
            if name in _NOISE or parts & _TALK:
                return 2
            if parts & _NOISE and not _ABOUT.match(name):
                if parts <= _NOISE | _NEUTRAL:
                    return 2
                most = 1
    return most


def _left_out(tags: list[str], parent: list[int], hard: list[bool], noise: list[int]) -> list[bool]:
    """What tags or whole names leave out. Where no article is outside of what names leave out, an element that holds one stays."""
    n = len(tags)
    named, inside, holds = [False] * n, [False] * n, [False] * n
    whole = [tags[i] in ("article", "main") and not hard[i] and noise[i] < 2 for i in range(n)]
    for i in range(1, n):
        named[i] = noise[i] == 2 and tags[i] not in _WHOLE
        inside[i] = inside[parent[i]] or named[i]
    if any(named) and not any(whole[i] and not inside[i] for i in range(n)):
        for i in range(n - 1, 0, -1):
            holds[parent[i]] = holds[parent[i]] or holds[i] or whole[i]
        named = [named[i] and not holds[i] for i in range(n)]
    out = list(hard)
    for i in range(1, n):
        out[i] = out[i] or out[parent[i]] or named[i]
    return out


def _tree(html: str) -> tuple[list[str], list[int], list[int], list[bool], list[int], list[tuple[int, str | None]]]:
    """Of all elements in order: tag, parent, last descendant, whether left out, noise of names; and the runs of text, None
    between blocks. Each open element is in the lists of its kinds, so that a tag costs the same however deep it is."""
    tags, parent, last, out, noise = ["#root"], [0], [0], [False], [0]
    stack, runs, at = [0], [], 0
    open_: dict[str, list[int]] = defaultdict(list)  # by tag, and "#block", "#whole" and "#" with a kind of _ENDS: places in the stack
    open_["#root"].append(0)
    unended = set()

    def kinds(tag: str) -> list[str]:
        return [tag] + ["#block"] * (tag in _BLOCK) + ["#whole"] * (tag in _WHOLE) + _KINDS.get(tag, [])

    def close(to: int) -> None:
        while len(stack) > to:
            i = stack.pop()
            last[i] = len(tags) - 1
            for kind in kinds(tags[i]):
                open_[kind].pop()
            if tags[i] in _BLOCK:
                runs.append((i, None))

    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text and not out[stack[-1]]:
            runs.append((stack[-1], text))
        if not m:
            break
        at = m.end()
        end, tag, attributes = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if there := open_.get(tag):  # a stray end tag does not end the article
                if tag in _WHOLE or not open_["#whole"] or open_["#whole"][-1] < there[-1]:
                    close(there[-1])
            continue
        if tag in _BLOCK and open_["#block"] and tags[stack[open_["#block"][-1]]] == "p":
            close(open_["#block"][-1])
        if tag in _ENDS:
            there = open_[f"#{tag}"]
            while there and tags[stack[there[-1]]] in _ENDS[tag][0]:
                close(there[-1])
        if tag in _VOID:
            runs.append((stack[-1], None if tag == "hr" else " "))
            continue
        if tag in _RAW:
            done = None if tag in unended else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if not done:
                unended.add(tag)
            at = done.end() if done else len(html) if tag in ("script", "style", "textarea") else at
            continue
        i, up = len(tags), stack[-1]
        inside = tag == "header" and (open_["article"] or open_["main"])
        tags.append(tag)
        parent.append(up)
        last.append(i)
        out.append(out[up] or (tag in _DROP and not inside))
        noise.append(_noisy(attributes) if attributes else 0)
        if tag in _BLOCK:
            runs.append((up, None))
        for kind in kinds(tag):
            open_[kind].append(len(stack))
        stack.append(i)
    close(0)
    return tags, parent, last, _left_out(tags, parent, out, noise), noise, runs


def densities(tags: list[str], parent: list[int], out: list[bool], runs: list[tuple[int, str | None]]) -> tuple[list[float], list[float], list[bool]]:
    """Of all elements: the composite text density, the sum of the children's densities (an element without children: its
    own), and whether it is mostly links."""
    n = len(tags)
    chars, link_chars, n_tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked, leaf = [False] * n, [True] * n
    for i in range(1, n):
        linked[i] = linked[parent[i]] or tags[i] == "a"
        leaf[parent[i]] = False
    for i, t in runs:
        if t and not out[i]:
            size = len(t) if t[:1] not in " \n\t\r" and t[-1:] not in " \n\t\r" else len(t.strip())
            chars[i] += size
            link_chars[i] += size * linked[i]
    body = next((i for i in range(n) if tags[i] == "body"), 0)
    for i in range(n - 1, 0, -1):
        if not out[i]:
            up = parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            n_tags[up] += n_tags[i] + 1
            link_tags[up] += link_tags[i] + (tags[i] == "a")
    share = link_chars[body] / max(chars[body], 1)
    density, summed = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c = chars[i]
        if c and not out[i]:
            lc, t, lt = link_chars[i], max(n_tags[i], 1), max(link_tags[i], 1)
            base = log(c / max(c - lc, 1) * lc + share * c + e)
            density[i] = c / t * max(log(max(c / max(lc, 1) * t / lt, 1)), 0.0) / base
            summed[i] += density[i] if leaf[i] else 0
            summed[parent[i]] += density[i] if i else 0
    return density, summed, [2 * lc >= c > 0 for c, lc in zip(chars, link_chars)]


def main_text(html: str | None) -> str:
    """The blocks of the main text of a page, two line ends between; empty if there is none."""
    tags, parent, last, out, noise, runs = _tree(html or "")
    n = len(tags)
    runs = [(i, t if t is None else unescape(t) if "&" in t else t) for i, t in runs if not out[i]]
    density, summed, links = densities(tags, parent, out, runs)
    body = next((i for i in range(n) if tags[i] == "body"), 0)
    best = max((i for i in range(n) if not out[i]), key=lambda i: (summed[i], -i), default=0)
    way = [best]
    while way[-1] not in (0, body):
        way.append(parent[way[-1]])
    threshold = min(density[k] for k in way)
    take = bytearray(n)

    def mark(i: int, value: int) -> None:
        take[i : last[i] + 1] = bytes([value]) * (last[i] + 1 - i)

    mark(best, 1)
    around = next((k for k in way if tags[k] in ("article", "main")), 0)
    for k, up in zip(way, way[1:]):  # beside the way up to the body: in the article all, outside what reaches the threshold
        i = up + 1
        while i <= last[up]:
            if i != k and not out[i] and (around and around <= up <= last[around] or not around and tags[i] != "a" and not noise[i] and density[i] >= threshold > 0):
                mark(i, 1)
            i = last[i] + 1
        if around == up:
            take[up] = 1
    for k in way:  # text of the elements on the way themselves
        take[k] = take[k] or not around or around <= k
    if around:  # other articles that are dense enough; one inside an article belongs to it or is a comment
        outer = [False] * n
        for i in range(1, n):
            outer[i] = outer[parent[i]] or tags[parent[i]] == "article"
            if tags[i] == "article" and not outer[i] and not out[i] and not i <= around <= last[i] and density[i] >= threshold > 0:
                mark(i, 1)
    for i in range(1, n):  # a name that is noise in part only: its density decides
        if noise[i] == 1 and take[i] and tags[i] not in _WHOLE and not i <= best <= last[i] and (density[i] < threshold or links[i]):
            mark(i, 0)
    blocks, now = [], []
    for i, t in [*runs, (0, None)]:
        if t is None:
            if block := " ".join("".join(now).split()):
                blocks.append(block)
            now = []
        elif take[i]:
            now.append(t)
    return "\n\n".join(blocks)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 1000):
            part = batch.slice(i, 1000)
            text = [main_text(h) for h in part["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(text, pa.string())], ["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html).

    Null and empty html give an empty text. Repeated rows are each returned, null ids and urls stay null, other
    columns are ignored. n_chars counts code points.
    """
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    out = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(_texts, f"{kinds}, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
