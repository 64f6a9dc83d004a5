"""Problem 2: tell a page's main body from the site's furniture.

Method: a linear-chain conditional random field over the DOM's leaf blocks, on
ancestor-tag and text features, trained on labelled pages, decoded by Viterbi.

Labels come from the pages themselves: a labeller marks blocks it is sure of
(landmarks such as nav and footer, text that recurs on several pages of the site, counted
over all its pages, the page's title, prose beside it) and leaves the rest open; training sums over open
blocks.  So pages that say what they are teach the words and positions by which
pages with meaningless classes are decoded.  Training sees at most ``TRAIN_PAGES`` pages
(a fixed bound, least key hashes first); decoding covers every page in full, where it
is read, without a shuffle.

Results: bytes are read as UTF-8, invalid ones replaced; null or empty bytes and
answers that aren't HTML have no blocks; unclosed elements end where HTML ends
them, unclosed comments and scripts at the end of the page.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from lectern.llm.crf import Chain, bucket

TRAIN_PAGES = 900
FURNITURE, MAIN = 0, 1

_DROP = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b([^<>]*)>")
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z]\w*);")
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote".split())
_VOID = frozenset("br hr img input meta link wbr area base col embed source track".split())
_INLINE = frozenset("a abbr b bdi bdo button cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
_LANDMARK = {"nav": 1, "header": 2, "footer": 4, "aside": 8, "dialog": 16, "main": 32, "article": 64, "form": 128}
_ROLE = {"navigation": 1, "banner": 2, "contentinfo": 4, "complementary": 8, "dialog": 16, "alertdialog": 16, "main": 32, "article": 64, "search": 128, "menu": 1}
#: Words that name furniture, and content, in class and id values.
_FURNITURE_WORD = re.compile(r"(?:^|[-_ ])(?:nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|footer|cookies?|consent|share|sharing|social|related|teasers?|promo|pagination|pager|newsletter|subscribe|sign-?up|comments?|after-post|masthead|widget|advert|ads?)(?:$|[-_ ])")
_CONTENT_WORD = re.compile(r"(?:^|[-_ ])(?:content|article|post|entry|main|body|document|story|markdown)(?:$|[-_ ])")


class Block:
    """A leaf block; number is None for text outside the numbered elements."""

    __slots__ = ("container", "flags", "linked", "number", "parent", "rules", "tag", "text")

    def __init__(self, number: int | None, tag: str, container: tuple[int, ...], flags: int, parent: str, rules: int) -> None:
        self.rules = rules  # horizontal rules before it
        self.number, self.tag, self.container, self.flags, self.parent = number, tag, container, flags, parent
        self.text, self.linked = "", 0


@lru_cache(100_000)
def _mark(tag: str, attributes: str) -> int:
    """Landmark bits of one element; 256 and 512 for classes that name furniture or content."""
    bits = _LANDMARK.get(tag, 0)
    if attributes and tag not in {"html", "body"}:
        low = attributes.lower()
        for value in re.findall(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", low):
            joined = " ".join(value)
            if _FURNITURE_WORD.search(joined):
                bits |= 256
            elif _CONTENT_WORD.search(joined):
                bits |= 512
        role = re.search(r"\brole\s*=\s*[\"']?([a-z]+)", low)
        if role:
            bits |= _ROLE.get(role.group(1), 0)
    return bits


def read(data: bytes | None) -> str:
    text = (data or b"").decode("utf-8", "replace")
    return text[1:] if text[:1] == "﻿" else text


def is_html(content_type: str | None, text: str) -> bool:
    """By the declared type; where there is none, by the look of the answer."""
    if content_type:
        low = content_type.lower()
        return "html" in low
    return bool(re.match(r"\s*(?:<!doctype\s+html|<html|<head|<body|<!--|<[a-z][a-z0-9]*[\s>])", text, re.I))


def parse(page: str) -> tuple[str, list[Block]]:
    """The title and the leaf blocks of a page in source order."""
    page = _DROP.sub(" ", page)
    blocks: list[Block] = []
    # open containers: (tag, flags, serial number)
    stack: list[tuple[str, int, int]] = [("html", 0, 0)]
    path: tuple[int, ...] = (0,)
    serial, number, links, rules, title = 0, 0, 0, 0, ""
    block: Block | None = None
    at, in_title = 0, False

    def add(raw: str) -> None:
        nonlocal block, title
        if in_title:
            title += raw
            return
        if not raw or (block is None and raw.isspace()):
            return
        if block is None:
            block = Block(None, "text", path, stack[-1][1], stack[-1][0], rules)
            blocks.append(block)
        block.text += raw
        if links:
            block.linked += len(raw.strip())

    for m in _TAG.finditer(page):
        start, end = m.span()
        if start > at:
            add(page[at:start])
        at = end
        closing, tag, attributes = m.groups()
        tag = tag.lower()
        if tag in BLOCKS:
            if closing:
                if block is not None and block.tag == tag:
                    block = None
            else:
                number += 1
                links = 0
                block = Block(number, tag, path, stack[-1][1], stack[-1][0], rules)
                blocks.append(block)
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "title":
            in_title = not closing
        elif tag in _VOID:
            if tag == "br" and block is not None:
                block.text += "\n"
            elif tag == "hr":
                block, rules = None, rules + 1
        elif tag not in _INLINE:
            block, links = None, 0
            if not closing:
                serial += 1
                stack.append((tag, stack[-1][1] | _mark(tag, attributes), serial))
                path = (*path, serial)
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        path = path[:k]
                        break
    add(page[at:])
    kept = [b for b in blocks if b.number is not None or b.text.strip()]
    for b in kept:
        b.text = clean(b.text)
    return clean(title), kept


def clean(raw: str) -> str:
    if "&" in raw:
        import html

        raw = _ENTITY.sub(lambda m: html.unescape(m.group()), raw)
    return " ".join(raw.replace("¶", " ").split())


_WORD = re.compile(r"[^\W\d_]+|\d+|[©|»›@:?]")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]+")


def text_names(tag: str, text: str) -> set[str]:
    """Features of a block's own text: its words (pairs of characters in scripts without spaces), ends and shape."""
    names = {f"t={tag}"}
    low = text.lower()
    words = _WORD.findall(low)
    for w in words:
        if _WIDE.match(w):
            names.update(f"w={w[i : i + 2]}" for i in range(max(1, len(w) - 1)))
        else:
            names.add("w=0" if w.isdigit() else f"w={w}")
    names.update(f"b={a} {b}" for a, b in zip(words[:6], words[1:6], strict=False))
    names.add(f"f={tag}/{text[:1].isupper()}/{text[-1:] in '.!?。！？:'}")
    names.add(f"n={tag}/{min(len(words), 60).bit_length()}")
    return names


def shape_names(key: tuple) -> list[str]:
    tag, parent, flags, side, near, link, size, before, fromend, title = key
    return [
        "bias", f"p={parent}/{tag}", f"m={flags}", f"s={side}/{near}", f"s={side}/{near}/{tag}", f"s={side}/{near}/{tag}/{link}", f"l={tag}/{link}/{size}",
        f"q={before}/{tag}", f"e={fromend}/{side}/{near}", f"m={flags & 319}/{side}/{near}", f"h={title}/{tag}", f"p={parent}/{side}/{near}/{link}",
    ]


def shapes(title: str, blocks: list[Block]) -> list[tuple]:
    """What is said of each block by its place: tag, ancestors, where it stands to the page's heading, links, length."""
    head = next((i for i, b in enumerate(blocks) if b.tag == "h1"), -1)
    sides = "<=>"
    if head < 0:  # without a heading, the first text that isn't a link stands for it
        head, sides = next((i for i, b in enumerate(blocks) if not b.linked and b.tag != "li" and not b.flags & 287), -1), "{~}"
    home = blocks[head].container if head >= 0 else ()
    cut = blocks[head].rules if head >= 0 else 0
    out, before = [], "^"
    count = len(blocks)
    low_title = title.lower()
    for i, b in enumerate(blocks):
        side = "-" if head < 0 else sides[(i > head) - (i < head) + 1]
        c, n = b.container, len(home)
        near = "out" if c[:n] != home else f"rule{min(b.rules - cut, 1)}" if b.rules != cut else "same" if c == home else "in"
        text = b.text
        # in a list or quote of the heading's container a block is as near as its own container
        if near == "in" and len(c) == n + 1 and b.tag in {"li", "p", "text"} and b.parent in {"ul", "ol", "div"}:
            near = "list" if b.parent != "div" else "in"
        link = 0 if not b.linked else 3 if b.linked >= len(text) * 0.9 else 2 if b.linked * 2 >= len(text) else 1
        named = bool(text) and len(text) > 3 and text.lower() in low_title
        out.append((b.tag, b.parent, b.flags, side, near, link, min(len(text), 500).bit_length(), before, min(count - i, 15).bit_length(), named))
        before = b.tag + ("h" if b.tag[0] == "h" and link == 0 else "")
    return out


class Reader:
    """Decodes pages with a trained chain; scores of texts and places seen before are kept."""

    def __init__(self, chain: Chain) -> None:
        self.chain = chain
        # of two labels only the difference counts
        self.weight = (chain.weights[:, MAIN] - chain.weights[:, FURNITURE]).tolist()
        self.names: dict[str, float] = {}
        self.words: dict[str | tuple, float] = {}
        self.texts: dict[tuple[str, str], float] = {}
        self.places: dict[tuple, float] = {}

    def _score(self, names) -> float:
        known, total = self.names, 0.0
        for n in names:
            w = known.get(n)
            if w is None:
                w = known[n] = self.weight[bucket(n)]
            total += w
        return total

    def text_score(self, tag: str, text: str) -> float:
        """The score of ``text_names``, from the weights of words and pairs that are kept under the words themselves."""
        low = text.lower()
        if not low.isascii() and _WIDE.search(low):
            return self._score(text_names(tag, text))
        words, known, total, number = _WORD.findall(low), self.words, 0.0, False
        for w in set(words):
            if w[0].isdigit():
                number = True
                continue
            x = known.get(w)
            if x is None:
                x = known[w] = self.weight[bucket(f"w={w}")]
            total += x
        for pair in set(zip(words[:6], words[1:6], strict=False)):
            x = known.get(pair)
            if x is None:
                x = known[pair] = self.weight[bucket(f"b={pair[0]} {pair[1]}")]
            total += x
        shape = (tag, text[:1].isupper(), text[-1:] in ".!?。！？:", min(len(words), 60).bit_length(), number)
        x = known.get(shape)
        if x is None:
            names = [f"t={tag}", f"f={tag}/{shape[1]}/{shape[2]}", f"n={tag}/{shape[3]}"] + ["w=0"] * number
            x = known[shape] = sum(self.weight[bucket(n)] for n in names)
        return total + x

    def labels(self, title: str, blocks: list[Block]) -> list[int]:
        if len(self.words) > 500_000:
            self.words.clear()
        if len(self.texts) > 100_000:
            self.texts.clear()
        if len(self.names) > 500_000:
            self.names.clear()
        if len(self.places) > 200_000:
            self.places.clear()
        scores = []
        for b, key in zip(blocks, shapes(title, blocks), strict=True):
            text = self.texts.get((b.tag, b.text))
            if text is None:
                text = self.texts[b.tag, b.text] = self.text_score(b.tag, b.text)
            place = self.places.get(key)
            if place is None:
                place = self.places[key] = self._score(shape_names(key))
            scores.append((0.0, text + place))
        return self.chain.decode(scores)


_DIGIT = re.compile(r"\d+")


def recurring(block: Block) -> str | None:
    """What a block repeats where it recurs: its text with numbers as 0; None where that says nothing."""
    return _DIGIT.sub("0", block.text.lower()) if len(block.text) > 2 and block.tag != "pre" else None


def sure_labels(pages: list[tuple[str, list[Block]]], counts: list[dict[str, int]] | None = None, repeated: int = 4) -> list[list[int]]:
    """The labeller: FURNITURE, MAIN, or -1 where it isn't sure.

    ``counts`` says for each page on how many pages of its site a text stands; without it, the pages given are taken for one site.
    """
    if counts is None:
        whole: Counter[str] = Counter()
        for _, blocks in pages:
            whole.update({t for b in blocks if (t := recurring(b)) is not None})
        counts = [whole] * len(pages)
    out = []
    for (title, blocks), seen in zip(pages, counts, strict=True):
        places = shapes(title, blocks)
        labels = []
        # a page without any prose of its own may be an error page, whose text recurs as furniture does
        prose = any(b.tag in {"p", "pre"} and len(b.text) > 60 and not b.linked and seen.get(_DIGIT.sub("0", b.text.lower()), 0) < repeated for b in blocks)
        landmarks = any(b.flags & (1 | 4 | 8) for b in blocks)
        for b, key in zip(blocks, places, strict=True):
            side, near, link = key[3], key[4], key[5]
            same = seen.get(_DIGIT.sub("0", b.text.lower()), 0)
            inside = b.flags & (32 | 64 | 512) and near in {"same", "list", "in"}
            if b.tag == "h1" or (side == "~" and inside and not b.flags & 287):
                y = MAIN
            elif b.flags & (1 | 4 | 8 | 16 | 256):
                y = FURNITURE
            elif len(blocks) <= 4 and not any(x.linked for x in blocks):
                # an answer of a few words has no room for furniture
                y = MAIN
            elif same >= repeated and b.tag != "blockquote" and len(b.text) < 400 and b.tag != "text" and (prose or near != "same"):
                y = FURNITURE
            elif not prose and side == ">" and near == "same" and len(b.container) > 1 and b.tag == "p" and not b.linked:
                y = MAIN
            elif side == "<":
                # what stands before the page's heading leads to it
                y = FURNITURE
            elif landmarks and inside and side == ">" and near != "in" and (same < repeated or b.tag == "pre"):
                y = MAIN
            elif side == ">" and near == "same" and len(b.container) > 1 and b.tag in {"p", "pre", "h2", "h3"} and link == 0 and (len(b.text) > 160 or b.tag != "p"):
                y = MAIN
            elif b.tag == "li" and link == 3 and near == "out" and side == ">":
                y = FURNITURE
            else:
                y = -1
            labels.append(y)
        out.append(labels)
    return out


def train(pages: list[tuple[str, list[Block]]], counts: list[dict[str, int]] | None = None) -> Chain:
    labels = sure_labels(pages, counts)
    data = []
    for (title, blocks), ys in zip(pages, labels, strict=True):
        keys = shapes(title, blocks)
        data.append([([bucket(n) for n in (*text_names(b.tag, b.text), *shape_names(k))], y) for b, k, y in zip(blocks, keys, ys, strict=True)])
    return Chain(["furniture", "main"]).train(data)


def main_text(blocks: list[Block], labels: list[int]) -> list[str]:
    """Texts of the main blocks in order."""
    return [b.text for b, y in zip(blocks, labels, strict=True) if y == MAIN and b.text]


def furniture(blocks: list[Block], labels: list[int]) -> list[int]:
    return [b.number for b, y in zip(blocks, labels, strict=True) if y == FURNITURE and b.number is not None]

