"""Main text of web pages as the maximum-scoring run of words and tags.

Each word of a page scores +1, each tag a cost below zero; the run with the largest sum is the content region. How much
a tag costs is learned from the pages that label their main text with an element of its own: the larger the share of
the words behind such a tag that lies outside of it, the more. Elements that can't hold main text, by their name or by
the words with which pages mark them, never give words, unless those only marked enclose a label or, without one, most of the page;
the borders of a label cost more than a page has words.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by what they hold, and words in class, id or role by which pages mark the rest.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg")
APART = ("head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "annotation", "annotation-xml")
INLINE = (
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr object "
    "math menclose mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
    "munderover semantics"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
LABELS = ("article", "main")
#: Never apart by how a page marks them; and what is apart but shown by no browser, so it breaks no run.
WHOLE, HIDDEN = ("html", "body", *LABELS), ("annotation", "annotation-xml")
NOISE = (
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentary consent "
    "cookie cookies disclaimer footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo "
    "promoted related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget"
).split()
NOISE_ROLES = "banner navigation complementary contentinfo search form dialog alert menu".split()

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({'|'.join(RAW)})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>?|[^<]+|<",
    re.S | re.I,
)
MARK = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
#: Costs: of a tag whose words are all inside, less than half of one word so that no paragraph is too short; of one whose
#: words are all outside, and of what begins apart from the text; and of a label's border.
INSIDE, OUTSIDE, BORDER = 0.1, 10.0, 1e9
#: Tag names kept from the labelled pages, the most frequent first.
TAGS = 1000


@dataclass
class Piece:
    """A tag (``words`` is None) or a stretch of text; whether it belongs to what can't be main text, whether it begins
    that, whether a label encloses it, whether it is the label's own tag, and whether it ends a block."""

    tag: str
    words: str | None = None
    apart: bool = False
    begins: bool = False
    inside: bool = False
    label: bool = False
    block: bool = True


def is_noise(attributes: str) -> bool:
    for name, value in MARK.findall(attributes):
        parts = re.split(r"[^a-z]+", value.lower())
        if any(p in _NOISE_ROLES for p in parts) if name.lower() == "role" else any(p in _NOISE for p in parts):
            return True
    return False


_NOISE, _NOISE_ROLES = frozenset(NOISE), frozenset(NOISE_ROLES)


def spared(tokens: list[re.Match]) -> set[int]:
    """Where elements begin that aren't apart though a page marks them so: they enclose a label that isn't marked itself,
    or, on a page without any, more than half of its words outside of elements that are apart by name."""
    stack: list[list] = []  # name, place, words before, whether a label is inside, apart by name
    ended, words, labelled = [], 0, False

    def end(at: int) -> None:
        ended.extend((e[1], words - e[2], e[3]) for e in stack[at:])
        del stack[at:]

    for m in tokens:
        if m[1]:
            continue
        if not m[3]:
            if (m[0][0] != "<" or m[0] == "<") and not (stack and stack[-1][4]):
                words += len(m[0].split())
            continue
        name = m[3].lower()
        if m[2]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                end(at)
            continue
        apart = bool(stack) and stack[-1][4] or name in APART
        if name in LABELS and not apart and not is_noise(m[4]):
            labelled = True
            for e in stack:
                e[3] = True
        if name not in _VOID and not m[4].rstrip().endswith("/"):
            while name in _ENDS and stack and stack[-1][0] in _ENDS[name]:
                end(len(stack) - 1)
            stack.append([name, m.start(), words, False, apart])
    end(0)
    return {at for at, n, label in ended if label or not labelled and 2 * n > words}


def pieces(page: str) -> Iterator[Piece]:
    """Tags and texts in page order. What is left open ends with the element around it or with the page."""
    stack: list[tuple[str, bool, bool]] = []  # name, apart, label: of the element and all around it
    tokens, spare = list(TOKEN.finditer(page)), None
    for m in tokens:
        if m[1]:
            yield Piece(m[1].lower(), apart=True)
            continue
        if not m[3]:
            text = m[0]
            if text[0] != "<" or text == "<":
                yield Piece("", words=html.unescape(text), apart=bool(stack) and stack[-1][1], inside=bool(stack) and stack[-1][2], block=False)
            continue
        name = m[3].lower()
        if m[2]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is None:
                yield Piece(name, apart=bool(stack) and stack[-1][1], block=name not in _INLINE)
                continue
            apart = stack[at][1]
            yield Piece(name, apart=apart, block=name not in _INLINE, label=name in LABELS and not apart)
            del stack[at:]
            continue
        above = stack[-1] if stack else ("", False, False)
        apart = above[1] or name in APART
        if not apart and name not in WHOLE and is_noise(m[4]):
            spare = spared(tokens) if spare is None else spare
            apart = m.start() not in spare
        label = above[2] or name in LABELS and not apart
        yield Piece(name, apart=apart, begins=not above[1] and name not in HIDDEN, inside=above[2], block=name not in _INLINE, label=name in LABELS and not apart)
        if name not in _VOID and not m[4].rstrip().endswith("/"):
            while name in _ENDS and stack and stack[-1][0] in _ENDS[name]:
                stack.pop()
            stack.append((name, apart, label))


_INLINE, _VOID = frozenset(INLINE), frozenset(VOID)
#: Elements that a tag of this name ends if they are open.
_ENDS = {"p": ("p",), "li": ("li", "p"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def extract(page: str, costs: dict[str, float]) -> str:
    """The text of the best run: blocks in page order, white space in them as one space, joined by one space."""
    found = list(pieces(page))
    best, total, start, region, unknown = 0.0, 0.0, 0, (0, 0), (INSIDE + OUTSIDE) / 2
    for i, p in enumerate(found):
        if p.label:
            total -= BORDER
        elif p.apart:
            total -= OUTSIDE if p.begins and not p.inside else 0
        elif p.words is None:
            total -= INSIDE if not p.block or p.tag in _VOID else costs.get(p.tag, unknown)
        else:
            total += len(p.words.split())
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region = total, (start, i + 1)
    out, block = [], []
    for p in found[region[0] : region[1]]:
        if p.words is not None and not p.apart:
            block.append(p.words)
        elif p.block:
            out.append("".join(block))
            block = []
    out.append("".join(block))
    return " ".join(t for t in (" ".join(b.split()) for b in out) if t)


def tag_counts(page: str) -> dict[str, tuple[int, int]]:
    """Words behind each tag, up to the next block's, inside the label and outside of it; nothing from pages without."""
    counts: dict[str, list[int]] = {}
    behind, labelled = "", False
    for p in pieces(page):
        labelled |= p.label
        if p.words is None:
            behind = p.tag if p.block and not p.label else behind
        elif behind:
            counts.setdefault(behind, [0, 0])[0 if p.inside and not p.apart else 1] += len(p.words.split())
    return {k: (a, b) for k, (a, b) in counts.items()} if labelled else {}


def learn_costs(pages: DataFrame, column: str = "html") -> dict[str, float]:
    """Cost of each tag name from all labelled pages, the ``TAGS`` most frequent names; 0 pages give no costs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for page in batch[column].dropna():
                for tag, (a, b) in tag_counts(page).items():
                    s = sums.setdefault(tag[:40], [0, 0])
                    s[0] += a
                    s[1] += b
            yield pd.DataFrame([(k, *v) for k, v in sums.items()], columns=["tag", "inside", "outside"])

    found = pages.select(column).mapInPandas(count, "tag string, inside bigint, outside bigint")
    sums = found.groupBy("tag").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    top = sums.orderBy(F.desc(F.col("inside") + F.col("outside")), "tag").limit(TAGS).collect()
    return {r.tag: INSIDE + (OUTSIDE - INSIDE) * (r.outside + 1) / (r.inside + r.outside + 2) for r in top}


def extract_pages(pages: DataFrame, costs: dict[str, float] | None = None, key: str = "page_id", url: str = "url",
                  column: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row: its main text, empty if there is none, and its code points.

    A null or empty page has the empty text; keys and urls pass through, nulls too; repeated rows give repeated
    results; pages of any length are read whole; among runs of one score the first wins. Costs are learned from the
    same pages if none are given. Other columns are not read.
    """
    learned = learn_costs(pages, column) if costs is None else costs

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(p, learned) if p else "" for p in batch], dtype=object)

    text = F.pandas_udf(run, "string")
    return pages.select(F.col(key), F.col(url), text(F.col(column)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
