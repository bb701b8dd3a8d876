"""Main text of web pages by tag-path ratios.

Each run of text is a leaf; its path is the tags from the root down to it (with class names).  Over a page, each path gathers text length, number
of leaves and punctuation: text per leaf and punctuation per leaf are the path's ratios.  Ratios are smoothed along the page and fused by their
geometric mean; a stated prior lowers them in elements whose tag, role, class or id tells of something else (PRIOR_*).  Leaves over a threshold, a share
of the page's own spread, are content.  No element is looked for by name, <article> and <main> included: what the ratios choose is kept, and
what stands beside it in the same container (short paragraphs, headings between long ones), and headings and paragraphs of the innermost element that holds nearly
all of it.  An element under a prior goes unless most of its text is content by score.

Pages are independent, so this is one map over Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements whose text is never shown.
UNSHOWN = {"script", "style", "noscript", "template", "head", "svg", "math", "iframe", "object", "canvas", "audio", "video", "textarea", "select", "button", "title"}
#: Elements that seldom hold article text, those of prose first; a prior on scores.
ASIDE = {"header", "footer", "aside", "form", "dialog"}
LISTS = {"nav", "menu"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
ONE_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "td", "th", "tr", "tbody", "table", "dd", "dt", "dl", "figcaption", "figure"}
#: Words in class names and ids of elements that hold prose which is no article text.
ASIDE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "comment", "comments", "cookie", "cookies", "consent", "disqus", "footer", "form", "header", "modal", "newsletter", "notice", "notices", "popup", "promo", "related", "replies", "respond", "responses", "sidebar", "signup", "sponsor", "sponsored", "subscribe", "widget"}
#: The same of elements that hold short entries.
LIST_NAMES = {"breadcrumb", "breadcrumbs", "menu", "nav", "navbar", "navigation", "pager", "pagination", "share", "sharing", "social", "tags", "toolbar"}
ASIDE_ROLES = {"banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"}
LIST_ROLES = {"navigation", "menu"}

# an attribute's value is quoted only right behind its =; possessive, so that no page makes it go back
_ATTRIBUTES = r"(?>[^\s=<>]++|=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s>]*+)|\s++)*+"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe|template)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>|<[!?/][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: A leaf is content from this share of the mean score on, weighted by text and prior.
THRESHOLD = 0.4
#: What a path without punctuation has as its ratio of punctuation.
PLAIN = 0.25
#: The prior: what the score of a leaf is multiplied by in an element of ASIDE, with a role of ASIDE_ROLES or a class or id that is one of ASIDE_NAMES; with such
#: a word as a part of its class or id; and in one of LISTS, LIST_ROLES or LIST_NAMES, which leaves the choice to the ratios.  The least factor around a leaf counts.
PRIOR_WHOLE, PRIOR_PART, PRIOR_LIST = 0.03, 0.3, 0.5
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
NAMES_SPARE = {"body", "html"} | TEXT_TAGS
BLOCK_PARTS = INLINE | ONE_BLOCK
#: The region may miss this share of the text of the leaves that pass.
STRAY = 0.1


def _prior(tag: str, attributes: str) -> tuple[bool, str, float]:
    """(whether the element is never shown, its class names, the factor of the prior)."""
    names, out, factor = "", tag in UNSHOWN, PRIOR_WHOLE if tag in ASIDE else PRIOR_LIST if tag in LISTS else 1.0
    if attributes and not attributes.isspace():
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                out = True
            elif key == "role":
                factor = min(factor, PRIOR_WHOLE if value.lower() in ASIDE_ROLES else PRIOR_LIST if value.lower() in LIST_ROLES else 1.0)
            elif key in ("class", "id"):
                names += "." + value if key == "class" else ""
                if tag not in NAMES_SPARE:
                    for name in value.split():
                        words = ASIDE_NAMES.intersection(w.lower() for w in _NAME_WORDS.findall(name))
                        factor = min(factor, PRIOR_WHOLE if name.lower() in ASIDE_NAMES else PRIOR_LIST if name.lower() in LIST_NAMES else PRIOR_PART if words else 1.0)
    return out, names, factor


class Page:
    """Leaves of a page: text, block, path, the elements around it, whether it can be article text."""

    def __init__(self, source: str):
        self.text: list[str] = []
        self.block: list[int] = []
        self.path: list[str] = []
        self.chain: list[tuple[int, ...]] = []
        self.fit: list[bool] = []
        stack: list[tuple[str, str, int, bool]] = []  # tag, path, element, no article text
        self.tag: dict[int, str] = {}
        self.named: dict[int, float] = {}  # elements under a prior
        block = element = at = 0

        def leaf(raw: str) -> None:
            if raw and not raw.isspace():
                self.text.append(html.unescape(raw))
                self.block.append(block)
                self.path.append(stack[-1][1] if stack else "")
                self.chain.append(tuple(s[2] for s in stack))
                self.fit.append(not (stack and stack[-1][3]))
            elif raw and self.text and self.block[-1] == block:
                self.text[-1] += " "

        for m in _TAG.finditer(source):
            leaf(source[at : m.start()])
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if m[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                if tag not in INLINE:
                    block += 1
                continue
            if tag == "br":
                if self.text and self.block[-1] == block:
                    self.text[-1] += " "
                continue
            if tag not in INLINE:
                block += 1
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table"):
                        break
            if tag in VOID or m[4].endswith("/") and tag not in CLOSES_P:
                continue
            out, names, factor = _prior(tag, m[4])
            above = stack[-1] if stack else ("", "", 0, False)
            out = out or above[3]
            element += 1
            self.tag[element] = tag
            if factor < 1:
                self.named[element] = factor
            stack.append((tag, f"{above[1]}/{tag}{names}", element, out))
        leaf(source[at:])


def content(page: Page, fit: list[int]) -> list[int]:
    """The leaves of the main text, by the ratios of their tag paths."""
    size, marks, count = {}, {}, {}
    for i in fit:
        p = page.path[i]
        size[p] = size.get(p, 0) + len(page.text[i])
        marks[p] = marks.get(p, 0) + len(_PUNCTUATION.findall(page.text[i]))
        count[p] = count.get(p, 0) + 1
    ratio = np.array([[size[p] / count[p], PLAIN + marks[p] / count[p]] for p in (page.path[i] for i in fit)])
    padded = np.concatenate([ratio[:1], ratio, ratio[-1:]])
    smooth = (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4
    factor = np.array([min((page.named[e] for e in page.chain[i] if e in page.named), default=1.0) for i in fit])
    text = {i for i in fit if any(page.tag[e] in TEXT_TAGS for e in page.chain[i])}
    own = factor * np.sqrt(ratio[:, 0] * ratio[:, 1])
    fused = np.where(factor < 1, own, np.sqrt(smooth[:, 0] * smooth[:, 1]))
    weights = factor * np.array([len(page.text[i]) for i in fit])
    limit = min(THRESHOLD * (fused * weights).sum() / weights.sum(), fused.max())
    # neighbours lift headings and paragraphs only, and none in a named element
    passing = [i for i, f, o in zip(fit, fused, own) if f >= limit and (i in text or o >= limit)] or [fit[int(own.argmax())]]
    weight, whole = {}, {}
    for found, out in ((passing, weight), (fit, whole)):
        for i in found:
            for e in page.chain[i]:
                out[e] = out.get(e, 0) + len(page.text[i])
    total = sum(len(page.text[i]) for i in passing)
    # names leave out an element only if most of its text doesn't pass
    lost = {e for e in page.named if 2 * weight.get(e, 0) < whole.get(e, 0)}
    fit = [i for i in fit if lost.isdisjoint(page.chain[i])]
    # the innermost element with nearly all of the chosen text, and what it is the article of; inner ones have greater numbers
    best = max((e for e, w in weight.items() if w >= (1 - STRAY) * total), default=0)
    around = next((page.chain[i][: page.chain[i].index(best) + 1] for i in passing if best in page.chain[i]), ())
    # one block is not the whole text: up to what holds its neighbours
    while around and page.tag[around[-1]] in BLOCK_PARTS:
        around = around[:-1]
    held = around[-1] if around else 0
    # what shares its nearest container with a leaf that passes, be it outside the region, and the region's headings and paragraphs
    container = {i: next((e for e in reversed(page.chain[i]) if page.tag[e] not in BLOCK_PARTS), 0) for i in fit}
    near = {container[i] for i in passing if i in container}
    return [i for i in fit if container[i] in near or i in text and (not held or held in page.chain[i])]


def main_text(source: str | None) -> str:
    """The blocks of the main text, joined by \\n; white space in a block is one space, and none around it."""
    if not source:
        return ""
    page = Page(source)
    fit = [i for i, f in enumerate(page.fit) if f]
    if not fit:
        return ""
    blocks: dict[int, list[str]] = {}
    for i in content(page, fit):
        blocks.setdefault(page.block[i], []).append(page.text[i])
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def _extracted(batches):
    for batch in batches:
        for lo in range(0, len(batch), 128):
            part = batch.slice(lo, 128)
            text = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: the id, url, text (main text, empty if none) and n_chars (its code points).

    Null or empty html: empty text.  Null ids and urls stay null; repeated rows are treated alike; plain text without tags is its own main text.
    An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extracted, "page long, url string, text string, n_chars long").withColumnsRenamed({"page": id_col, "url": url_col})


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
