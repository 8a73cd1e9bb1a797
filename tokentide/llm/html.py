"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. A word scores by the element it stands in, a tag by its name and class; the
weights are log ratios of how often such a token stands inside and outside the content of labelled pages. Labelled are
pages that mark their content with one `article` element; that element itself never counts as a token. One linear scan
finds the contiguous region of the highest total, and its blocks are the text. Words of an element that scores
negative inside the region (an advert in the middle of a story) are left out.

Words in elements that no labelled page shows get the weights of their element's name, then a fixed small positive one,
or a negative one in elements whose name or class says that they aren't content.

Defined cases: null and empty pages give an empty text; of equal regions the first counts; pages without words of positive score give
an empty text; repeated rows get equal texts; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentide.llm.words import pieces

# Pages that the weights are learned from, at most about this many.
LABELLED = 2000
WORD, TAG, LIMIT = 0.5, -1.0, 6.0
# Names of the HTML standard and of page builders (fixed values).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
NO_CONTENT = frozenset("head nav header footer aside form button select option menu dialog fieldset iframe object svg canvas".split())
NO_CONTENT_CLASS = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|"
    r"notices?|popup|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[-_ ])",
    re.IGNORECASE,
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
# An element that ends an open one of the same kind.
_ENDS = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt"),
         "option": ("option",)}


class Token:
    """A run of text in one element, or a tag: `kinds` names the features from special to general."""

    __slots__ = ("article", "block", "kinds", "odd", "text", "words")

    def __init__(self, text: str | None, kinds: tuple[str, ...], words: int, article: bool, block: bool, odd: bool):
        self.text, self.kinds, self.words, self.article, self.block, self.odd = text, kinds, words, article, block, odd


def tokens(page: str) -> Iterator[Token]:
    """Words (as runs) and tags of a page in order."""
    # An open element: name, its kind for words, is content ruled out, inside an article.
    stack: list[tuple[str, str, bool, bool]] = []
    for m in _TOKEN.finditer(page):
        name = m[3]
        if name is None:
            text = m[0]
            if text.startswith("<") and text != "<":
                continue
            top = next((s for s in reversed(stack) if s[0] in BLOCKS), ("", "", False, False))
            last = stack[-1] if stack else top
            link = "a:" if any(s[0] == "a" for s in stack[-3:]) else ""
            at = "w:" + ("odd:" if last[2] else "") + link
            yield Token(text, (f"{at}{top[1]}", f"{at}{top[0]}"), len(text.split()), last[3], False, last[2])
            continue
        name = name.lower()
        named = name
        if m[4]:
            labels = " ".join(x or y or z for x, y, z in _CLASS.findall(m[4]))
            named = f"{name}.{labels.lower()}" if labels else name
        inside = bool(stack and stack[-1][3])
        odd = bool(stack and stack[-1][2])
        block = name in BLOCKS
        if m[2]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if at is not None:
                named = stack[at][1]
                del stack[at:]
            yield Token(None, (f"/{named}", f"/{name}"), 0, inside and name != "article", block, odd)
            continue
        for other in _ENDS.get(name, ()):
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == other), None)
            walls = ("table", "ul", "ol", "div", "article", "section")
            if at is not None and not any(s[0] in walls for s in stack[at + 1 :]):
                del stack[at:]
        here = odd or name in NO_CONTENT or bool(named != name and NO_CONTENT_CLASS.search(named[len(name) + 1 :]))
        yield Token(None, (named, name), 0, inside and name != "article", block, here)
        if name not in VOID and not m[4].endswith("/"):
            stack.append((name, named, here, inside or name == "article"))


def labelled(page: str) -> bool:
    return len(re.findall(r"<article\b", page, re.IGNORECASE)) == 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside: dict[str, int] = defaultdict(int)
    outside: dict[str, int] = defaultdict(int)
    for batch in batches:
        for page in batch.column("html").to_pylist():
            if page and labelled(page):
                for t in tokens(page):
                    n = t.words if t.text is not None else 1
                    for kind in t.kinds:
                        if n and kind.lstrip("/") != "article":
                            (inside if t.article else outside)[kind] += n
    kinds = sorted({*inside, *outside})
    yield pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()), pa.array([outside[k] for k in kinds], pa.int64())],
        names=["kind", "inside", "outside"],
    )


def weights(pages: DataFrame, html_col: str = "html", most: int = LABELLED) -> dict[str, float]:
    """Weight per kind of token, from about `most` labelled pages: a table as large as the sample's vocabulary of tags."""
    rows = pages.select(F.col(html_col).alias("html")).where(F.col("html").rlike("(?i)<article\\b"))
    total = rows.count()
    rate = min(1.0, most / max(1, total))
    sample = rows.where(F.xxhash64("html").bitwiseAND(F.lit((1 << 32) - 1)) < int(rate * (1 << 32)))
    counted = sample.mapInArrow(_counts, "kind string, inside long, outside long")
    sums = counted.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    found = {}
    for r in sums:
        ratio = math.log((r.inside + 0.5) / (r.outside + 0.5))
        ratio = max(-LIMIT, min(LIMIT, ratio))
        # Words pay by their ratio; a tag never gains.
        found[r.kind] = ratio if r.kind.startswith("w:") else min(-0.01, ratio - 1.0 if ratio < 0 else -0.05)
    return found


def score(t: Token, weight: dict[str, float]) -> float:
    if t.text is not None and not t.words or t.kinds[-1].lstrip("/") == "article":
        return 0.0
    known = next((weight[k] for k in t.kinds if k in weight), None)
    if t.text is None:
        return TAG if known is None else known
    if known is None:
        known = -1.0 if t.odd else WORD
    return t.words * known


def region(scores: list[float]) -> tuple[int, int]:
    """Best contiguous run [a, b) by one scan; empty if nothing is above zero."""
    best, a, b, total, begin = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, k
        total += s
        if total > best:
            best, a, b = total, begin, k + 1
    return a, b


def main_text(page: str | None, weight: dict[str, float]) -> str:
    found = list(tokens(page or ""))
    scores = [score(t, weight) for t in found]
    a, b = region(scores)
    blocks: list[list[str]] = [[]]
    for t, s in zip(found[a:b], scores[a:b], strict=True):
        if t.text is None:
            if t.block:
                blocks.append([])
        elif s >= 0:
            blocks[-1].append(html.unescape(t.text))
    lines = (" ".join("".join(block).split()) for block in blocks)
    return "\n".join(line for line in lines if line)


def extracted(pages: DataFrame, weight: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "html"):
                texts = [main_text(page, weight) for page in piece.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
