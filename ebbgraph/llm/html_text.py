"""Main text of web pages: the best-scoring contiguous run of a page's words and tags.

A page is read as a sequence of words and tags. A word scores by where it stands: the summed weights of
the elements around it (semantic tags, and words of class, id and role names). A tag scores below zero,
by how often it stands outside content, and next to nothing in content. One linear scan finds the contiguous run with the largest
sum, the article with what is set into it; blocks of the run that stand in an element of
negative weight (an advert or a form inside the article) are left out.

The weights are log-odds counted on labelled pages: a written sample (``labelled_pages``), and pages of
the corpus whose article element labels them, at most ``sample`` of these, taken in order of a hash. All
pages are then extracted, whole.

Defined results: null or empty html gives an empty text; a page without content words too; tags
left open, comments without end and stray ``<`` are tolerated as browsers do; rows are independent but for
the weights, so repeats and null ids each get their row; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbgraph.llm.common import rowwise
from ebbgraph.llm.labelled_pages import sample_pages

SAMPLE = 2000
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
NAMES = re.compile(r"""\b(class|id|role|data-content|data-other)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Fixed values of the HTML standard.
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead tr ul".split()
)
#: Tags that tell what an element holds; others (div, span, lists, emphasis) say nothing by themselves.
TELLING = frozenset(
    "article main nav header footer aside form button select dialog menu p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split()
)
FRESH = frozenset(("article", "main"))
OFTEN_OPEN = frozenset(("nav", "header", "menu"))  # if one is still open where an article begins, its end was forgotten
NEGATIVE = -1.0
LEAST = 0.01  # what a tag costs at least
MOST = 5.0


def features(tag: str, attributes: str, inside: bool) -> list[str]:
    """What an element says about its words; ``inside``: within an article."""
    out = [f"{tag} in article" if tag == "header" and inside else tag] if tag in TELLING else []
    if attributes:
        words = [
            w.lower() for m in NAMES.finditer(attributes) if m[1].lower() in ("class", "id", "role")
            for w in NAME_WORD.findall(m[2] or m[3] or m[4] or "")
        ]
        if "header" in words and any(w in words for w in ("article", "post", "entry", "story", "content")):
            words = [w for w in words if w != "header"]
        out += [f".{w}" for w in dict.fromkeys(words)]
    return out


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds are "open", "close" and "text"; raw elements are skipped whole."""
    at = 0
    while True:
        m = MARKUP.search(page, at)
        if m is None:
            if at < len(page):
                yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        if m[1] or m[4]:
            yield "close", name, ""
        elif name in RAW:
            if not (m[3] or m[6] or "").endswith("/") or name not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        else:
            yield "open", name, m[3] or m[6] or ""


class Page:
    """The open elements of a page; each with what its words inherit."""

    def __init__(self):
        self.open: list[tuple] = []
        self.count: Counter[str] = Counter()

    def start(self, name: str, state) -> None:
        if name not in VOID:
            self.open.append((name, state))
            self.count[name] += 1

    def end(self, name: str) -> None:
        if self.count[name]:
            while True:
                last = self.open.pop()[0]
                self.count[last] -= 1
                if last == name:
                    return

    def state(self, nothing):
        return self.open[-1][1] if self.open else nothing


def learn(page: str, weights: dict[str, float] | None) -> Counter:
    """Counts of (feature or tag, in content) of a labelled page: marked by attributes, or by its article element."""
    seen: Counter = Counter()
    marked = "data-content" in page
    tree = Page()
    nothing = (False, False, frozenset())
    for kind, name, attributes in events(page):
        if kind == "open":
            if name in BLOCK and tree.count["p"]:
                tree.end("p")
            content, other, around = tree.state(nothing)
            mine = features(name, attributes, content)
            if marked:
                content = (content or "data-content" in attributes) and "data-other" not in attributes
            else:
                content = content or name in FRESH
                other = other or (weights is not None and any(weights.get(f, 0.0) < NEGATIVE for f in mine))
            seen[f"<{name}", content and not other] += 1
            tree.start(name, (content, other, around | frozenset(mine)))
        elif kind == "close":
            tree.end(name)
        else:
            content, other, around = tree.state(nothing)
            words = len(name.split())
            if words and not (content and other):
                for f in around:
                    seen[f, content] += words
    return seen


def log_odds(counts: Counter) -> dict[str, float]:
    return {k: math.log((counts[k, True] + 0.5) / (counts[k, False] + 0.5)) for k in {k for k, _ in counts}}


def train(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights of features and tags; from at most ``sample`` pages of the corpus, so their number is bounded."""
    written: Counter = Counter()
    for page in sample_pages():
        written.update(learn(page, None))
    prior = log_odds(written)

    def make():
        def one(page):
            return [(k, inside, n) for (k, inside), n in learn(page or "", prior).items()]

        return one

    count = rowwise(make, "array<struct<name: string, content: boolean, n: bigint>>")
    labelled = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b")).select("html")
    chosen = labelled.orderBy(F.xxhash64("html"), "html").limit(sample)
    sums = chosen.select(F.explode(count("html")).alias("c")).groupBy("c.name", "c.content").agg(F.sum("c.n").alias("n"))
    seen = Counter({(r["name"], r["content"]): r["n"] for r in sums.collect()})
    found = log_odds(seen)
    # the written pages are few: where both know a feature, each has an equal say
    return {k: round((found[k] + prior[k]) / 2 if k in found and k in prior else found.get(k, prior.get(k, 0.0)), 6) for k in {**found, **prior}}


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best contiguous run of a page."""
    if not page:
        return ""
    blocks: list[list[tuple[int, str]]] = [[]]
    scores: list[float] = []
    tree = Page()
    # summed weights, whether the words may be kept, whether inside an article, whether in what no article ends
    nothing = (0.0, True, False, False)
    for kind, name, attributes in events(page):
        total, kept, inside, shut = tree.state(nothing)
        if kind == "text":
            words = len(name.split())
            if kept:
                good = 1.0 if total >= 0 else max(total, -MOST)
            else:
                good = -LEAST if inside else max(min(total, NEGATIVE), -MOST)
            scores.append(words * good)
            if kept:
                blocks[-1].append((len(scores) - 1, name))
            continue
        if kind == "open":
            if name in BLOCK and tree.count["p"]:
                tree.end("p")
                total, kept, inside, shut = tree.state(nothing)
            if name in FRESH and not inside and not shut:
                total, kept = 0.0, True
            for f in features(name, attributes, inside):
                weight = weights.get(f, 0.0)
                total += weight
                if weight < NEGATIVE:
                    kept, shut = False, shut or f not in OFTEN_OPEN
            inside = inside or (name in FRESH and kept)
            tree.start(name, (total, kept, inside, shut))
        else:
            tree.end(name)
        cost = min(weights.get(f"<{name}", 0.0), 0.0)
        scores.append(-LEAST if inside or (kept and total > 0) else max(min(cost, -LEAST), -MOST))
        if name in BLOCK:
            if blocks[-1]:
                blocks.append([])
        elif name in ("br", "td", "th") and blocks[-1]:
            blocks[-1].append((len(scores) - 1, " "))
    first, last = best_run(scores)
    lines = (" ".join(entities.unescape("".join(t for at, t in block if first <= at <= last)).split()) for block in blocks)
    return "\n".join(line for line in lines if line)


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last index of the contiguous run with the largest positive sum; (0, -1) if there is none."""
    best, found, total, start = 0.0, (0, -1), 0.0, 0
    for at, score in enumerate(scores):
        if total <= 0.0:
            total, start = 0.0, at
        total += score
        if total > best:
            best, found = total, (start, at)
    return found


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points)."""
    weights = train(pages, sample)
    of = rowwise(lambda: lambda page: main_text(page, weights), "string")
    return pages.select("page_id", "url", of("html").alias("text")).select("*", F.length("text").cast("long").alias("n_chars"))
