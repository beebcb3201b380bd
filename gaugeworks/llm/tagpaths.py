"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|title|object|math)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr",)), "th": ("th", ("tr",)), "option": ("option", ("select",))}
OUTSIDE = frozenset("head nav footer aside form button fieldset dialog menu".split())  # elements that HTML has for other things than the main text
WRAPS = frozenset("form fieldset dialog".split())  # of these, elements that servers also wrap around a whole page
HEADED = frozenset("article main h1".split())  # what an element holds that is more than its names say
MARKED = frozenset("div section ul ol dl table p".split())  # elements whose names may lower the weight of what they hold
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|menu|nav\w*|breadcrumbs?|side-?bar|widget|footer|copyright|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|replies|disqus|login|signup|search|pagination|pager|toolbar|masthead|site-?header|page-?header)(?:$|[\s_-])",
    re.I,
)
MARK_WEIGHT = 0.1
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
STOPS = re.compile(r"[.,;:!?…。、，；：！？]")
PLAIN = frozenset("p li td th pre blockquote dt dd".split() + [f"h{i}" for i in range(1, 7)])  # blocks that hold text, not an article


class Paths:
    """The tag paths of a page as a tree, and its text nodes in page order: (path, block number, text).

    A path is a number; parents have smaller numbers than children, so one run over the numbers passes values up or
    down, and the work is linear in the page, however deep elements nest.
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.depth, self.outside, self.link, self.marked = [0], [""], [0], [False], [False], [False]
        self.number: dict[tuple[int, str], int] = {}
        self.nodes: list[tuple[int, int, str]] = []
        self.read(page)
        self.unwrap()

    def child(self, at: int, tag: str, names: str, inside: bool) -> int:
        key = (at, f"{tag}.{names.lower()}")
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.parent)
            self.parent.append(at)
            self.tag.append(tag)
            self.depth.append(self.depth[at] + 1)
            self.outside.append(tag in OUTSIDE or (tag == "header" and not inside))
            self.link.append(self.link[at] or tag == "a")
            self.marked.append(tag in MARKED and bool(MARKS.search(names)))
        return found

    def read(self, page: str) -> None:
        stack: list[tuple[str, int]] = []
        places: dict[str, list[int]] = {}  # open elements of a tag, by place in the stack
        blocks: list[int] = []  # open block elements
        block = 0

        def close(i: int) -> None:
            while len(stack) > i:
                tag, _ = stack.pop()
                places[tag].pop()
                if tag in BLOCK:
                    blocks.pop()

        def last(tag: str) -> int:
            return places[tag][-1] if places.get(tag) else -1

        for m in TOKEN.finditer(page):
            at = stack[-1][1] if stack else 0
            if m["text"] is not None:
                if m["text"].strip():
                    self.nodes.append((at, block, entities.unescape(m["text"]) if "&" in m["text"] else m["text"]))
                elif self.nodes and self.nodes[-1][1] == block:
                    self.nodes.append((self.nodes[-1][0], block, " "))
                continue
            if m["tag"] is None:
                continue
            tag = m["tag"].lower()
            if tag in BLOCK:
                block += 1
            elif tag == "br" and self.nodes and self.nodes[-1][1] == block:
                self.nodes.append((self.nodes[-1][0], block, " "))
            if m["end"]:
                i = last(tag)
                if i >= 0 and (tag in BLOCK or not blocks or blocks[-1] < i):  # an inline end tag closes nothing outside its block
                    close(i)
                continue
            if tag in VOID or m["attrs"].endswith("/"):
                continue
            if tag in CLOSES:
                i = last(CLOSES[tag][0])
                if i > max((last(t) for t in CLOSES[tag][1]), default=-1):
                    close(i)
            elif tag in BLOCK and blocks and blocks[-1] == last("p"):
                close(blocks[-1])
            names = " ".join(filter(None, (x for found in NAMES.findall(m["attrs"]) for x in found)))
            inside = bool(places.get("article") or places.get("main"))
            at = self.child(stack[-1][1] if stack else 0, tag, names, inside)
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append((tag, at))

    def unwrap(self) -> None:
        """An element is outside the main text with all it holds, but for a form, fieldset or dialog that holds most of what is
        in no other such element."""
        def inherited(own: list[bool]) -> list[bool]:
            out = list(own)
            for i in range(1, len(out)):
                out[i] = out[i] or out[self.parent[i]]
            return out

        firm = inherited([o and t not in WRAPS for o, t in zip(self.outside, self.tag, strict=True)])
        if any(o and t in WRAPS for o, t in zip(self.outside, self.tag, strict=True)):
            text = [0.0] * len(self.parent)
            for path, _, t in self.nodes:
                if not firm[path] and not self.link[path]:
                    text[path] += len(t)
            held = self.below(text)
            self.outside = [o and not (t in WRAPS and 2 * held[i] > held[0]) for i, (o, t) in enumerate(zip(self.outside, self.tag, strict=True))]
        self.outside = inherited(self.outside)

    def below(self, values: list[float]) -> list[float]:
        """Sums over the paths that begin with each path."""
        total = list(values)
        for i in range(len(total) - 1, 0, -1):
            total[self.parent[i]] += total[i]
        return total

    def weights(self) -> list[float]:
        """1, or MARK_WEIGHT under an element whose names speak of other things.

        Such names are overruled where elements in it hold most of the page's text, if it holds an article or the page's
        heading, or nearly all text of a page without either; so comments that are longer than their article stay marked, a layout's wrapper does not.
        """
        text = [0.0] * len(self.parent)
        for path, _, t in self.nodes:
            if not self.outside[path] and not self.link[path]:
                text[path] += len(t)
        held, out = self.below(text), [1.0] * len(text)
        heads = self.below([float(t in HEADED) for t in self.tag])
        for i in range(1, len(out)):
            wrapper = 2 * (held[i] - text[i]) > held[0] and (heads[i] > 0 or (not heads[0] and held[i] >= 0.9 * held[0]))
            out[i] = MARK_WEIGHT if self.marked[i] and not wrapper else out[self.parent[i]]
        return out

    def common(self, a: int, b: int) -> float:
        """The share of the longer of two paths that they have in common."""
        longest = max(self.depth[a], self.depth[b], 1)
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return self.depth[a] / longest


def path_scores(paths: Paths, weights: list[float], width: int = 1) -> dict[int, float]:
    """Score per path with text: text per node and punctuation per node, each smoothed, fused as their geometric mean, times its weight.

    Smoothing runs over the paths in order of first appearance: Gaussian in the distance, times the share of the
    path that two neighbours have in common. Paths outside the main text score 0; text in links doesn't count.
    """
    sums: dict[int, list[float]] = {}
    for path, _, text in paths.nodes:
        got = sums.setdefault(path, [0, 0, 0])
        if text == " ":
            continue
        got[0] += 1
        if not paths.link[path]:
            got[1] += len(text)
            got[2] += len(STOPS.findall(text))
    order = list(sums)
    ratio = [[sums[p][k] / max(1, sums[p][0]) for p in order] for k in (1, 2)]
    scores = {}
    for i, p in enumerate(order):
        near = range(max(0, i - width), min(len(order), i + width + 1))
        w = [math.exp(-((i - j) ** 2)) * paths.common(p, order[j]) if i != j else 1.0 for j in near]
        text, stops = (sum(a * r[j] for a, j in zip(w, near, strict=True)) / sum(w) for r in ratio)
        scores[p] = 0.0 if paths.outside[p] else weights[p] * math.sqrt(text * (stops + 0.1))
    for p in order:
        if paths.link[p]:  # a link is worth what the text around it is worth: nothing in a list of links
            q = p
            while paths.link[q]:
                q = paths.parent[q]
            scores[p] = scores[q] if q in sums and sums[q][1] else 0.0
    return scores


def main_text(page: str | None) -> str:
    """Text of the nodes on selected paths, white space inside a block as one space, blocks two line ends apart.

    A path is selected if its score reaches half the standard deviation of the page's scores; one of lowered weight only
    if none scores higher, one outside the element that holds nearly all selected text only if it scores half of the best. What stands beside the
    selected paths under that element (headings, short items) belongs to them, unless
    its weight is lowered, and lists of links where they lie between selected nodes; where that element is the whole
    body, only what lies between selected nodes, and headings. A page without a scoring path has no text.
    """
    paths = Paths(page or "")
    weights = paths.weights()
    scores = path_scores(paths, weights)
    if not scores or max(scores.values()) <= 0:
        return ""
    values = list(scores.values())
    mean = sum(values) / len(values)
    limit = 0.5 * math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    best = max(values)
    chosen = {p for p, v in scores.items() if v > 0 and v >= (limit if weights[p] == 1 else best)}
    held = [0.0] * len(paths.parent)
    for path, _, text in paths.nodes:
        if path in chosen:
            held[path] += len(text)
    held = paths.below(held)
    root = 0
    for i in range(1, len(held)):  # the deepest element that holds nearly all selected text
        if held[i] >= 0.9 * held[0] and paths.depth[i] > paths.depth[root] and paths.tag[i] in BLOCK and paths.tag[i] not in PLAIN:
            root = i
    under = [False] * len(held)
    for i in range(len(held)):
        under[i] = i == root or under[paths.parent[i]]
    at = [k for k, (path, _, _) in enumerate(paths.nodes) if path in chosen]
    whole = paths.tag[root] in ("", "html", "body")
    blocks: dict[int, list[str]] = {}
    for k, (path, block, text) in enumerate(paths.nodes):
        beside = under[path] and not paths.outside[path] and weights[path] == weights[root]
        if beside and paths.link[path] and not scores[path]:  # a list of links belongs to the text only inside it
            beside = at[0] <= k <= at[-1]
        if whole and beside:
            beside = at[0] <= k <= at[-1] or (paths.tag[path][:1] == "h" and paths.tag[path] in PLAIN)
        if (path in chosen and (under[path] or 2 * scores[path] >= best)) or beside:
            blocks.setdefault(block, []).append(text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(x for x in joined if x)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``; null and empty pages have an empty text.

    Pages are independent; repeated rows give equal results, other columns are not read; an empty table gives an
    empty result. Of paths with equal scores all are chosen or none. Long and deeply nested pages take time in proportion to their length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                text = [main_text(h) for h in part[html_col]]
                yield pd.DataFrame({"page_id": part["page_id"].astype("Int64"), "url": part["url"], "text": text, "n_chars": list(map(len, text))})

    return pages.select("page_id", "url", F.col(html_col)).mapInPandas(run, "page_id long, url string, text string, n_chars long")
