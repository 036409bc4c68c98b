"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded so that the tree agrees with itself.

Every block element gets features: its tag and attribute tokens (as log-odds learned in training, its own, its
parent's and the least among its ancestors), text, link and tag densities of its subtree, depth, and how it compares
with its siblings. The trees give a log-odds of belonging to the article. Decoding takes the best labelling of the
whole tree in which everything under a dropped node is dropped and everything above a kept node is kept.

The trees are trained on ``PAGES`` invented pages (``page_maker``), whose main text is known; the same on every run.
A header, list, table or caption of the article itself is part of it, and so is a paragraph full of links. Elements that
only wrap another one count for nothing, however many they are.
Text: the kept blocks in page order, character references decoded, white space inside a block made one space, joined
by line feeds. Null and empty pages, and pages without a kept block, give the empty text. Repeated rows get equal
results; null ids are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .boosting import Boosted
from .dom import Node, parse
from .page_maker import Maker
from .store import free
from .words import small

PAGES = 3200
N_FEATURES = 31
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def features(nodes: list[Node], blocks: list[tuple[int, str]], tag_odds: dict[str, float], token_odds: dict[str, float]) -> np.ndarray:
    n = len(nodes)
    own = np.zeros((8, n))  # characters, link characters, inline tags, controls, marks, blocks, words, copyright signs
    for k, text in blocks:
        own[0, k] += len(text)
        own[4, k] += text.count(",") + text.count(".")
        own[5, k] += 1
        own[6, k] += text.count(" ") + 1
        own[7, k] += text.count("©")
    parent = np.fromiter((v.parent for v in nodes), np.int64, n)
    for k, v in enumerate(nodes):
        own[1, k], own[2, k], own[3, k] = v.links, v.inline, v.controls
    below = own.copy()
    wraps = wrappers(nodes, blocks)
    size = (~wraps).astype(float)
    paragraphs = np.fromiter((v.tag == "p" for v in nodes), float, n)
    items = np.fromiter((v.tag == "li" for v in nodes), float, n)
    children = np.zeros(n)
    for k in range(n - 1, 0, -1):
        p = parent[k]
        below[:, p] += below[:, k]
        size[p] += size[k]
        paragraphs[p] += paragraphs[k]
        items[p] += items[k]
        children[p] += 1
    tag = np.fromiter((tag_odds.get(v.tag, 0.0) for v in nodes), float, n)
    token = np.fromiter((min(max(sum(token_odds.get(t, 0.0) for t in v.tokens), -6), 6) for v in nodes), float, n)
    least_tag, most_tag, least_token, most_token = tag.copy(), tag.copy(), token.copy(), token.copy()
    for k in range(1, n):
        p = parent[k]
        least_tag[k] = min(tag[k], least_tag[p])
        most_tag[k] = max(tag[k], most_tag[p])
        least_token[k] = min(token[k], least_token[p])
        most_token[k] = max(token[k], most_token[p])
    up = np.maximum(parent, 0)
    chars = below[0]
    total = max(1.0, chars[0])
    before = np.zeros(n)
    seen = 0.0
    at = 0
    order = [0.0] * n
    for k, text in blocks:  # characters before a node's first block
        while at <= k:
            order[at] = seen
            at += 1
        seen += len(text)
    while at < n:
        order[at] = seen
        at += 1
    before[:] = order
    link = np.minimum(1.0, below[1] / np.maximum(1, chars))
    x = np.empty((n, N_FEATURES), np.float32)
    x[:, 0], x[:, 1], x[:, 2] = tag, tag[up], least_tag
    x[:, 3], x[:, 4], x[:, 5], x[:, 6] = token, token[up], least_token, most_token
    x[:, 7] = [len(v.tokens) for v in nodes]
    x[:, 8] = np.log1p(chars)
    x[:, 9] = np.log1p(own[0])
    x[:, 10] = link
    x[:, 11] = size / (1 + chars / 20)
    x[:, 12] = below[2] / (1 + chars / 20)
    x[:, 13] = below[4] / np.maximum(1, below[6])
    x[:, 14] = np.log1p(below[3])
    x[:, 15] = np.minimum(below[7], 3)
    # wrappers do not count as depth, nor what is deeper than any page of the training
    depth = np.zeros(n)
    for k in range(1, n):
        depth[k] = depth[parent[k]] + (not wraps[parent[k]])
    x[:, 16] = np.minimum(depth, 16)
    x[:, 17] = np.fromiter((v.index for v in nodes), float, n) / np.maximum(1, children[up])
    x[:, 18] = np.log1p(children[up])
    x[:, 19] = np.log1p(children)
    x[:, 20] = chars / np.maximum(1, chars[up])
    x[:, 21] = chars / total
    x[:, 22] = before / total
    x[:, 23] = np.log1p(paragraphs)
    x[:, 24] = np.log1p(paragraphs[up])
    x[:, 25] = np.log1p(items)
    x[:, 26] = link[up]
    x[:, 27] = np.log1p(below[6] / np.maximum(1, below[5]))
    x[:, 28] = [v.tag in HEADINGS for v in nodes]
    x[:, 29] = below[3] / np.maximum(1, size)
    x[:, 30] = most_tag
    return x


def wrappers(nodes: list[Node], blocks: list[tuple[int, str]]) -> np.ndarray:
    """Which elements only wrap one other: no text and no sibling inside, and neither tag nor attributes tell anything."""
    out = np.fromiter((v.tag in ("div", "center", "#root", "html", "body") and v.own == 0 and (not v.tokens or v.tokens == ["x"]) for v in nodes), bool, len(nodes))
    children = np.bincount([v.parent for v in nodes[1:]], minlength=len(nodes)) if len(nodes) > 1 else np.zeros(len(nodes), np.int64)
    return out & (children == 1)


def decode(parent: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """The likeliest labels in which a dropped node's descendants are dropped; parents stand before their children."""
    keep_p, drop_p = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    drop, keep = drop_p.copy(), keep_p.copy()
    best = np.empty(len(parent))
    for k in range(len(parent) - 1, -1, -1):
        best[k] = max(drop[k], keep[k])
        if k:
            drop[parent[k]] += drop[k]
            keep[parent[k]] += best[k]
    kept = np.zeros(len(parent), bool)
    for k in range(len(parent)):
        kept[k] = (k == 0 or kept[parent[k]]) and keep[k] > drop[k]
    return kept


def _truth(nodes: list[Node]) -> np.ndarray:
    """A node is of the article if it is marked, stands above a marked one, or (unmarked elements inside) under one."""
    y = np.array([v.truth for v in nodes])
    marked = y.copy()
    for k in range(1, len(nodes)):
        marked[k] |= marked[nodes[k].parent]
    y |= marked
    for k in range(len(nodes) - 1, 0, -1):
        y[nodes[k].parent] |= y[k]
    return y


class Extractor:
    def __init__(self, pages: int = PAGES, seed: int = 1):
        made = [parse(Maker(seed + k).page()) for k in range(pages)]
        truth = [_truth(nodes) for nodes, _ in made]
        # odds come from one half of the pages, trees from the other, so that rare tokens are not taken at face value
        half = pages // 2
        self.tag_odds = self._odds([([v.tag], t) for (nodes, _), y in zip(made[:half], truth[:half], strict=True) for v, t in zip(nodes, y, strict=True)])
        self.token_odds = self._odds([(set(v.tokens), t) for (nodes, _), y in zip(made[:half], truth[:half], strict=True) for v, t in zip(nodes, y, strict=True)])
        x = np.concatenate([features(nodes, blocks, self.tag_odds, self.token_odds) for nodes, blocks in made[half:]])
        self.trees = Boosted().fit(x, np.concatenate(truth[half:]).astype(float))

    @staticmethod
    def _odds(seen: list) -> dict[str, float]:
        yes, no = Counter(), Counter()
        for names, label in seen:
            (yes if label else no).update(names)
        a, b = sum(label for _, label in seen) + 1, sum(not label for _, label in seen) + 1
        return {k: float(np.log((yes[k] + 1) / a) - np.log((no[k] + 1) / b)) for k in yes.keys() | no.keys()}

    def kept(self, parsed: list[tuple[list[Node], list[tuple[int, str]]]]) -> list[np.ndarray]:
        """For each parsed page which of its nodes are kept."""
        if not parsed:
            return []
        margin = self.trees.margin(np.concatenate([features(nodes, blocks, self.tag_odds, self.token_odds) for nodes, blocks in parsed]))
        margin[np.concatenate([wrappers(nodes, blocks) for nodes, blocks in parsed])] = 0  # they go as what they wrap goes
        out, at = [], 0
        for nodes, _ in parsed:
            out.append(decode(np.fromiter((v.parent for v in nodes), np.int64, len(nodes)), margin[at : at + len(nodes)]))
            at += len(nodes)
        return out

    def texts(self, pages: list[str | None]) -> list[str]:
        out: list[str] = []
        for i in range(0, len(pages), 100):
            parsed = [parse(p or "") for p in pages[i : i + 100]]
            out += ["\n".join(t for k, t in blocks if kept[k]) for (_, blocks), kept in zip(parsed, self.kept(parsed), strict=True)]
        return out


@lru_cache(1)
def extractor() -> Extractor:
    return Extractor()


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", model: Extractor | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, text, n_chars) for every row, and the columns named in ``keep``. A computed column whose name is taken by
    one of those gets underscores after it."""
    m = model or extractor()
    own_names = [id_col, *(k for k in keep if k != id_col)]
    rows = pages.select(*own_names, F.col(html_col).alias(free("_html", own_names)))
    own = rows.schema.fields[:-1]
    text_name, chars_name = free("text", own_names), free("n_chars", own_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = m.texts(batch.column(len(own)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*own_names, text_name, chars_name])

    return rows.mapInArrow(run, StructType([*own, StructField(text_name, StringType()), StructField(chars_name, LongType())]))
