"""Main text of HTML pages by boosted trees over DOM nodes and hierarchical decoding.

Every block element, and every run of text right under the root, is a node with features of its tag, attribute tokens, subtree
(text, link density, punctuation, paragraphs), depth, place and siblings (how long they are, and how many have
the same shape, as comments do). Attribute tokens are hashed, and a token counts by how often elements with it held main
text in training, which says nothing of tokens that were not seen there. Boosted trees
give the probability that a node's subtree holds main text. Decoding then picks the most
likely consistent labelling of the tree: below a dropped node everything is
dropped, and a kept node without text of its own has a kept child, so ancestors and
descendants never contradict each other. The kept nodes' runs of text, in page
order, are the result.

The trees are fitted on invented pages with known main text (page_templates), once on
the driver; the pages are a parameter and no page of the input is needed. Half of them have meaningless names throughout,
so that structure must do where names don't help. Odds of tokens are taken from other pages than those whose nodes they describe.

Scale: one pass over the pages without a shuffle; the model is a few kilobytes.

Defined results: a null or empty page has no text; a page without main text gives an
empty string; repeated rows are extracted each; an empty table gives no rows; other
input columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .dom import TEXT, Page, parse
from .page_templates import labelled_page, loose_page

_TAG_GROUPS = ("p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "article", "main", "section", "div center", "nav menu", "header hgroup", "footer address", "aside", "form fieldset search dialog", "table thead tbody tfoot tr td th", "blockquote pre figure", TEXT)
_GROUP = {t: i for i, g in enumerate(_TAG_GROUPS) for t in g.split()}
_WORDS = re.compile("[a-z]+")


#: Log-odds that are added to every node of a page without main text.
BENEFIT = 2.5
#: Buckets of attribute tokens, and elements that a bucket counts for without any of its own.
TOKENS, DOUBT = 4096, 4.0


@lru_cache(maxsize=100_000)
def token_buckets(attributes: str) -> tuple[int, ...]:
    """Buckets of the names in an element's attributes and of the words in them."""
    return tuple(sorted({crc32(t.encode()) % TOKENS for t in (*attributes.split(), *_WORDS.findall(attributes))}))


def token_odds(pages: list[Page], kept: list[list[bool]]) -> np.ndarray:
    """Per bucket how much likelier its elements hold main text than others: log-odds, 0 for what was hardly seen."""
    held, every = np.zeros(TOKENS), np.zeros(TOKENS)
    for page, labels in zip(pages, kept, strict=True):
        for attributes, keep in zip(page.attributes[1:], labels[1:], strict=True):
            at = list(token_buckets(attributes))
            every[at] += 1
            held[at] += keep
    share = min(max(held.sum() / max(every.sum(), 1.0), 0.01), 0.99)
    return np.log((held + DOUBT * share) / (every - held + DOUBT * (1 - share))) - np.log(share / (1 - share))


def node_features(pages: list[Page], odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all nodes of some pages, and where each page begins; odds: see token_odds."""
    starts = np.concatenate([[0], np.cumsum([len(p.tags) for p in pages])])
    n = int(starts[-1])
    page_of = np.repeat(np.arange(len(pages)), np.diff(starts))
    parent = np.concatenate([np.array(p.parents) + s for p, s in zip(pages, starts, strict=False)]) if n else np.zeros(0, int)
    root = starts[:-1]
    parent[root] = root
    depth = np.zeros(n, int)
    for i in range(n):  # parents come first
        depth[i] = depth[parent[i]] + 1
    depth[root] = 0
    group = np.array([_GROUP.get(t, 7) for p in pages for t in p.tags], int)
    told = [odds[list(token_buckets(a))] if a else odds[:0] for p in pages for a in p.attributes]
    # How far an element's tokens speak against main text and for it, and whether it is hidden.
    flags = np.array([(-min(0.0, x.min(initial=0.0)), max(0.0, x.max(initial=0.0)), float("hidden" in a.split())) for x, a in zip(told, (a for p in pages for a in p.attributes), strict=True)]).reshape(n, 3)
    own = np.zeros((n, 8))  # chars, words, marks, runs, link chars, inputs, paragraphs, items
    first = np.zeros(n)
    for p, s in zip(pages, starts, strict=False):
        for node, text in p.runs:
            row = own[s + node]
            row[0] += len(text)
            row[1] += text.count(" ") + 1
            row[2] += text.count(".") + text.count(",")
            row[3] += 1
        own[s : s + len(p.tags), 4] = p.links
        own[s : s + len(p.tags), 5] = p.inputs
    own[:, 6] = group == 0
    own[:, 7] = group == 3
    total = own.copy()
    before = flags.copy()
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    levels = np.split(order, cuts)
    for level in levels[:-1] if n else []:
        np.add.at(total, parent[level], total[level])
    for level in reversed(levels):
        inner = level[parent[level] != level]
        before[inner] = np.maximum(flags[inner], before[parent[inner]])
    children = np.bincount(parent, minlength=n) - np.isin(np.arange(n), root)
    at_text = np.concatenate([np.cumsum(own[s:e, 0]) - own[s:e, 0] for s, e in zip(starts[:-1], starts[1:], strict=False)]) if n else first
    whole = np.maximum(total[root, 0], 1)[page_of]
    up = np.maximum(total[parent, 0], 1)
    chars = np.maximum(total[:, 0], 1)
    rank = np.zeros(n)
    seen: dict[int, int] = {}
    for i in range(n):
        rank[i] = seen.get(parent[i], 0)
        seen[parent[i]] = int(rank[i]) + 1
    # The shape of an element: its tag and its children's shapes, repeats of a kind as one. Siblings of one shape are twins.
    shape = np.zeros(n, np.int64)
    inner_shapes: dict[int, list[int]] = {}
    names: dict[tuple, int] = {}
    for i in range(n - 1, -1, -1):  # children come first
        below = inner_shapes.pop(i, [])
        plain = [c for k, c in enumerate(below) if k == 0 or below[k - 1] != c]
        shape[i] = names.setdefault((group[i], *plain), len(names))
        if parent[i] != i:
            inner_shapes.setdefault(int(parent[i]), []).append(int(shape[i]))
    kin = Counter(zip(parent.tolist(), shape.tolist(), strict=True))
    twins = np.array([kin[p, c] for p, c in zip(parent.tolist(), shape.tolist(), strict=True)], float)
    bushy = children > 0
    most_twins = np.zeros(n)  # among an element's children that have children themselves
    np.maximum.at(most_twins, parent[bushy], twins[bushy])
    opening, dated = np.zeros(n), np.zeros(n)  # the first run inside an element with others: an author's name and a date are short
    for p, s in zip(pages, starts, strict=False):
        for node, text in reversed(p.runs):
            at, digits = p.parents[node], sum(map(text.count, "0123456789"))
            while at > 0:
                opening[s + at], dated[s + at] = len(text), digits / len(text)
                at = p.parents[at]
    # the sibling before and after: their text and whether they are plain paragraphs
    prior, after = np.full(n, -1), np.full(n, -1)
    last: dict[int, int] = {}
    for i in range(n):
        j = last.get(parent[i], -1)
        if j >= 0 and parent[i] != i:
            prior[i], after[j] = j, i
        last[parent[i]] = i
    side = lambda k: np.where(k >= 0, np.log1p(total[k, 0]), -1)
    same = lambda k: np.where(k >= 0, group[k] == group, False)
    x = np.column_stack(
        [
            *(group == g for g in range(len(_TAG_GROUPS))),
            flags,
            before,
            np.log1p(twins),
            np.log1p(twins) * bushy,
            np.log1p(most_twins),
            np.log1p(most_twins[parent]),
            np.log1p(opening),
            dated,
            *(group[parent] == g for g in (2, 4, 5, 7, 8, 9, 10, 11, 12)),
            np.log1p(total[:, 0]),
            np.log1p(own[:, 0]),
            total[:, 4] / chars,
            total[:, 2] / np.maximum(total[:, 1], 1),
            total[:, 1] / np.maximum(total[:, 3], 1),
            total[:, 0] / whole,
            total[:, 0] / up,
            np.log1p(total[:, 6]),
            np.log1p(total[:, 7]),
            np.log1p(total[:, 5]),
            np.minimum(depth, 12),
            at_text / whole,
            np.minimum(rank, 20),
            np.log1p(children),
            np.log1p(children[parent]),
            side(prior),
            side(after),
            same(prior),
            same(after),
            total[parent, 4] / up,
            total[:, 6] / np.maximum(total[root[page_of], 6], 1),
        ]
    ).astype(float)
    return x, starts


def decode(parents: list[int], own_text: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """The most likely labelling that agrees along every path; the root is kept, its children decide.

    A node is worth its margin if kept and 0 if dropped (log-odds); a kept node without
    own text needs a kept child, a dropped one has none.
    """
    n = len(parents)
    gain = np.zeros(n)  # of the best kept children
    least = np.full(n, -np.inf)  # the best child, kept though it does not pay
    pick = np.full(n, -1)
    value = np.zeros(n)
    for i in range(n - 1, -1, -1):
        best = gain[i]
        if best <= 0 and not own_text[i]:
            best = least[i]  # -inf for an empty leaf
        value[i] = margin[i] + best
        p = parents[i]
        if p >= 0:
            if value[i] > 0:
                gain[p] += value[i]
            if value[i] > least[p]:
                least[p], pick[p] = value[i], i
    keep = np.zeros(n, bool)
    if n:
        keep[0] = True
        for i in range(1, n):
            p = parents[i]
            if keep[p]:
                forced = p > 0 and gain[p] <= 0 and not own_text[p] and pick[p] == i
                keep[i] = value[i] > 0 or forced
    return keep


@dataclass(frozen=True)
class Extractor:
    """Boosted trees and the odds of attribute tokens."""

    trees: boosting.Boosted
    odds: np.ndarray


@lru_cache(maxsize=4)
def fit_extractor(pages: int = 800, seed: int = 2) -> Extractor:
    """Fitted on that many invented pages and half as many with text right in the body, every second one with meaningless names; the same arguments give the same trees."""
    made = [labelled_page(seed * 1_000_003 + i, bool(i % 2)) for i in range(pages)] + [loose_page(seed * 1_000_003 + i, bool(i % 2)) for i in range(pages // 2)]
    parsed, kept = [parse(html) for html, _ in made], [k for _, k in made]
    for p, labels in zip(parsed, kept, strict=True):
        if len(p.tags) != len(labels):
            raise AssertionError("a template's elements don't match its labels")
    # Two neighbours, one with names and one without, go to the same half.
    halves = [[i for i in range(len(made)) if i // 2 % 2 == h] for h in (0, 1)]
    x, y = [], []
    for mine, others in (halves, halves[::-1]):
        odds = token_odds([parsed[i] for i in others], [kept[i] for i in others])
        x.append(node_features([parsed[i] for i in mine], odds)[0])
        y += [k for i in mine for k in kept[i]]
    return Extractor(boosting.fit(np.concatenate(x), np.array(y, float)), token_odds(parsed, kept))


def extract_pages(pages: list[Page], model: Extractor) -> list[str]:
    x, starts = node_features(pages, model.odds)
    margin = model.trees.margin(x)
    out = []
    for p, s, e in zip(pages, starts[:-1], starts[1:], strict=True):
        own = np.zeros(e - s, bool)
        own[[node for node, _ in p.runs]] = True
        keep = decode(p.parents, own, margin[s:e])
        if not keep[1:].any():  # most pages have a main text, so one that seems to have none gets the benefit of the doubt
            keep = decode(p.parents, own, margin[s:e] + BENEFIT)
        out.append("\n".join(text for node, text in p.runs if keep[node]))
    return out


def extract_main_text(pages: DataFrame, model: Extractor | None = None, chunk: int = 500) -> DataFrame:
    """page_id, url, text, n_chars: one row per page, from its whole html."""
    model = model or fit_extractor()

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for i in range(0, len(batch), chunk):
                out += extract_pages([parse(h) for h in batch.iloc[i : i + chunk]], model)
            yield pd.Series(out, dtype="object")

    done = pages.select("page_id", "url", text_of(F.coalesce(F.col("html"), F.lit(""))).alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("bigint"))
