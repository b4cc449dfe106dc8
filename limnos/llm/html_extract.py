"""Main text of web pages by a tree-structured graphical model over the DOM.

Every node of a page (blocks, marked inline elements, texts) carries a binary
variable: content or not.  Its own evidence (tag, words in class, id and role,
lengths, share of links) gives a log-odds score; each edge has a potential
table over (parent, child), one for each kind of child.  The tree makes
inference exact: one sweep of sum-product messages from the leaves to the root,
one back, and every node's marginal follows.  Texts whose marginal is one half
or more are the main text.

Weights are learned from labelled pages by the gradient of the conditional
log-likelihood, whose expectations come from the same two sweeps.  Both sweeps
run over all pages of a batch at once, level by level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import by_batch
from limnos.llm.page_tree import BLOCK_TAGS, GROUPS, TEXT, Page, parse
from limnos.llm.labelled_pages import labelled_pages

#: Labelled pages that a model is fitted on at most, drawn by a hash of the page.
MOST_LABELLED = 2000
#: Steps and rate of the fit, and the weight of its squared penalty.
STEPS, RATE, PENALTY = 150, 0.12, 2e-3

#: Html characters that are parsed before the sweeps run over them.
PART_CHARS = 1 << 20

_TAGS = {t: k for k, t in enumerate(["root", "inline", "other", *BLOCK_TAGS])}
_NEGATIVE_TAGS = frozenset(("nav", "aside", "footer", "form", "header", "menu", "search", "noscript", "button", "dialog", "fieldset", "legend"))
_G = len(GROUPS)

# Columns of the evidence: one indicator each.
_ELEMENT, _ELEMENT_IN = 0, len(_TAGS)  # the tag; the tag inside an article
_GROUP, _GROUP_IN = 2 * len(_TAGS), 2 * len(_TAGS) + _G
_LEAF, _LEAF_IN = _GROUP_IN + _G, _GROUP_IN + _G + len(_TAGS)  # a text under the tag
_LENGTH, _LENGTH_IN = _LEAF_IN + len(_TAGS), _LEAF_IN + len(_TAGS) + 5  # outside of an article, inside
_LINKS = _LENGTH_IN + 5
_MARKS = _LINKS + 3
_SUM_LENGTH, _SUM_LINKS, _MEAN = _MARKS + 1, _MARKS + 6, _MARKS + 9
N_EVIDENCE = _MEAN + 4
#: Kinds of children: text, plain element, element named as something else, element named as text.
N_KINDS = 4

_LENGTHS, _SUMS, _MEANS = [20, 60, 160, 500], [30, 120, 600, 3000], [15, 50, 150]
_LINKED = [0.05, 0.5]


class Forest:
    """The trees of several pages, without elements that hold no text."""

    def __init__(self, pages: list[Page]):
        parent, tag, group, page_of, chars, linked, marks, block = [], [], [], [], [], [], [], []
        texts = []
        for number, p in enumerate(pages):
            base = len(parent)
            parent.extend([q + base if q >= 0 else -1 for q in p.parents])
            tag.extend([_TAGS.get(t, 2) if t else -1 for t in p.tags])
            group.extend(p.groups)
            page_of.extend([number] * len(p.parents))
            block.extend(p.blocks)
            for t, n in zip(p.texts, p.links):
                if t is None:
                    chars.append(0)
                    linked.append(0)
                    marks.append(0)
                else:
                    t = t.strip()
                    chars.append(len(t))
                    linked.append(min(n, len(t)))
                    marks.append("©" in t)
                    texts.append(t)
        self.texts = texts
        parent, tag, chars = np.array(parent), np.array(tag), np.array(chars, np.int64)
        linked, group = np.array(linked, np.int64), np.array(group)
        leaf = tag < 0
        self.leaf_at = np.flatnonzero(leaf)
        depth = np.zeros(len(parent), np.int64)
        inside = np.zeros(len(parent), bool)
        article = np.isin(tag, (_TAGS["article"], _TAGS["main"]))
        order, level = [], np.flatnonzero(parent < 0)
        children = np.argsort(parent, kind="stable")
        begin = np.searchsorted(parent[children], np.arange(len(parent)))
        end = np.searchsorted(parent[children], np.arange(len(parent)), "right")
        while len(level):
            order.append(level)
            size = end[level] - begin[level]
            total = int(size.sum())
            if not total:
                break
            at = np.arange(total) + np.repeat(begin[level] - (np.cumsum(size) - size), size)
            below = children[at]
            depth[below] = len(order)
            inside[below] = inside[parent[below]] | article[parent[below]]
            level = below
        self.levels, self.parent = order, parent
        total, links, leaves = chars.copy(), linked.copy(), leaf.astype(np.int64)
        for nodes in order[:0:-1]:
            for x in (total, links, leaves):
                np.add.at(x, parent[nodes], x[nodes])
        self.total = total
        self.page, self.block = np.array(page_of)[self.leaf_at], np.array(block)[self.leaf_at]

        where, what = [], []

        def note(nodes, columns):
            where.append(nodes)
            what.append(columns)

        elements = np.flatnonzero(~leaf & (total > 0))
        note(elements, _ELEMENT + tag[elements])
        some = elements[inside[elements]]
        note(some, _ELEMENT_IN + tag[some])
        for g in range(_G):
            named = elements[(group[elements] >> g) & 1 > 0]
            note(named, np.full(len(named), _GROUP + g))
            some = named[inside[named]]
            note(some, np.full(len(some), _GROUP_IN + g))
        note(elements, _SUM_LENGTH + np.searchsorted(_SUMS, total[elements]))
        note(elements, _SUM_LINKS + np.searchsorted(_LINKED, links[elements] / total[elements]))
        note(elements, _MEAN + np.searchsorted(_MEANS, total[elements] / leaves[elements]))
        own = self.leaf_at
        above = tag[parent[own]]
        note(own, _LEAF + above)
        some = own[inside[own]]
        note(some, _LEAF_IN + tag[parent[some]])
        note(own, np.where(inside[own], _LENGTH_IN, _LENGTH) + np.searchsorted(_LENGTHS, chars[own]))
        note(own, _LINKS + np.searchsorted(_LINKED, linked[own] / np.maximum(chars[own], 1)))
        some = np.flatnonzero(marks)  # a copyright sign
        note(some, np.full(len(some), _MARKS))
        self.where, self.what = np.concatenate(where), np.concatenate(what)
        named_else = (group & ~(1 << TEXT) > 0) | np.isin(tag, [_TAGS[t] for t in _NEGATIVE_TAGS])
        named_text = (group >> TEXT & 1 > 0) | article
        self.kind = np.where(leaf, 0, np.where(named_else, 2, np.where(named_text, 3, 1)))

    def sweeps(self, weights: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of content for each node, and of each edge's (parent, child)
        state for each node but the roots (which hold zeros).  ``tables`` is
        (kinds, 2, 2), in logarithms."""
        n = len(self.parent)
        up = np.zeros((n, 2))
        up[:, 1] = np.bincount(self.where, weights[self.what], n)
        sent = np.zeros((n, 2))
        for nodes in self.levels[:0:-1]:
            t = tables[self.kind[nodes]] + up[nodes][:, None, :]
            sent[nodes] = np.logaddexp(t[:, :, 0], t[:, :, 1])
            np.add.at(up, self.parent[nodes], sent[nodes])
        full = up.copy()
        pairs = np.zeros((n, 2, 2))
        for nodes in self.levels[1:]:
            rest = full[self.parent[nodes]] - sent[nodes]
            t = tables[self.kind[nodes]] + rest[:, :, None]
            full[nodes] += np.logaddexp(t[:, 0], t[:, 1])
            t += up[nodes][:, None, :]
            t -= t.max(axis=(1, 2), keepdims=True)
            np.exp(t, out=t)
            pairs[nodes] = t / t.sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -60, 60))), pairs

    def shown(self, content: np.ndarray) -> dict[int, list[str]]:
        """Lines by page: the blocks whose texts are ``content`` (by leaf)."""
        out: dict[int, list[str]] = {}
        last = None
        for k in np.flatnonzero(content):
            page, key = int(self.page[k]), (int(self.page[k]), int(self.block[k]))
            lines = out.setdefault(page, [])
            if key == last:
                lines[-1].append(self.texts[k])
            else:
                lines.append([self.texts[k]])
            last = key
        return out


def _line(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def _labels(forest: Forest, texts: list[str]) -> np.ndarray:
    """Content or not for every node: a block's texts are content where they
    make up the page's next expected line (with or without its marked inline
    elements); an element is where most of its characters are."""
    wanted = [[x for x in (t or "").split("\n") if x] for t in texts]
    at = [0] * len(texts)
    leaf_label = np.zeros(len(forest.leaf_at), bool)
    inline = forest.kind[forest.parent[forest.leaf_at]] == 2
    k = 0
    while k < len(leaf_label):
        end = k
        while end < len(leaf_label) and forest.page[end] == forest.page[k] and forest.block[end] == forest.block[k]:
            end += 1
        page = int(forest.page[k])
        for chosen in (np.arange(k, end), np.flatnonzero(~inline[k:end]) + k):
            line = _line([forest.texts[j] for j in chosen])
            if line and line in wanted[page][at[page]: at[page] + 1]:
                leaf_label[chosen] = True
                at[page] += 1
                break
        k = end
    mass = np.zeros(len(forest.parent))
    mass[forest.leaf_at] = leaf_label * forest.total[forest.leaf_at]
    for nodes in forest.levels[:0:-1]:
        np.add.at(mass, forest.parent[nodes], mass[nodes])
    out = mass * 2 > forest.total
    out[forest.leaf_at] = leaf_label
    return out


def fit(pages: list[tuple[str, str]], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(evidence weights, edge tables) from labelled pages (html, text)."""
    forest = Forest([parse(h or "") for h, _ in pages])
    y = _labels(forest, [t for _, t in pages])
    below = np.concatenate(forest.levels[1:]) if len(forest.levels) > 1 else np.zeros(0, np.int64)
    kind, n = forest.kind[below], max(len(below), 1)
    state = 2 * y[forest.parent[below]] + y[below]
    seen = np.bincount(kind * 4 + state, minlength=4 * N_KINDS).reshape(N_KINDS, 2, 2)
    have = np.bincount(forest.what, y[forest.where], N_EVIDENCE)
    x = np.zeros(N_EVIDENCE + 4 * N_KINDS)
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        weights, tables = x[:N_EVIDENCE], x[N_EVIDENCE:].reshape(N_KINDS, 2, 2)
        p, pairs = forest.sweeps(weights, tables)
        expected = np.stack([np.bincount(kind, pairs[below, a, b], N_KINDS) for a in (0, 1) for b in (0, 1)], axis=1).reshape(N_KINDS, 2, 2)
        g = np.concatenate([have - np.bincount(forest.what, p[forest.where], N_EVIDENCE), (seen - expected).ravel()]) / n - PENALTY / len(pages) * x
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        x = x + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return x[:N_EVIDENCE], x[N_EVIDENCE:].reshape(N_KINDS, 2, 2)


def train(labelled: DataFrame, html_col: str = "html", text_col: str = "text", most: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """A model from a table of labelled pages, ``text`` holding a page's main
    blocks as lines.  Pages that repeat count once; of more than ``most``, those
    with the smallest hashes are taken."""
    rows = labelled.select(F.col(html_col).alias("html"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("html IS NOT NULL")
    drawn = rows.groupBy(F.xxhash64("html").alias("h")).agg(F.min(F.struct("html", "text")).alias("page")).orderBy("h").limit(most)
    return fit([(r.page.html, r.page.text) for r in drawn.collect()])


def texts_of(htmls: list[str], weights: np.ndarray, tables: np.ndarray) -> list[str]:
    """Main texts, a line a block."""
    forest = Forest([parse(h) for h in htmls])
    p, _ = forest.sweeps(weights, tables)
    shown = forest.shown(p[forest.leaf_at] >= 0.5)
    return ["\n".join(line for parts in shown.get(k, ()) if (line := _line(parts))) for k in range(len(htmls))]


def extract(pages: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text (the main text: blocks in page
    order, white space inside a block as one space, joined by a line feed).

    The model is trained from ``labelled`` (see :func:`train`), by default from
    the drawn layouts of :mod:`limnos.llm.labelled_pages`; pages are read where
    they lie, nothing is shuffled.  A null or empty page has an empty text;
    null ids and urls stay; repeated rows are rows like any other; other
    columns play no part; an empty table gives no rows."""
    weights, tables = fit(labelled_pages()) if labelled is None else train(labelled)
    model = pages.sparkSession.sparkContext.broadcast((weights.tolist(), tables.ravel().tolist()))

    def batch(b: pa.RecordBatch):
        w, t = np.array(model.value[0]), np.array(model.value[1]).reshape(N_KINDS, 2, 2)
        htmls, texts, part, size = b.column("html").to_pylist(), [], [], 0
        for k, h in enumerate(htmls):
            part.append(h)
            size += len(h)
            if size >= PART_CHARS or k + 1 == len(htmls):
                texts.extend(texts_of(part, w, t))
                part, size = [], 0
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return by_batch(rows, batch, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string")
