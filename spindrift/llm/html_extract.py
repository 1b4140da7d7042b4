"""Main-text extraction by a tree-structured graphical model.

The nodes of a page's block tree are binary variables (content or not). Each node has a potential from its
features, each edge one that couples parent and child. Sum-product messages go from the leaves to the root and
back; the exact marginals decide which runs of text are content. Weights are learned by maximum likelihood (the same
marginals give the exact gradient) from labelled pages: pages of many layouts drawn by rule, whose runs are marked.
"""

from __future__ import annotations

from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .html_pages import labelled_pages
from .html_tree import Tree

TRAIN_PAGES = 1500
EPOCHS = 6
_CONTAINERS = frozenset("#root html body article aside div dl details fieldset figure footer form header main menu nav ol section table tbody thead tfoot tr ul center".split())
_SECTIONS = frozenset("article main section nav aside header footer form".split())
_END = frozenset(".!?…。:;\"'»”’)")


def _step(x: float, bounds: tuple) -> int:
    return sum(x > b for b in bounds)


def features(tree: Tree) -> list[list[str]]:
    """Names of each node's features."""
    size = len(tree.tag)
    chars, linked, runs = [len(t) for t in tree.text], list(tree.linked), [t == "#text" for t in tree.tag]
    runs = [int(r) for r in runs]
    for i in range(size - 1, 0, -1):
        p = tree.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        runs[p] += runs[i]
    total, before = chars[0] or 1, 0
    within, seen = ["none"] * size, set()
    out = []
    for i in range(size):
        tag, n = tree.tag[i], chars[i]
        if i:
            within[i] = within[tree.parent[i]]
        first = tag not in seen
        seen.add(tag)
        if tag in _SECTIONS:
            within[i] = f"{tag}-{'first' if first else 'later'}"
        density = _step(linked[i] / n, (0.0, 0.3, 0.7)) if n else 4
        if tag == "#text":
            text = tree.text[i]
            words = _step(text.count(" "), (0, 2, 5, 10, 20, 40))
            owner = tree.tag[tree.parent[i]]
            found = [
                "#text", f"link{density}", f"words{words}", f"owner-{owner}", f"end{text[-1] in _END}", f"end{text[-1] in _END}-words{words}",
                f"within-{within[i]}", f"within-{within[i]}-words{words}",
                f"place{_step(before / total, (0.03, 0.1, 0.9, 0.97))}", f"mark{text[0] in '©®™' or '©' in text[:40]}",
            ]
            before += n
        else:
            found = [
                f"<{tag}>", f"within-{within[i]}", f"first{first}-<{tag}>", f"all-link{density}", f"all-chars{_step(n / total, (0.02, 0.1, 0.3, 0.6))}",
                f"all-mean{_step(n / runs[i], (8, 20, 50, 100, 200)) if runs[i] else 9}", *(f".{x}" for x in tree.names[i]), *(f".{x[:4]}~" for x in tree.names[i] if len(x) > 4),
            ]
        out.append(found)
    return out


def edge_kind(tree: Tree, child: int) -> int:
    """Which coupling an edge has: by the child (run, container, other block) and whether the parent is the page's frame."""
    tag = tree.tag[child]
    kind = 0 if tag == "#text" else 1 if tag in _CONTAINERS else 2
    return kind + 3 * (tree.tag[tree.parent[child]] in ("#root", "html", "body"))


EDGES = 6


def _odds(low0: float, low1: float, high0: float, high1: float, x: float) -> float:
    """log((e^high0 + e^(high1 + x)) / (e^low0 + e^(low1 + x)))"""
    x = 30.0 if x > 30 else -30.0 if x < -30 else x
    e = exp(x)
    return log((exp(high0) + exp(high1) * e) / (exp(low0) + exp(low1) * e))


def sum_product(parent: list[int], kinds: list[int], unary: list[float], coupling) -> tuple[list[float], list[float], list[float]]:
    """Exact beliefs as log odds of content, and for each edge the log odds of its ends without it.

    Upward: every node gathers its children's messages before it sends its own; downward: a child gets
    what its parent believes without the child's own message.
    """
    size = len(parent)
    gathered, sent = list(unary), [0.0] * size
    for i in range(size - 1, 0, -1):
        c = coupling[kinds[i]]
        sent[i] = _odds(c[0][0], c[0][1], c[1][0], c[1][1], gathered[i])
        gathered[parent[i]] += sent[i]
    belief, outside = list(gathered), [0.0] * size
    for i in range(1, size):
        c = coupling[kinds[i]]
        outside[i] = belief[parent[i]] - sent[i]
        belief[i] = gathered[i] + _odds(c[0][0], c[1][0], c[0][1], c[1][1], outside[i])
    return belief, gathered, outside


def _sigmoid(x: float) -> float:
    return 1 / (1 + exp(-x)) if x > -700 else 0.0


class Model:
    """Weights by feature name, and coupling[kind][parent][child]."""

    def __init__(self, weights: dict[str, float] | None = None, coupling=None):
        self.weights = weights or {}
        self.coupling = coupling or [[[0.0, 0.0], [0.0, 0.0]] for _ in range(EDGES)]

    def marginals(self, tree: Tree) -> list[float]:
        """Probability of content of every node."""
        get = self.weights.get
        unary = [sum([get(f, 0.0) for f in found]) for found in features(tree)]
        kinds = [0, *(edge_kind(tree, i) for i in range(1, len(tree.tag)))]
        return [_sigmoid(b) for b in sum_product(tree.parent, kinds, unary, self.coupling)[0]]

    def text(self, source: str | None) -> str:
        """The runs that are content with a probability over one half, in page order."""
        if not source:
            return ""
        tree = Tree(source)
        chosen = self.marginals(tree)
        return "\n".join(t for t, tag, p in zip(tree.text, tree.tag, chosen, strict=True) if tag == "#text" and p > 0.5)


def node_labels(tree: Tree, is_content) -> list[int]:
    """A run is content if ``is_content`` says so of its text; an element if at least half of its characters are."""
    share = [[0, 0] for _ in tree.tag]
    for i, tag in enumerate(tree.tag):
        if tag == "#text":
            share[i] = [len(tree.text[i]) * is_content(tree.text[i]), len(tree.text[i])]
    for i in range(len(share) - 1, 0, -1):
        share[tree.parent[i]][0] += share[i][0]
        share[tree.parent[i]][1] += share[i][1]
    return [int(a * 2 >= n and n > 0) for a, n in share]


def fit(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 3, rate: float = 0.15, decay: float = 2e-4) -> Model:
    """Maximum likelihood on drawn pages by adaptive gradient steps; names rarer than 4 pages get no weight."""
    examples, seen = [], {}
    for source, is_content in labelled_pages(pages, seed):
        tree = Tree(source)
        found = features(tree)
        for f in {f for node in found for f in node}:
            seen[f] = seen.get(f, 0) + 1
        kinds = [0, *(edge_kind(tree, i) for i in range(1, len(tree.tag)))]
        examples.append((tree.parent, kinds, found, node_labels(tree, is_content)))
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 4))}
    examples = [(p, k, [[index[f] for f in node if f in index] for node in found], y) for p, k, found, y in examples]
    weight, past = np.zeros(len(index)), np.full(len(index), 1e-2)
    couple, couple_past = np.zeros((EDGES, 2, 2)), np.full((EDGES, 2, 2), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for e in rng.permutation(len(examples)):
            parent, kinds, found, label = examples[e]
            w, c = weight.tolist(), couple.tolist()
            unary = [sum([w[f] for f in node]) for node in found]
            belief, inside, outside = sum_product(parent, kinds, unary, c)
            step, couple_step = np.zeros(len(index)), np.zeros((EDGES, 2, 2))
            for node, b, y in zip(found, belief, label, strict=True):
                step[node] += y - _sigmoid(b)
            for i in range(1, len(parent)):
                k = kinds[i]
                joint = np.exp(
                    np.clip(couple[k] + np.array([[0.0, inside[i]], [outside[i], inside[i] + outside[i]]]), -60, 60)
                )
                couple_step[k] -= joint / joint.sum()
                couple_step[k, label[parent[i]], label[i]] += 1
            for value, total, g in ((weight, past, step - decay * weight), (couple, couple_past, couple_step - decay * couple)):
                total += g * g
                value += rate * g / np.sqrt(total)
    return Model({f: float(weight[i]) for f, i in index.items()}, couple.tolist())


@lru_cache(maxsize=1)
def trained() -> Model:
    return fit()


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    White space inside a block becomes one space, blocks are joined by a newline. Defined cases: null or empty html
    gives an empty text; markup that is never closed ends with the page; repeated rows give repeated rows; an empty
    table gives no rows; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches):
        for batch in batches:
            texts = [shared.value.text(h.as_py()) for h in batch.column("html")]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    thin = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(thin, run, "page_id long, url string, text string, n_chars long")
