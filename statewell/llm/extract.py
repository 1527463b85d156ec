"""Main text of pages by a tree-structured graphical model.

Every node of a page's DOM is content or not. Potentials on parent and child (by the child's tag) and on what a node
shows (class and id words, length and links of its text) come from counts over labelled pages. Sum-product messages go
up the tree and down again, which gives every node its exact marginal; texts more likely content than not are kept. Where a page has none, as some main
text is likely there, those from half the largest marginal up are kept, if that is above 0.1.

Definitions:
* null and empty pages have an empty text; every row gives one row, repeated rows included;
* character references are decoded; white space inside a block becomes one space; blocks are joined in page order by one
  newline; an inline element or <br> ends no block; scripts, styles, titles and comments are no text;
* unclosed and stray tags are read as far as they go; only id, url and html are read, so other columns cannot clash;
* an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewell.llm.labelled_pages import PAGES, TEXTS
from statewell.llm.pages import BLOCK, Node, parse

NAMED = re.compile(r"[a-z]+|[A-Z][a-z]*")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
REGION = frozenset("body article section div main aside nav header footer form td".split())
PSEUDO = 0.15
SOFT = 0.4


def names_of(node: Node) -> set[str]:
    """Words of class, id, role, itemprop and label; "hidden" for what is not shown."""
    out: set[str] = set()
    attrs = node.attrs
    if not attrs:
        return out
    for key in ("class", "id", "role", "itemprop", "aria-label"):
        if key in attrs:
            out.update(w.lower() for w in NAMED.findall(attrs[key]) if len(w) > 1)
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style", "")):
        out.add("hidden")
    return out


def shown(nodes: list[Node]) -> list[tuple[str, ...]]:
    """Of each region, how much text is its own (in no region inside it) and how much of that is links, in classes.

    Single paragraphs show nothing: many alike in one region would count as so many proofs.
    """
    n = len(nodes)
    region, link, own, linked = [0] * n, [False] * n, [0] * n, [0] * n
    for i, node in enumerate(nodes):
        if i:
            region[i] = i if node.tag in REGION else region[node.parent]
            link[i] = node.tag == "a" or link[node.parent]
        if node.tag == "" and node.text.strip():
            words = node.text.count(" ") + 1
            own[region[i]] += words
            linked[region[i]] += words * link[i]
    out: list[tuple[str, ...]] = [()] * n
    for i, node in enumerate(nodes):
        if node.tag in REGION:
            size = 0 if not own[i] else 1 if own[i] <= 30 else 2 if own[i] <= 100 else 3
            out[i] = (f"own{size}", f"links{min(3, 4 * linked[i] // own[i])}") if size else ("own0",)
    return out


class Model:
    """Log potentials from counts: ``step[tag]`` on (parent, child), ``sign[name]`` and ``look[class]`` on a node."""

    def __init__(self) -> None:
        step: dict[str, list[list[float]]] = defaultdict(lambda: [[PSEUDO * 3, PSEUDO], [PSEUDO, PSEUDO * 3]])
        sign: dict[str, list[float]] = defaultdict(lambda: [PSEUDO, PSEUDO])
        look: dict[str, list[float]] = defaultdict(lambda: [2.0, 2.0])
        total = [1.0, 1.0]
        for page in PAGES:
            nodes = parse(re.sub(r"(?<![\w\"=-])([SML])(?![\w\"])", lambda m: TEXTS[m.group()], page))
            label = [0] * len(nodes)
            for i, (node, classes) in enumerate(zip(nodes, shown(nodes))):
                if i:
                    label[i] = int(node.attrs.get("m", label[node.parent]))
                    for tag in (node.tag, "*"):
                        step[tag][label[node.parent]][label[i]] += 1 if tag != "*" else 0.02
                total[label[i]] += 1
                # a name speaks where it starts a region, not for every node inside
                for name in names_of(node):
                    sign[name][label[i]] += 1
                for c in classes:
                    look[c][label[i]] += 1
        self.step = {t: [[math.log(x / sum(row)) for x in row] for row in m] for t, m in step.items()}
        odds = math.log(total[1] / total[0])
        self.sign = {k: math.log(b / a) for k, (a, b) in sign.items()}
        self.look = {k: SOFT * (math.log(b / a) - odds) for k, (a, b) in look.items()}

    def named(self, name: str) -> float:
        """A name's log odds; a longer one counts as the known name that it starts with."""
        if name in self.sign:
            return self.sign[name]
        for cut in range(len(name) - 1, 3, -1):
            if name[:cut] in self.sign:
                return self.sign[name[:cut]]
        return 0.0

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for each node: messages up, then down."""
        n = len(nodes)
        step = {t: [[math.exp(x) for x in row] for row in m] for t, m in self.step.items()}
        other = step["*"]
        off, on = [1.0] * n, [1.0] * n
        for i, (node, classes) in enumerate(zip(nodes, shown(nodes))):
            log_odds = sum(self.look.get(c, 0.0) for c in classes)
            if node.attrs:
                log_odds += sum(self.named(x) for x in names_of(node))
            if log_odds:
                on[i] = math.exp(max(-8.0, min(8.0, log_odds)))
        up0, up1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            (a, b), (c, d) = step.get(nodes[i].tag, other)
            x, y, parent = off[i], on[i], nodes[i].parent
            u0, u1 = a * x + b * y, c * x + d * y
            s = u0 + u1
            up0[i], up1[i] = u0 / s, u1 / s
            x, y = off[parent] * up0[i], on[parent] * up1[i]
            s = x + y
            off[parent], on[parent] = x / s, y / s
        down0, down1, out = [1.0] * n, [1.0] * n, [0.0] * n
        down0[0], down1[0] = 0.98, 0.02
        for i in range(n):
            if i:
                parent = nodes[i].parent
                (a, b), (c, d) = step.get(nodes[i].tag, other)
                x, y = down0[parent] * off[parent] / up0[i], down1[parent] * on[parent] / up1[i]
                u0, u1 = x * a + y * c, x * b + y * d
                s = u0 + u1
                down0[i], down1[i] = u0 / s, u1 / s
            x, y = down0[i] * off[i], down1[i] * on[i]
            s = x + y
            out[i] = y / s
        return out


def main_text(page: str | None, model: Model) -> str:
    """The kept texts, one line a block."""
    if not page:
        return ""
    nodes = parse(page)
    keep = model.marginals(nodes)
    most = max((k for k, node in zip(keep, nodes) if node.tag == "" and not node.text.isspace()), default=0.0)
    limit = 0.5 if most >= 0.5 else max(0.1, most / 2)
    block = [0] * len(nodes)
    lines: list[str] = []
    held: list[str] = []
    now = -1

    def flush() -> None:
        line = " ".join("".join(held).split())
        if line:
            lines.append(line)
        held.clear()

    for i, node in enumerate(nodes):
        if node.tag in BLOCK:
            block[i] = i
            flush()
        elif i:
            block[i] = block[node.parent]
        if node.tag == "br" or node.tag == "wbr":
            held.append(" " if node.tag == "br" else "")
        elif node.tag == "" and keep[i] >= limit:
            if block[i] != now:
                flush()
                now = block[i]
            held.append(node.text)
    flush()
    return "\n".join(lines)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)`` for every page; one pass, no shuffle."""
    model = Model()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), model) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["key", "url", "text", "n_chars"],
            )

    source = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    done = source.mapInArrow(read, f"key {kinds['key']}, url {kinds['url']}, text string, n_chars long")
    return done.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
