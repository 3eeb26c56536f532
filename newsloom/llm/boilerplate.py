"""Problem 4: the article's own paragraphs among the matter of its page.

Each page is a graph. Its nodes are the lines of the extracted content, each tied to the block of the page source that
holds its text. A classifier gives each line the cost of calling it content and of calling it page matter: these are the
capacities of its edges to source and sink. Lines that stand next to each other and lines whose blocks share a parent in
the DOM are joined by smoothness edges. A minimum cut separates the article from the rest.

The classifier is a logistic regression over how the line reads (against paragraphs of accepted articles) and where its
block stands in the DOM. It is fitted on bounded samples: SAMPLE_TEXTS accepted texts for how articles read, and
SAMPLE_PAGES pages for the weights, labelled by the lines whose wording alone leaves no doubt. Every page is then
labelled whole, in one pass without a shuffle.
"""

from __future__ import annotations

import html
import math
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.values import is_stand_in

SAMPLE_TEXTS, SAMPLE_PAGES = 6_000, 2_000
START_CHARS = 20
CUT_END = regex.compile(r"\s*(?:…|\.\.\.|\[\.\.\.\]|\(more\))\s*$")
NEXT_LINE, SAME_PARENT = 0.45, 0.35  # smoothness, in units of the classifier's log-odds

_TOKEN = regex.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b([^>]*)>|<![^>]*>", regex.S | regex.I)
_CLASS = regex.compile(r"""\bclass\s*=\s*["']?([^"'>]*)""", regex.I)
# Elements that do not interrupt a line of text, and elements without an end tag.
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PAGE_PARTS = frozenset("nav header footer aside form button".split())
_SPACE = regex.compile(r"[\s ]+")
_JOINT = regex.compile(r"\s[·|•»]\s|\s*[|·•]\s*")
_WORD = regex.compile(r"\p{L}+|\p{N}+")
_SENTENCE = regex.compile(r"(?<=[.!?])\s+")
_END = regex.compile(r"[.!?。…][\"'”’»)]*$")


def clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


@dataclass
class Block:
    text: str
    tag: str
    parent: int  # number of the parent element
    kind: str  # tag and class of the parent, for elements that repeat
    in_part: bool
    link_share: float


def blocks_of(source: str) -> list[Block]:
    """Texts of the block-level elements in document order. Wrongly nested and unclosed tags are tolerated."""
    out: list[Block] = []
    stack: list[tuple[str, int, str, bool]] = [("", 0, "", False)]
    n_elements, at = 0, 0
    parts: list[str] = []
    linked = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        t = clean(html.unescape("".join(parts)))
        if t:
            tag, _, _, inside = stack[-1]
            up = stack[-2] if len(stack) > 1 else stack[-1]
            out.append(Block(t, tag, up[1], up[2], inside, min(1.0, linked / max(1, len(t)))))
        parts.clear()
        linked = 0

    for m in _TOKEN.finditer(source):
        if m.start() > at:
            raw = source[at : m.start()]
            parts.append(raw)
            if in_link:
                linked += len(raw.strip())
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m[2] else 1
                if stack[-1][0] not in ("p", "li", "h1", "h2", "h3", "td", "blockquote"):
                    flush()  # links of a menu or rail are texts of their own
            elif tag == "span" and stack[-1][0] == "div":
                flush()
            continue
        flush()
        if tag in VOID:
            continue
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            in_link = 0
        else:
            if stack[-1][0] == "p" or (tag == "li" and stack[-1][0] == "li"):
                stack.pop() if len(stack) > 1 else None  # an unclosed paragraph or item ends here
            n_elements += 1
            cls = _CLASS.search(m[4])
            stack.append((tag, n_elements, f"{tag}.{cls[1].strip() if cls else ''}", stack[-1][3] or tag in PAGE_PARTS))
    if at < len(source):
        parts.append(source[at:])
    flush()
    return out


def pairs_of(line: str) -> list[str]:
    """A line's word pairs; numbers count as one word. The first word of a sentence pairs with its start."""
    out = []
    for sentence in _SENTENCE.split(line):
        last = "^"
        for w in _WORD.findall(sentence):
            w = "0" if w[0].isdigit() else w.casefold()
            out.append(f"{last} {w}")
            last = w
    return out


FEATURES = ("bias", "familiar", "strange", "words", "ended", "found", "linked", "listed", "paragraph", "part", "repeated", "mass", "main", "headline")


def features(content: str, source: str, familiar: frozenset[str], headlines: frozenset[str]) -> tuple[list[str], np.ndarray, list[int]]:
    """(lines, one row of FEATURES for each, number of each line's parent element or -1)."""
    lines = content.split("\n")
    blocks = blocks_of(source)
    by_text: dict[str, list[Block]] = defaultdict(list)
    mass: Counter = Counter()
    kinds: dict[str, set[int]] = defaultdict(set)
    by_start: dict[str, list[Block]] = defaultdict(list)
    for b in blocks:
        by_text[b.text].append(b)
        by_start[b.text[:START_CHARS]].append(b)
        kinds[b.kind].add(b.parent)
    read: list[tuple[float, int, float]] = []
    met: list[Block | None] = []
    for line in lines:
        t = clean(line)
        p = pairs_of(t)
        known = sum(x in familiar for x in p) / len(p) if p else 0.0
        read.append((known, len(p), sum(x in headlines and x not in familiar for x in p) / len(p) if p else 0.0))
        b = next(iter(by_text.get(t, ())), None)
        if b is None and t:
            some = [by_text[x][0] for x in (clean(y) for y in _JOINT.split(t)) if x in by_text]
            b = some[0] if some else None
            if b is None and len(t) >= START_CHARS:  # a line that was cut short
                own = CUT_END.sub("", t)
                b = next((x for x in by_start.get(t[:START_CHARS], ()) if x.text.startswith(own)), None)
        met.append(b)
        if b is not None:
            mass[b.parent] += known * len(p)
    total = sum(mass.values()) or 1.0
    main = max(mass, key=lambda k: (mass[k], -k)) if mass else -1
    rows = np.zeros((len(lines), len(FEATURES)))
    parents = []
    for k, (line, (known, n, heading), b) in enumerate(zip(lines, read, met)):
        t = clean(line)
        row = [1.0, known, 1.0 if known < 0.6 else 0.0, math.log1p(min(n, 80)), 1.0 if _END.search(t) else 0.0]
        if b is None:
            row += [0.0] * 8 + [heading]
            parents.append(-1)
        else:
            row += [
                1.0, b.link_share, 1.0 if b.tag in ("li", "a", "ul", "div", "span") else 0.0, 1.0 if b.tag == "p" else 0.0,
                1.0 if b.in_part else 0.0, 1.0 if len(kinds[b.kind]) > 1 else 0.0, mass[b.parent] / total, 1.0 if b.parent == main else 0.0, heading,
            ]
            parents.append(b.parent)
        rows[k] = row
    return lines, rows, parents


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights by Newton's method with a ridge penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least energy: a node pays |unary| for going against its sign, an edge its weight if cut.

    Nodes that outweigh all their edges are settled first, exactly; the rest goes to max-flow by shortest augmenting
    paths.
    """
    n = len(unary)
    pull = list(unary)
    near: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] += w
            near[b][a] += w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        k = todo.popleft()
        if label[k] is not None or abs(pull[k]) < sum(near[k].values()):
            continue
        label[k] = pull[k] >= 0
        for j, w in near[k].items():
            pull[j] += w if label[k] else -w
            near[j].pop(k, None)
            todo.append(j)
        near[k].clear()
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        s, t = n, n + 1
        cap: dict[int, dict[int, float]] = {k: defaultdict(float) for k in [*rest, s, t]}
        for k in rest:
            if pull[k] >= 0:
                cap[s][k] += pull[k]
                cap[k][s] += 0
            else:
                cap[k][t] += -pull[k]
                cap[t][k] += 0
            for j, w in near[k].items():
                cap[k][j] += w
        while True:
            back = {s: s}
            queue = deque([s])
            while queue and t not in back:
                u = queue.popleft()
                for v, c in cap[u].items():
                    if c > 1e-12 and v not in back:
                        back[v] = u
                        queue.append(v)
            if t not in back:
                break
            path, v = [], t
            while v != s:
                path.append((back[v], v))
                v = back[v]
            flow = min(cap[a][b] for a, b in path)
            for a, b in path:
                cap[a][b] -= flow
                cap[b][a] += flow
        for k in rest:
            label[k] = k in back
    return [bool(x) for x in label]


@dataclass(frozen=True)
class Model:
    familiar: frozenset[str]  # word pairs of accepted paragraphs
    headlines: frozenset[str]  # word pairs of headlines
    weights: tuple[float, ...]


def label_lines(content: str, source: str, model: Model) -> list[bool | None]:
    """For each line of the content: True if it is the article's, False if the page's, None if it has no text.

    A content that is a stand-in for a missing value has neither.
    """
    lines = content.split("\n")
    if is_stand_in(content):
        return [None] * len(lines)
    lines, rows, parents = features(content, source, model.familiar, model.headlines)
    odds = rows @ np.array(model.weights)
    full = [k for k, line in enumerate(lines) if line.strip()]
    edges = [(a, b, NEXT_LINE) for a, b in zip(range(len(full)), range(1, len(full)))]
    last: dict[int, int] = {}
    for a, k in enumerate(full):
        if parents[k] >= 0:
            if parents[k] in last:
                edges.append((last[parents[k]], a, SAME_PARENT))
            last[parents[k]] = a
    own = min_cut([float(odds[k]) for k in full], edges)
    out: list[bool | None] = [None] * len(lines)
    for k, x in zip(full, own):
        out[k] = x
    return out


def _some(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows (where a hash of the key leaves fewer, those), the same ones whatever the layout: those with the least
    hashes, of which a bound on the hash lets only half as many again through to the sort."""
    share = min(1.0, 1.5 * n / max(1, df.count()))
    h = F.pmod(F.xxhash64(key), F.lit(1_000_000_007))
    return df.where(h < F.lit(int(share * 1_000_000_007) + 1)).orderBy(h, key).limit(n)


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen, heads = Counter(), Counter()
        for t, title in zip(pdf["text"], pdf["title"]):
            if not is_stand_in(title):
                heads.update(set(pairs_of(clean(title))))
            if not is_stand_in(t):
                seen.update({p for line in t.split("\n") for p in pairs_of(clean(line))})
        yield pd.DataFrame([(k, p, n) for k, c in ((False, seen), (True, heads)) for p, n in c.items()], columns=["head", "pair", "n"])


def word_pairs(texts: DataFrame, texts_a_pair: int) -> tuple[frozenset[str], frozenset[str]]:
    """Word pairs of all texts(text, title) and those of their titles, each that stands in two of every `texts_a_pair`
    texts or in one of fewer than half as many: so they are at most as many as that share of an average text allows."""
    clean_texts = texts.where(F.col("text").isNotNull()).select("text", "title")
    least = 2 * clean_texts.count() / texts_a_pair
    counts = clean_texts.mapInPandas(_count_pairs, "head boolean, pair string, n bigint").groupBy("head", "pair").agg(F.sum("n").alias("n"))
    kept = counts.where(F.col("n") >= least).select("head", "pair").collect()
    return frozenset(x["pair"] for x in kept if not x["head"]), frozenset(x["pair"] for x in kept if x["head"])


def fit(pages: DataFrame, texts: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_pages: int = SAMPLE_PAGES) -> Model:
    """The classifier, from the word pairs of texts(id, text, title), which are clean, and a bounded sample of
    pages(doc, source, content)."""
    familiar, headlines = word_pairs(texts, sample_texts)
    xs, ys = [], []
    whole = pages.where(F.col("doc").isNotNull() & F.col("source").isNotNull() & F.col("content").isNotNull())
    for content, source in _some(whole, "doc", sample_pages).select("content", "source").collect():
        if is_stand_in(content):
            continue
        _, rows, _ = features(content, source, familiar, headlines)
        for r in rows:
            if r[1] >= 0.85 and r[3] >= math.log1p(8) and r[4]:
                xs.append(r)
                ys.append(1.0)
            elif r[3] > 0 and (r[1] < 0.5 or (r[6] > 0.9 and not r[4])):
                xs.append(r)
                ys.append(0.0)
    if len(set(ys)) < 2:  # nothing to learn from: how a line reads and whether it is a link
        return Model(familiar, headlines, (-4.0, 6.0, -1.0, 0.5, 0.5, 0.0, -2.0, -0.5, 0.5, -1.0, -0.5, 0.5, 0.5, -4.0))
    return Model(familiar, headlines, tuple(fit_logistic(np.array(xs), np.array(ys)).tolist()))


def page_lines(pages: DataFrame, model: Model) -> DataFrame:
    """(doc, line_no) of the lines that are not the article's, in pages(doc, source, content). Rows with a NULL in any
    of them and contents that are stand-ins give none."""
    handle = pages.sparkSession.sparkContext.broadcast(model)  # bounded by the share of texts asked of a word pair

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (d, k + 1)
                for d, s, c in zip(pdf["doc"], pdf["source"], pdf["content"])
                for k, own in enumerate(label_lines(c, s, handle.value))
                if own is False
            ]
            yield pd.DataFrame(rows, columns=["doc", "line_no"])

    whole = pages.where(F.col("doc").isNotNull() & F.col("source").isNotNull() & F.col("content").isNotNull())
    return whole.select("doc", "source", "content").mapInPandas(label, "doc bigint, line_no int")


def text_of(source: str) -> str:
    """All texts of a page, a line for each block."""
    return "\n".join(b.text for b in blocks_of(source))


def main_text(pages: DataFrame, model: Model) -> DataFrame:
    """(doc, text): the article's lines of pages(doc, source, content) only; empty if the page holds none of it.

    Where the content is NULL or a stand-in, the lines are the blocks of the page source. Rows without an id or a source
    give none.
    """
    handle = pages.sparkSession.sparkContext.broadcast(model)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for s, c in zip(pdf["source"], pdf["content"]):
                c = text_of(s) if is_stand_in(c) else c
                texts.append("\n".join(x for x, own in zip(c.split("\n"), label_lines(c, s, handle.value)) if own))
            yield pd.DataFrame({"doc": pdf["doc"], "text": texts})

    whole = pages.where(F.col("doc").isNotNull() & F.col("source").isNotNull())
    return whole.select("doc", "source", "content").mapInPandas(cut, "doc bigint, text string")
