"""Problem 10: oversized items as pieces within a limit, cut at natural boundaries and overlapping.

A text is parsed into a tree: sections under headings (by level), blocks between blank lines or block tags of left-over
markup, list items and items within items, lines (table rows), sentences, words. A node that fits the limit is one unit;
sibling units are merged from the left up to the limit; only a node that is itself over the limit is opened, and what
comes of it is never merged with its siblings, so no piece holds the end of one opened section and the start of the
next. A heading stays with what follows it, and so does the start of a text that holds fewer tokens than are to be
shared. Cuts fall where white space or sentence punctuation ends a word of the tokenizer's pattern, so a text is encoded
once and the tokens of any span are a difference of two sums. Only a single word over the limit is cut between its
tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.tokens import count, encoding, vocabulary_path

OUT = "doc_id bigint, piece_no int, char_from int, char_to int, n_tokens int, n_shared int, piece string"

WORD, SENTENCE, LINE, INNER_ITEM, ITEM, BLOCK, SECTION = range(7)  # section levels go on upwards: 6 for ######, 11 for #
INSIDE = -1  # within a word
SLACK = 8  # tokens that a shared part may hold over what was asked
_HEADING = regex.compile(r"(?:(?<=\n)|^)(#{1,6})[ \t]")
_MARKER = regex.compile(r"(?:(?<=\n)|^)([ \t]*)(?:[-*+•‣]|\d{1,3}[.)])[ \t]")
_MARKUP = regex.compile(r"<(/?)(p|div|li|ul|ol|tr|table|section|article|blockquote|h[1-6]|br)\b[^<>]{0,200}>", regex.I)
_CJK_END = regex.compile(r"[。！？]+[」』）]*")
# The characters that count as white space in the tokenizer's pattern.
_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
_ENDS = np.array([ord(c) for c in ".!?…"], dtype=np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"'”’»)]*_"], dtype=np.uint32)


def _marked(text: str) -> dict[tuple[int, int], int]:
    """How strongly the text pauses before a heading, list item or opening tag (1, where it starts) and behind a closing
    tag or line break (0, where it ends)."""
    out: dict[tuple[int, int], int] = {}
    for m in _MARKER.finditer(text):
        out[(1, m.end(1))] = INNER_ITEM if m[1] else ITEM
    if "#" in text:
        for m in _HEADING.finditer(text):
            out[(1, m.start())] = SECTION + 6 - len(m[1])
    if "<" in text:
        for m in _MARKUP.finditer(text):
            tag = m[2].lower()
            level = LINE if tag == "br" else ITEM if tag in ("li", "tr") else SECTION + 6 - int(tag[1]) if tag[0] == "h" and not m[1] else BLOCK
            out[(0, m.end()) if m[1] or tag == "br" else (1, m.start())] = level
    return out


def _is_heading(line: str) -> bool:
    line = line.strip()
    return "\n" not in line and (_HEADING.match(line) is not None or regex.match(r"<h[1-6]\b", line, regex.I) is not None)


def cut_points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which the text may be cut, and how strongly it pauses there. Neither end is included.

    Every position lies behind a character that is no white space and before white space, or behind a sentence mark of
    a script without spaces: there the tokenizer's words end too.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    space = np.isin(codes, _SPACES)
    starts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    after = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if space[0]:
        after = after[1:]
    starts = starts[: len(after)]  # a run of white space at the end has nothing after it
    newlines = np.concatenate([[0], np.cumsum(codes == 10)])
    breaks = newlines[after] - newlines[starts]
    last = starts - 1
    for _ in range(3):
        last = np.where((last > 0) & np.isin(codes[last], _CLOSERS), last - 1, last)
    strength = np.where(breaks > 1, BLOCK, np.where(breaks == 1, LINE, np.where(np.isin(codes[last], _ENDS), SENTENCE, WORD)))
    known = _marked(text)
    if known:
        before, behind = starts.tolist(), after.tolist()
        for k in range(len(before)):
            own = max(known.get((0, before[k]), -1), known.get((1, behind[k]), -1) if breaks[k] or (1, behind[k]) in known else -1)
            if own >= 0 and (own >= BLOCK or breaks[k] < 2 or own == INNER_ITEM):
                strength[k] = own
    if n and codes.max() >= 0x3002:
        extra = [m.end() for m in _CJK_END.finditer(text) if m.end() < n and text[m.end()].isalpha()]
        if extra:
            starts = np.concatenate([starts, np.array(extra, dtype=starts.dtype)])
            strength = np.concatenate([strength, np.full(len(extra), SENTENCE)])
            order = np.argsort(starts, kind="stable")
            starts, strength = starts[order], strength[order]
    return starts, strength


@lru_cache(maxsize=4)
def _token_bytes(enc) -> np.ndarray:
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], dtype=np.int64)


def _byte_positions(text: str) -> np.ndarray | None:
    """Bytes before each character, or None where characters are bytes."""
    if text.isascii():
        return None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    widths = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    return np.concatenate([[0], np.cumsum(widths)])


def _hard_cuts(enc, text: str, a: int, b: int, limit: int) -> list[tuple[int, int]]:
    """A word over the limit as (end, tokens) of spans of at most `limit` tokens, cut between characters.

    A character never has more tokens than bytes, so every span holds at least one character unless the limit is below
    four tokens.
    """
    out = []
    while a < b:
        ids = enc.encode_ordinary(text[a : min(b, a + 16 * limit)])
        if a + 16 * limit >= b and len(ids) <= limit:
            out.append((b, len(ids)))
            break
        k = min(len(ids), limit)
        while True:
            end = a + max(1, len(enc.decode_bytes(ids[:k]).decode("utf-8", "ignore")))
            n = count(enc, text[a:end])
            if n <= limit or end == a + 1:
                break
            k -= 1
        out.append((end, n))
        a = end
    return out


def split_text(enc, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(from, to, tokens, tokens shared with the piece before) of the pieces of a text; one piece if it is in the limit.

    Every piece has at most `limit` tokens. From the second on, it begins with the end of the piece before: the fewest
    whole words that hold `overlap` tokens, or, where those hold over SLACK more, the shortest text that does.
    """
    ids = enc.encode_ordinary(text)
    if len(ids) <= limit:
        return [(0, len(text), len(ids), 0)]
    at, strength = cut_points(text)
    edges = np.concatenate([[0], at, [len(text)]])
    before = np.concatenate([[0], np.cumsum(_token_bytes(enc)[np.array(ids)])])
    widths = _byte_positions(text)
    total = np.searchsorted(before, edges if widths is None else widths[edges]).tolist()
    pauses = [SECTION + 6, *strength.tolist()]
    edges = edges.tolist()
    room = max(1, limit - overlap - SLACK)
    if max(y - x for x, y in zip(total, total[1:])) > room:
        e2, t2, p2 = [0], [0], []
        for k in range(len(edges) - 1):
            own = total[k + 1] - total[k]
            cuts = [(edges[k + 1], own)] if own <= room else _hard_cuts(enc, text, edges[k], edges[k + 1], room)
            for j, (end, n) in enumerate(cuts):
                e2.append(end)
                t2.append(t2[-1] + n)
                p2.append(INSIDE if j else pauses[k])
        edges, total, pauses = e2, t2, p2
    pauses_np = np.array(pauses)

    known: dict[int, tuple[int, int]] = {0: (0, 0)}

    def shared(end: int) -> tuple[int, int]:
        """Where the text shared with a piece that ends before leaf `end` begins, and its tokens."""
        if end not in known:
            k = end
            while k > 0 and total[end] - total[k] < overlap:
                k -= 1
            start, n = edges[k], total[end] - total[k]
            if INSIDE in pauses[k : end + 1]:  # spans of a cut word may hold fewer tokens together
                n = count(enc, text[start : edges[end]])
                while k > 0 and n < overlap:
                    k -= 1
                    start, n = edges[k], count(enc, text[edges[k] : edges[end]])
            if n > overlap + SLACK:
                tail, whole, first = enc.encode_ordinary(text[start : edges[end]]), start, overlap
                while True:  # what is left of a word may be other tokens, and fewer
                    start = whole + len(enc.decode_bytes(tail[: max(0, len(tail) - first)]).decode("utf-8", "ignore"))
                    n = count(enc, text[start : edges[end]])
                    if n >= overlap or start == whole:
                        break
                    first += 1
            known[end] = (start, n)
        return known[end]

    def size(a: int, b: int) -> int:
        """Tokens of a piece that owns leaves a to b."""
        return total[b] - total[a] + shared(a)[1]

    def heads(a: int, b: int) -> bool:
        """Whether leaves a to b are a heading and no more."""
        return pauses[a] >= SECTION and (b - a == 1 or pauses_np[a + 1 : b].max() <= SENTENCE) and _is_heading(text[edges[a] : edges[b]])

    groups: list[tuple[int, int]] = []

    def pack(a: int, b: int, lead: int) -> None:
        """The pieces of a node, leaves a to b, which is over the limit with the heading before it, which begins at `lead`."""
        if b - a == 1:
            groups.extend([(lead, a)] * (lead < a) + [(a, b)])
            return
        inner = pauses_np[a + 1 : b]
        starts = [a, *(np.flatnonzero(inner == inner.max()) + a + 1).tolist(), b]
        held: list[tuple[int, int]] = []  # at most one: merged siblings that may still grow
        for x, y in zip(starts, starts[1:]):
            if y < b and heads(x, y) and size(lead, y) <= limit // 2:
                continue  # goes with the next sibling
            if held and size(held[0][0], y) <= limit:
                held = [(held[0][0], y)]
            else:
                if held and total[held[0][1]] < overlap:  # the start of the text, with too little to share
                    lead = held[0][0]
                else:
                    groups.extend(held)
                held = [(lead, y)] if size(lead, y) <= limit else []
                if not held:
                    pack(x, y, lead)
            lead = y
        groups.extend(held)

    pack(0, len(pauses), 0)
    out = []
    for a, b in groups:
        start, n_shared = shared(a)
        n = n_shared + total[b] - total[a]
        if INSIDE in pauses[max(0, a - 1) : b + 1]:  # spans of a cut word do not add up exactly
            n = count(enc, text[start : edges[b]])
            while n > limit and start < edges[a]:
                start += 1
                n = count(enc, text[start : edges[b]])
            n_shared = count(enc, text[start : edges[a]])
        out.append((start, edges[b], n, n_shared))
    return out


def split_documents(docs: DataFrame, limit: int, overlap: int, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> the pieces of every text that is over `limit` tokens.

    Texts within the limit, empty ones and NULLs give no rows; rows without an id are left out. `char_from` and
    `char_to` place a piece in its text; leaving out each piece's shared part, the pieces in order are the text.
    """
    if not 0 <= overlap <= limit // 2:
        raise ValueError("overlap must be at most half of the limit")
    path = path or vocabulary_path()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                spans = split_text(enc, t, limit, overlap)
                if len(spans) > 1:
                    rows.extend((i, k, a, b, n, s, t[a:b]) for k, (a, b, n, s) in enumerate(spans))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    big = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") > limit))
    return big.select("doc_id", "text").mapInPandas(pieces, OUT)
