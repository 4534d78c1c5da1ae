"""Texts over a size limit cut into pieces at natural boundaries."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cost of a cut by the kind of boundary it stands at, best first.
CUT_COST = {"end": 0.0, "heading": 0.0, "paragraph": 0.2, "line": 1.0, "sentence": 1.5, "clause": 4.0, "space": 8.0, "hard": 60.0}
_KINDS = list(CUT_COST)
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = frozenset(
    "e.g i.e etc vs no nr dr prof mr mrs ms approx ca min max sec std sek abb fig bzw usw inkl evtl ggf z.b d.h u.a o.ä vgl mind st ing dipl hr fr tel art bd pos cf al jan feb mär apr jun jul aug sep okt nov dez z b d h u a".split()
)
_BREAK = re.compile(r"\s+")
_WORD = re.compile(r"\S*")
# White space that may end a sentence, line or paragraph.
_COARSE = re.compile(r"(?<=[.!?…\"'”»)])\s+|[^\S\n\r]*[\n\r]\s*")
_NUMBERS = re.compile(r"(\d+(?:[.,]\d+)*)\s*(k\b|k(?=[_\W]|$)|%)?", re.IGNORECASE)


def parse_strategy(strategy: str | None) -> tuple[int | None, int]:
    """(limit, overlap) in characters that a chunking strategy, typed by hand,
    states. Of two sizes the smaller is the overlap; a percentage is an overlap
    relative to the limit; '1.2k' is 1200. Without a size there is no limit. One
    size stated twice is no overlap; an overlap leaves a piece one character of
    its own at least."""
    sizes, parts = [], []
    for number, mark in _NUMBERS.findall(strategy or ""):
        grouped = re.fullmatch(r"\d{1,3}(?:[.,]\d{3})+", number)
        value = float(re.sub(r"[.,]", "", number) if grouped and mark.lower() != "k" else number.replace(",", ".").rstrip(".") if number.count(".") + number.count(",") < 2 else re.sub(r"[.,]", "", number))
        (parts if mark == "%" else sizes).append(value * (1000 if mark.lower() == "k" else 1))
    sizes = sorted(set(sizes))
    if not sizes or sizes[-1] < 1:
        return None, 0
    limit = int(sizes[-1])
    overlap = int(sizes[0]) if len(sizes) > 1 else int(limit * parts[0] / 100) if parts else 0
    return limit, min(overlap, limit - 1)


def boundaries(text: str, gaps: re.Pattern = _BREAK, start: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions between start and end where a piece may end, ascending, and the
    kind of each boundary as its place in CUT_COST. White space belongs to what
    precedes it."""
    positions, kinds = [], []
    for m in gaps.finditer(text, start, len(text) if end is None else end):
        gap, at = m.group(), m.end()
        if at >= len(text) or not m.start():
            continue
        last = text[m.start() - 1]
        if "\n" in gap or "\r" in gap:
            kind = "heading" if text.startswith("#", at) else "paragraph" if gap.count("\n") > 1 else "line"
        elif last in ".!?…" or last in "\"'”»)" and text[m.start() - 2 : m.start() - 1] in (".", "!", "?"):
            word = text[max(0, m.start() - 12) : m.start()].split()[-1].rstrip(".").lstrip("(").lower()
            after = text[at]
            kind = "space" if last == "." and (word in ABBREVIATIONS or word.isdigit() and len(word) < 3 or not (after.isupper() or after.isdigit() or not after.isalnum())) else "sentence"
        elif last in ",;:–—":
            kind = "clause"
        else:
            kind = "space"
        positions.append(at)
        kinds.append(_KINDS.index(kind))
    return np.array(positions, dtype=np.int64), np.array(kinds, dtype=np.int64)


def longest_run(text: str) -> int:
    """Length of the longest stretch without white space."""
    return max(map(len, text.split()), default=0)


def run_at(text: str, at: int) -> int:
    """Length of the stretch without white space around a position in it."""
    before = at
    while before and not text[before - 1].isspace():
        before -= 1
    return _WORD.match(text, at).end() - before


def split_points(text: str, limit: int, overlap: int, *, balance: float = 6.0) -> list[tuple[int, int, str]]:
    """(start, end, kind of boundary at the end) of the pieces of text.

    Every piece but the first starts overlap characters before the end of the
    one before; none is longer than limit. Dynamic programming over all
    boundaries minimises the cost of the cuts plus balance times the squared
    relative deviation from equal sizes. It runs over lines, paragraphs and
    sentences first, with clauses and words only where those are further apart
    than a piece may advance; then again with all clauses, or all words, unless
    what it found costs no more than any way with one of these must. Cuts inside
    a stretch without white space ('hard') are offered only where words are too
    far apart.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    step = limit - overlap

    def far_apart(at: np.ndarray) -> list[tuple[int, int]]:
        edges = np.concatenate([[0], at, [n]])
        wide = np.flatnonzero(np.diff(edges) > step)
        return list(zip(edges[wide].tolist(), edges[wide + 1].tolist()))

    at, kind = boundaries(text, _COARSE)
    at, kind = at[kind <= _KINDS.index("sentence")], kind[kind <= _KINDS.index("sentence")]
    for finest in ("clause", "space"):
        finer = [boundaries(text, _BREAK, a, b) for a, b in far_apart(at)]
        at, first = np.unique(np.concatenate([at, *(p[k <= _KINDS.index(finest)] for p, k in finer)]), return_index=True)
        kind = np.concatenate([kind, *(k[k <= _KINDS.index(finest)] for _, k in finer)])[first]
    hard = []
    for a, b in far_apart(at):
        every = max(1, step // 8)
        hard.extend(range(a + every, b, every))
        hard.extend(range(b - step, a, -step))
        hard.extend(range(a + step, b, step))
    hard = np.array(sorted({h for h in hard if 0 < h < n} - set(at.tolist())), dtype=np.int64)
    least, pieces = _cheapest(n, limit, overlap, balance, at, kind, hard)
    # What the other cuts of a way cost at least: of every kind there may be, the cheapest.
    others = (math.ceil((n - overlap) / step) - 2) * min([CUT_COST["clause"], *(CUT_COST[_KINDS[k]] for k in set(kind.tolist()))])
    if least > CUT_COST["clause"] + others:
        every_at, every_kind = boundaries(text)
        finest = "clause" if least <= CUT_COST["space"] + others else "space"
        more = every_kind <= _KINDS.index(finest)
        at, first = np.unique(np.concatenate([at, every_at[more]]), return_index=True)
        kind = np.concatenate([kind, every_kind[more]])[first]
        _, pieces = _cheapest(n, limit, overlap, balance, at, kind, hard)
    return pieces


def _cheapest(n: int, limit: int, overlap: int, balance: float, at: np.ndarray, kind: np.ndarray, hard: np.ndarray) -> tuple[float, list[tuple[int, int, str]]]:
    """(cost, pieces) of the cheapest way to cut n characters at these boundaries."""
    step = limit - overlap
    where = np.concatenate([at, hard, [n]]).astype(np.int64)
    what = np.concatenate([kind, np.full(len(hard), _KINDS.index("hard")), [_KINDS.index("end")]]).astype(np.int64)
    order = np.argsort(where, kind="stable")
    where, what = where[order], what[order]
    cost = np.array([CUT_COST[k] for k in _KINDS])[what]
    even = (n - overlap) / math.ceil((n - overlap) / step)
    best = np.full(len(where) + 1, np.inf)  # best[i]: pieces up to boundary i - 1; 0 is the start
    best[0] = 0.0
    ends, back = np.concatenate([[0], where]), np.zeros(len(where) + 1, dtype=np.int64)
    low = 0
    for i in range(1, len(ends)):
        while ends[i] - ends[low] > (limit if low == 0 else step):
            low += 1
        if low >= i:
            continue
        advance = ends[i] - ends[low:i]
        total = best[low:i] + balance * ((advance - (overlap if low == 0 else 0) * (np.arange(low, i) == 0)) / even - 1) ** 2
        k = int(total.argmin())
        best[i], back[i] = total[k] + cost[i - 1], low + k
    cuts, i = [], len(ends) - 1
    while i > 0:
        cuts.append(i)
        i = int(back[i])
    pieces, before = [], 0
    for i in reversed(cuts):
        pieces.append((max(0, before - overlap), int(ends[i]), _KINDS[what[i - 1]]))
        before = int(ends[i])
    return float(best[-1]), pieces


def split_texts(df: DataFrame, record_id: str, text: str, limit: str | Column, overlap: str | Column) -> DataFrame:
    """Pieces of all texts longer than their limit.

    df        one row for each record_id; limit and overlap (int) in Unicode
              characters; other columns are ignored
    returns   record_id, piece (from 0), start, end, text, boundary (the kind of
              boundary at the end of the piece), hard (1 if a stretch without
              white space is itself longer than the limit)

    A text within its limit, without a limit (null, or below one character),
    null or empty gives no row. An overlap of the limit or more is taken as one
    character less than the limit. A
    repeated row gives its pieces again. Texts are independent and are cut
    whole, so the work splits evenly however the ids are spread.
    """
    rows = df.select(F.col(record_id).alias("id"), F.col(text).alias("text"), *(F.col(c).cast("int").alias(n) if isinstance(c, str) else c.cast("int").alias(n) for c, n in ((limit, "size"), (overlap, "overlap"))))
    rows = rows.where((F.col("size") > 0) & (F.length("text") > F.col("size")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rid, t, size, over in zip(pdf["id"], pdf["text"], pdf["size"], pdf["overlap"].fillna(0).astype(int)):
                pieces = split_points(t, int(size), max(0, min(int(over), int(size) - 1)))
                # A stretch over the limit is cut inside in any way there is.
                hard = int(any(run_at(t, b) > size for _, b, kind in pieces if kind == "hard"))
                out.extend((rid, i, a, b, t[a:b], kind, hard) for i, (a, b, kind) in enumerate(pieces))
            yield pd.DataFrame(out, columns=["id", "piece", "start", "end", "text", "boundary", "hard"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, piece int, start int, end int, text string, boundary string, hard int").withColumnRenamed("id", record_id)
