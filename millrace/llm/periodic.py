"""Runs of words that repeat with a period, by recompression.

A text's words become letters, and block compression (a run of one letter is one
symbol) alternates with pair compression (letters are dealt to left and right, each
left-right pair is one symbol) until few symbols are left: a run-length grammar,
whose levels are kept.  Equal stretches are named alike wherever they stand, but for
their edges, so how far two places agree is found by climbing the levels while their
symbols agree and going down again where they don't: a few steps a level, for many
pairs of places at once.

For each period p the places on a grid are held against those p words on; the grid
is so fine that each run has one on it.  That is a harmonic sum of places, n log n.
A place whose next words agree is extended exactly by the grammar.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import M1, M2, M3, mix, released, slices

#: Least words of a run, and its least number of periods.
LEAST, TIMES = 24, 3
#: Bytes of text that are worked on together (a longer text is alone), and places that are held against others together.
BLOCK_BYTES, BLOCK_PLACES = 1_000_000, 1_000_000
#: Words after a grid place that must agree before the grammar is asked.
SEED = 4
#: Symbols that aren't compressed any more, and deals of letters to left and right of which the best is taken.
TOP, DEALS = 16, 4
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True


def _named(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal keys by equal numbers from 0, and how many there are."""
    found, names = np.unique(keys, return_inverse=True)
    return names.astype(np.int64), len(found)


class Grammar:
    """The levels over ``letters``, whose first and last one occur once each.

    A level has its symbols, which of them each next level's symbol begins with
    (``bounds``), the number of the next level's symbol that each belongs to
    (``up``), and whether that level is of blocks.
    """

    def __init__(self, letters: np.ndarray):
        symbols, count = _named(letters)
        self.levels, blocks = [], True
        while len(symbols) > TOP:
            bounds, keys = self._blocks(symbols) if blocks else self._pairs(symbols, count, len(self.levels))
            if len(bounds) <= len(symbols):
                size = np.diff(bounds)
                self.levels.append((symbols, bounds, np.repeat(np.arange(len(size)), size), blocks))
                symbols, count = _named(keys)
            blocks = not blocks
        self.top = symbols

    @staticmethod
    def _blocks(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        bounds = np.append(heads, len(s))
        size = np.diff(bounds)
        return bounds, s[heads] * (int(size.max()) + 1) + size

    @staticmethod
    def _pairs(s: np.ndarray, count: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        best, most = None, -1
        for deal in range(DEALS):
            turn = np.full(1, level * DEALS + deal + 1, np.uint64) * M2
            side = mix(np.arange(count, dtype=np.uint64) * M1 + turn) >> np.uint64(63) > 0
            left = side[s]
            for both in (left[:-1] & ~left[1:], ~left[:-1] & left[1:]):
                if (n := int(both.sum())) > most:
                    best, most = both, n
        heads = np.flatnonzero(~np.append(False, best))
        paired = np.append(best, False)[heads]
        second = np.where(paired, s[np.minimum(heads + 1, len(s) - 1)] + 1, 0)
        return np.append(heads, len(s)), s[heads] * (count + 1) + second

    def agree(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many letters agree from the places ``a`` and ``b`` (which differ) on, or up to them and back if not ``forward``."""
        way, start, which = (1 if forward else -1), a, np.arange(len(a))
        parted = []  # of each level: the pairs whose symbols differ there, all before them being equal
        for symbols, bounds, up, _ in self.levels:
            same = symbols[a] == symbols[b]
            apart = [(which[~same], a[~same], b[~same])]
            which, a, b = which[same], a[same], b[same]
            over, under = up[a], up[b]
            left_a = bounds[over + 1] - a if forward else a + 1 - bounds[over]
            left_b = bounds[under + 1] - b if forward else b + 1 - bounds[under]
            edge = (left_a == bounds[over + 1] - bounds[over]) & (left_b == bounds[under + 1] - bounds[under])
            step = np.where(edge, 0, np.minimum(left_a, left_b)) * way
            a, b = a + step, b + step
            on = edge | (left_a == left_b)
            apart.append((which[~on], a[~on], b[~on]))
            parted.append(tuple(np.concatenate(x) for x in zip(*apart)))
            which, a, b = which[on], up[a[on]], up[b[on]]
        while len(more := np.flatnonzero(self.top[a] == self.top[b])):
            a[more] += way
            b[more] += way
        for (symbols, bounds, _, blocks), (w, x, y) in zip(reversed(self.levels), reversed(parted)):
            size = np.minimum(bounds[a + 1] - bounds[a], bounds[b + 1] - bounds[b]) if blocks else 1
            a, b = (bounds[a], bounds[b]) if forward else (bounds[a + 1] - 1, bounds[b + 1] - 1)
            step = np.where(symbols[a] == symbols[b], size, 0) * way
            which, a, b = np.append(which, w), np.append(a + step, x), np.append(b + step, y)
        out = np.empty(len(start), np.int64)
        out[which] = (a - start[which]) * way
        return out


def _grid(counts: np.ndarray, least: int, times: int):
    """Blocks of (text, place in the text, period): every run of ``least`` words and ``times`` periods has ``SEED`` words from one of them that agree with those a period on."""
    periods = np.where(counts >= least, counts // times, 0)
    ends = np.cumsum(periods)
    # each (text, period) once, ``BLOCK_PLACES`` at a time; a pair's own places then in blocks as well
    for lo in range(0, int(ends[-1]) if len(ends) else 0, BLOCK_PLACES):
        at = np.arange(lo, min(lo + BLOCK_PLACES, int(ends[-1])))
        text = np.searchsorted(ends, at, side="right")
        p = at - (ends[text] - periods[text]) + 1
        step = np.maximum(1, np.maximum(least, times * p) - p - SEED + 1)
        n = np.maximum(0, (counts[text] - SEED - p) // step + 1)
        upto = np.cumsum(n)
        for first in range(0, int(upto[-1]), BLOCK_PLACES):
            place = np.arange(first, min(first + BLOCK_PLACES, int(upto[-1])))
            pair = np.searchsorted(upto, place, side="right")
            yield text[pair], (place - upto[pair] + n[pair]) * step[pair], p[pair]


def find_runs(letters: np.ndarray, counts: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    ``letters`` are the texts' one after another, ``counts`` of them each.  A run has
    ``least`` letters and ``times`` periods at least (2 periods or more); it isn't longer with the same
    period, and has no smaller one.
    """
    firsts = np.cumsum(counts) - counts
    seeds = np.zeros(max(0, len(letters) - SEED + 1), np.uint64)
    for i in range(SEED):
        seeds = mix(seeds * M3 + letters[i : i + len(seeds)].astype(np.uint64) * M1 + np.uint64(i + 1))
    found = []
    for text, place, p in _grid(counts, least, times):
        at = firsts[text] + place
        hit = np.flatnonzero(seeds[at] == seeds[at + p])
        found.append((text[hit], place[hit], p[hit]))
    text, place, p = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    if not len(text):
        return np.zeros((0, 4), np.int64)
    # only texts with a hit, each between letters that occur once
    some = np.unique(text)
    size = counts[some]
    before = np.cumsum(size + 1) - size
    whole = int(letters.max()) + 1 + np.arange(int(before[-1] + size[-1]) + 1)
    inner = np.repeat(before - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    whole[inner] = letters[np.repeat(firsts[some] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
    grammar = Grammar(whole)
    base = before[np.searchsorted(some, text)]
    a = base + place
    start = place - grammar.agree(a - 1, a + p - 1, forward=False)
    length = place + p + grammar.agree(a, a + p, forward=True) - start
    runs = np.stack([text, start, length, p], 1)[length >= np.maximum(least, times * p)]
    runs = runs[np.lexsort(runs.T[[3, 2, 1, 0]])]
    # the same stretch with a multiple of its period follows it
    runs = runs[np.append(True, (runs[1:, :3] != runs[:-1, :3]).any(1))] if len(runs) else runs
    return runs[np.lexsort(runs.T[[3, 1, 0]])]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (runs of other than ASCII white space) of all texts as one binary array, and each text's number of them; null has none."""
    texts = texts.fill_null("").cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    if offsets[-1] == offsets[0]:
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    blank = _BLANK[data]
    first = ~blank
    first[1:] &= blank[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = ~blank[begins]
    starts = np.flatnonzero(first)
    kept = data[~blank]
    bounds = np.append(starts - np.cumsum(blank)[starts], len(kept)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(kept))])
    return words, np.diff(np.searchsorted(starts, offsets))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _lists(bounds: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def _judge(part: pa.RecordBatch, least: int, times: int, order) -> pa.RecordBatch:
    words, counts = words_of(part.column("text"))
    source = np.arange(len(words))  # which word stands at each place
    if order:
        at = 0
        for doc_id, n in zip(part.column("doc_id").to_pylist(), counts.tolist()):
            own = order(doc_id, n) if n else None
            if own is not None:
                source[at : at + n] = at + own
            at += n
    letters = words.dictionary_encode().indices.to_numpy().astype(np.int64)[source]
    runs = find_runs(letters, counts, least, times)
    firsts = np.cumsum(counts) - counts
    text, start, length, period = runs.T
    change = np.zeros(len(letters) + 1, np.int64)
    np.add.at(change, firsts[text] + start + period, 1)
    np.add.at(change, firsts[text] + start + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    upto = np.append(0, np.cumsum(kept))[np.append(firsts, len(letters))]
    collapsed = pc.binary_join(_lists(upto, words.take(pa.array(source[kept]))), b" ").cast(pa.string())
    triples = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (start, length, period)], fields=list(_RUN))
    lists = _lists(np.searchsorted(text, np.arange(len(counts) + 1)), triples)
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), lists, collapsed], ["doc_id", "n_words", "runs", "collapsed"])


def _blocks(batches, least: int, times: int, order):
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        for lo, hi in slices([n + 1 for n in sizes], BLOCK_BYTES):
            yield _judge(batch.slice(lo, hi - lo), least, times, order)


def periodic_runs(docs: DataFrame, *, least: int = LEAST, times: int = TIMES, order: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs`` (doc_id long, text string).

    ``runs`` (start, length, period, in words from 0) has every stretch of ``least``
    words and ``times`` (2 or more) periods at least that no neighbouring word extends with the same
    period, by start and period.  ``collapsed`` has the words that no run holds after
    its first period, joined by blanks.  ``order`` may put other words of the text at
    its places: it gets doc_id and the number of words, and returns the place of the
    word that each place takes, or None.

    Texts stay in their tasks, so nothing is hot.  Null, empty and blank texts have
    no words, no runs and an empty ``collapsed``; rows with a null or repeated doc_id are
    judged like any other; a very long text is a block of its own, in memory that
    grows with its words; other columns are ignored.
    """
    if times < 2 or least * (times - 1) < times * SEED:
        raise ValueError(f"a run has two periods, and {SEED} words that agree with those a period on")
    return docs.select("doc_id", "text").mapInArrow(lambda it: released(_blocks(it, least, times, order)), RUNS)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the run with the most periods, the first of several, and hashes of all."""
    more = "reduce(slice(runs, 2, greatest(size(runs) - 1, 0)), get(runs, 0), (a, r) -> IF(r.length * a.period > a.length * r.period, r, a))"
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", "runs", "collapsed", F.expr(more).alias("best"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
