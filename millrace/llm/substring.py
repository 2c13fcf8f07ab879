"""Substring dedup: MinHash banding of paragraphs, exact verification, removal by components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import M1, M2, M3, byte_strings, common_count, distinct_sorted, forget, materialize, mix, released, size_estimate, slices, word_hashes
from millrace.llm.components import connected_components
from millrace.llm.near_dup import ORDER_CELLS, prefix_pairs

SHINGLE, PERCENT = 5, 80
#: Six bands of two minima find a paragraph at similarity 0.8 with probability 0.998, and always its exact copy.
BANDS, ROWS = 6, 2
#: Least and most words of a paragraph.
LEAST, MOST = 24, 88
#: Each ``WINDOW`` places of a text hold the start of a passage of ``PASSAGE`` words, so that each run of
#: WINDOW + PASSAGE - 1 = 51 words holds one that depends on the run's own words alone.
WINDOW, PASSAGE = 26, 26
#: One word in so many ends a sentence whatever its punctuation, so that long lines without any are cut by content too.
BREAK = 64
BLOCK_WORDS = 1_500_000
#: Bytes of the table for each bucket of keys at most: a bucket's keys, about half as many bytes, meet in one worker.
BUCKET_BYTES = 128 * 1024 * 1024
_STOPS = np.isin(np.arange(256), list(b".!?"))


class Block:
    """The words of some texts in one array, and their paragraphs and passages.

    Paragraphs, which are compared by similarity, are: lines, each with as many of
    those that follow as bring it to ``LEAST`` words; in lines of more than ``MOST``
    words, runs of sentences of that length; the first and the last ``PASSAGE`` words
    of a text; a shorter text as a whole.  Passages, which are compared for equality,
    are ``PASSAGE`` words from the place of the least shingle hash in each window.
    ``near`` tells which are paragraphs.
    """

    def __init__(self, texts: pa.Array | list[bytes | None]):
        own, last, self.ends_of_docs, line_ends = word_hashes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()))
        self.hash, self.ends = own, _STOPS[last] | ((own >> np.uint64(16)) % np.uint64(BREAK) == 0)
        self.counts = np.diff(self.ends_of_docs, prepend=0)
        self.shingle = self.shingles()
        self._paragraphs(line_ends)

    def _paragraphs(self, line_ends: np.ndarray):
        lengths = np.diff(line_ends, prepend=0)
        start, stop = self._runs(line_ends)
        whole = stop - start <= MOST
        own = np.flatnonzero(self.ends) + 1
        marks = np.zeros(len(self.hash) + 1, bool)
        marks[own] = marks[line_ends] = True
        inner, inner_stop = self._runs(np.flatnonzero(marks))
        long = np.repeat(lengths > MOST, lengths)[inner] if len(inner) else np.zeros(0, bool)
        ends, firsts = self.ends_of_docs, self.ends_of_docs - self.counts
        filled, full = self.counts > 0, self.counts >= LEAST
        brief = filled & ~full
        edge = np.minimum(self.counts, PASSAGE)[full]
        starts = [start[whole], inner[long], firsts[full], ends[full] - edge, firsts[brief]]
        stops = [stop[whole], np.minimum(inner_stop, inner + MOST)[long], firsts[full] + edge, ends[full], ends[brief]]
        near = distinct_sorted(np.concatenate(starts) * (MOST + 1) + np.concatenate(stops) - np.concatenate(starts))
        passages = self._winnowed()
        both = distinct_sorted(np.concatenate([near, passages * (MOST + 1) + PASSAGE]))
        self.near = np.isin(both, near, assume_unique=True)
        self.start, n = np.divmod(both, MOST + 1)
        self.stop = self.start + n
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.first = firsts[self.doc]

    def _runs(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each place after one of ``ends`` (those of texts among them) to the first end that is ``LEAST`` words on, if in its text."""
        if not len(ends):
            return ends, ends
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        at = np.searchsorted(ends, starts + LEAST)
        stop = np.where(at < len(ends), ends[np.minimum(at, len(ends) - 1)], np.iinfo(np.int64).max)
        fits = np.minimum(stop, starts + MOST) <= self.ends_of_docs[np.searchsorted(self.ends_of_docs, starts, side="right")]
        return starts[fits], stop[fits]

    def _winnowed(self) -> np.ndarray:
        """Of each window of places within a text, the one of the least shingle hash."""
        n = len(self.hash)
        if n < WINDOW + PASSAGE:
            last = np.repeat(self.ends_of_docs, self.counts) - WINDOW - PASSAGE + 1
            at = np.flatnonzero(np.arange(n) <= last)
            return distinct_sorted(np.array([p + int(self.shingle[p : p + WINDOW].argmin()) for p in at.tolist()], np.int64))
        bits = np.uint64(max(21, n.bit_length()))
        least = (self.shingle >> bits << bits) | np.arange(len(self.shingle), dtype=np.uint64)
        width = 1
        while 2 * width <= WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
        last = np.repeat(self.ends_of_docs, self.counts) - WINDOW - PASSAGE + 1
        at = np.flatnonzero(np.arange(n) <= last)
        marks = np.zeros(n, bool)
        marks[(least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
        return np.flatnonzero(marks)

    def shingles(self) -> np.ndarray:
        n = max(0, len(self.hash) - SHINGLE + 1)
        out = np.zeros(n, np.uint64)
        for i in range(SHINGLE):
            out = (out ^ self.hash[i : n + i]) * (M1 if i % 2 else M3)
            out ^= out >> np.uint64(29)
        return mix(out)

    def classes(self) -> np.ndarray:
        """A hash of each paragraph's words, from running sums of a polynomial modulo 2^64."""
        base = int(M2) | 1
        up, down = np.full(len(self.hash) + 1, base, np.uint64), np.full(len(self.hash) + 1, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        runs = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mix(self.hash) * up[:-1])])
        return mix((runs[self.stop] - runs[self.start]) * down[self.start] + (self.stop - self.start).astype(np.uint64) * M1).view(np.int64)

    def keys(self, at: np.ndarray) -> np.ndarray:
        """The band keys of the paragraphs ``at``, a row for each band; those under ``SHINGLE`` words have their words' hash."""
        start, stop = self.start[at], self.stop[at]
        short = stop - start < SHINGLE
        padded = np.append(self.shingle, np.uint64(0)) if len(self.shingle) else np.zeros(1, np.uint64)
        lo = np.minimum(start, len(padded) - 1)
        bounds = np.stack([lo, np.minimum(np.maximum(stop - SHINGLE + 1, lo + 1), len(padded) - 1)], 1).ravel()
        draw = np.random.default_rng(20240502).integers(0, 2**64, (BANDS * ROWS, 2), np.uint64)
        own = self.classes()[at].view(np.uint64)
        out = np.empty((BANDS, len(at)), np.uint64)
        for b in range(BANDS):
            h = np.full(len(at), b + 1, np.uint64)
            for a, c in draw[b * ROWS : (b + 1) * ROWS]:
                h = mix(h * M3 + np.minimum.reduceat(padded * (a | np.uint64(1)) + c, bounds)[::2])
            out[b] = np.where(short, mix(own + np.uint64(b)), h)
        return out

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, paragraphs): the band keys of each paragraph, and the words' hash of each passage; the lowest bit is 0."""
        near, passages = np.flatnonzero(self.near), np.flatnonzero(~self.near)
        keys = [self.keys(near).ravel() if len(near) else np.zeros(0, np.uint64), mix(self.classes()[passages].view(np.uint64))]
        return np.concatenate(keys) & ~np.uint64(1), np.concatenate([np.tile(near, BANDS), passages])


_MORE = np.dtype([("doc_id", "<i8"), ("start", "<i4"), ("n", "<i4")])
ENTRIES = "bucket int, doc_id long, keys binary, docs binary"
LIVE = "cls long, doc_id long, start int, n int, size int, more binary, keys array<long>, shingles binary"


def _blocks(batches):
    for batch in batches:
        texts = batch.column("text")
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for lo, hi in slices([n // 6 + 1 for n in sizes], BLOCK_WORDS):
            yield batch.slice(lo, hi - lo), Block(texts.slice(lo, hi - lo))


def _blobs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary value for each run of ``values`` (8 bytes each) that begins at ``starts``."""
    offsets = np.append(starts, len(values)).astype(np.int64) * 8
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _heads(sorted_values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, np.int64)


def _entries(batches, buckets: int):
    """The keys of a block by bucket, each once, with one document that holds it.

    The lowest bit of a key tells that several documents of the block hold it; those
    need no other block to know that, and go along as a row of their own.
    """
    for part, block in _blocks(batches):
        if not len(block.start):
            continue
        key, at = block.entries()
        doc = part.column("doc_id").to_numpy()[block.doc[at]]
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        once = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
        key, doc = key[once], doc[once]
        heads = _heads(key)
        several = np.diff(np.append(heads, len(key))) > 1
        own = np.repeat(several, np.diff(np.append(heads, len(key))))
        order = np.argsort(doc[own], kind="stable")
        mine, keys = doc[own][order], key[own][order]
        first = _heads(mine)
        rows = [pa.array((mine[first] % buckets).astype(np.int32)), pa.array(mine[first]), _blobs(keys, first), pa.nulls(len(first), pa.binary())]
        yield pa.RecordBatch.from_arrays(rows, ["bucket", "doc_id", "keys", "docs"])
        key, doc = key[heads] | several.astype(np.uint64), doc[heads]
        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        first = _heads(bucket[order])
        rows = [pa.array(bucket[order][first]), pa.nulls(len(first), pa.int64()), _blobs(key[order], first), _blobs(doc[order], first)]
        yield pa.RecordBatch.from_arrays(rows, ["bucket", "doc_id", "keys", "docs"])


def _shared(bucket: pa.Table) -> pa.Table:
    """(doc_id, keys): the keys of one bucket that more than one block or document holds, by document."""
    known = bucket.filter(bucket.column("doc_id").is_valid()).select(["doc_id", "keys"])
    rows = bucket.filter(bucket.column("doc_id").is_null())
    both = [np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("docs", np.int64))]
    order = np.argsort(both[0], kind="stable")
    key, doc = both[0][order], both[1][order]
    heads = _heads(key >> np.uint64(1))
    sizes = np.diff(np.append(heads, len(key)))
    live = np.repeat(sizes > 1, sizes) & (key & np.uint64(1) == 0)
    key, doc = key[live], doc[live]
    order = np.argsort(doc, kind="stable")
    first = _heads(doc[order])
    own = pa.Table.from_arrays([pa.array(doc[order][first]), _blobs(key[order], first)], ["doc_id", "keys"])
    return pa.concat_tables([known, own])


def _live(batches):
    """One row for each class of paragraphs in a block that hold a shared key: the first place, the others packed.

    Paragraphs have their shared keys, the number of their shingles and these themselves too.
    """
    for part, block in _blocks(batches):
        if not len(block.start):
            continue
        wanted = [b"".join(x) for x in part.column("live").to_pylist()]
        sizes = np.array([len(x) // 8 for x in wanted])
        own = np.frombuffer(b"".join(wanted), np.uint64)
        pair = lambda k, d: mix(k + mix(d.astype(np.uint64) + M2))  # noqa: E731  a key and the number of its text in the block
        known = np.sort(pair(own, np.repeat(np.arange(len(sizes)), sizes)))
        key, at = block.entries()
        asked = pair(key, block.doc[at])
        found = np.searchsorted(known, asked)
        hit = known[np.minimum(found, len(known) - 1)] == asked if len(known) else np.zeros(len(asked), bool)
        key, at = key[hit], at[hit]
        order = np.lexsort((key, at))
        key, at = key[order].view(np.int64), at[order]
        first = _heads(at)
        ends, places = np.append(first[1:], len(at)), at[first]
        if not len(places):
            continue
        docs = part.column("doc_id").to_numpy()[block.doc[places]]
        start, n = (block.start - block.first)[places].astype("i4"), (block.stop - block.start)[places].astype("i4")
        cls, near = block.classes()[places], block.near[places]
        order = np.lexsort((start, docs, ~near, cls))
        new = _heads(cls[order])
        upto = np.append(new[1:], len(order))
        more: list = [None] * len(new)
        for i in np.flatnonzero(upto - new > 1):
            rest = order[new[i] + 1 : upto[i]]
            packed = np.empty(len(rest), _MORE)
            packed["doc_id"], packed["start"], packed["n"] = docs[rest], start[rest], n[rest]
            more[i] = packed.tobytes()
        head = order[new]
        keys: list = [None] * len(head)
        sets: list = [None] * len(head)
        size = np.ones(len(head), np.int32)
        small = block.shingle.astype(np.uint32)
        for i in np.flatnonzero(near[head] & (n[head] >= SHINGLE)).tolist():
            h = head[i]
            keys[i] = key[first[h] : ends[h]]
            p = places[h]
            own = distinct_sorted(small[block.start[p] : block.stop[p] - SHINGLE + 1])
            sets[i], size[i] = own.tobytes(), len(own)
        columns = [pa.array(c[head]) for c in (cls, docs, start, n)]
        columns += [pa.array(size), pa.array(more, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["cls", "doc_id", "start", "n", "size", "more", "keys", "shingles"])


def _places(batches):
    """(cls, doc_id, start, n) of every paragraph that the rows stand for."""
    for batch in batches:
        packed = [np.frombuffer(m or b"", _MORE) for m in batch.column("more").to_pylist()]
        flat = np.concatenate(packed) if packed else np.empty(0, _MORE)
        cls = np.repeat(batch.column("cls").to_numpy(), [len(p) for p in packed])
        names = ["cls", "doc_id", "start", "n"]
        yield batch.select(names)
        yield pa.RecordBatch.from_arrays([pa.array(cls), *(pa.array(np.ascontiguousarray(flat[c])) for c in names[1:])], names)


def _verified(batches, percent: int):
    for batch in batches:
        keep = []
        for a, b in zip(byte_strings(batch.column("a")), byte_strings(batch.column("b"))):
            x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
            both = common_count(x, y)
            keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])


def _cell_counts(batches):
    """How many of the shingles of the batches fall to each cell of the order table."""
    for batch in batches:
        flat = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.uint32)
        counts = np.bincount(flat % np.uint32(ORDER_CELLS), minlength=ORDER_CELLS)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])


def _prefixes(batches, percent: int, table):
    """A set's rarest shingles, as many as must hold one that any near enough set holds too, with the parities of the set by 128 residues."""
    counts = table.value
    for batch in batches:
        sets = [np.frombuffer(b, np.uint32) for b in byte_strings(batch.column("shingles"))]
        if not sets:
            continue
        tokens, sizes = [], np.array([len(s) for s in sets])
        for s in sets:
            order = np.lexsort((s, counts[s % np.uint32(ORDER_CELLS)]))
            tokens.append(s[order[: len(s) - -(-percent * len(s) // 100) + 1]].astype("i8"))
        flat, starts = np.concatenate(sets), np.cumsum(np.append(0, sizes[:-1]))
        bit = np.uint64(1) << ((flat * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.uint64)
        upper = flat * np.uint32(0x85EBCA6B) >> np.uint32(31) > 0
        marks = [np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0)), starts).view(np.int64) for side in (upper, ~upper)]
        m = [len(t) for t in tokens]
        rest = np.concatenate([n - np.arange(k) for n, k in zip(sizes, m)])
        columns = [np.repeat(batch.column(c).to_numpy(), m) for c in ("cls", "comp")]
        columns += [np.repeat(sizes, m), np.concatenate(tokens), rest, *(np.repeat(x, m) for x in marks)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["doc_id", "comp", "n", "token", "rest", "x", "y"])


def _star(met: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``met`` (key, cls, size, w) with their bucket's first, the class of most places, as ``pivot``; and pairs (u, v) of such whose sizes allow it."""
    pivots = met.groupBy("key").agg(F.max(F.struct("w", "cls", "size")).alias("pivot"), F.count("*").alias("n")).where("n > 1")
    starred = materialize(met.join(pivots, "key").where("cls <> pivot.cls"), "substring-star")
    edges = starred.where(f"100 * least(size, pivot.size) >= {percent} * greatest(size, pivot.size)")
    return starred, materialize(edges.select(F.col("cls").alias("u"), F.col("pivot.cls").alias("v")).distinct(), "substring-edges")


def _open(several: DataFrame, components: DataFrame) -> DataFrame:
    """The rows (key, cls, size, w) of buckets' classes that their first did not draw into its component: one bucket more, without it."""
    own = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    placed = several.join(own("cls"), "cls", "left").join(own("pivot"), "pivot", "left")
    return placed.where("coalesce(cls_in, cls) <> coalesce(pivot_in, pivot)").select("key", "cls", "size", "w")


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose shingle sets are near enough."""
    side = lambda c, s: sets.select(F.col("cls").alias(c), F.col("shingles").alias(s))
    wide = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")
    wide = wide.where(f"100 * least(length(a), length(b)) >= {percent} * greatest(length(a), length(b))")
    return wide.mapInArrow(lambda it: _verified(it, percent), "u long, v long")


def _missed(met: DataFrame, components: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that may be near enough of classes that met the same firsts but lie in different components.

    Every class of a bucket was compared with one or two of the bucket; two others of
    different components were not compared yet.
    """
    own = components.select(F.col("node").alias("cls"), "component")
    placed = met.join(own, "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    nodes = placed.join(mixed, "key").select("cls", "comp").distinct()
    cells = sets.mapInArrow(_cell_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(ORDER_CELLS, np.int64)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    schema = "doc_id long, comp long, n long, token long, rest long, x long, y long"
    rows = nodes.join(sets, "cls").mapInArrow(lambda it: _prefixes(it, percent, shared), schema)
    rows = materialize(rows, "substring-prefixes")
    tokens = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    # words that only one set holds change its parities: pairs of too many such words are left out before they are made
    alone = f"{100 + percent} * (bit_count(a.x ^ b.x) + bit_count(a.y ^ b.y)) <= {100 - percent} * (a.n + b.n)"
    return prefix_pairs(rows.join(tokens, "token", "left_semi"), percent, alone)


def _lists(values: np.ndarray, rows: np.ndarray, n: int, kind=None) -> pa.ListArray:
    """The values as one list for each of ``n`` rows (``rows``: sorted numbers of rows)."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values if kind else pa.array(values))


def _merged(batches):
    """Per document: its repeated paragraphs, and the word ranges to remove, joined where they touch."""
    for batch in batches:
        count, places = batch.num_rows, batch.column("places")
        row = np.repeat(np.arange(count), places.value_lengths().to_numpy())
        flat = places.flatten()
        start, n, component, first = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "n", "component", "first"))
        kept = flat.field("kept").to_numpy(zero_copy_only=False)
        order = np.lexsort((component, n, start, row))
        row, start, n, component, first, kept = (x[order] for x in (row, start, n, component, first, kept))
        same = np.zeros(len(row), bool)  # rows that share a doc_id have their places twice
        same[1:] = (row[1:] == row[:-1]) & (start[1:] == start[:-1]) & (n[1:] == n[:-1]) & (component[1:] == component[:-1])
        lists = []
        for values in (first, component):
            by = np.lexsort((values, row))
            once = np.append(True, (np.diff(values[by]) != 0) | (np.diff(row[by]) != 0))[: len(by)]
            lists.append(_lists(values[by][once], row[by][once], count))
        amount = np.bincount(row[~same], minlength=count)
        row, start, end = row[~kept], start[~kept], (start + n)[~kept]
        wide = int(end.max(initial=0)) + 1
        reach = np.maximum.accumulate(end + row * wide) if len(row) else end
        new = np.append(True, start[1:] + row[1:] * wide > reach[:-1])[: len(row)]
        heads = np.flatnonzero(new)
        begin, stop = start[heads], (reach - row * wide)[np.append(heads[1:], len(row))[: len(heads)] - 1]
        ranges = pa.StructArray.from_arrays([pa.array(begin), pa.array(stop)], ["start", "end"])
        removed = np.bincount(row[heads], stop - begin, minlength=count).astype(np.int64)
        columns = [batch.column("doc_id"), pa.array(amount), pa.array(removed), _lists(ranges, row[heads], count, kind=True), *lists]
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _OUT.types)], schema=_OUT)


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_paragraphs", pa.int64()), ("n_removed_words", pa.int64()),
        ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept_in", pa.list_(pa.int64())), ("components", pa.list_(pa.int64())),
    ]
)
OUT = "doc_id long, n_paragraphs long, n_removed_words long, removed array<struct<start: long, end: long>>, kept_in array<long>, components array<long>"


def repeated_passages(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """One row for each document that shares a passage with another one: what to remove, and where a copy stays.

    A first pass over the texts gives the MinHash band keys of the paragraphs and
    the hashes of the passages, packed by bucket and each once a block of texts, so
    that a paragraph that every document holds is one entry for each block.  Keys
    that more than one document holds go back to their documents, and a second pass
    gives the places that hold one.  Paragraphs of equal words are one class.  Classes that meet in
    a band bucket are linked to the bucket's most frequent one, then those that are
    left to the most frequent of these, and verified by the Jaccard
    similarity of their five-word shingles; classes linked at ``percent`` or more
    form components.  Classes of buckets that then still hold several components
    are settled by an exact prefix-filter join.  A component found in two documents
    or more is a repeat: the document with the smallest doc_id keeps its places, all
    others are removed.  Ranges are in words, from 0.

    Null and empty texts have no paragraphs; a text under 24 words is one paragraph,
    and one under five words has no shingles and equals its copies only.  A very long text is a block of its own.
    Rows with a null doc_id take no part; rows that share a doc_id are one document,
    whose places coincide.  A repeat within one document alone is left.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    buckets = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), size_estimate(docs) // BUCKET_BYTES)
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    packed = docs.mapInArrow(lambda it: released(_entries(it, buckets)), ENTRIES)
    shared = materialize(packed.groupBy("bucket").applyInArrow(_shared, "doc_id long, keys binary"), "substring-keys")
    wanted = shared.groupBy("doc_id").agg(F.collect_list("keys").alias("live"))
    live = materialize(docs.join(wanted, "doc_id").mapInArrow(lambda it: released(_live(it)), LIVE), "substring-live")

    places = (1 + F.coalesce(F.octet_length("more"), F.lit(0)) / _MORE.itemsize).cast("long")
    met = live.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "cls", "size", places.alias("w"))
    met = met.groupBy("key", "cls", "size").agg(F.sum("w").alias("w"))
    starred, edges = _star(met, percent)
    several = materialize(starred.where("n > 2").select("key", "cls", "size", "w", F.col("pivot.cls").alias("pivot")), "substring-several")
    ends = edges.select(F.col("u").alias("cls")).union(edges.select("v")).union(several.select("cls")).distinct()
    sets = live.where("shingles IS NOT NULL").select("cls", "shingles").join(ends, "cls", "left_semi")
    sets = materialize(sets.groupBy("cls").agg(F.first("shingles").alias("shingles")), "substring-sets")
    links = materialize(_near(edges, sets, percent), "substring-links")
    components = connected_components(links, "substring-stars")
    again, second = _star(_open(several, components), percent)
    links, first = materialize(links.unionByName(_near(second, sets, percent)), "substring-links"), links
    forget(first, components)
    components = connected_components(links, "substring-stars")
    more = materialize(_near(_missed(several.select("key", "cls"), components, sets, percent), sets, percent), "substring-more")
    if not more.isEmpty():
        forget(components)
        components = connected_components(links.unionByName(more), "substring-all")

    places = live.select("cls", "doc_id", "start", "n", "more").mapInArrow(_places, "cls long, doc_id long, start int, n int")
    places = places.join(components.withColumnRenamed("node", "cls"), "cls", "left")
    places = places.select(F.coalesce("component", "cls").alias("component"), "doc_id", "start", "n")
    places = materialize(places, "substring-places")
    forget(shared, live, starred, edges, several, again, second, sets, links, more, components)
    heads = places.groupBy("component").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    heads = materialize(heads.where("first < last"), "substring-heads")  # read back, so that a join of a hot component can be split
    repeats = places.join(heads, "component")
    each = F.struct("start", "n", "component", "first", (F.col("doc_id") == F.col("first")).alias("kept"))
    grouped = repeats.groupBy("doc_id").agg(F.collect_list(each).alias("places"))
    return grouped.mapInArrow(_merged, OUT)
