"""Alignment of two tokenizers' tokens of the same text.

Both sides' tokens cover the text's bytes without gaps.  A token's start lies in one
token of the other side, which ``pandas.merge_asof`` finds: the last one of the same
document that starts no later.  Both directions together give all overlaps; where
tokens of both sides end at one byte, a group ends.
"""

from __future__ import annotations

import functools
import hashlib
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import pieces
from millrace.llm.bpe import ChunkEncoder, list_array
from millrace.llm.common import BROADCAST_ROWS, byte_strings, forget, materialize, released, slices

#: Bytes of text that are aligned together.
BLOCK_BYTES = 1_000_000
#: Chunks of text that a worker remembers the ids of.
REMEMBERED = 150_000


class _PlainEncoder(ChunkEncoder):
    """Byte-level BPE in which the strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__(path, "lead", REMEMBERED)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True


def _byte_of_letter() -> dict[str, int]:
    """Byte-level spelling: printable Latin-1 characters stand for their own bytes, the others are moved up from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: how it encodes texts, and the bytes of each id."""

    def __init__(self, spelled: list[bytes], encode):
        self.spelled, self.encode = pa.array(spelled, pa.binary()), encode
        self.size = np.array([len(s) for s in spelled], np.int64)

    def covers(self, ids: np.ndarray, ends: np.ndarray, texts: list[bytes]) -> list[bool]:
        """Whether the joined bytes of each text's ids are that text."""
        whole = self.spelled.take(pa.array(ids))
        joined = byte_strings(pc.binary_join(list_arrays(ends, whole), b"")) if len(ends) else []
        return [a == b for a, b in zip(joined, texts)]


def list_arrays(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values)


@functools.lru_cache(2)
def sides(byte_path: str, piece_path: str) -> tuple[Side, Side]:
    """Both tokenizers, once for each Python worker; both get texts with a blank before them."""
    encoder, letters = _PlainEncoder(byte_path), _byte_of_letter()
    names = [encoder.library.id_to_token(i) for i in range(encoder.library.get_vocab_size(with_added_tokens=True))]
    first = [bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for n in names]
    model, table = pieces.load(piece_path), pieces.ChunkTable(piece_path, REMEMBERED)
    second = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(pieces.MARKER, " ").encode() for i, p in enumerate(map(model.id_to_piece, range(model.vocab_size())))]
    return Side(first, lambda texts: encoder.encode_array(pc.binary_join_element_wise(" ", texts, ""))), Side(second, lambda texts: pieces.encode_array(table, texts))


def _tokens(ids: np.ndarray, ends: np.ndarray, side: Side) -> pd.DataFrame:
    """A row for each token: its document, id, start and end in the bytes of all documents."""
    stop = np.cumsum(side.size[ids])
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    return pd.DataFrame({"doc": doc, "start": stop - side.size[ids], "end": stop, "id": ids.astype(np.int64)})


def common_ends(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each token of either side, whether a token of the other side ends with it."""
    mine, other = a["end"].to_numpy(), b["end"].to_numpy()
    at = np.searchsorted(other, mine)  # both sides end at one byte: none is beyond the other's last
    full_a, full_b = other[at] == mine, np.zeros(len(b), bool)
    full_b[at[full_a]] = True
    return full_a, full_b


def links(a: pd.DataFrame, b: pd.DataFrame, full_b: np.ndarray) -> pd.DataFrame:
    """(doc, start, id_a, id_b): all pairs of tokens that overlap, by the byte that the overlap begins at."""
    one = pd.merge_asof(a[["doc", "start", "id"]], b[["doc", "start", "id"]], on="start", by="doc", suffixes=("_a", "_b"))
    # tokens that start together, after a common end, are found in both directions
    late = b.loc[~np.append(True, full_b[:-1])[: len(b)], ["doc", "start", "id"]]
    two = pd.merge_asof(late, a[["doc", "start", "id"]], on="start", by="doc", suffixes=("_b", "_a"))
    return pd.concat([one, two])


def group_hashes(a: pd.DataFrame, b: pd.DataFrame, full: tuple[np.ndarray, np.ndarray], count: int, sides_: tuple[Side, Side]) -> tuple[np.ndarray, list[str]]:
    """For each of ``count`` documents its number of groups, and the sha256 of ``a1,a2|b1;a3|b2,b3`` ("" without tokens)."""
    stop_a, stop_b = (np.flatnonzero(f) for f in full)  # the last tokens of each group
    docs = a["doc"].to_numpy()[stop_a]
    last = np.append(docs[1:] != docs[:-1], True)[: len(docs)]
    group_a, group_b = (np.cumsum(f) - f for f in full)
    # a group's tokens of side a come after those of side b of all groups before it, its tokens of side b after its own of side a
    place_a = np.arange(len(a)) + np.append(0, stop_b + 1)[group_a]
    place_b = np.arange(len(b)) + (stop_a + 1)[group_b]
    after_a, after_b = full[0].astype(np.int64), np.zeros(len(b), np.int64)
    after_b[stop_b] = np.where(last, 3, 2)
    text = np.empty(len(a) + len(b), np.int64)
    one, two = sides_
    text[place_a] = after_a * len(one.size) + a["id"].to_numpy()
    text[place_b] = (4 * len(one.size)) + after_b * len(two.size) + b["id"].to_numpy()
    written = _written(one, two).take(pa.array(text))
    offsets = np.frombuffer(written.buffers()[1], np.int32)[: len(written) + 1] if len(written) else np.zeros(1, np.int32)
    data = memoryview(written.buffers()[2] or b"")
    tokens = np.bincount(a["doc"].to_numpy(), minlength=count) + np.bincount(b["doc"].to_numpy(), minlength=count)
    upto = offsets[np.cumsum(tokens)].tolist()
    hashes = [hashlib.sha256(data[lo:hi]).hexdigest() if hi > lo else "" for lo, hi in zip([0, *upto], upto)]
    return np.bincount(docs, minlength=count), hashes


@functools.lru_cache(2)
def _written(one: Side, two: Side) -> pa.Array:
    """Ids of both sides in decimal, each with what may follow one: within a group, between its sides, between groups, nothing."""
    return pa.array([f"{i}{after}".encode() for s in (one, two) for after in (",", "|", ";", "") for i in range(len(s.size))], pa.binary())


_ALIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
    + [("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def _align(part: pa.RecordBatch, one: Side, two: Side) -> pa.RecordBatch:
    texts, count = part.column("text").fill_null(""), part.num_rows
    empty = pc.equal(pc.binary_length(texts), 0)
    led = byte_strings(pc.binary_join_element_wise(" ", texts, "").cast(pa.binary()))
    encoded = [side.encode(texts) for side in (one, two)]
    fits = np.array([not e and x and y for e, x, y in zip(empty.to_pylist(), *(s.covers(*e, led) for s, e in zip((one, two), encoded)))], bool)
    a, b = (_tokens(*_only(*e, fits), s) for s, e in zip((one, two), encoded))
    full = common_ends(a, b)
    found = links(a, b, full[1])
    groups, hashes = group_hashes(a, b, full, count, (one, two))
    docs = found["doc"].to_numpy()
    width = len(one.size) * len(two.size)
    linked = np.sort(docs * width + found["id_a"].to_numpy() * len(two.size) + found["id_b"].to_numpy())
    heads = np.flatnonzero(np.append(True, linked[1:] != linked[:-1])[: len(linked)])
    pair, times = linked[heads], np.diff(heads, append=len(linked))
    ends = np.searchsorted(pair, np.arange(1, count + 1) * width)
    lists = [list_array((pair % width).astype(np.int32), ends), list_array(times.astype(np.int32), ends)]
    numbers = [np.bincount(x, minlength=count) for x in (a["doc"].to_numpy(), b["doc"].to_numpy())]
    columns = [part.column("doc_id"), *map(pa.array, (*numbers, groups, np.bincount(docs, minlength=count))), pa.array(hashes, pa.string()), *lists]
    return pa.RecordBatch.from_arrays(columns, schema=_ALIGNED)


def _only(ids: np.ndarray, ends: np.ndarray, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts that fit; the others have none."""
    size = np.diff(ends, prepend=0)
    return ids[np.repeat(fits, size)], np.cumsum(np.where(fits, size, 0))


def _blocks(batches, byte_path: str, piece_path: str):
    one, two = sides(byte_path, piece_path)
    if len(one.size) * len(two.size) >= 2**31:
        raise ValueError("the vocabularies are too large for pairs of 31 bits")
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        for lo, hi in slices([n + 1 for n in sizes], BLOCK_BYTES):
            yield _align(batch.slice(lo, hi - lo), one, two)


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) for each row of ``docs`` (doc_id long, text string).

    Side a is a byte-level BPE file of the tokenizers library on a blank and the text,
    with special tokens' strings as plain text; side b a SentencePiece model, which
    puts that blank itself.  ``pairs`` has a document's distinct linked pairs of ids as
    a * (size of b's vocabulary) + b, ``times`` how often each is linked.

    Texts whose joined token bytes on either side aren't the blank and the text
    (those with U+2581, say) and null and empty ones have no tokens; rows with a null
    or repeated doc_id are aligned like any other; a very long text is a block of its
    own, in memory that grows with it; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda it: released(_blocks(it, byte_path, piece_path)), ALIGNED)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair int, n long, best boolean): in how many rows of ``align`` a pair is linked, and whether none of its id of side a is in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = materialize(counts.withColumn("a", F.expr(f"pair DIV {width}")), "align-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    few = most.hint("broadcast")  # a row for each id of side a at most
    return counts.join(few, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score(docs: DataFrame, byte_path: str, piece_path: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs``.

    A pair's count is in how many rows it is linked.  ``count_sum`` adds it up over a
    row's links; ``n_best`` counts links whose pair has the highest count of its id of
    side a, ties included.  The table of counts, one row for each pair that is ever
    linked, is broadcast where it has ``most`` rows at most, else joined by shuffle;
    each row's links are then summed by row.
    """
    width = sides(byte_path, piece_path)[1].size.size
    aligned = align(docs, byte_path, piece_path).withColumn("row", F.monotonically_increasing_id())
    aligned = materialize(aligned, "align-rows")
    counts = materialize(pair_counts(aligned, width), "align-pairs")
    small = counts.limit(most + 1).count() <= most
    each = aligned.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    joined = each.join(F.broadcast(counts) if small else counts.hint("merge"), "pair")
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    sums = joined.groupBy("row").agg(best, F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    sums = materialize(sums, "align-sums")
    forget(counts)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return aligned.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
