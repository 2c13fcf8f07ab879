"""SentencePiece encoding and decoding by a table of distinct chunks.

A marker (U+2581) stands for a blank.  Where no piece of a vocabulary has a marker
after another character, no merge reaches over the place before a run of markers, so
a text is the chain of its chunks, each a run of markers with what follows up to the
next one, and a chunk's ids are the same wherever it stands.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import list_array
from millrace.llm.common import byte_strings, released, slices

MARKER = "▁"
#: Bytes of text that are cut together; longer texts are cut by themselves, in windows of this size.
BLOCK_BYTES = 1_000_000
#: Chunks that a worker's table keeps between blocks, and the bytes of a chunk that is kept.
REMEMBERED, KEPT_BYTES = 200_000, 40
#: Ids that are decoded together.
BLOCK_IDS = 400_000


@functools.lru_cache(2)
def load(path: str):
    """The library's model of a vocabulary file, once for each Python worker; its pieces have to begin with their markers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(re.search(f"[^{MARKER}]{MARKER}", model.id_to_piece(i)) for i in range(model.vocab_size())):
        raise ValueError(f"pieces of {path} cross markers: texts can't be cut there")
    return model


class ChunkTable:
    """Distinct chunks with their ids; a block's new ones are segmented once, by the library."""

    def __init__(self, path: str, limit: int = REMEMBERED):
        self.model, self.limit = load(path), limit
        self.blank = self.model.piece_to_id(MARKER)
        self._forget()

    def _forget(self):
        self.slot, self.flat, self.begin, self.count = {}, array("i"), array("q"), array("q")

    def _segment(self, chunks: list[bytes]) -> list[list[int]]:
        """The library puts a marker before what it encodes: a chunk's first one is left to it."""
        found = self.model.encode([c[1:].decode() for c in chunks], num_threads=1)
        return [ids or [self.blank] for ids in found]

    def _slots(self, chunks: list[bytes]) -> np.ndarray:
        if len(self.slot) > self.limit or len(self.flat) > 16 * self.limit:
            self._forget()
        slots = list(map(self.slot.get, chunks))
        if None in slots:
            new = [c for c, s in zip(chunks, slots) if s is None]
            found, first, at = self._segment(new), len(self.begin), len(self.flat)
            sizes = np.array([len(x) for x in found], np.int64)
            self.begin.frombytes((at + np.cumsum(sizes) - sizes).tobytes())
            self.count.frombytes(sizes.tobytes())
            for ids in found:
                self.flat.extend(ids)
            self.slot.update((c, first + i) for i, c in enumerate(new) if len(c) <= KEPT_BYTES)
            own = iter(range(first, first + len(new)))
            slots = [next(own) if s is None else s for s in slots]
        return np.array(slots, np.int64)

    def encode_block(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, each with a blank before it and blanks for markers, and where each text's ids end."""
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        head = raw == 32
        head[1:] &= raw[:-1] != 32
        starts = np.append(0, ends[:-1])
        head[starts[starts < ends]] = True
        bounds = np.append(np.flatnonzero(head), len(raw))
        buffers = [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]
        chunks = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers).dictionary_encode()
        slots = self._slots(byte_strings(chunks.dictionary))
        begin, count = np.frombuffer(self.begin, np.int64)[slots], np.frombuffer(self.count, np.int64)[slots]
        index = chunks.indices.to_numpy()
        size = count[index]
        upto = np.cumsum(size)
        places = np.repeat(begin[index] - upto + size, size) + np.arange(int(upto[-1]))
        return np.frombuffer(self.flat, np.int32)[places], np.append(0, upto)[np.searchsorted(bounds, ends)]

    def encode_long(self, text: bytes) -> np.ndarray:
        """One text, window by window: a window ends before a run of blanks."""
        parts, at = [], 0
        while at < len(text):
            stop = text.find(b" ", at + BLOCK_BYTES)
            while stop > 0 and text[stop - 1 : stop] == b" ":
                stop = text.find(b" ", stop + 1)
            stop = stop if stop > 0 else len(text)
            parts.append(self.encode_block(text[at:stop], np.array([stop - at]))[0])
            at = stop
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


@functools.lru_cache(2)
def chunk_table(path: str) -> ChunkTable:
    """The table of this Python worker, which goes on from task to task."""
    return ChunkTable(path)


def marked(texts: pa.Array) -> pa.Array:
    """Texts as the library cuts them, in blanks: one before each text that isn't empty, and one for each marker.  Null is empty."""
    texts = pc.replace_substring(texts.fill_null(""), MARKER, " ")
    lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ")
    return pc.binary_join_element_wise(lead, texts, "")


def encode_array(table: ChunkTable, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts one after another, and where each text's end."""
    texts = marked(texts).cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    if len(texts) == 1 and offsets[-1] - offsets[0] > BLOCK_BYTES:
        ids = table.encode_long(texts[0].as_py())
        return ids, np.array([len(ids)])
    data = bytes(memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]]) if offsets[-1] > offsets[0] else b""
    return table.encode_block(data, offsets[1:] - offsets[0])


def text_blocks(batches):
    """Slices of the batches of about ``BLOCK_BYTES`` of text, with their texts; a longer text is alone in its slice."""
    for batch in batches:
        texts = batch.column("text")
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for lo, hi in slices([n + 1 for n in sizes], BLOCK_BYTES):
            yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo)


def _encode(batches, path: str):
    table = chunk_table(path)
    for part, texts in text_blocks(batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), list_array(*encode_array(table, texts))], ["doc_id", "ids"])


def _decode(batches, path: str):
    model = load(path)
    for batch in batches:
        sizes = batch.column("ids").value_lengths().fill_null(0)
        for lo, hi in slices(sizes.to_pylist(), BLOCK_IDS):
            part = batch.slice(lo, hi - lo)
            texts = model.decode([x or [] for x in part.column("ids").to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])


IDS, DECODED = "doc_id long, ids array<int>", "doc_id long, ids array<int>, decoded string"


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``docs`` (doc_id long, text string): the library's ids of the whole text.

    The distinct chunks of a block of texts are looked up in the worker's table, the
    new ones among them segmented once, and the ids go back to the chunks' places by
    vector code: rows stay in their tasks, so no word is hot.  The table is emptied
    when it is full; long chunks aren't kept.  Null and empty texts have no ids; a
    text of blanks has; rows with a null or repeated doc_id are encoded like any
    other; a very long text is cut in windows within its task; other columns are
    ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda it: released(_encode(it, path)), IDS)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for each row of ``encoded``: the library's decode(ids).  Null and empty ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: released(_decode(it, path)), DECODED)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``decode(encode(docs))``, decoded by the task that encodes: the ids don't leave its worker in between."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: released(_decode(_encode(it, path), path)), DECODED)


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    size = F.size("ids").cast("long").alias("n_tokens")
    return decoded.select("doc_id", size, F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
