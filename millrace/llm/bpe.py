"""BPE encoding and decoding with the tokenizers library; long texts by tree concatenation."""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_strings, materialize, released, slices

#: Texts of more characters are cut into leaves, which are encoded in parallel.
LONG_CHARS, LEAF_CHARS = 65_536, 32_768
#: Tokens that must agree, one after another, on either side of a join; tokens of the first window.
AGREE, WINDOW = 4, 32
#: Characters next to a cut, and to a window's own ends, whose tokens never count as agreeing: they
#: may lie in a special token, a contraction or a composed letter that the cut goes through.
MARGIN = 24
#: Bytes of text that are encoded together, and ids that are decoded together.
BLOCK_BYTES, BLOCK_IDS = 2_000_000, 500_000
#: Chunks that a worker remembers (about 200 bytes each); several workers of an executor encode and decode.
REMEMBERED = 200_000


#: Byte-level spelling: printable Latin-1 characters stand for their own bytes, the others are moved up from U+0100 on.
_KEPT = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _KEPT)}


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies; any other path can be given to the operators instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(4)
def load(path: str):
    """The library's tokenizer of a vocabulary file, once for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


_WS, _SAFE, _LETTER, _STOP, _TWO, _REST = 1, 2, 4, 8, 16, 32


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[list(b" \t\n\r")] = _WS
    kinds[33:127] = _SAFE
    kinds[[*range(65, 91), *range(97, 123)]] |= _LETTER
    kinds[list(b",.")] |= _STOP
    kinds[0xC3:0xE0], kinds[0x80:0xC0] = _TWO, _REST
    return kinds


_KINDS = _byte_kinds()
_TRANSLATE = _KINDS.tobytes()


def _places(n: int, *places: np.ndarray) -> np.ndarray:
    """The distinct ones of places from 0 to ``n``, in order, with 0 itself."""
    marks = np.zeros(n + 1, bool)
    marks[0] = True
    for at in places:
        marks[at] = True
    return np.flatnonzero(marks)


class ChunkEncoder:
    """Encodes texts by chunks between which no token can reach, remembering chunks.

    ``split`` names where the vocabulary's own pre-tokenizer always cuts:
    "blank": at ASCII white space, which it drops (so does the result here);
    "lead": before a run of ASCII white space that follows another character;
    "": nowhere.  With either of the first two, a comma or full stop after a
    letter begins a chunk too.  Where it isn't certain that the pre-tokenizer cuts
    (after characters that may be Unicode white space), no cut is made.

    The texts of a block are cut by vector code and their distinct chunks found by
    an Arrow dictionary; only chunks that aren't remembered reach the library.
    """

    def __init__(self, path: str, split: str, limit: int = 150_000):
        self.library, self.split, self.limit = load(path), split, limit
        self._forget()

    def _forget(self):
        self.known, self.flat, self.begin, self.count, self.uses = {}, array("i"), array("q"), array("i"), np.zeros(0, np.int64)

    def _shrink(self):
        """Keeps the chunks that the most blocks held, half of the limit at most."""
        known, flat, begin, count, uses = self.known, self.flat, self.begin, self.count, self.uses
        often = np.sort(uses[list(known.values())])[-(self.limit // 2) :]
        least = int(often[0]) + 1 if len(often) else 1
        self._forget()
        for chunk, slot in known.items():
            if slot < len(uses) and uses[slot] >= least:
                self.known[chunk] = len(self.begin)
                self.begin.append(len(self.flat))
                self.count.append(count[slot])
                self.flat.extend(flat[begin[slot] : begin[slot] + count[slot]])
        self.uses = np.ones(len(self.begin), np.int64)

    def _cut(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes to encode, the ends of the texts in them, and the bounds of the chunks (from 0)."""
        if not self.split:
            return data, ends, _places(len(data), ends)
        kinds = np.frombuffer(data.tobytes().translate(_TRANSLATE), np.uint8)
        at = np.flatnonzero(kinds & (_WS | _STOP) > 0)
        blank = kinds[at] & _WS > 0
        before, second = data[at - 1], data[np.maximum(at - 2, -len(data))]  # of the first places the last bytes, which change nothing: a text begins there
        wide = (_KINDS[before] & _REST > 0) & (_KINDS[second] & _TWO > 0)
        letter = (_KINDS[before] & _LETTER > 0) | wide & (second == 0xC3) & (before != 0x97) & (before != 0xB7)
        if self.split == "lead":
            at = at[np.where(blank, (_KINDS[before] & _SAFE > 0) | wide, letter)]
        else:
            gone = at[blank]
            data = data[kinds & _WS == 0]
            at = (at - np.cumsum(blank) + blank)[blank | letter]
            ends = ends - np.searchsorted(gone, ends)
        return data, ends, _places(len(data), at, ends)

    def _piece(self, word: str) -> str | None:
        """A word of plain letters, which is one piece, in the spelling that the merges use; None for others.

        Letters up to U+0250 are composed already and stay one letter in lower case, but for U+0130.
        """
        if not word.isalpha() or not (word.isascii() or max(word) < "\u0250" and "\u0130" not in word):
            return None
        if self.split == "blank":
            word = word.lower()
        return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)

    def _learn(self, chunks: list[bytes]) -> list[int]:
        """The slots of chunks that aren't remembered: plain words go to the library's model at once, others through its whole encoding."""
        tokenize, flat, out, rest, lead = self.library.model.tokenize, self.flat, {}, [], self.split == "lead"
        for chunk in chunks:
            text = chunk.decode()
            own = lead and text[:1] == " "
            piece = self._piece(text[1:] if own else text) if self.split else None
            if piece is None:
                rest.append(chunk)
                continue
            ids = [t.id for t in tokenize("\u0120" + piece if own else piece)]
            out[chunk] = len(self.begin)
            self.begin.append(len(flat))
            self.count.append(len(ids))
            flat.extend(ids)
        for chunk, found in zip(rest, self.library.encode_batch_fast([c.decode() for c in rest], add_special_tokens=False)):
            out[chunk] = len(self.begin)
            self.begin.append(len(flat))
            self.count.append(len(found.ids))
            flat.extend(found.ids)
        self.known.update((c, slot) for c, slot in out.items() if len(c) <= 40)
        return [out[c] for c in chunks]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids (int32) of the texts one after another, and where each text's ids end; null counts as empty."""
        texts = texts.fill_null("").cast(pa.binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        if offsets[-1] == offsets[0]:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        data, ends, bounds = self._cut(data, offsets[1:].astype(np.int64) - offsets[0])
        if len(self.known) > self.limit or len(self.flat) > 16 * self.limit:
            self._shrink()
        buffers = [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
        chunks = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers).dictionary_encode()
        words = byte_strings(chunks.dictionary)
        slots = list(map(self.known.get, words))
        if None in slots:
            new = iter(self._learn([w for w, s in zip(words, slots) if s is None]))
            slots = [next(new) if s is None else s for s in slots]
        slots = np.array(slots, np.int64)
        self.uses = np.append(self.uses, np.zeros(len(self.begin) - len(self.uses), np.int64))
        self.uses[slots] += 1
        begin, count = np.frombuffer(self.begin, np.int64)[slots], np.frombuffer(self.count, np.int32)[slots]
        index = chunks.indices.to_numpy()
        count = count[index]
        upto = np.cumsum(count, dtype=np.int64)
        total = int(upto[-1]) if len(upto) else 0
        places = np.repeat(begin[index] - upto + count, count) + np.arange(total)
        ids = np.frombuffer(self.flat, np.int32)[places] if total else np.zeros(0, np.int32)
        return ids, np.append(0, upto)[np.searchsorted(bounds, ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as int32 in the machine's order."""
        ids, ends = self.encode_array(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, ends[:-1])] if texts else []


@functools.lru_cache(4)
def chunk_encoder(path: str, split: str, limit: int) -> ChunkEncoder:
    """The encoder of this Python worker, which goes on from task to task with what it remembers."""
    return ChunkEncoder(path, split, limit)


def list_array(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))


def text_blocks(batches, column: str, most: int = BLOCK_BYTES):
    """Slices of the batches of about ``most`` bytes of text each, with that column of theirs."""
    for batch in batches:
        texts = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for lo, hi in slices([n + 1 for n in sizes], most):
            yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo)


def _encode(batches, path: str, split: str):
    encoder = chunk_encoder(path, split, REMEMBERED)
    for part, texts in text_blocks(batches, "text"):
        yield pa.RecordBatch.from_arrays([part.column(0), list_array(*encoder.encode_array(texts))], ["doc_id", "ids"])


NODE = "rid long, doc_id long, idx long, text string, ids binary, starts binary, ends binary"


def _leaves(batches, chars: int):
    for batch in batches:
        for row in batch.to_pylist():
            cuts = range(0, len(row["text"]), chars)
            yield pa.RecordBatch.from_pylist(
                [row | {"idx": i, "text": row["text"][c : c + chars]} for i, c in enumerate(cuts)],
                pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("idx", pa.int64()), ("text", pa.string())]),
            )


def _tokens(library, text: str, shift: int = 0) -> np.ndarray:
    """Rows (id, start, end) of the text's tokens, in characters from ``-shift``."""
    found = library.encode(text, add_special_tokens=False)
    out = np.empty((len(found.ids), 3), np.int32)
    out[:, 0] = found.ids
    if len(out):
        out[:, 1:] = np.array(found.offsets, np.int32) + shift
    return out


def _encode_leaves(batches, path: str):
    library = load(path)
    for batch in batches:
        for row in batch.to_pylist():
            t = _tokens(library, row["text"])
            row |= {"ids": t[:, 0].tobytes(), "starts": t[:, 1].tobytes(), "ends": t[:, 2].tobytes()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([*batch.schema, *((n, pa.binary()) for n in ("ids", "starts", "ends"))]))


def _run_of_agreement(window: np.ndarray, side: np.ndarray, start: int, end: int, last: bool) -> tuple[int, int] | None:
    """Where ``AGREE`` tokens within characters ``start:end`` are the same in both: the first place, or the last one."""
    at = {tuple(t): i for i, t in enumerate(side.tolist())}
    order = np.flatnonzero((window[:, 1] >= start) & (window[:, 2] <= end)).tolist()
    order = [p for p in order if p + AGREE <= len(window) and window[p + AGREE - 1, 2] <= end]
    for p in reversed(order) if last else order:
        i = at.get(tuple(window[p].tolist()))
        if i is not None and i + AGREE <= len(side) and (window[p : p + AGREE] == side[i : i + AGREE]).all():
            return p, i
    return None


def concatenate(library, text: str, cut: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The tokens of ``text`` from those of ``text[:cut]`` and ``text[cut:]`` (offsets in ``text``).

    A window of tokens around the cut is encoded anew.  It is taken when a run of
    its tokens equals a run of the left side and another one a run of the right
    side: every two adjacent tokens of the spliced result then stand together in
    some valid encoding, which for BPE makes the whole valid.  Otherwise the
    window doubles; in the end it is the whole text.
    """
    reach = WINDOW
    while True:
        a = int(left[-reach, 1]) if reach < len(left) else 0
        b = int(right[reach - 1, 2]) if reach < len(right) else len(text)
        window = _tokens(library, text[a:b], a)
        lo, hi = (0, 0), (len(window), len(right))
        if a > 0:
            lo = _run_of_agreement(window, left[-reach:], a + MARGIN, cut - MARGIN, last=True)
            lo = lo and (lo[0], len(left) - reach + lo[1])
        if b < len(text):
            hi = _run_of_agreement(window, right[:reach], cut + MARGIN, b - MARGIN, last=False)
        if lo and hi:
            return np.concatenate([left[: lo[1]] if a > 0 else left[:0], window[lo[0] : hi[0]], right[hi[1] :]])
        reach *= 2


def _join_pair(pdf: pd.DataFrame, path: str) -> pd.DataFrame:
    """Two neighbours become one node; a last node without neighbour stays."""
    pdf = pdf.sort_values("idx")
    first = pdf.iloc[0]
    if len(pdf) == 2:
        sides = [np.stack([np.frombuffer(r[c], np.int32) for c in ("ids", "starts", "ends")], 1) for _, r in pdf.iterrows()]
        cut, text = len(first["text"]), first["text"] + pdf.iloc[1]["text"]
        t = concatenate(load(path), text, cut, sides[0], sides[1] + np.array([0, cut, cut], np.int32))
        first = first.copy()
        first[["text", "ids", "starts", "ends"]] = [text, *(np.ascontiguousarray(t[:, i]).tobytes() for i in range(3))]
    first["idx"] //= 2
    return pd.DataFrame([first])


def _long_ids(batches):
    for batch in batches:
        ids = [np.frombuffer(x, "<i4") for x in batch.column(1).to_pylist()]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), list_array(flat, np.cumsum([len(x) for x in ids]))], ["doc_id", "ids"])


IDS, DECODED = "doc_id long, ids array<int>", "doc_id long, ids array<int>, decoded string"


def encode(docs: DataFrame, path: str, *, split: str, long_chars: int = LONG_CHARS, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``docs`` (doc_id long, text string): the library's ids of the whole text.

    Texts up to ``long_chars`` are encoded where they are read.  Longer ones are cut
    into leaves, which spread over the tasks, and neighbours are joined level by
    level.  Null and empty texts have no ids; rows with a null or repeated doc_id
    are encoded like any other; other columns are ignored.
    """
    return _encoded(docs, path, split, long_chars, leaf_chars, iter, IDS)


def round_trip(docs: DataFrame, path: str, *, split: str, long_chars: int = LONG_CHARS, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``decode(encode(docs))``, decoded by the task that encodes: the ids don't leave its worker in between."""
    return _encoded(docs, path, split, long_chars, leaf_chars, lambda it: released(_decode(it, path)), DECODED)


def _encoded(docs: DataFrame, path: str, split: str, long_chars: int, leaf_chars: int, then, schema: str) -> DataFrame:
    docs = docs.select("doc_id", "text")
    short = docs.where(f"text IS NULL OR length(text) <= {long_chars}")
    short = short.mapInArrow(lambda it: released(then(_encode(it, path, split))), schema)
    found = docs.where(f"length(text) > {long_chars}")
    found = materialize(found.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "bpe-long")
    most = found.agg(F.max(F.length("text"))).first()[0]
    if most is None:
        return short
    nodes = found.mapInArrow(lambda it: _leaves(it, leaf_chars), "rid long, doc_id long, idx long, text string")
    nodes = nodes.repartition("rid", "idx").mapInArrow(lambda it: released(_encode_leaves(it, path)), NODE)
    count = -(-most // leaf_chars)
    while count > 1:
        pairs = nodes.groupBy("rid", F.floor(F.col("idx") / 2).alias("pair"))
        nodes, count = pairs.applyInPandas(lambda pdf: _join_pair(pdf, path), NODE), -(-count // 2)
    long = nodes.select("doc_id", "ids").mapInArrow(lambda it: released(then(_long_ids(it))), schema)
    return short.unionByName(long)


def _decode(batches, path: str):
    library = load(path)
    plain = library.decoder is None  # then decode() joins the tokens by spaces
    tokens = pa.array([library.id_to_token(i) for i in range(library.get_vocab_size(with_added_tokens=True))]) if plain else None
    for batch in batches:
        sizes = batch.column("ids").value_lengths().fill_null(0)
        for lo, hi in slices(sizes.to_pylist(), BLOCK_IDS):
            part = batch.slice(lo, hi - lo)
            ids, ends = part.column("ids"), np.cumsum(sizes.slice(lo, hi - lo).to_numpy())
            if plain:
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), tokens.take(ids.flatten()))
                texts = pc.binary_join(lists, " ")
            else:
                texts = pa.array(library.decode_batch([x or [] for x in ids.to_pylist()], skip_special_tokens=False), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, texts], ["doc_id", "ids", "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for each row of ``encoded``: the library's decode(ids, skip_special_tokens=False)."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: released(_decode(it, path)), DECODED)


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
