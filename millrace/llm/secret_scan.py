"""Secret scans: a recursive decoding worklist, each layer rescanned and its spans mapped back."""

from __future__ import annotations

import base64
import binascii
import bisect
import codecs
import hashlib
import re
import zlib
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import text_blocks
from millrace.llm.common import released

#: Kinds in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
_URL, _UNICODE = re.compile(r"(?:%[0-9A-Fa-f]{2})+"), re.compile(r"(?:\\u[0-9A-Fa-f]{4})+")
#: Other ways to write code points.
_FORMS = re.compile(r"(?:\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|%u[0-9A-Fa-f]{4}|(?:\\x[0-9A-Fa-f]{2})+)+")
_FORM = re.compile(r"\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|%u([0-9A-Fa-f]{4})|((?:\\x[0-9A-Fa-f]{2})+)")
#: The shortest secret is 14 bytes, which is 19 characters of base64.
_BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, as MIME, PEM and the base64 command write it; line ends may be written out.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:(?:\r?\n|(?:\\r)?\\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_LEAST_RUN = 19
_BREAK = re.compile(r"(?:\s|\\r|\\n)+")
#: Secrets and encoded runs are ASCII, so this much of a run's bytes is what may hold one.
_ASCII = re.compile(rb"[\t\n\r\x20-\x7e]{8,}")
#: The same in UTF-16, of either order.
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){8,}|(?:\x00[\t\n\r\x20-\x7e]){8,}")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: The first two bytes of zlib data with smaller windows: deflate, no dictionary, a multiple of 31.
_SMALL = re.compile(b"|".join(re.escape(bytes([w << 4 | 8, f])) for w in range(7) for f in range(256) if ((w << 4 | 8) << 8 | f) % 31 == 0 and not f & 32))
#: What inflates is scanned in windows of about so many bytes, each of which ends where no secret and no encoded run can lie:
#: after a byte that none holds, or a single blank that isn't next to a sign of assignment or another blank.
#: Where no such place comes for ``STRETCH`` bytes, windows overlap by ``OVERLAP`` bytes instead.
WINDOW_BYTES, STRETCH, OVERLAP, _STEP = 4_000_000, 16_000_000, 1 << 16, 1 << 18
_EDGE = re.compile(rb"[^A-Za-z0-9+/_.=%\\\"':\s\x80-\xff{}-]|(?<=[^\s:=]) (?=[^\s:=])")
#: An encoded run that inflates beyond this many bytes is scanned up to there and counted: this bounds time, windows bound memory.
MAX_LAYER = 16_000_000_000


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets in plain sight: leftmost, not overlapping within a kind."""
    found = []
    if any(w in low for w in _WORDS) if (low := text.lower()) else False:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text and, piece by piece, where it comes from in its parent."""

    def __init__(self, text: str, parent: Layer | None = None, pieces: list[tuple[int, int, int, int]] = ()):
        self.text, self.parent, self.pieces = text, parent, pieces
        self.starts = [p[0] for p in pieces]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text that the span ``start:end`` of this layer stands for.

        ``pieces`` (start here, end here, start there, end there) are what was
        decoded; it maps as a whole, and what lies between them shifts along.
        """
        if self.parent is None:
            return start, end
        return self.parent.origin(self._back(start, False), self._back(end, True))

    def _back(self, at: int, is_end: bool) -> int:
        i = (bisect.bisect_left if is_end else bisect.bisect_right)(self.starts, at) - 1
        if i < 0:
            return at
        here, end, there, there_end = self.pieces[i]
        inside = at <= end if is_end else at < end
        if inside:
            return there_end if is_end else there
        return there_end + at - end


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match that decodes replaced, or None."""
    out, pieces, at, length = [], [], 0, 0
    for m in pattern.finditer(layer.text):
        new = decode(m[0])
        if new is None:
            continue
        out += [layer.text[at : m.start()], new]
        length += m.start() - at
        pieces.append((length, length + len(new), m.start(), m.end()))
        length, at = length + len(new), m.end()
    return Layer("".join([*out, layer.text[at:]]), layer, pieces) if pieces else None


def _strict(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def _keep_url(e):
    return "".join(f"%{x:02X}" for x in e.object[e.start : e.end]), e.end


def _keep_unicode(e):
    return "\\u" + e.object[e.start : e.start + 2].hex(), e.start + 2


codecs.register_error("secret-keep-url", _keep_url)
codecs.register_error("secret-keep-unicode", _keep_unicode)


def _from_url(run: str) -> str | None:
    new = bytes.fromhex(run.replace("%", "")).decode("utf-8", "secret-keep-url")
    return None if new.upper() == run.upper() else new


def _from_unicode(run: str) -> str | None:
    new = bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "secret-keep-unicode")
    return None if new.upper() == run.upper() else new


def _form(m: re.Match) -> str:
    if m[4]:
        data = bytes.fromhex(m[4].replace("\\x", ""))
        return _strict(data, "utf-8") or data.decode("latin-1")
    code = int(m[1] or m[2] or m[3], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def _from_forms(run: str) -> str | None:
    new = _FORM.sub(_form, run)
    return None if new == run else new


def _begins(data, at: int) -> bool:
    """Whether what looks like compressed data at a place has a first block that can be one."""
    if data[at] == 0x1F:
        return len(data) > at + 3 and data[at + 3] < 32
    if len(data) < at + 3 or (kind := data[at + 2] >> 1 & 3) == 3:
        return False
    stored = data[at + 3 : at + 7]
    return kind > 0 or len(stored) == 4 and stored[0] ^ stored[2] == 255 == stored[1] ^ stored[3]


def _sliced(data):
    """Bytes in pieces that are not copied."""
    view = memoryview(data)
    return (view[i : i + _STEP] for i in range(0, len(view), _STEP))


def _inflates(data) -> bool:
    """Whether zlib data inflates to its end, checksum included."""
    unpack = zlib.decompressobj()
    try:
        for piece in _sliced(data):
            while len(piece):
                unpack.decompress(piece, _STEP)
                piece = unpack.unconsumed_tail
            if unpack.eof:
                return True
    except zlib.error:
        pass
    return False


def _inflate(pieces, state: dict):
    """What gzip (all members) or zlib data holds, piece by piece.  Where nothing comes out, the data itself, marked plain."""
    held, unpack, data, some = [], zlib.decompressobj(47), b"", False
    while data := data or next(pieces, b""):
        if not some:
            held.append(data)
        try:
            new = unpack.decompress(data, _STEP)
        except zlib.error:
            new, unpack = b"", None
        if new:
            some, held = True, []
            state["left"] -= len(new)
            if state["left"] < 0:
                raise ValueError("too large")
            yield new
        if unpack is None:
            break
        data = unpack.unconsumed_tail
        if unpack.eof:
            data = unpack.unused_data
            while len(data) < 2 and (more := next(pieces, b"")):
                data += more
            if data[:2] != b"\x1f\x8b":
                break
            unpack = zlib.decompressobj(47)
    if not some:
        state["plain"] = True
        yield from held
        yield from pieces


def _unpacked(data: bytes, most: int):
    """(pieces, whether anything was inflated) of data that may be compressed any number of times."""
    pieces, state, inflated = _sliced(data), {"left": most, "plain": False}, False
    if _SMALL.match(data) and _inflates(data):
        inner = _inflate(pieces, state)
        pieces, inflated = chain([next(inner, b"")], inner), True
    while True:
        head, held = b"", []
        while len(head) < 3 and (piece := next(pieces, b"")):
            head += piece
            held.append(piece)
        pieces = chain(held, pieces)
        if state["plain"] or not _PACKED.match(head):
            return pieces, inflated
        inner = _inflate(pieces, state)
        pieces = chain([next(inner, b"")], inner)
        inflated |= not state["plain"]


def _windows(pieces):
    """The pieces joined to windows; each byte is looked at once for a place to end."""
    rest, edge, looked = bytearray(), 0, 0
    for piece in pieces:
        rest += piece
        if len(rest) < WINDOW_BYTES:
            continue
        for start in (max(looked - 1, len(rest) - OVERLAP, 0), max(looked - 1, 0)):
            for m in _EDGE.finditer(rest, start) if not edge else ():
                edge = m.end()
        looked = len(rest)
        if edge:
            yield bytes(rest[:edge])
            del rest[:edge]
            edge, looked = 0, len(rest)
        elif len(rest) >= STRETCH:
            yield bytes(rest)
            del rest[:-OVERLAP]
            looked = len(rest)
    if rest:
        yield bytes(rest)


def _wide(data: bytes):
    """The stretches of UTF-16 in bytes, as text."""
    if b"\0" in data:
        for m in _WIDE.finditer(data):
            yield m[0].replace(b"\0", b"").decode("ascii")


def _texts(data: bytes, most: int):
    """The text in bytes that may be compressed any number of times, in windows; "" where there is more than ``most`` bytes of it.

    Bytes that aren't compressed must be UTF-8; in inflated ones, what isn't is replaced.
    """
    try:
        pieces, inflated = _unpacked(data, most)
        for window in _windows(pieces):
            text = window.decode("utf-8", "replace") if inflated else _strict(window, "utf-8")
            if text:
                yield text
            yield from _wide(window)
    except (ValueError, RecursionError):
        yield ""


def _decoded(blob: str) -> bytes | None:
    """The bytes of a base64 run that is one as a whole."""
    core = blob.rstrip("=")
    if len(core) % 4 == 1:
        return None
    try:
        return base64.b64decode(core + "=" * (-len(core) % 4), altchars=b"-_" if "-" in core or "_" in core else None)
    except binascii.Error:
        return None


def _parts(run: str, most: int):
    """(text, start, end) of what a base64 run holds from whatever place on: a prefix may shift it, other words may follow.

    The run is decoded at each of the four alignments; its ASCII stretches, and
    what begins like compressed data and is, are taken.
    """
    core = run.rstrip("=").replace("-", "+").replace("_", "/")
    for shift in range(4):
        own = core[shift:]
        own = own[:-1] if len(own) % 4 == 1 else own
        data = base64.b64decode(own + "=" * (-len(own) % 4))
        for m in _ASCII.finditer(data):
            yield m[0].decode("ascii"), shift + m.start() // 3 * 4, min(shift + -(-m.end() // 3) * 4, len(run))
        for m in _WIDE.finditer(data) if b"\0" in data else ():
            yield m[0].replace(b"\0", b"").decode("ascii"), shift + m.start() // 3 * 4, min(shift + -(-m.end() // 3) * 4, len(run))
        for at in _starts(data):
            for text in _packed(memoryview(data)[at:], most):
                yield text, shift + at // 3 * 4, len(run)


def _starts(data: bytes):
    """Where compressed data may begin."""
    yield from (m.start() for m in _PACKED.finditer(data) if _begins(data, m.start()))
    if _SMALL.match(data) and _inflates(data):
        yield 0


def _packed(data, most: int):
    """The texts of data that looks compressed, where it is."""
    try:
        pieces, inflated = _unpacked(data, most)
        for window in _windows(pieces) if inflated else ():
            yield window.decode("utf-8", "replace")
            yield from _wide(window)
    except (ValueError, RecursionError):
        yield ""


def _escaped(layer_text: str, most: int):
    """(text, start, end) of what compressed bytes in runs of URL or Unicode escapes hold."""
    for pattern, width, take in ((_URL, 3, slice(1, 3)), (_UNICODE, 6, slice(4, 6))):
        if (pattern is _URL and "%" not in layer_text) or (pattern is _UNICODE and "\\u" not in layer_text):
            continue
        for m in pattern.finditer(layer_text):
            run = m[0]
            if len(run) < 8 * width:
                continue  # fewer bytes than a compressed stream has
            data = bytes.fromhex("".join(run[i : i + width][take] for i in range(0, len(run), width)))
            for at in _starts(data):
                for text in _packed(memoryview(data)[at:], most):
                    yield text, m.start() + width * at, m.end()


def _inner(layer: Layer, most: int):
    """The layers that a layer holds, one after another; None for each run that inflates beyond ``most`` bytes."""
    text = layer.text
    if "%" in text and (new := _replaced(layer, _URL, _from_url)):
        yield new
    if "\\u" in text and (new := _replaced(layer, _UNICODE, _from_unicode)):
        yield new
    if any(x in text for x in ("\\x", "\\U", "\\u{", "%u")) and (new := _replaced(layer, _FORMS, _from_forms)):
        yield new
    for inner, start, end in _escaped(text, most):
        yield Layer(inner, layer, [(0, len(inner), start, end)]) if inner else None
    for m in _BLOB.finditer(text):
        data, whole = _decoded(m[0]), False
        for inner in _texts(data, most) if data else ():
            whole = True
            yield Layer(inner, layer, [(0, len(inner), m.start(), m.end())]) if inner else None
        for inner, start, end in _parts(m[0], most) if not whole else ():
            yield Layer(inner, layer, [(0, len(inner), m.start() + start, m.start() + end)]) if inner else None
    for m in _WRAPPED.finditer(text) if "\n" in text or "\\n" in text else ():
        wrapped = m[0]
        lines = list(_solid(wrapped))
        run = "".join([wrapped[at:stop] for at, stop in lines])
        if len(run) < _LEAST_RUN:
            continue
        firsts = [0, *accumulate(stop - at for at, stop in lines)]
        place = lambda i: m.start() + lines[k := bisect.bisect_right(firsts, i) - 1][0] + i - firsts[k]  # noqa: B023, E731
        for inner, start, end in _parts(run, most):
            yield Layer(inner, layer, [(0, len(inner), place(start), place(end - 1) + 1)]) if inner else None


def _solid(run: str):
    """The stretches of a run between its line ends."""
    at = 0
    for m in _BREAK.finditer(run):
        yield at, m.start()
        at = m.end()
    yield at, len(run)


def find(text: str, most: int = MAX_LAYER) -> tuple[list, list, int]:
    """(base spans, all spans, runs that inflate beyond ``most`` bytes) of a text; spans (start, kind, end) in code points.

    The worklist is worked off depth first: it has the layers that are open, one in
    another, each of which makes its inner ones when they are wanted, so one window of
    what a run holds is kept for each depth.  A layer is scanned; one with URL or
    Unicode escapes has them replaced, which gives a new layer, what is no valid escape
    staying as it is; each base64 run that holds text, in UTF-8 or UTF-16, compressed or
    not, gives some too, also one over several lines or behind a prefix.  It ends when
    no new layer comes up: a text whose hash was seen before at the same place is not
    taken again.
    """
    base = scan(text)
    spans, seen, closed = set(base), set(), 0
    work = [iter([Layer(text)])]
    while work:
        layer = next(work[-1], work)
        if layer is work:
            work.pop()
            continue
        if layer is None:
            closed += 1
            continue
        key = (layer.origin(0, len(layer.text)), hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        if key in seen:
            continue
        seen.add(key)
        if layer.parent is not None:
            for start, kind, end in scan(layer.text):
                at, to = layer.origin(start, end)
                spans.add((at, kind, to))
        work.append(_inner(layer, most))
    return base, sorted(spans), closed


_SPANS = "array<struct<kind: string, start: long, end: long>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _named(spans: list) -> list:
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]


def _find(batches, most: int):
    for part, texts in text_blocks(batches, "text"):
        found = [find(t or "", most) for t in texts.to_pylist()]
        columns = [pa.array([_named(f[i]) for f in found], _ARROW) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *columns, pa.array([f[2] for f in found], pa.int64())], ["doc_id", "base", "spans", "n_closed"]
        )


def find_secrets(docs: DataFrame, *, max_layer: int = MAX_LAYER) -> DataFrame:
    """(doc_id, base, spans, n_closed) for each row of ``docs`` (doc_id long, text string).

    ``base`` holds the spans in plain sight, ``spans`` those and what decoding
    adds, each by start and kind.  Null and empty texts have none; rows with a
    null or repeated doc_id are scanned like any other; other columns are
    ignored.  A very long text is scanned whole, in one task; what it holds in compressed
    form is inflated and scanned in windows, one at a time, which end where no secret can lie, or overlap where
    16 MB have no such place: an encoded run of more than 16 MB within what was inflated is decoded in parts.  ``n_closed`` counts encoded runs that
    inflate to more than ``max_layer`` bytes; they are scanned up to there.
    """
    schema = f"doc_id long, base {_SPANS}, spans {_SPANS}, n_closed long"
    return docs.select("doc_id", "text").mapInArrow(lambda it: released(_find(it, max_layer)), schema)


def span_text(spans: str):
    """kind:start:end of a column of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_closed)."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(span_text("base"), 256).alias("base_sha256"),
        span_text("spans").alias("spans"),
        "n_closed",
    )


def masked(text: str, mark: str, most: int = MAX_LAYER) -> str:
    """The text with each secret, and each encoded run that holds one, replaced by ``mark``."""
    out, at = [], 0
    spans = find(text, most)[1]
    if not spans:
        return text
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _mask(batches, mark: str, most: int):
    for part, _ in text_blocks(batches, "text"):
        at = part.schema.get_field_index("text")
        texts = [t if t is None else masked(t, mark, most) for t in part.column(at).to_pylist()]
        yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))


def mask_secrets(docs: DataFrame, *, mark: str = "<secret>", max_layer: int = MAX_LAYER) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by ``mark``; every row and column stays."""
    return docs.mapInArrow(lambda it: released(_mask(it, mark, max_layer)), docs.schema)
