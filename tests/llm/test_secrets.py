"""Secret scans: base spans against plain regular expressions, and nested layers."""

import base64
import gzip
import hashlib
import random
import re
import subprocess
import sys
import urllib.parse
import zlib

import pytest

from millrace.llm import secret_scan as s

SECRET = 'password = "abcdefgh1234"'


def base(text):
    text, out = text or "", []
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_base_spans_and_digest(docs, rows):
    got = s.digests(s.find_secrets(docs)).collect()
    want = {}
    for r in rows:
        spans = base(r[1])
        text = ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want[r[0]] = (*(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(text.encode()).hexdigest())
    assert len(got) == len(rows) and any(r["n_assign"] for r in got)
    for r in got:
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == want[r["doc_id"]]


quote = lambda t: urllib.parse.quote(t, safe="")
b64 = lambda t: base64.b64encode(t if isinstance(t, bytes) else t.encode()).decode()
LAYERS = [
    quote(SECRET), quote(quote(SECRET)), b64(SECRET), b64(b64(SECRET)), b64(gzip.compress(SECRET.encode())), b64(zlib.compress(SECRET.encode())),
    b64(gzip.compress(b64(quote(SECRET)).encode())), "".join(f"\\u{ord(c):04x}" for c in SECRET), quote(b64(SECRET)), b64(gzip.compress(gzip.compress(SECRET.encode()))),
]


@pytest.mark.parametrize("layer", LAYERS)
def test_nested_layers_map_back(layer):
    text = f"é before {layer} after"
    plain, spans, closed = s.find(text)
    assert closed == 0 and (len(spans) > len(plain) or plain)
    assert any(9 <= a < b <= 9 + len(layer) for a, _, b in spans)
    assert set(plain) <= set(spans)
    assert "abcdefgh1234" not in s.masked(text, "<secret>") and s.masked(text, "<secret>").startswith("é before ")


def test_cycles_end():
    assert s.find("%25" * 50)[2] == 0
    assert s.find("\\u005cu0041" * 20)[1] == []


def test_large_layers_stay_closed():
    bomb = b64(gzip.compress(b"a" * 100_000))
    assert s.find(f"x {bomb} y", most=1000)[2] == 1 and s.find(f"x {bomb} y")[2] == 0


def test_masking_keeps_rows_and_columns(docs, none):
    out = s.mask_secrets(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert not any(r["text"] and base(r["text"]) for r in out.collect())
    assert s.mask_secrets(none).collect() == [] and s.find_secrets(none).collect() == []


LONG = "".join(f"line {i} {hashlib.sha1(str(i).encode()).hexdigest()[:20]}\n" for i in range(40)) + SECRET
wrap = lambda t, n=76, end="\n": end.join(t[i : i + n] for i in range(0, len(t), n))
UNUSUAL = [
    wrap(b64(LONG)), wrap(b64(gzip.compress(LONG.encode()))), wrap(b64(LONG), 64, "\r\n"), f"-----BEGIN X-----\n{wrap(b64(LONG))}\nHello there",
    wrap(b64("x" * 45 + SECRET)), f"path/{b64(SECRET)}", f"key-{b64(SECRET)}", f"name_{b64(SECRET)}", f"some/{b64(gzip.compress(SECRET.encode()))}",
    quote(SECRET) + "%E9", "%E9" + "".join(f"%{ord(c):02x}" for c in SECRET), "\\ud800" + "".join(f"\\u{ord(c):04x}" for c in SECRET),
    b64(gzip.compress(b"first member ") + gzip.compress(SECRET.encode())),
    "%FF" + "".join(f"%{ord(c):02x}" for c in SECRET), b64(SECRET.encode() + " caf\xe9 au lait".encode("latin-1")), b64(("\x01" * 8 + SECRET).encode()),
    "".join(f"%{c:02x}" for c in gzip.compress(SECRET.encode())), "".join(f"\\u{c:04x}" for c in gzip.compress(SECRET.encode())),
    b64(gzip.compress("\xe9 ".encode("latin-1") + SECRET.encode())), b64(gzip.compress(zlib.compress(b"x^2 " + SECRET.encode()))),
]


@pytest.mark.parametrize("layer", UNUSUAL)
def test_wrapped_shifted_and_partly_invalid_runs(layer):
    text = f"é before {layer} after"
    plain, spans, closed = s.find(text)
    added = set(spans) - set(plain)
    assert closed == 0 and any(9 <= a < b <= 9 + len(layer) for a, k, b in added if k == 0)
    assert s.masked(text, "<secret>").startswith("é before ") and s.masked(text, "<secret>").endswith(" after")


def test_plain_words_give_no_layers_with_secrets():
    text = "internationalization-of-everything\nsome/path/to/a_long_name_of_a_file\n" * 50
    assert s.find(text)[1:] == ([], 0)


def test_large_layers_are_scanned_in_windows(monkeypatch):
    monkeypatch.setattr(s, "WINDOW_BYTES", 1000)
    rnd, words = random.Random(4), ["some", "word,", "more;", "text\n", "(x)", "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo="]
    for _ in range(30):
        filler = lambda n: " ".join(rnd.choice(words) for _ in range(n))
        inner = f"{filler(rnd.randint(0, 900))} {rnd.choice(LAYERS)} {filler(rnd.randint(0, 900))}"
        text = f"é before {b64(gzip.compress(gzip.compress(inner.encode())))} after"
        plain, spans, closed = s.find(text)
        assert closed == 0 and any(a == 9 and k == 0 for a, k, b in set(spans) - set(plain))


wide = lambda e: b64(("a plain line " + SECRET).encode(e))


def small_window(data, bits):
    made = zlib.compressobj(wbits=bits)
    return made.compress(data) + made.flush()


FORMS = [
    wide("utf-16-le"), wide("utf-16-be"), b64("x" + SECRET.encode("utf-16-le").decode("latin-1")), b64(gzip.compress(SECRET.encode("utf-16-le"))),
    *(b64(small_window(SECRET.encode(), bits)) for bits in range(9, 16)), b64(small_window(SECRET.encode(), 9) + b"and more"),
    wrap(b64(LONG), 12), wrap(b64(LONG), 76, "\\n"), wrap(b64(SECRET), 20, "\\r\\n"), "".join(f"\\U{ord(c):08x}" for c in SECRET), "".join(f"\\u{{{ord(c):x}}}" for c in SECRET),
    "".join(f"\\x{ord(c):02x}" for c in SECRET), "".join(f"%u{ord(c):04X}" for c in SECRET), quote("".join(f"\\x{c:02X}" for c in b64(SECRET).encode())),
]


@pytest.mark.parametrize("layer", FORMS)
def test_other_encodings(layer):
    text = f"é before {layer} after"
    plain, spans, closed = s.find(text)
    assert closed == 0 and any(9 <= a < b <= 9 + len(layer) for a, k, b in set(spans) - set(plain) if k == 0)
    assert s.masked(text, "<secret>").startswith("é before ") and s.masked(text, "<secret>").endswith(" after")


def peak(code):
    """MB that a process of its own takes at most for some code, and the seconds of its work."""
    head = "import base64, gzip, resource, sys, time, zlib\nsys.path.insert(0, '.')\nfrom millrace.llm import secret_scan as s\n"
    tail = "\nstart = time.process_time()\nfound = s.find(text)\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, time.process_time() - start, len(found[1]))"
    out = subprocess.run([sys.executable, "-c", head + code + tail], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    return float(out[0]), float(out[1]), int(out[2])


PACK = "z = zlib.compressobj(9)\nparts = [z.compress({piece}) for _ in range({n})]\ntext = base64.b64encode(b''.join(parts) + z.compress(b' password = \"abcdefgh1234\"') + z.flush()).decode()"


@pytest.mark.parametrize("piece", ["b'some words and no marks. ' * 40000", "b'z' * 1000000", "b'word,(x);' * 100000"])
def test_memory_and_time_of_what_inflates(piece):
    """A text of a few KB that inflates to 20, then to 120 MB: memory stays, time follows; the secret at the end is found."""
    (small, short, one), (large, long, two) = (peak(PACK.format(piece=piece, n=n)) for n in (20, 120))
    assert one == two == 1 and large < small + 60 and long < 10 * short + 1


def test_time_of_what_only_begins_like_compressed_data():
    for code in ("base64.b64encode(b'\\x78\\x9c' * {n}).decode()", "'a' * {n} + ' \\n b'", "'a\\n' * {n}", "'%41' * {n}", "'\\\\x' * {n}", "'aaaa\\\\n' * {n} + '!'"):
        times = [peak("text = " + code.format(n=n))[1] for n in (50_000, 400_000)]
        assert times[1] < 12 * times[0] + 1, code


def test_windows_end_where_no_secret_lies(monkeypatch):
    """Against the text as a whole, for texts of all that edges are made of; also where windows overlap."""
    rnd = random.Random(8)
    bits = [" ", "  ", "\n", "=", " = ", ":", "password", "token", '"', "'", "abcdefgh1234", "word", ".", ",", "(", "é", "AKIA" + "B" * 16, "0123456789abcdef" * 2, b64(SECRET), "{", "}", "\\u0041"]
    for n in range(400):
        monkeypatch.setattr(s, "WINDOW_BYTES", rnd.choice([1, 5, 40]))
        data = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 60))).encode()
        cut = [data[i : i + 7] for i in range(0, len(data), 7)]
        windows = list(s._windows(iter(cut)))
        assert b"".join(windows) == data
        at, got = 0, set()
        for w in windows:
            text = w.decode("utf-8")
            got |= {(at + a, k, at + b) for a, k, b in s.find(text)[1]}
            at += len(text)
        assert got == set(s.find(data.decode())[1])


def test_a_stretch_without_an_edge_is_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(s, "WINDOW_BYTES", 100)
    monkeypatch.setattr(s, "STRETCH", 300)
    monkeypatch.setattr(s, "OVERLAP", 60)
    for n in range(250, 700, 7):
        text = f"a {b64(gzip.compress(('x' * n + '.password=abcdefgh1234.' + 'y' * 400).encode()))} b"
        assert any(k == 0 for _, k, _ in s.find(text)[1])


def test_text_that_only_looks_compressed():
    for start in ("x^2 + y ", "x\x01 "):
        assert s.find(f"a {b64(start + SECRET)} b")[1]
