"""Secret scan: a recursive decoding worklist over nested URL, Unicode, base64 and compressed layers.

The text itself is the first layer. Each layer taken from the worklist is scanned
for every kind of secret, then unwrapped in each way that applies; what comes out
are new layers. Escapes are decoded by kind and all together, each time to their own
fixpoint in one linear pass (``%252525..3D`` is one layer, not one for each ``25``).
A layer that was seen before at the same place of the text is not taken again, so
cycles (a compressed file that unpacks to itself, say) end, and the worklist ends
when no way of unwrapping gives anything new. Equal layers at several places are
each taken. Spans found in a layer are mapped back through the layers to code points
of the text, by a loop at any depth.

Null and empty texts have no spans. Long texts are scanned whole. Repeated rows each
give a row; equal spans found in several layers count once; extra columns are ignored.
Compressed data is unpacked to its end, with all members of a stream and what follows
them. What unpacks to more than ``max_layer`` characters is taken in pieces, cut only at
line ends that no pattern spans. Base64 that is wrapped in lines is decoded line by line
and joined, and base64 that is glued to other characters at every alignment.
"""

from __future__ import annotations

import binascii
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm.common import arrow_map, picked

KINDS = ("assign", "access", "hex")

# The patterns of the contract.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # a run is taken whole, so shorter ones need no look
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

Span = tuple[int, int, int]  # start, number of the kind, end


def plain_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind in one layer."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(n in low for n in _NAMES):
            out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


class Pieces:
    """Maps offsets of a decoded layer to its parent: runs that were copied, and characters that an escape gave."""

    def __init__(self):
        self.child: list[int] = []
        self.parent: list[int] = []
        self.copied: list[bool] = []
        self.end = 0
        self.parent_end = 0

    def add(self, size: int, parent: int, parent_end: int, copied: bool) -> None:
        if size:
            self.child.append(self.end)
            self.parent.append(parent)
            self.copied.append(copied)
            self.end += size
        self.parent_end = parent_end

    def start_of(self, at: int) -> int:
        k = bisect_right(self.child, at) - 1
        return self.parent[k] + (at - self.child[k] if self.copied[k] else 0)

    def end_of(self, at: int) -> int:
        k = bisect_right(self.child, at - 1) - 1
        if self.copied[k]:
            return self.parent[k] + at - self.child[k]
        return self.parent[k + 1] if k + 1 < len(self.parent) else self.parent_end


class Layer:
    """A decoded text that knows its place in the layer it came from."""

    __slots__ = ("end_of", "escapes", "parent", "start_of", "text")

    def __init__(self, text: str, parent: Layer | None = None, start_of=None, end_of=None, escapes: bool = True):
        self.text, self.parent, self.start_of, self.end_of, self.escapes = text, parent, start_of, end_of, escapes

    def place(self, start: int, end: int) -> tuple[int, int]:
        """The span in code points of the first layer."""
        at = self
        while at.parent is not None:
            start, end = at.start_of(start), at.end_of(end)
            at = at.parent
        return start, end


_URL = r"%[0-7][0-9A-Fa-f]|%[CDcd][0-9A-Fa-f]%[89ABab][0-9A-Fa-f]|%[Ee][0-9A-Fa-f](?:%[89ABab][0-9A-Fa-f]){2}|%[Ff][0-4](?:%[89ABab][0-9A-Fa-f]){3}"
_UNICODE = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]{1,6}\}|\\x[0-9a-fA-F]{2}|&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|[uU]\+[0-9a-fA-F]{4,6}"
#: Ways of unwrapping escapes: one kind, the other, and both.
_ESCAPES = [re.compile(x) for x in (_URL, _UNICODE, f"{_URL}|{_UNICODE}")]
#: An escape has this many characters at most, consists of these, and begins with one of those.
_LONGEST, _OF, _FIRST = 12, frozenset("%&#\\uUxX+;{}0123456789abcdefABCDEF"), "%&\\uU"


def _decoded(escape: str) -> str:
    """The one character of an escape; an escape that stands for none is returned as it is."""
    if escape[0] == "%":
        try:
            return bytes.fromhex(escape.replace("%", "")).decode("utf-8")
        except UnicodeDecodeError:
            return escape
    digits = re.findall(r"[0-9a-fA-F]+", escape[2:])
    if len(digits) == 2:
        return bytes.fromhex(digits[0] + digits[1]).decode("utf-16-be")
    code = int(digits[0], 10 if re.match(r"&#[0-9]", escape) else 16)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else escape


def _unescaped(parent: Layer, pattern: re.Pattern) -> Layer | None:
    """The layer with all escapes of a kind decoded, or None if it has none.

    What an escape gives is looked at again together with the characters around it, until
    nothing is left to decode: ``%252525..3D`` and escapes that alternate between kinds take
    one pass. Each step takes characters off the text, so work is linear in its length.
    """
    text, n = parent.text, len(parent.text)
    out: list[tuple[int, int, str | None]] = []  # places in the text, and the decoded character (None: copied)
    at, some = 0, False
    while (m := pattern.search(text, at)) is not None:
        new = _decoded(m.group())
        if new == m.group():
            out.append((at, m.start() + 1, None))
            at = m.start() + 1
            continue
        some = True
        if m.start() > at:
            out.append((at, m.start(), None))
        begin, at = m.start(), m.end()
        while new in _OF:
            before, k = [], len(out)
            while k and len(before) < _LONGEST - 1:
                k -= 1
                a, b, c = out[k]
                before += c if c is not None else reversed(text[max(a, b - _LONGEST) : b])
            left = "".join(reversed(before[: _LONGEST - 1]))
            near = left + new + text[at : at + _LONGEST - 1]
            hit = None
            for s in range(len(left) + 1):
                if near[s] in _FIRST and (x := pattern.match(near, s)) and x.end() > len(left) and _decoded(x.group()) != x.group():
                    hit = x
                    break
            if hit is None:
                break
            for _ in range(len(left) - hit.start()):
                a, b, c = out.pop()
                begin = a if c is not None else b - 1
                if c is None and b - 1 > a:
                    out.append((a, b - 1, None))
            at += hit.end() - len(left) - 1
            new = _decoded(hit.group())
        out.append((begin, at, new))
    if not some:
        return None
    out.append((at, n, None))
    pieces = Pieces()
    for a, b, c in out:
        pieces.add(1 if c is not None else b - a, a, b, c is None)
    return Layer("".join(text[a:b] if c is None else c for a, b, c in out), parent, pieces.start_of, pieces.end_of, escapes=False)


_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_PRINTABLE = re.compile(rb"[\x09\x0a\x0d\x20-\x7e\x80-\xff]*\Z")
_BREAK = re.compile(r"[^A-Za-z0-9+/_=;}\r\n-]\r?\n|\n(?![A-Za-z0-9+/_=%\\&-])")
_CHUNK = 1 << 20


def _packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] & 0x0F == 8 and (raw[0] << 8 | raw[1]) % 31 == 0)


def _inflated(chunks: Iterator[bytes], rest: list[bytes]) -> Iterator[bytes]:
    """Unpacked data of all members in chunks, up to a fault if there is one; what follows the last member goes to ``rest``."""
    member, data = zlib.decompressobj(wbits=47), b""
    for chunk in chunks:
        data += chunk
        while member is not None and data:
            try:
                out = member.decompress(data, _CHUNK)
                data = member.unconsumed_tail
                while out:
                    yield out
                    if len(out) < _CHUNK and not data:
                        break
                    out = member.decompress(data, _CHUNK)
                    data = member.unconsumed_tail
            except zlib.error:
                return
            if member.eof:
                data = member.unused_data
                member = zlib.decompressobj(wbits=47) if _packed(data) else None
    if member is None:
        rest.append(data)


def _level(raw: bytes, depth: int, rest: list[bytes]) -> Iterator[bytes]:
    chunks = iter([raw])
    for _ in range(depth):
        rest.clear()
        chunks = _inflated(chunks, rest)
    return chunks


def _pieces(chunks: Iterator[bytes], size: int) -> Iterator[str]:
    """Text of the chunks in pieces of about ``size``; it ends where the data is no text."""
    decoder, held = codecs.getincrementaldecoder("utf-8")(), ""
    for data in chunks:
        if not _PRINTABLE.match(data):
            return
        try:
            new = decoder.decode(data)
        except UnicodeDecodeError:
            return
        look = max(0, len(held) - 2)
        held += new
        if len(held) > size:
            cut = max((m.end() for m in _BREAK.finditer(held, look)), default=0)
            if cut:
                yield held[:cut]
                held = held[cut:]
    if held:
        yield held


def _unpacked(raw: bytes, max_layer: int) -> Iterator[str]:
    """Texts in packed data, however often it was packed; none if it isn't packed."""
    depth, seen = 0, set()
    while True:
        head = b""
        for chunk in _level(raw, depth, []):
            head += chunk
            if len(head) > 2:
                break
        if not _packed(head):
            break
        whole = hashlib.blake2b()
        some = False
        for chunk in _level(raw, depth + 1, []):
            whole.update(chunk)
            some = True
        if not some or whole.digest() in seen:  # no packed data, or data that unpacks to itself
            break
        seen.add(whole.digest())
        depth += 1
    for d in range(1, depth + 1):
        rest: list[bytes] = []
        chunks = _level(raw, d, rest)
        if d == depth:
            yield from _pieces(chunks, max_layer)
        for _ in chunks:
            pass
        if rest and rest[0]:
            yield from _pieces(iter(rest), max_layer)


def _runs(text: str) -> Iterator[tuple[str, Pieces]]:
    """Base64 runs of one line, and those that lines of one length, with what may begin and end them, make together."""
    for m in _BASE64.finditer(text):
        pieces = Pieces()
        pieces.add(m.end() - m.start(), m.start(), m.end(), True)
        yield m.group(), pieces
    if "\n" not in text:
        return
    for m in _LINES.finditer(text):
        lines = [x.span() for x in _LINE.finditer(text, m.start(), m.end())]
        size = [len(text[a:b].rstrip("=")) for a, b in lines]
        a = 0
        while a < len(lines):
            b = a + 1
            while b < len(lines) and size[b] == size[a]:
                b += 1
            if size[a] >= 16:
                for first in {a, max(0, a - 1)}:
                    for last in {b, b + 1 if b < len(lines) and size[b] < size[a] else b}:
                        if last - first > 1:
                            pieces = Pieces()
                            for x, y in lines[first:last]:
                                pieces.add(y - x, x, y, True)
                            yield "".join(text[x:y] for x, y in lines[first:last]), pieces
            a = b


#: Text of 12 characters or more, as the shortest span has; and where packed data may begin.
_TEXT = re.compile(
    rb"(?:[\x09\x0a\x0d\x20-\x7e]++|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})++"
)
_HEADER = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|\A[\x08\x18\x28\x38\x48\x58\x68]")
_SHORTEST = 12


def _begins_packed(raw: bytes, at: int) -> bool:
    """Whether packed data begins there, told from its first bytes."""
    if not _packed(raw[at : at + 3]):
        return False
    try:
        zlib.decompressobj(wbits=47).decompress(raw[at : at + 256], 64)
    except zlib.error:
        return False
    return True


def _byte_places(text: str) -> Callable[[int], int]:
    """Byte offset of each character's start."""
    if text.isascii():
        return lambda k: k
    code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    places = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])
    return lambda k: int(places[k])


def _blobs(layer: Layer, max_layer: int) -> Iterator[Layer]:
    """Layers inside base64 runs, packed or plain. Spans of packed data map to the run from their data's first character.

    What a run is glued to at either end is base64 too, to look at, and shifts what it holds:
    a run is decoded at each of four alignments, and each stretch of text in it is a layer.
    """
    for run, pieces in _runs(layer.text):
        body = run.rstrip("=").translate(_STANDARD)
        for shift in range(4):
            size = len(body) - shift
            size -= size % 4 == 1
            if size < 16:
                break
            raw = binascii.a2b_base64(body[shift : shift + size] + "=" * (-size % 4))
            for m in _HEADER.finditer(raw):
                if _begins_packed(raw, m.start()):
                    start, end = pieces.start_of(shift + m.start() * 4 // 3), pieces.end_of(len(run))
                    for inner in _unpacked(raw[m.start() :], max_layer):
                        yield Layer(inner, layer, lambda _, s=start: s, lambda _, e=end: e)
            for m in _TEXT.finditer(raw):
                if m.end() - m.start() < _SHORTEST:
                    continue
                inner = m.group().decode("utf-8")
                byte = _byte_places(inner)
                first = lambda k, f=byte, p=pieces, z=shift, o=m.start(): p.start_of(min(p.end - 1, z + (o + f(k)) * 4 // 3))
                last = lambda k, f=byte, p=pieces, z=shift, o=m.start(): p.end_of(max(1, min(p.end, z - (-(o + f(k)) * 4 // 3))))
                yield Layer(inner, layer, first, last)


_STANDARD = str.maketrans("-_", "+/")


def _children(layer: Layer, max_layer: int) -> Iterator[Layer]:
    """What one step of each way of unwrapping gives."""
    if layer.escapes:
        for pattern in _ESCAPES:
            if child := _unescaped(layer, pattern):
                yield child
    yield from _blobs(layer, max_layer)


def deeper_spans(text: str, max_layer: int = 16 << 20) -> set[Span]:
    """Spans found in layers below the text, in code points of the text."""
    found: set[Span] = set()
    seen = {(_digest(text), 0, len(text))}
    work = [_children(Layer(text), max_layer)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        key = _digest(layer.text), *layer.place(0, len(layer.text))
        if key not in seen:
            seen.add(key)
            for a, kind, b in plain_spans(layer.text):
                start, end = layer.place(a, b)
                found.add((start, kind, end))
            work.append(_children(layer, max_layer))
    return found


def _digest(layer: str) -> bytes:
    return hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with those of deeper layers, both in order."""
    if not text:
        return [], []
    base = plain_spans(text)
    return base, sorted({*base, *deeper_spans(text)})


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every text."""

    def make():
        def run(cols):
            out = {"doc_id": cols["doc_id"], "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
            for text in cols["text"]:
                base, every = scan_text(text)
                for n, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(1 for s in base if s[1] == n))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(every))
            return out

        return run

    return arrow_map(picked(docs, "doc_id", "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, mask: str = "[SECRET]") -> str:
    """The text with each span, overlaps merged, replaced by ``mask``."""
    out, at = [], 0
    for a, _, b in scan_text(text)[1]:
        if b > at:
            if a >= at:
                out += [text[at:a], mask]
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """doc_id and the redacted text; a null text stays null."""

    def make():
        return lambda cols: {"doc_id": cols["doc_id"], "text": [t if t is None else redacted(t, mask) for t in cols["text"]]}

    return arrow_map(picked(docs, "doc_id", "text"), make, "doc_id long, text string")
