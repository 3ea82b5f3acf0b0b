import base64
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

import pytest

from plumbline.llm import queries
from plumbline.llm import secret_scan as S

from .helpers import EDGES, docs


def brute(t):
    assign = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({assign})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(out)


def test_base_spans_on_random_texts():
    rnd = random.Random(5)
    parts = ["password", "Token", "api_key", "apiKEY", "=", ":", " ", '"', "AKIA", "ABCD1234EFGH5678", "deadbeef01", "%3D", "%", "\\u0041", "a", "0", "\n", "é", "ſecret"]
    for _ in range(5000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert S.plain_spans(t) == brute(t)
        base, every = S.scan_text(t)
        assert set(base) <= set(every)


WRAPS = {
    "base64": lambda x: base64.b64encode(x.encode()).decode(),
    "url": lambda x: urllib.parse.quote(x, safe=""),
    "unicode": lambda x: "".join(f"\\u{ord(c):04x}" for c in x),
    "gzip": lambda x: base64.b64encode(gzip.compress(x.encode(), mtime=0)).decode(),
}


@pytest.mark.parametrize("inner", WRAPS)
@pytest.mark.parametrize("outer", [*WRAPS, None])
def test_nested_layers(inner, outer):
    hidden = WRAPS[inner]('password = "hunter22abc"')
    text = "héllo " + (WRAPS[outer](hidden) if outer else hidden) + " tail"
    base, every = S.scan_text(text)
    assert not [s for s in base if s[1] == 0]
    assert [s for s in every if s[1] == 0 and s[0] == 6]


def test_cycles_end():
    text = "%2525" * 50 + " \\u005cu005c" + base64.b64encode(base64.b64encode(b"token=abcdefgh" * 3)).decode()
    assert any(k == 0 for _, k, _ in S.scan_text(text)[1])


def test_all_documents_and_edges(spark, sf):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op3_secrets(spark, sf).collect():
        want = brute(rows[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in want) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(S.joined(want).encode()).hexdigest()
    got = S.scan(docs(spark, [*EDGES, (9, "token=abcdefg " * 5000)])).collect()
    assert len(got) == len(EDGES) + 1 and max(r["n_assign"] for r in got) == 5000
    assert S.scan(docs(spark, [])).count() == 0
    assert {r["text"] for r in S.redact(docs(spark, [(1, "x token=abcdefgh y"), (2, None)])).collect()} == {"x [SECRET] y", None}


@pytest.mark.parametrize("inner", WRAPS)
@pytest.mark.parametrize("outer", [*WRAPS, None])
def test_equal_layers_at_several_places(inner, outer):
    hidden = WRAPS[inner]('password = "hunter22abc"')
    once = WRAPS[outer](hidden) if outer else hidden
    text = " and ".join([once] * 3)
    starts = {a for a, k, _ in S.scan_text(text)[1] if k == 0}
    assert starts == {k * (len(once) + 5) for k in range(3)}
    assert once not in S.redacted(text)


SECRET = 'password = "hunter22abc"'


def _kinds(raw, **how):
    return {k for _, k, _ in S.deeper_spans("x " + base64.b64encode(raw).decode() + " y", **how)}


def test_packed_data_to_its_end():
    filler = "é line of text, with nothing\n" * 3000
    assert 0 in _kinds(gzip.compress((filler + SECRET).encode()), max_layer=5000)
    assert 0 in _kinds(gzip.compress(gzip.compress((filler * 20 + SECRET).encode())))
    assert 0 in _kinds(gzip.compress(b"first member") + gzip.compress(SECRET.encode()))
    assert 0 in _kinds(gzip.compress(b"a member") + SECRET.encode())
    assert 0 in _kinds(gzip.compress(b"a " * (10 << 20) + SECRET.encode()))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_base64(end):
    rnd = random.Random(2)
    noise = " ".join(str(rnd.random()) for _ in range(60))
    for raw in (f"{noise} {SECRET}".encode(), gzip.compress(f"{noise} {SECRET}".encode())):
        for cut in (76, 64):
            b = base64.b64encode(raw).decode()
            text = "data: " + end + end.join(b[i : i + cut] for i in range(0, len(b), cut)) + end + "Regards, me"
            spans = [s for s in S.deeper_spans(text) if s[1] == 0]
            assert spans and "hunter22abc" not in "".join(S.redacted(text))
            if raw[:1] != b"\x1f":
                flat = [len(text[:a].replace(end, "")) for a, _, _ in spans]
                at = raw.index(b"password")
                assert 6 + at * 4 // 3 in flat


def test_deep_nesting():
    base, every = S.scan_text("%" + "25" * 1500 + " token=abcdefghi")
    assert (3002, 0, 3017) in every
    for text in ("%" + "25" * 500_000 + "3Dx", "token" + "&#38;" + "#38;" * 3000 + "#61;abcdefgh", "token\\" + "x5c" * 3000 + "x3dabcdefgh"):
        every = S.scan_text(text)[1]
        assert len(text) > 900_000 or (0, 0, len(text)) in every
    mixed = "="
    for _ in range(60):
        mixed = mixed.replace("%", "&#37;") if "%" in mixed else mixed.replace("&", "%26") if "&" in mixed else "%3D"
    assert (0, 0, len("secret" + mixed + "abcdefg")) in S.scan_text("secret" + mixed + "abcdefg")[1]
    deep = SECRET
    for _ in range(25):
        deep = base64.b64encode(deep.encode()).decode()
    assert [s for s in S.scan_text(deep)[1] if s[1] == 0]


def _one_step(text):
    """Every layer that one step gives, without places: a plain decoder to compare with."""
    yield urllib.parse.unquote(text, errors="surrogateescape")
    yield re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m.group(1), 16)), text)
    for m in re.finditer(r"[A-Za-z0-9+/]{16,}={0,2}", text.replace("\n", "")):
        for k in range(4):
            body = m.group().rstrip("=")[k:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
            yield raw.decode("latin-1")
            for z in re.finditer(b"\x1f\x8b\x08", raw):
                try:
                    yield zlib.decompressobj(wbits=31).decompress(raw[z.start() :]).decode("latin-1")
                except zlib.error:
                    pass


def _plain(text):
    """Values of all secrets that any order of unwrapping shows."""
    seen, work, found = set(), [text], set()
    while work:
        at = work.pop()
        if at not in seen:
            seen.add(at)
            found |= set(re.findall(r"password = .(hunter[0-9]+[a-z]+)", at))
            work += _one_step(at)
    return found


def test_random_nestings_with_glue_and_repeats():
    rnd = random.Random(3)
    for _ in range(150):
        parts, want = [], set()
        for _ in range(rnd.randint(1, 3)):
            value = f"hunter{rnd.randint(10, 10**6)}" + "abc"
            hidden = f'password = "{value}"'
            for _ in range(rnd.randint(1, 3)):
                hidden = WRAPS[rnd.choice(list(WRAPS))](hidden)
            for _ in range(rnd.randint(1, 2)):
                parts.append((rnd.choice(["", "abc-", "a/", "token_", "x"]) + hidden, len(hidden), value))
            want.add(value)
        text = " , ".join(p for p, _, _ in parts)
        assert want <= _plain(text)
        spans, at = {s for s in S.scan_text(text)[1] if s[1] == 0}, 0
        for part, size, _ in parts:  # each copy has a span inside its own place
            end = at + len(part)
            assert [s for s in spans if at <= s[0] and s[2] <= end and s[2] > end - size], (text, part)
            at = end + 3
        assert not _plain(S.redacted(text)) & want
