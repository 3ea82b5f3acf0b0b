import hashlib
import random
import re

from plumbline.llm import pii
from plumbline.llm import queries

from .helpers import EDGES, docs


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def row(i, t):
    s = brute(t)
    text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in s)
    return (i if i is not None else -1, *[sum(x[1] == k for x in s) for k in range(4)], hashlib.sha256(text.encode()).hexdigest())


def rows_of(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in df.collect())


def test_all_documents(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(queries.op5_pii(spark, sf)) == sorted(row(*t) for t in texts)


def test_random_and_edges(spark):
    rnd = random.Random(2)
    parts = ["a", "é", "😀", " ", ".", "@", "+", "-", "1", "23", "4539578763621486", "255", "256", "a@b.co", "x_y", "(", ")", "+1 415", "555-0199", "1.2.3.4", "0", "00", "\n", "call me "]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for i in range(1500)] + EDGES
    rows += [(5001, "1 " * 30_000), (5002, "a." * 30_000 + "@x" + ".b" * 20_000), (5003, "a@b.c_d@e.f.g..h")]
    assert rows_of(pii.find(docs(spark, rows))) == sorted(row(*t) for t in rows)
    assert pii.find(docs(spark, [])).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"my phone number is +1 415 555 {i:04d} thanks") for i in range(40)] + [(100 + i, f"so her number is 555-{i:04d}.") for i in range(3)] + [(200 + i, f"see order no 77{i:04d} there") for i in range(20)]
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs(spark, rows)).collect()}
    assert all(got[100 + i] == "context:17:25" for i in range(3))
    assert all(got[200 + i] == "" for i in range(20))
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs(spark, rows)).collect()}
    assert masked[0] == "my phone number is [PHONE] thanks" and masked[100] == "so her number is [CONTEXT]." and masked[200] == rows[43][1]


def test_mask_overlaps(spark):
    rows = [(1, "x 1.2.3.4@host.org y"), (2, None), (3, "4539578763621486")]
    out = pii.mask(docs(spark, rows))
    assert out.columns == docs(spark, []).columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "x [EMAIL] y", 2: None, 3: "[CARD]"}


def patterns_before(t, at):
    w = re.findall(r"\S+", t[:at], re.A)[-2:]
    return re.sub("[0-9]", "0", " ".join(w)).translate({c: c + 32 for c in range(65, 91)}) if len(w) == 2 else None


def brute_contexts(texts):
    """Spans of context by a plain version of the rounds; texts hold their index."""
    candidates, edges = [], {}
    for n, t in enumerate(texts):
        base = brute(t)
        for a, _, b in base:
            edges.setdefault(patterns_before(t, a), {})[t[a:b]] = True
        words = [m.span() for m in re.finditer(r"\S+", t, re.A)]
        k = 0
        while k < len(words):
            a, b = words[k]
            k += 1
            if not re.search("[0-9]", t[a:b]):
                continue
            while t[b - 1].isdigit() and k < len(words) and t[b : words[k][0]] == " " and (m := re.match(r"([0-9]+(?:-[0-9]+)*)[.,;:!?)\"']*$", t[slice(*words[k])])):
                b = words[k][0] + m.end(1)
                k += 1
            m = re.search(r"[A-Za-z0-9+].*[A-Za-z0-9]", t[a:b])
            if m and len(re.sub("[^0-9]", "", m.group())) >= 4 and not any(x < a + m.end() and a + m.start() < y for x, _, y in base):
                candidates.append((n, a + m.start(), a + m.end(), patterns_before(t, a)))
    for n, a, b, p in candidates:
        edges.setdefault(p, {}).setdefault(texts[n][a:b], False)
    edges.pop(None, None)
    known = {v for vs in edges.values() for v, seed in vs.items() if seed}
    while True:
        trusted = {p for p, vs in edges.items() if len(known & set(vs)) >= 5 and len(known & set(vs)) / len(vs) >= 0.8}
        new = {v for p in trusted for v in edges[p]} - known
        if not new:
            return {(n, a, b) for n, a, b, p in candidates if p in trusted}
        known |= new


def contexts_of(spark, texts):
    got = pii.find(docs(spark, list(enumerate(texts)))).collect()
    return {(r["doc_id"], int(a), int(b)) for r in got for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k == "context"}


def test_bootstrapping_goes_on_from_what_it_finds(spark):
    texts = [f"call his number is +1 415 555 {i:04d} ok" for i in range(60)]
    texts += [f"her number is 555-{i:04d} ok" for i in range(8)] + [f"the extension code 555-{i:04d} ok" for i in range(8)]  # the same values after another context
    texts += ["the extension code 777-1234 ok", "desk number is 4111 1111 1111 1112, ok", "that number is " + "9x" * 40 + " ok", "line 2 number is 555-9999 and 555-9998"]
    got = contexts_of(spark, texts)
    assert got == brute_contexts(texts)
    assert {(76, 19, 27), (77, 15, 34), (78, 15, 95)} <= got


def test_contexts_against_a_plain_version(spark):
    rnd = random.Random(8)
    leads = ["my number is", "code for", "see order no", "line 7 ext", "Room No.", "id:", "born in", "x y z", "a@b.co wrote", "(ref 12) tel"]
    for size in (60, 300):
        values = [f"{rnd.randint(100, 999)}-{rnd.randint(1000, 1020)}" for _ in range(25)] + ["AB-1234-99", "2019", "4111 1111 1111 1112", "(7777)", "12,5 88 99", "+1 415 555 0199", "+44 20 7946 0018"]
        values += [f"+1 415 555 {i:04d}" for i in range(20)] + ["x9@mail.org", "10.0.0.1", "300.1.1.1"]
        texts = [" ".join(f"{rnd.choice(leads[rnd.randint(0, 3) :])} {rnd.choice(values)}{rnd.choice(['', '.', ',', ' then'])}" for _ in range(rnd.randint(1, 6))) for _ in range(size)]
        assert contexts_of(spark, texts) == brute_contexts(texts)
