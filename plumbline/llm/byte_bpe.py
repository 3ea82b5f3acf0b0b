"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly when each
two neighbours are (merging never crosses their border before both are complete).
So every prefix of a piece has one last token: the token ``t`` that ends there and
is compatible with the last token of the prefix before ``t``. A nondeterministic
transducer reads bytes with states (trie node of the bytes since a border, last
token at that border); a set of such states is one state of the deterministic
machine. Sets and arcs are built when first needed and kept in a bounded table.
A border can only be left open for as long as the trie is deep, so tokens are
emitted after bounded lookahead: those that all open borders have in common.

The text is first cut into pieces by the tokenizer's pattern. A space between two
non-spaces always opens a piece, so texts are cut there first and the encodings of
the words in between are memoised (bounded as well); other texts take the pattern
over the whole text.

Decoding joins token bytes in chunks; an incremental UTF-8 state machine holds back
the bytes of a character that a chunk leaves unfinished.

A null or empty text has no tokens. Texts of any length take memory in proportion to
one text. Repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame

from plumbline.llm.common import WORKER_CACHES, arrow_map, picked

ROOT = 0


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines ``base64(token) rank``."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Merges:
    """What the merge ranks say about tokens: how each is built, and which pairs can stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self._halves:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
                if rank >= token:
                    raise ValueError(f"token {token} can't be reached by merges")
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps ``left`` and ``right`` apart where they stand side by side.

        Merges are undone from the latest to the earliest, only along the border. At
        each moment the two tokens at the border may not have a merge that came
        earlier than the one just undone (at equal rank, the left place comes first).
        """
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[left, right] = self._apart(left, right)
        return known

    def _apart(self, a: int, b: int) -> bool:
        late = (1 << 60, 1)  # rank of the merge undone last, and whether it lies right of the border
        while True:
            joint = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joint is not None and (joint, 0) < late and not (joint == late[0] and not late[1]):
                return False
            ha, hb = self.halves(a), self.halves(b)
            if ha is None and hb is None:
                return True
            if hb is None or (ha is not None and a > b):
                late, a = (a, 0), ha[1]
            else:
                late, b = (b, 1), hb[0]


class Transducer:
    """The deterministic machine, built while it runs."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000):
        self.merges = Merges(ranks)
        self.max_states = max_states
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.token_at: list[int] = [-1]
        self.size = {r: len(b) for b, r in ranks.items()}
        self.deepest = max(self.size.values(), default=1)
        for token, rank in ranks.items():
            node = ROOT
            for b in token:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = rank
        self._reset()

    def _reset(self) -> None:
        self.sets: list[tuple[tuple[int, int], ...]] = [((ROOT, -1),)]
        self.known = {self.sets[0]: 0}
        self.arcs: dict[int, tuple[int, int]] = {}  # state << 8 | byte -> (state, last token there)

    def _determinise(self, members: tuple[tuple[int, int], ...], byte: int) -> tuple[tuple[tuple[int, int], ...], int]:
        live, last = [], -1
        for node, before in members:
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            live.append((nxt, before))
            token = self.token_at[nxt]
            if last < 0 <= token and (before < 0 or self.merges.fits(before, token)):
                last = token
        if last < 0:
            raise ValueError("the vocabulary lacks a byte")
        return (*live, (ROOT, last)), last

    def arc(self, state: int, byte: int) -> tuple[int, int]:
        members, last = self._determinise(self.sets[state], byte)
        target = self.known.get(members)
        if target is None:
            target = self.known[members] = len(self.sets)
            self.sets.append(members)
        self.arcs[state << 8 | byte] = target, last
        return target, last

    def encode(self, piece: bytes) -> Iterator[int]:
        """Tokens of one piece, emitted as soon as no open border can change them."""
        if len(self.sets) > self.max_states:
            self._reset()
        state, lasts, arcs = 0, [], self.arcs
        limit = 4 * self.deepest
        for byte in piece:
            hop = arcs.get(state << 8 | byte)
            state, last = hop if hop is not None else self.arc(state, byte)
            lasts.append(last)
            if len(lasts) >= limit:
                settled = self._settled(state, lasts)
                yield from settled
                del lasts[: sum(self.size[t] for t in settled)]
                limit = len(lasts) + 4 * self.deepest
                if len(self.sets) > self.max_states:  # the set itself is all the machine needs to go on
                    members = self.sets[state]
                    self._reset()
                    self.sets.append(members)
                    state = self.known.setdefault(members, len(self.sets) - 1)
                    arcs = self.arcs
        yield from self._chain(lasts, len(lasts))

    def encode_short(self, piece: bytes) -> list[int]:
        """As ``encode``, for a piece that ends before anything is emitted early."""
        if len(piece) >= 4 * self.deepest or len(self.sets) > self.max_states:
            return list(self.encode(piece))
        state, lasts, get = 0, [], self.arcs.get
        for byte in piece:
            state, last = get(state << 8 | byte) or self.arc(state, byte)
            lasts.append(last)
        return self._chain(lasts, len(lasts))

    def _chain(self, lasts: list[int], end: int) -> list[int]:
        out, size = [], self.size
        while end > 0:
            token = lasts[end - 1]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out

    def _settled(self, state: int, lasts: list[int]) -> list[int]:
        """The tokens that the chains of all open borders begin with."""
        depth: list[int] = []
        borders = self._borders(state, lasts, depth)
        chains = [self._chain(lasts, b) for b in borders]
        common = chains[0]
        for c in chains[1:]:
            n = 0
            while n < min(len(common), len(c)) and common[n] == c[n]:
                n += 1
            common = common[:n]
        return common

    def _borders(self, state: int, lasts: list[int], depth: list[int]) -> list[int]:
        """Positions of the state's open borders. A member's trie node tells how far back its border lies."""
        if not hasattr(self, "_depth"):
            self._depth = [0] * len(self.token_at)
            for key, node in self.child.items():  # parents come before their children
                self._depth[node] = self._depth[key >> 8] + 1
        depth[:] = [self._depth[node] for node, _ in self.sets[state]]
        return [len(lasts) - d for d in depth]


class Encoder:
    """Whole texts to packed ids (little-endian unsigned 32-bit)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_words: int = 700_000, max_states: int = 150_000):
        self.machine = Transducer(ranks, max_states)
        self.pieces = regex.compile(pattern).findall
        self.words = _Memo(self._word, max_words)
        self.heads = _Memo(lambda w: self._word(w, ""), max_words // 10)
        self.parts = _Memo(self._piece, max_words // 5)

    def _piece(self, piece: str) -> bytes:
        if piece[0] == " ":
            known = self.words.get(piece[1:])
            if known is not None:
                return known
        ids = self.machine.encode_short(piece.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str, lead: str = " ") -> bytes | None:
        """Ids of a word with the space before it; None if its ends aren't both non-spaces, where pieces may cross."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        pieces = self.pieces(lead + word)
        return self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self.parts.__getitem__, pieces))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        head, *rest = text.split(" ")
        got = [self.heads[head], *map(self.words.__getitem__, rest)]
        if None in got:
            return b"".join(map(self.parts.__getitem__, self.pieces(text)))
        return b"".join(got)


class _Memo(dict):
    """Values by key, computed at the first look; emptied when full. Long keys hardly ever come again and aren't kept."""

    def __init__(self, fn, most: int, longest: int = 16):
        super().__init__()
        self.fn, self.most, self.longest = fn, most, longest

    def __missing__(self, key):
        value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Utf8Stream:
    """Incremental UTF-8: ``complete`` gives the bytes of all characters that are complete, ``feed`` their text; malformed bytes become U+FFFD in it."""

    #: Continuation bytes that follow a lead byte; lead bytes of other kinds are malformed.
    FOLLOW = {**dict.fromkeys(range(0xC2, 0xE0), 1), **dict.fromkeys(range(0xE0, 0xF0), 2), **dict.fromkeys(range(0xF0, 0xF5), 3)}

    def __init__(self):
        self.held = b""

    def complete(self, data: bytes) -> bytes:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):  # only the last character can be unfinished
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                if self.FOLLOW.get(byte, 0) >= back:
                    cut = len(data) - back
                break
        self.held = data[cut:]
        return data[:cut]

    def rest(self) -> bytes:
        rest, self.held = self.held, b""
        return rest

    def feed(self, data: bytes) -> str:
        return self.complete(data).decode("utf-8", "replace")

    def finish(self) -> str:
        return self.rest().decode("utf-8", "replace")


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.table: list[bytes] = [b""] * size
        for b, r in ranks.items():
            self.table[r] = b

    def pieces(self, ids: bytes, chunk: int = 1 << 14) -> Iterator[bytes]:
        """Bytes of packed ids, in pieces of whole characters as far as they are well-formed."""
        stream = Utf8Stream()
        for at in range(0, len(ids), 4 * chunk):
            part = memoryview(ids)[at : at + 4 * chunk].cast("I")  # native order; the contract's order is little-endian
            yield stream.complete(b"".join(map(self.table.__getitem__, part)))
        yield stream.rest()

    def decode(self, ids: bytes, chunk: int = 1 << 14) -> Iterator[str]:
        """Text of packed ids, piece by piece."""
        return (piece.decode("utf-8", "replace") for piece in self.pieces(ids, chunk))


_KEPT: dict[str, tuple[Encoder, Decoder]] = {}
WORKER_CACHES.append(_KEPT)


def tools(data: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    """The machines for a rank file, kept for later tasks of the same Python worker."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _KEPT:
        ranks = read_ranks(data)
        _KEPT.clear()
        _KEPT[key] = Encoder(ranks, pattern), Decoder(ranks)
    return _KEPT[key]


def _with_ranks(docs: DataFrame, rank_file: str):
    with open(rank_file, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, under 1 MB


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit) of every text."""
    shared = _with_ranks(docs, rank_file)

    def make():
        encoder, _ = tools(shared.value, pattern)

        def run(cols):
            ids = [encoder.encode(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

        return run

    return arrow_map(picked(docs, "doc_id", "text"), make, "doc_id long, n_tokens long, ids binary", keep_caches=True)


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and text of packed ids."""
    shared = _with_ranks(encoded, rank_file)

    def make():
        _, decoder = tools(shared.value, pattern)

        def run(cols):
            return {"doc_id": cols["doc_id"], "text": ["".join(decoder.decode(x or b"")) for x in cols["ids"]]}

        return run

    return arrow_map(picked(encoded, "doc_id", "ids"), make, "doc_id long, text string", keep_caches=True)


def _round_trip(encoder: Encoder, decoder: Decoder, text: str | None) -> tuple[bytes, str]:
    """Ids of a text, and the hash of the bytes that decoding them gives."""
    ids = encoder.encode(text)
    back = hashlib.sha256()
    for part in decoder.pieces(ids):
        back.update(part)
    return ids, back.hexdigest()


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and decoded_sha256: each text encoded, decoded again and hashed in one pass."""
    shared = _with_ranks(docs, rank_file)

    def make():
        encoder, decoder = tools(shared.value, pattern)

        def run(cols):
            pairs = [_round_trip(encoder, decoder, t) for t in cols["text"]]
            ids = [p[0] for p in pairs]
            return {"doc_id": cols["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [p[1] for p in pairs]}

        return run

    return arrow_map(picked(docs, "doc_id", "text"), make, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string", keep_caches=True)


def digest(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """The contract's columns; the ids themselves don't leave the Python workers."""
    shared = _with_ranks(docs, rank_file)

    def make():
        encoder, decoder = tools(shared.value, pattern)

        def run(cols):
            out = {"doc_id": cols["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in cols["text"]:
                ids, back = _round_trip(encoder, decoder, text)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(back)
            return out

        return run

    return arrow_map(picked(docs, "doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keep_caches=True)
