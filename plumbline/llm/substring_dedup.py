"""Exact substring deduplication: bytes covered by a window of ``WINDOW`` bytes that also starts earlier.

Windows are never shuffled one by one. A window's anchor is the ``GRAM``-byte string
in it whose hash is least (the leftmost of equals), so equal windows have equal
anchors at equal offsets. Windows next to each other with one anchor form a cell.

1. ``_cells``: each map task turns texts into cells: the anchor's hash, a short hash of
   the cell, and where it lies. Of cells with equal bytes (compared, not just hashed)
   only the first goes on, the others are already known to repeat it. An anchor with
   many different cells in one task is called hot there; its cells don't go to its
   bucket, one mark does.
2. ``_match_cells``, by anchor: cells of an anchor that no other cell has are done.
3. ``_edge_text`` joins the other cells with the texts again and sends their bytes to
   their anchor's bucket, again one of equal ones. Cells of hot anchors are cut into
   single windows, whose anchor is the whole window, which spreads them evenly.
4. ``_match_edges``: hash-compared suffix sort. The bytes right of an anchor, and the
   reversed bytes left of it, are sorted by a mergesort whose comparison finds the
   common extension by binary search over prefix polynomial hashes. Extensions of
   neighbours are then verified on the bytes; if a hash collided, the bucket is
   sorted again with another hash. Two windows at offset j are equal if their anchors
   agree on j bytes to the left and WINDOW - j to the right.
5. ``_cut`` removes the bytes from the texts.

So hashes only bring windows together; what is removed was compared byte by byte.
Order is by doc_id, then start, as integers; a null doc_id comes after all others. A
null text has no bytes. Rows that repeat a doc_id are one document by that order: equal
strings at equal starts of its rows don't cut each other. Extra columns are ignored.
Memory: one bucket's records, or one group of documents and its cells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, picked, release_memory

WINDOW, GRAM = 100, 32
#: Bytes of the longest cell.
SPAN = 2 * WINDOW - GRAM
#: Text bytes for each bucket and for each group of documents, and for one pass in a map task.
BUCKET_BYTES, PASS_BYTES, PIECE = 16 << 20, 8 << 20, 1 << 19
#: Finer buckets of step 4 in one bucket, and most shuffle partitions (beyond, a partition has several buckets).
FINE, MOST_PARTITIONS = 16, 50_000
#: Different cells of one anchor from which it counts as hot, in a map task and in a bucket.
HOT_LOCAL, HOT = 64, 4000

OPEN, MARK, EDGE, HOT_EDGE = range(4)
LAST = 2**63 - 1
_U = np.uint64
CELL = np.dtype([("anchor", "<u8"), ("who", "<u8"), ("cell", "<u4"), ("start", "<i4"), ("off", "u1"), ("count", "u1"), ("tag", "u1")])
CUT = np.dtype([("who", "<u8"), ("start", "<i4"), ("size", "<i4")])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class Poly:
    """Prefix polynomial hashes modulo 2**64 over random values of the bytes."""

    def __init__(self, seed: int):
        self.seed = seed
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 2**64, 256, dtype=_U)
        self.base = int(rng.integers(0, 2**62)) * 8 + 5
        self.power = self.back = np.ones(1, dtype=_U)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, 2 * PIECE)
            for name, base in (("power", self.base % 2**64), ("back", pow(self.base, -1, 2**64))):
                step = np.full(size, base, dtype=_U)
                step[0] = 1
                setattr(self, name, np.multiply.accumulate(step))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(self.value[data] * self.power[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of [start, end), the same wherever the bytes lie."""
        return (prefix[end] - prefix[start]) * self.back[start]


_ONE, _TWO = Poly(1), Poly(2)


def anchors(prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's position for each window of the data, and the hash of each gram."""
    n = len(prefix) - 1
    grams = mixed((prefix[GRAM:] - prefix[:-GRAM]) * _ONE.back[: n - GRAM + 1])
    low = _U((1 << 24) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=_U)
    width, goal = 1, WINDOW - GRAM + 1
    while 2 * width <= goal:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if goal > width:
        least = np.minimum(least[: len(least) - (goal - width)], least[goal - width :])
    return (least & low).astype(np.int64), grams


def cells_of(texts: list[bytes], docs: list[int], whose: list[int], shifts: list[int], mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts (or pieces of texts, which begin at ``shifts``) one after the other, their cells, these cells' doc_ids, and where they begin."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    nothing = np.empty(0, dtype=CELL), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    if len(data) < WINDOW:
        return data, *nothing
    prefix = _ONE.prefix(data)
    at, grams = anchors(prefix)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + WINDOW <= (begins + sizes)[row])
    if not len(start):
        return data, *nothing
    first = np.flatnonzero(np.r_[True, (at[start[1:]] != at[start[:-1]]) | (start[1:] != start[:-1] + 1)])
    count = np.diff(np.r_[first, len(start)])
    start = start[first]
    out = np.empty(len(start), dtype=CELL)
    where = at[start]
    out["anchor"] = grams[where] & _U(mask)
    out["off"], out["count"], out["tag"] = where - start, count, OPEN
    out["cell"] = mixed(mixed(_ONE.spans(prefix, start, start + count - 1 + WINDOW)) + out["off"].astype(_U) * _U(256) + count.astype(_U)) & _U(mask & 0xFFFFFFFF)
    k = row[start]
    out["who"] = np.array(whose, dtype=np.int64).view(_U)[k]
    out["start"] = start - begins[k] + np.array(shifts, dtype=np.int64)[k]
    return data, out, np.array(docs, dtype=np.int64)[k], start


def padded(chunks: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([*chunks, np.zeros(SPAN, dtype=np.uint8)])


def _sizes(cells: np.ndarray) -> np.ndarray:
    return cells["count"].astype(np.int64) - 1 + WINDOW


def equal_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes at x and y are the same; ``data`` is padded."""
    view = np.lib.stride_tricks.sliding_window_view(data, SPAN)
    out = np.empty(len(x), dtype=bool)
    for a in range(0, len(x), 10_000):
        b = a + 10_000
        differ = view[x[a:b]] != view[y[a:b]]
        out[a:b] = ~(differ & (np.arange(SPAN) < size[a:b, None])).any(axis=1)
    return out


def _changes(cells: np.ndarray, *fields: str) -> np.ndarray:
    """Whether a cell differs from the one before it in any of the fields."""
    out = np.ones(len(cells), dtype=bool)
    if len(cells):
        out[1:] = False
    for f in fields:
        out[1:] |= cells[f][1:] != cells[f][:-1]
    return out


def collapse(cells: np.ndarray, doc: np.ndarray, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells in order, their doc_ids, where their bytes begin, and whether they repeat an earlier one; ``data`` is padded.

    Cells whose hashes agree are compared byte by byte; one that differs from the first
    gets another hash, so that equal hashes mean equal bytes in what is returned.
    """
    while True:
        order = np.lexsort((cells["who"], cells["start"], doc, cells["cell"], cells["anchor"]))
        order = order[_changes(cells[order], "anchor", "cell", "start", "who")]  # a row given twice counts once
        cells, doc, begin = cells[order], doc[order], begin[order]
        head = np.flatnonzero(_changes(cells, "anchor", "cell"))
        first = np.repeat(head, np.diff(np.r_[head, len(cells)]))
        differ = (cells["off"] != cells["off"][first]) | (cells["count"] != cells["count"][first])
        ask = np.flatnonzero(~differ & (first != np.arange(len(cells))))
        differ[ask] = ~equal_bytes(data, begin[ask], begin[first[ask]], _sizes(cells)[ask])
        if not differ.any():
            return cells, doc, begin, (doc != doc[first]) | (cells["start"] != cells["start"][first])
        cells["cell"][differ] = (cells["cell"][differ].astype(_U) * _U(0x9E3779B1) + _U(0x7F4A7C15)) & _U(0xFFFFFFFF)


def settle(cells: np.ndarray, hot_from: int) -> np.ndarray:
    """Different cells of one map task, in order: those of hot anchors are tagged, with a mark for each such anchor."""
    if not len(cells):
        return cells
    head = _changes(cells, "anchor")
    group = np.cumsum(head) - 1
    hot = np.bincount(group, weights=_changes(cells, "anchor", "cell")) > hot_from
    cells["tag"][hot[group]] = HOT_EDGE
    marks = cells[np.flatnonzero(head)[hot]]
    marks["tag"] = MARK
    return np.concatenate([cells, marks])


def with_company(cells: np.ndarray, hot_from: int) -> np.ndarray:
    """Cells of one bucket whose anchor has others too."""
    marked = cells["anchor"][cells["tag"] == MARK]
    cells = cells[cells["tag"] == OPEN]
    if not len(cells):
        return cells
    cells = cells[np.lexsort((cells["who"], cells["start"], cells["cell"], cells["anchor"]))]
    cells = cells[_changes(cells, "anchor", "cell", "start", "who")]
    head = _changes(cells, "anchor")
    group = np.cumsum(head) - 1
    hot = (np.bincount(group, weights=_changes(cells, "anchor", "cell")) > hot_from) | np.isin(cells["anchor"][head], marked)
    many = np.bincount(group) > 1
    cells["tag"] = np.where(hot[group], HOT_EDGE, EDGE)
    return cells[(hot | many)[group]]


def _batches(names: list[str], keys, records: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """One row for each key: the key, the kind, and the key's records as bytes."""
    if not len(records):
        return
    order = np.argsort(keys, kind="stable")
    keys, records = keys[order], records[order]
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    blobs = [records[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(records)])]
    yield pa.RecordBatch.from_arrays([pa.array(keys[cuts].astype(np.int32)), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names)


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows of one key; the rows come sorted."""
    held, last = [], None
    for batch in batches:
        ks = batch.column(batch.schema.get_field_index(key)).to_pylist()
        a = 0
        for b in range(1, len(ks) + 1):
            if b == len(ks) or ks[b] != ks[a]:
                if held and ks[a] != last:
                    yield last, pa.Table.from_batches(held)
                    held = []
                last = ks[a]
                held.append(batch.slice(a, b - a))
                a = b
    if held:
        yield last, pa.Table.from_batches(held)


def _records(table: pa.Table, dtype: np.dtype, kind: int) -> np.ndarray:
    blobs = [b.as_py() for b, k in zip(table.column("blob"), table.column("kind").to_pylist()) if k == kind]
    return np.frombuffer(b"".join(blobs), dtype=dtype).copy()


def _home(records: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that a record's document belongs to."""
    return np.mod(records["who"].copy().view(np.int64), groups)


def _cuts(cells: np.ndarray) -> np.ndarray:
    out = np.empty(len(cells), dtype=CUT)
    out["who"], out["start"], out["size"] = cells["who"], cells["start"], _sizes(cells)
    return merged(out)


KEYED = "bucket int, kind int, blob binary"
_NAMES = ["bucket", "kind", "blob"]
#: Kinds of rows: cuts by document, cells by anchor, cells by document, cells with their bytes by anchor.
CUTS, BY_ANCHOR, BY_DOC, WITH_BYTES = range(4)


def _cells(texts: DataFrame, groups: int, hot_local: int, mask: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory(caches=True)
        found: list[tuple[np.ndarray, ...]] = []
        held, ids, whose, shifts, size, passed = [], [], [], [], 0, 0

        def flush():
            nonlocal size
            if held:
                found.append(cells_of(held, ids, whose, shifts, mask))
            for x in (held, ids, whose, shifts):
                x.clear()
            size = 0

        def emit():
            flush()
            if found:
                at = np.cumsum([0, *(len(f[0]) for f in found)])
                starts = np.concatenate([f[3] + k for f, k in zip(found, at)])
                cells, _, _, again = collapse(np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]), padded([f[0] for f in found]), starts)
                found.clear()
                cuts = _cuts(cells[again])
                yield from _batches(_NAMES, _home(cuts, groups), cuts, CUTS)
                cells = settle(cells[~again], hot_local)
                hot = cells["tag"] == HOT_EDGE
                yield from _batches(_NAMES, _home(cells[hot], groups), cells[hot], BY_DOC)
                yield from _batches(_NAMES, (cells["anchor"][~hot] % _U(groups)).astype(np.int64), cells[~hot], BY_ANCHOR)

        for batch in batches:
            docs, who = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "who"))
            column = batch.column(batch.schema.get_field_index("text"))
            for r in range(batch.num_rows):
                if not column[r].is_valid:
                    continue
                text = column[r].as_buffer().to_pybytes()
                for at in range(0, max(1, len(text) - WINDOW + 1), PIECE):
                    piece = text[at : at + PIECE + WINDOW - 1] if len(text) > PIECE else text
                    if size + len(piece) > PIECE:
                        flush()
                    held.append(piece)
                    ids.append(docs[r])
                    whose.append(who[r])
                    shifts.append(at)
                    size += len(piece)
                    passed += len(piece)
                    if passed >= PASS_BYTES:
                        yield from emit()
                        passed = 0
        yield from emit()
        release_memory()

    rows = texts.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "who", "text").mapInArrow(run, KEYED)
    return rows.repartition(min(groups, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")


def _match_cells(cells: DataFrame, groups: int, hot: int) -> DataFrame:
    """Rows by documents: cuts, and cells whose bytes are to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, t in _by_key(batches, "bucket"):
            for kind, dtype in ((CUTS, CUT), (BY_DOC, CELL)):
                done = _records(t, dtype, kind)
                yield from _batches(_NAMES, np.full(len(done), bucket), done, kind)
            left = with_company(_records(t, CELL, BY_ANCHOR), hot)
            yield from _batches(_NAMES, _home(left, groups), left, BY_DOC)
            del done, left
            release_memory()

    return cells.mapInArrow(run, KEYED)


def _single_windows(cells: np.ndarray, data: np.ndarray, shift: int, mask: int) -> np.ndarray:
    """Cells of one window each, for all windows of one document's ``cells``; their anchor is the whole window."""
    count = cells["count"].astype(np.int64)
    start = np.unique(np.repeat(cells["start"] - np.cumsum(count) + count, count) + np.arange(count.sum()))
    low, high = int(start[0]), int(start[-1]) + WINDOW
    part = data[shift + low : shift + high]
    out = np.empty(len(start), dtype=CELL)
    out["anchor"] = mixed(_ONE.spans(_ONE.prefix(part), start - low, start - low + WINDOW)) & _U(mask)
    out["cell"] = mixed(_TWO.spans(_TWO.prefix(part), start - low, start - low + WINDOW)) & _U(mask & 0xFFFFFFFF)
    out["who"], out["start"], out["off"], out["count"], out["tag"] = cells["who"][0], start, 0, 1, EDGE
    return out


def _packed(cells: np.ndarray, doc: np.ndarray, data: np.ndarray) -> bytes:
    """Cells with their doc_ids and bytes, compressed, after the size of what was compressed and the number of cells."""
    raw = cells.tobytes() + doc.tobytes() + data.tobytes()
    return np.array([len(raw), len(cells)], dtype="<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, n = np.frombuffer(blob, dtype="<i8", count=2).tolist()
    raw = pa.decompress(blob[16:], decompressed_size=size, codec="zstd", asbytes=True)
    at = n * CELL.itemsize
    return np.frombuffer(raw, dtype=CELL, count=n), np.frombuffer(raw, dtype="<i8", count=n, offset=at), np.frombuffer(raw, dtype=np.uint8, offset=at + 8 * n)


def _edge_text(texts: DataFrame, found: DataFrame, groups: int, mask: int) -> DataFrame:
    """Cells and their bytes by anchor, and cuts known already, in the first fine bucket of their documents' group."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        edges = _records(right, CELL, BY_DOC)
        edges = edges[np.argsort(edges["who"], kind="stable")]
        heads = np.flatnonzero(_changes(edges, "who"))
        mine = {int(edges["who"][a]): (a, b) for a, b in zip(heads, [*heads[1:], len(edges)])}
        chunks, cells, docs, begins, size = [], [], [], [], 0
        who, ids, column = left.column("who").to_pylist(), left.column("doc_id").to_pylist(), left.column("text")
        for r in range(left.num_rows) if mine else ():
            a, b = mine.pop(who[r] % 2**64, (0, 0))  # rows with equal doc_id and text are one
            if a == b:
                continue
            data = np.frombuffer(column[r].as_buffer(), dtype=np.uint8)
            own = edges[a:b]
            hot = own["tag"] == HOT_EDGE
            for part in (own[~hot], _single_windows(own[hot], data, 0, mask) if hot.any() else own[:0]):
                cells.append(part)
                docs.append(np.full(len(part), LAST if ids[r] is None else ids[r], dtype=np.int64))
                begins.append(part["start"].astype(np.int64) + size)
            chunks.append(data)
            size += len(data)
        rows: list[pa.RecordBatch] = []
        if cells:
            data = padded(chunks)
            every, doc, begin, again = collapse(np.concatenate(cells), np.concatenate(docs), data, np.concatenate(begins))
            cuts = _cuts(every[again])
            rows += _batches(_NAMES, _home(cuts, groups) * FINE, cuts, CUTS)
            every, doc, begin = every[~again], doc[~again], begin[~again]
            keys = (every["anchor"] % _U(groups * FINE)).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            keys, every, doc, begin = keys[order], every[order], doc[order], begin[order]
            heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            view = np.lib.stride_tricks.sliding_window_view(data, SPAN)
            blobs = []
            for a, b in zip(heads, [*heads[1:], len(keys)]):
                inside = np.arange(SPAN) < _sizes(every[a:b])[:, None]
                blobs.append(_packed(every[a:b], doc[a:b], view[begin[a:b]][inside]))
            rows.append(pa.RecordBatch.from_arrays([pa.array(keys[heads].astype(np.int32)), pa.array([WITH_BYTES] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], _NAMES))
        release_memory()
        return pa.Table.from_batches(rows) if rows else pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())]).empty_table()

    return texts.groupBy("dest").cogroup(found.where(F.col("kind") == BY_DOC).groupBy("bucket")).applyInArrow(join, KEYED)


class Suffixes:
    """Suffixes of bounded length in one buffer, compared by prefix polynomial hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int):
        self.data, self.start, self.size = data, start, size
        self.poly = Poly(seed)
        self.prefix = self.poly.prefix(data)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, by binary search."""
        most = np.minimum(self.size[x], self.size[y])
        low, high = np.zeros(len(x), dtype=np.int64), most.copy()
        sx, sy = self.start[x], self.start[y]
        for _ in range(int(most.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            equal = self.poly.spans(self.prefix, sx, sx + mid) == self.poly.spans(self.prefix, sy, sy + mid)
            low = np.where(equal, mid, low)
            high = np.where(equal, high, mid - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y (or equal to it, where that counts)."""
        n = self.common(x, y)
        end_x, end_y = n == self.size[x], n == self.size[y]
        last = len(self.data) - 1
        less = self.data[np.minimum(self.start[x] + n, last)] < self.data[np.minimum(self.start[y] + n, last)]
        return np.where(end_x | end_y, np.where(end_x & end_y, or_equal, end_x), less)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order by (group, suffix): merge sort of all groups at once; ``group`` ascends.

        In each round, runs of doubled length are merged: an element's new place is its
        place in its run plus the number of elements of the other run that go before it.
        """
        n = len(group)
        order = np.arange(n)
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        length = np.diff(np.r_[head, n])
        base, total = np.repeat(head, length), np.repeat(length, length)
        run = 1
        place = np.arange(n) - base
        while run < length.max(initial=0):
            mine = place // run
            other = mine ^ 1
            lo = other * run
            hi = np.minimum(lo + run, total)
            active = np.flatnonzero(lo < total)
            x = order[active]
            right = (mine[active] & 1).astype(bool)
            a, b = lo[active].copy(), hi[active].copy()
            floor = a.copy()
            for _ in range(run.bit_length()):
                todo = np.flatnonzero(a < b)
                if not len(todo):
                    break
                mid = (a[todo] + b[todo]) >> 1
                y = order[base[active[todo]] + mid]
                first = self.before(y, x[todo], right[todo])  # equal ones of the left run go first
                a[todo] = np.where(first, mid + 1, a[todo])
                b[todo] = np.where(first, b[todo], mid)
            new = place.copy()
            pair = (mine[active] >> 1) * 2 * run
            new[active] = pair + place[active] % run + (a - floor)
            fresh = order.copy()
            fresh[base + new] = order
            order = fresh
            run *= 2
        return order

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, bool]:
        """Common extension of each with the one before it (-1 across groups), and whether the bytes confirm all."""
        x, y = order[:-1], order[1:]
        near = group[x] == group[y]
        n = np.full(len(order), -1, dtype=np.int64)
        n[1:][near] = self.common(x[near], y[near])
        sx, sy, size = self.start[x[near]], self.start[y[near]], n[1:][near]
        for k in range(int(size.max(initial=0))):
            on = size > k
            if (self.data[sx[on] + k] != self.data[sy[on] + k]).any():
                return n, False
        return n, True


def classes_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the suffixes and verified common extensions of neighbours."""
    for seed in range(3, 103):
        s = Suffixes(data, start, size, seed)
        order = s.sort(group)
        near, sure = s.neighbours(order, group)
        if sure:
            return order, near
    raise RuntimeError("hashes keep colliding")


def edge_repeats(cells: np.ndarray, doc: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Cuts for windows of cells that repeat an earlier one; ``data`` has the cells' bytes one after the other."""
    size = _sizes(cells)
    begin = np.cumsum(size) - size
    order = np.argsort(cells["anchor"], kind="stable")
    cells, doc, size, begin = cells[order], doc[order], size[order], begin[order]
    group = np.cumsum(_changes(cells, "anchor")) - 1
    anchor = begin + cells["off"]
    right, right_near = classes_of(data, anchor, begin + size - anchor, group)
    left, left_near = classes_of(data[::-1], len(data) - anchor, anchor - begin, group)
    top = cells["off"].astype(np.int64)  # offsets j of a cell's windows: top - count + 1 .. top
    low = top - cells["count"] + 1
    out = []
    r_class, l_class = np.empty(len(cells), dtype=np.int64), np.empty(len(cells), dtype=np.int64)
    for j in range(WINDOW - GRAM + 1):
        has = np.flatnonzero((low <= j) & (j <= top))
        if len(has) < 2:
            continue
        r_class[right] = np.cumsum(right_near < WINDOW - j)
        l_class[left] = np.cumsum(left_near < j)
        key = r_class[has] * (len(cells) + 1) + l_class[has]
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        own, start = doc[has], cells["start"][has] + top[has] - j
        place = np.lexsort((start, own, back))  # by class, then by place
        head = place[np.searchsorted(back[place], np.arange(len(first)))]
        later = (own != own[head][back]) | (start != start[head][back])
        again = has[later]
        cut = np.empty(len(again), dtype=CUT)
        cut["who"], cut["start"], cut["size"] = cells["who"][again], start[later], WINDOW
        out.append(cut)
    return merged(np.concatenate(out)) if out else np.empty(0, dtype=CUT)


def _match_edges(edge_text: DataFrame, groups: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, t in _by_key(batches, "bucket"):
            known = _records(t, CUT, CUTS)
            yield from _batches(_NAMES, np.full(len(known), bucket // FINE), known, CUTS)
            parts = [_unpacked(blob.as_py()) for kind, blob in zip(t.column("kind").to_pylist(), t.column("blob")) if kind == WITH_BYTES]
            if parts:
                cuts = edge_repeats(*(np.concatenate(x) for x in zip(*parts)))
                yield from _batches(_NAMES, _home(cuts, groups), cuts, CUTS)
            del known, parts
            release_memory()

    rows = edge_text.repartition(min(groups, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, KEYED)


def merged(cuts: np.ndarray) -> np.ndarray:
    """Cuts of a document that overlap or touch become one."""
    if not len(cuts):
        return cuts
    cuts = cuts[np.lexsort((cuts["start"], cuts["who"]))]
    end = cuts["start"].astype(np.int64) + cuts["size"]
    rank = np.cumsum(_changes(cuts, "who"))  # documents far apart on one line, so that one running maximum does
    far = rank * (1 << 33)
    reach = np.maximum.accumulate(end + far)
    first = np.flatnonzero(np.r_[True, (cuts["start"][1:] + far[1:]) > reach[:-1]])
    out = cuts[first]
    out["size"] = reach[np.r_[first[1:] - 1, len(cuts) - 1]] - far[first] - out["start"]
    return out


def remaining(text: bytes, cuts: np.ndarray) -> bytes:
    """The text without its (merged) cuts."""
    out, at = [], 0
    for a, n in zip(cuts["start"].tolist(), cuts["size"].tolist()):
        out.append(text[at:a])
        at = a + n
    return b"".join([*out, text[at:]])


def _cut(texts: DataFrame, cuts: DataFrame) -> DataFrame:
    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        every = merged(_records(right, CUT, CUTS))
        heads = np.flatnonzero(_changes(every, "who"))
        mine = {int(every["who"][a]): every[a:b] for a, b in zip(heads, [*heads[1:], len(every)])}
        out = {"doc_id": left.column("doc_id").to_pylist(), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        column = left.column("text")
        for r, who in enumerate(left.column("who").to_pylist()):
            own = mine.get(who % 2**64, every[:0])
            text = column[r].as_buffer().to_pybytes() if column[r].is_valid else b""
            out["n_bytes"].append(len(text))
            out["n_removed"].append(int(own["size"].sum()))
            out["n_spans"].append(len(own))
            out["kept"].append(remaining(text, own))
        types = [pa.int64()] * 4 + [pa.binary()]
        release_memory()
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})

    return texts.groupBy("dest").cogroup(cuts.groupBy("bucket")).applyInArrow(join, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup_substrings(docs: DataFrame, hot_local: int = HOT_LOCAL, hot: int = HOT, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every document row.

    ``hash_bits`` weakens the hashes that bring windows together; the result is the same.
    """
    docs = picked(docs, "doc_id", "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    groups, mask = max(6, -(-total // BUCKET_BYTES)), (1 << hash_bits) - 1
    texts = docs.withColumn("who", F.xxhash64("doc_id", "text"))
    found = materialize(_match_cells(_cells(texts, groups, hot_local, mask), groups, hot), "cells")
    texts = texts.withColumn("dest", F.pmod("who", F.lit(groups)).cast("int"))
    cuts = _match_edges(_edge_text(texts, found, groups, mask), groups)
    return _cut(texts, found.where(F.col("kind") == CUTS).unionByName(cuts))


def digest(docs: DataFrame, **options: int) -> DataFrame:
    """The contract's columns; ``options`` go to ``dedup_substrings``."""
    return dedup_substrings(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
