"""Exact removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every window of `least` bytes has an anchor: the smallest hashed 20-byte string in it. Equal windows have equal
anchors, so windows can only repeat among the stretches around one anchor; anchors are dealt to buckets, and equal
stretches (whole copies) fall together by a 128-bit cryptographic digest of their bytes. The windows of a stretch fall
into parts by the place of the anchor in them; a part whose core, what all its windows hold, is in no other stretch
around the anchor can share no window and is left out. What remains is laid end to end in small texts whose transform
is expanded breadth first:
intervals of ever longer strings give the common prefixes by increasing value, up to the threshold. Suffixes that are
still together share a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix, prefix_sums, span_hashes
from .work import by_bucket, dealt, tasks, tidy, written

ANCHOR = 20
#: Longer texts are cut into pieces of so many window starts.
PIECE = 1 << 19
#: Bytes of texts whose anchors are looked for at once, if they are no longer.
SLICE = 1 << 17
#: An anchor with more different stretches than this is dealt by single windows instead.
CROWDED = 2000
#: Parts into which the windows of a stretch fall by the place of the anchor in them.
PARTS = 4
#: Bytes of text that are expanded at once.
AT_ONCE = 1 << 19

_U = np.uint64


def anchors(b: np.ndarray, least: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of texts of these sizes (`least` or more) end to end: anchor hash, first window start, number of windows and place of the anchor, by anchor."""
    n = len(b)
    m = n - ANCHOR + 1
    v = np.ndarray((n - 7,), dtype="<u8", buffer=b, strides=(1,))
    h = v[:m] * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(31)
    h += v[8 : 8 + m]
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    h += v[12 : 12 + m]
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(32)
    w = h & _U(0xFFFFFFFF00000000)
    w |= np.arange(m - 1, -1, -1, dtype=np.uint64)  # of equal ones, the rightmost
    span, s = least - ANCHOR + 1, 1
    while s * 2 <= span:
        w = np.minimum(w[:-s], w[s:])
        s *= 2
    if span > s:
        w = np.minimum(w[: s - span], w[span - s :])
    windows = sizes - (least - 1)
    inside = np.arange(int(windows.sum())) + np.repeat(np.arange(len(sizes)) * (least - 1), windows)  # windows of one text
    at = (m - 1) - (w[inside] & _U(0xFFFFFFFF)).astype(np.int64)
    low = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return h[at[low]], inside[low], np.diff(np.concatenate((low, [len(at)]))), at[low]


def _part_width(least: int) -> int:
    return -(-(least - ANCHOR + 1) // PARTS)


def cores(b: np.ndarray, low: np.ndarray, n: np.ndarray, place: np.ndarray, least: int) -> list[np.ndarray]:
    """For each part, hashes of the bytes that all its windows hold around the anchor; 0 where a stretch has none of them.

    The anchor's place in a window follows from the window's bytes, so that equal windows are of the same part. An equal
    hash of different bytes costs time, and no result.
    """
    span, width = least - ANCHOR, _part_width(least)
    sums, top = prefix_sums(b), place - low
    out = []
    for least_at in range(0, PARTS * width, width):
        most_at = min(span, least_at + width - 1)
        has = (top >= least_at) & (top - n < most_at)
        h = span_hashes(sums, np.where(has, place - least_at, 0), np.where(has, place + least - most_at, 0))
        out.append(np.where(has, (h >> _U(32)) | _U(1), 0).astype(np.uint32))
    return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of text in order, by doubling; after seven bytes only those that are still tied are sorted on."""
    n = len(text)
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = text
    key = padded[:n].copy()
    for j in range(1, 7):  # seven bytes fit beside each other
        key = (key << _U(8)) | padded[j : n + j]
    order, have = np.argsort(key), 7
    place = np.arange(n)
    rank = np.zeros(n + 1, dtype=np.int64)  # where a suffix's group begins; the empty suffix comes before all
    rank[n] = -1
    key = key[order]
    while True:
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((head, [len(key)])))
        rank[order[place]] = np.repeat(place[head], size)
        tied = np.repeat(size > 1, size)
        place = place[tied]
        if len(place) == 0:
            return order
        suffix = order[place]
        key = (rank[suffix].astype(np.uint64) << _U(32)) | (rank[np.minimum(suffix + have, n)] + 1).astype(np.uint64)
        by = np.argsort(key)
        order[place] = suffix[by]
        key = key[by]
        have *= 2


def common_windows(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of text that begin with `least` bytes of one stretch, in order, and which share these with the one before.

    text holds bytes plus one; a 0 ends each stretch, and no string across an end counts. The order of the suffixes
    gives the transform, and knows nothing of `least`. Intervals are then expanded backwards from the empty string,
    breadth first, so that each value of the longest common prefix below `least` is found at its own level; places
    that no interval has told apart at the last level share `least` bytes.
    """
    n = len(text)
    order = suffix_order(text)
    before = text[order - 1]  # the transform; the first suffix has the last end before it
    forward = np.empty(n, dtype=np.int32)  # where each suffix's predecessor stands
    forward[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    first = text[order]
    common = np.full(n + 1, -1, dtype=np.int16)
    common[0] = common[n] = 0
    low, high = np.array([0], dtype=np.int32), np.array([n], dtype=np.int32)
    owner = np.zeros(n + 1, dtype=np.int32)
    for level in range(least):
        size = high - low
        total = int(size.sum())
        ids = np.repeat(np.arange(1, len(low) + 1, dtype=np.int32), size)
        place = np.arange(total, dtype=np.int32) + np.repeat(low - (np.cumsum(size, dtype=np.int32) - size), size)
        to = forward[place]
        if total * 4 > n:
            owner[:n] = 0
            owner[to] = ids
            to = np.flatnonzero(owner[:n]).astype(np.int32)
            ids = owner[to]
        else:
            by = np.argsort(to)
            to, ids = to[by], ids[by]
        symbol = first[to]
        real = symbol > 0  # an end isn't extended over
        to, ids, symbol = to[real], ids[real], symbol[real]
        if len(to) == 0:
            break
        cut = np.concatenate(([True], (ids[1:] != ids[:-1]) | (symbol[1:] != symbol[:-1]) | (to[1:] != to[:-1] + 1)))
        begin = to[cut]
        end = to[np.concatenate((cut[1:], [True]))] + 1
        new = (common[begin] < 0) | (common[end] < 0)
        begin, end = begin[new], end[new]
        for bound in (begin, end):
            common[bound[common[bound] < 0]] = level
        # an interval with both bounds known before has no new bound in any extension
        low, high = begin, end
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    whole = left[order] >= least  # suffixes with that many bytes before an end
    order, bound = order[whole], np.cumsum(common[:n] >= 0)[whole]
    return order, np.concatenate(([False], bound[1:] == bound[:-1]))


#: Packed rows that travel between stages: one row holds arrays for one bucket.
BLOB = "bucket int, kind int, data binary"


def _blob(bucket: int, kind: int, *columns: np.ndarray) -> tuple[int, int, bytes]:
    return bucket, kind, np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unblob(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    found: list[list[np.ndarray]] = [[] for _ in kinds]
    for x in blobs:
        n, at = int(np.frombuffer(x, dtype=np.int64, count=1)[0]), 8
        for to, kind in zip(found, kinds):
            to.append(np.frombuffer(x, dtype=kind, count=n, offset=at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) if x else np.empty(0, dtype=k) for x, k in zip(found, kinds)]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, d = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], ["bucket", "kind", "data"])


def _dealt(bucket: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Splits columns by bucket into packed rows."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    for a, b in zip(at, [*at[1:], len(bucket)]):
        pick = order[a:b]
        yield _blob(int(bucket[a]), kind, *(c[pick] for c in columns))


def _spread(ids: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each 64-bit value."""
    return (mix(ids.astype(np.int64).view(np.uint64).copy()) % _U(buckets)).astype(np.int32)


STRETCHES, REMOVED, ASKED, CROWD, TEXT = 0, 1, 2, 3, 4
_OCCURS = ("<u8", "<u8", "<u8", "<i8", "<i8", "<u1", "<u1", *["<u4"] * PARTS)  # anchor, digest of the stretch, document, first window, windows, place of the anchor in the first, cores
_RUN = ("<i8", "<i8", "<u1")  # document, first window, windows
_WANT = ("<i8", "<i8", "<u1", "<u8")  # and the anchor


def _pieces(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[int, int, bytes]]:
    """Texts that have a window, long ones in pieces: document, place of the piece and its bytes."""
    for batch in batches:
        for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            whole = x.as_py() or b""
            for at in range(0, max(0, len(whole) - least + 1), PIECE):
                yield doc, at, whole[at : at + PIECE + least - 1]


def _stretches(pieces: list[tuple[int, int, bytes]], least: int) -> list[np.ndarray]:
    """The columns of _OCCURS of some pieces, by one pass over them all."""
    docs, places, texts = zip(*pieces)
    sizes = np.array([len(x) for x in texts])
    data = b"".join(texts)
    b = np.frombuffer(data, dtype=np.uint8)
    h, low, n, place = anchors(b, least, sizes)
    view = memoryview(data)
    digest = b"".join([hashlib.blake2b(view[i:j], digest_size=16).digest() for i, j in zip(low.tolist(), (low + n + least - 1).tolist())])
    stretch = np.frombuffer(digest, dtype="<u8").reshape(-1, 2)
    begin = np.cumsum(sizes) - sizes
    of = np.searchsorted(begin, low, side="right") - 1
    top = place - low
    return [h, stretch[:, 0] + top.astype(np.uint64), stretch[:, 1], np.array(docs, dtype=np.int64)[of], low - begin[of] + np.array(places)[of], n.astype(np.uint8), top.astype(np.uint8), *cores(b, low, n, place, least)]


def _occurrences(least: int, buckets: int, flush: int = 1 << 19):
    """Anchors of all windows, dealt by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple[int, int, bytes]] = []
        parts: list[list[np.ndarray]] = []
        size = have = 0
        for piece in _pieces(batches, least):
            pieces.append(piece)
            size += len(piece[2])
            if size >= SLICE:
                parts.append(_stretches(pieces, least))
                pieces, size, have = [], 0, have + len(parts[-1][0])
                if have >= flush:
                    c = [np.concatenate(p) for p in zip(*parts)]
                    yield _batch(list(_dealt(_spread(c[0].view(np.int64), buckets), STRETCHES, *c)))
                    parts, have = [], 0
        if pieces:
            parts.append(_stretches(pieces, least))
        if parts:
            c = [np.concatenate(p) for p in zip(*parts)]
            yield _batch(list(_dealt(_spread(c[0].view(np.int64), buckets), STRETCHES, *c)))

    return run


def _met(group: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Where a core is also in another row of its group."""
    order = np.lexsort((core, group))
    g, c = group[order], core[order]
    same = (g[1:] == g[:-1]) & (c[1:] == c[:-1]) & (c[1:] > 0)
    out = np.zeros(len(group), dtype=bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _sizes(ids: np.ndarray) -> np.ndarray:
    """How many rows have the id of each row."""
    _, which, n = np.unique(ids, return_inverse=True, return_counts=True)
    return n[which]


def _parts(anchor: np.ndarray, doc: np.ndarray, low: np.ndarray, n: np.ndarray, top: np.ndarray, core: np.ndarray, least: int) -> Iterator[tuple[int, tuple]]:
    """Of different stretches, the runs of windows whose cores are met again, under their anchor; where these are many, part by part under anchor and core."""
    width = _part_width(least)
    held = np.stack([_met(anchor, c) for c in core])
    some = held.any(axis=0)
    anchor, doc, low, n, top, core, held = anchor[some], doc[some], low[some], n[some].astype(np.int64), top[some].astype(np.int64), core[:, some], held[:, some]
    many = _sizes(anchor) > CROWDED

    def run(pick: np.ndarray, a: int, b: int) -> tuple:
        most, least_ = np.minimum(top[pick], (b + 1) * width - 1), np.maximum(top[pick] - n[pick] + 1, a * width)
        return doc[pick], low[pick] + top[pick] - most, (most - least_ + 1).astype(np.uint8)

    edge = np.zeros((1, held.shape[1]), dtype=bool)
    around = np.concatenate((edge, held, edge))
    for a in range(PARTS):
        for b in range(a, PARTS):
            pick = np.flatnonzero(~many & held[a : b + 1].all(axis=0) & ~around[a] & ~around[b + 2])
            yield ASKED, (*run(pick, a, b), anchor[pick])
        pick = np.flatnonzero(many & held[a])
        key = mix(anchor[pick] ^ mix(core[a, pick].astype(np.uint64) * _U(PARTS) + _U(a)))
        crowd = _sizes(key) > CROWDED
        own = (*run(pick, a, a), key)
        yield ASKED, tuple(c[~crowd] for c in own)
        yield CROWD, tuple(c[crowd] for c in own)


def _compared(buckets: int, least: int = 100):
    """Per anchor: later copies of a stretch are removed whole; of first ones, what may be in a different stretch is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches):
            columns = _unblob([x for r in rows for x in r.column(2).to_pylist()], *_OCCURS)
            del rows
            # only anchors that occur again
            order = np.argsort(columns[0])
            s = columns[0][order]
            same = s[1:] == s[:-1]
            again = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
            columns = [c[again] for c in columns]
            order = np.lexsort((columns[4], columns[3], columns[2], columns[1], columns[0]))
            anchor, stretch, more, doc, low, n, top, *core = (c[order] for c in columns)
            if len(anchor) == 0:
                continue
            first = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1]) | (more[1:] != more[:-1])))
            out = list(_dealt(_spread(doc[~first], buckets), REMOVED, doc[~first], low[~first], n[~first]))
            wanted: dict[int, list[tuple]] = {ASKED: [], CROWD: []}
            for kind, own in _parts(*(c[first] for c in (anchor, doc, low, n, top)), np.stack([c[first] for c in core]), least):
                wanted[kind].append(own)
            for kind, owns in wanted.items():
                own = [np.concatenate(c) for c in zip(*owns)]
                out += _dealt(_spread(own[0], buckets), kind, *own)
            yield _batch(out)

    return run


_SEG = ("<i8", "<i8", "<u1", "<u8", "<u4")  # document, first window, windows, anchor, bytes; then the bytes


def _segments(b: bytes, meta: list[np.ndarray]) -> bytes:
    return _blob(0, 0, *meta)[2] + b


def _cut_out(least: int, buckets: int, flush: int = 8 << 20):
    """The bytes of the stretches that were asked for, dealt by anchor; of crowded anchors, single windows dealt by their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[bytes] = []
        crowd: list[bytes] = []
        table: tuple | None = None
        current = None
        parts: list[tuple] = []
        size = 0
        windows: dict[bytes, tuple[int, int]] = {}

        def send() -> list[tuple[int, int, bytes]]:
            out = []
            by: dict[int, list[tuple]] = {}
            for p in parts:
                by.setdefault(p[0], []).append(p)
            for bucket, own in by.items():
                cols = [np.array([p[i] for p in own], dtype=k) for i, k in zip(range(1, 6), _SEG)]
                out.append((bucket, TEXT, _segments(b"".join(p[6] for p in own), cols)))
            parts.clear()
            return out

        for batch in batches:
            for bucket, kind, doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if bucket != current:
                    current, table, asked, crowd = bucket, None, [], []
                if kind != TEXT:
                    (asked if kind == ASKED else crowd).append(x.as_py())
                    continue
                if table is None:
                    a, c = _unblob(asked, *_WANT), _unblob(crowd, *_WANT)
                    cols = [np.concatenate((p, q)) for p, q in zip(a, c)] + [np.concatenate((np.zeros(len(a[0]), bool), np.ones(len(c[0]), bool)))]
                    cols.append(_spread(cols[3].view(np.int64), buckets))
                    order = np.argsort(cols[0], kind="stable")
                    table = tuple(p[order] for p in cols)
                    asked, crowd = [], []
                lo, hi = np.searchsorted(table[0], doc), np.searchsorted(table[0], doc, side="right")
                if lo == hi:
                    continue
                text = zstandard.decompress(x.as_py())
                removed = []
                for s, n, h, many, target in zip(*(c[lo:hi].tolist() for c in table[1:])):
                    if not many:
                        piece = text[s : s + n + least - 1]
                        parts.append((target, doc, s, n, h, len(piece), piece))
                        size += len(piece)
                        continue
                    for at in range(s, s + n):
                        piece = text[at : at + least]
                        have = windows.get(piece)
                        if have is not None and have <= (doc, at):
                            removed.append((doc, at))
                            continue
                        if have is not None:
                            removed.append(have)
                        windows[piece] = (doc, at)
                if len(windows) > 100_000:
                    size += _flush(windows, parts, least, buckets)
                if removed:
                    d, at = (np.array(v, dtype=np.int64) for v in zip(*removed))
                    yield _batch(list(_dealt(_spread(d, buckets), REMOVED, d, at, np.ones(len(d), dtype=np.uint8))))
                if size >= flush:
                    yield _batch(send())
                    size = 0
        _flush(windows, parts, least, buckets)
        yield _batch(send())

    return run


def _flush(windows: dict, parts: list, least: int, buckets: int) -> int:
    """Moves single windows to the parts, each dealt by its bytes."""
    size = 0
    if windows:
        b = np.frombuffer(b"".join(windows), dtype=np.uint8)
        at = np.arange(0, len(b), least)
        h = span_hashes(prefix_sums(b), at, at + least)
        for (piece, (doc, s)), key, bucket in zip(windows.items(), h.tolist(), _spread(h.view(np.int64), buckets).tolist()):
            parts.append((bucket, doc, s, 1, key, least, piece))
            size += least
        windows.clear()
    return size


def _expanded(least: int, buckets: int):
    """Windows that occur earlier in another stretch, by expansion of the transform of a few anchors' stretches at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches):
            out, cols, pieces = [], [], []
            for r in rows:
                for bucket, kind, x in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), r.column(2).to_pylist()):
                    if kind == REMOVED:
                        out.append((bucket, kind, x))
                        continue
                    n = int(np.frombuffer(x, dtype=np.int64, count=1)[0])
                    cols.append(_unblob([x], *_SEG))
                    pieces.append(np.frombuffer(x, dtype=np.uint8, offset=8 + n * sum(np.dtype(k).itemsize for k in _SEG)))
            if out:
                yield _batch(out)
            if not cols:
                continue
            doc, low, count, key, size = (np.concatenate(c) for c in zip(*cols))
            flat = np.concatenate(pieces)
            start = np.concatenate(([0], np.cumsum(size.astype(np.int64))))[:-1]
            order = np.argsort(key, kind="stable")
            total = np.cumsum(size[order].astype(np.int64) + 1)
            last = np.concatenate((key[order][1:] != key[order][:-1], [True]))
            begin = 0
            ends = np.flatnonzero(last) + 1
            while begin < len(order):
                base = total[begin - 1] if begin else 0
                k = np.searchsorted(total[ends - 1], base + AT_ONCE, side="right")
                end = int(ends[min(max(k - 1, np.searchsorted(ends, begin, side="right")), len(ends) - 1)])
                pick = order[begin:end]
                found = _earlier(flat, start[pick], size[pick].astype(np.int64), doc[pick], low[pick], least)
                if found is not None:
                    yield _batch(list(_dealt(_spread(found[0], buckets), REMOVED, *found)))
                begin = end

    return run


def _earlier(flat: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, low: np.ndarray, least: int) -> tuple | None:
    """Runs of windows of these stretches that also start earlier in another one."""
    at = np.concatenate(([0], np.cumsum(size + 1)))
    text = np.zeros(at[-1], dtype=np.uint8)
    inside = np.ones(len(text), dtype=bool)
    inside[at[1:] - 1] = False
    owner = np.repeat(np.arange(len(size)), size)
    text[inside] = flat[np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(len(owner))] + np.uint8(1)
    order, together = common_windows(text, least)
    if not together.any():
        return None
    held = together | np.concatenate((together[1:], [False]))
    group = np.cumsum(~together)[held]
    spot = order[held]
    piece = np.searchsorted(at, spot, side="right") - 1
    where = low[piece] + spot - at[piece]
    by = np.lexsort((where, doc[piece], group))
    later = by[np.concatenate(([False], group[by][1:] == group[by][:-1]))]
    d, w = doc[piece[later]], where[later]
    by = np.lexsort((w, d))
    d, w = d[by], w[by]
    jump = np.concatenate(([True], (d[1:] != d[:-1]) | (w[1:] != w[:-1] + 1)))
    head = np.flatnonzero(jump)
    length = np.diff(np.concatenate((head, [len(w)])))
    # runs longer than a byte counts are split
    parts = -(-length // 255)
    rep = np.repeat(np.arange(len(head)), parts)
    nth = np.arange(len(rep)) - np.repeat(np.concatenate(([0], np.cumsum(parts)[:-1])), parts)
    return d[head[rep]], w[head[rep]] + 255 * nth, np.minimum(255, length[rep] - 255 * nth).astype(np.uint8)


RESULT = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"


def _removed(least: int, digest: bool):
    """Each document's removed spans and remaining bytes (or their digest)."""
    names = ["doc_id", "n_bytes", "starts", "ends", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        table: list[np.ndarray] | None = None
        current = None
        for batch in batches:
            rows: list[tuple] = []
            for bucket, kind, doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if bucket != current:
                    current, table, blobs = bucket, None, []
                if kind != TEXT:
                    blobs.append(x.as_py())
                    continue
                if table is None:
                    table = _unblob(blobs, *_RUN)
                    order = np.lexsort((table[1], table[0]))
                    table, blobs = [c[order] for c in table], []
                text = zstandard.decompress(x.as_py())
                a = b = np.empty(0, dtype=np.int64)
                if doc is not None:
                    lo, hi = np.searchsorted(table[0], doc), np.searchsorted(table[0], doc, side="right")
                    if lo < hi:
                        a = table[1][lo:hi]
                        b = np.maximum.accumulate(a + table[2][lo:hi] + least - 1)
                        fresh = np.concatenate(([True], a[1:] > b[:-1]))
                        a, b = a[fresh], b[np.concatenate((fresh[1:], [True]))]
                kept = b"".join(text[p:q] for p, q in zip([0, *b.tolist()], [*a.tolist(), len(text)]))
                rows.append((doc, len(text), a, b, hashlib.sha256(kept).hexdigest().encode() if digest else kept))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _packed(buckets: int):
    """Texts for the way: compressed, dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            data = [tool.compress(x.as_py() or b"") for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_spread(ids, buckets)), pa.array(np.full(len(ids), TEXT, dtype=np.int32)), batch.column(0), pa.array(data, pa.binary())], ["bucket", "kind", "doc_id", "data"]
            )

    return run


_MOVED = "bucket int, kind int, doc_id long, data binary"


def _together(texts: DataFrame, blobs: DataFrame, buckets: int) -> DataFrame:
    """Texts and what concerns them, bucket of documents by bucket, packed rows first."""
    return dealt(blobs.select("bucket", "kind", F.lit(None).cast("long").alias("doc_id"), "data").unionByName(texts), buckets, "kind")


def repeated_spans(docs: DataFrame, least: int = 100, digest: bool = False) -> DataFrame:
    """Bytes of each document that lie in a string of `least` bytes which also starts earlier.

    docs has doc_id and text (other columns are ignored). Texts count as UTF-8, null as empty; matches stay inside a
    document. Earlier: in a document with a smaller doc_id, or in the same one at an earlier start; all strings are
    judged on the input. Returns doc_id, n_bytes, starts and ends of the maximal removed runs, and kept: the
    remaining bytes, or with digest their SHA-256 in hex. Empty and short texts lose nothing. A row without doc_id
    takes no part and is kept whole. doc_id must be unique: rows that share one are judged as if each had all of
    its windows removed that the other holds. `least` must be at least 28 and at most 255 more than the anchor.
    """
    if not 28 <= least < 255 + ANCHOR:
        raise ValueError("least must be from 28 to 274")
    buckets = tasks(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    occurring = docs.where("doc_id is not null").mapInArrow(tidy(_occurrences(least, buckets)), BLOB)
    found = written(dealt(occurring, buckets).mapInArrow(tidy(_compared(buckets, least)), BLOB))
    texts = docs.mapInArrow(tidy(_packed(buckets)), _MOVED)
    wanted = _together(texts.where("doc_id is not null"), found.where(F.col("kind").isin(ASKED, CROWD)), buckets)
    segments = wanted.mapInArrow(tidy(_cut_out(least, buckets)), BLOB)
    more = dealt(segments, buckets).mapInArrow(tidy(_expanded(least, buckets)), BLOB)
    runs = found.where(F.col("kind") == REMOVED).unionByName(more)
    return _together(texts, runs, buckets).mapInArrow(tidy(_removed(least, digest)), RESULT)


def without_repeats(docs: DataFrame, least: int = 100) -> DataFrame:
    """docs with the repeated bytes taken out of text; columns as they were, n_chars (if there) counted anew.

    A cut can split a character of several bytes: such broken bytes at the edge of a cut are dropped with it. A
    document of which nothing is left stays, with an empty text; null and empty texts stay as they are, and so do rows
    without doc_id. Rows that share a doc_id are judged as repeated_spans does; each keeps its row. Other columns pass
    through, whatever their names. An empty table gives an empty result.
    """
    out = repeated_spans(docs, least).mapInArrow(_decoded, "id long, left string, changed boolean")
    out = out.where("id is not null and changed")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    if docs.schema["doc_id"].dataType.simpleString() != "bigint" or "text" not in docs.columns:
        raise ValueError("docs must have a long doc_id and a text")
    both = rows.join(out, F.col("key") == F.col("id"), "left")
    changed, field = F.col("id").isNotNull(), lambda c: F.col("row").getField(c)
    new = {"text": F.when(changed, F.col("left")).otherwise(field("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("left")).otherwise(field("n_chars")).cast(docs.schema["n_chars"].dataType)
    return both.select(*(new.get(c, field(c)).alias(c) for c in docs.columns)).unionByName(docs.where("doc_id is null"))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left = [x.decode("utf-8", "ignore") for x in batch.column(4).to_pylist()]
        changed = [bool(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string()), pa.array(changed, pa.bool_())], ["id", "left", "changed"])
