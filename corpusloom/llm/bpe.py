"""Byte-level BPE encoding and decoding.

Texts become arrays of code-point classes; a scan over the transition functions of a small automaton (their
composition is associative and closed over a few dozen functions) gives the state before every character at once, and
with it the pre-token boundaries, without a regular expression. The slices feed a cache of pair merges. Token ids,
byte offsets and the vocabulary's bytes in one array make decoding a gather.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .work import tidy

END, LETTER, NUMBER, BLANK, WHITE, OTHER, SHORT, LONG = range(8)
#: States: nothing open, in letters, in numbers, in other signs, after a blank, after other white space, in a
#: contraction with one or two letters to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, AFTER_WHITE, ONE_MORE, TWO_MORE = range(8)
#: White space of the pattern.
_WHITE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _automaton() -> np.ndarray:
    """Next state for each (class, state)."""
    to = np.empty((8, 8), dtype=np.uint8)
    for c, s in ((END, FRESH), (LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (BLANK, AFTER_BLANK), (WHITE, AFTER_WHITE), (OTHER, IN_OTHER), (SHORT, ONE_MORE), (LONG, TWO_MORE)):
        to[c] = s
    to[LETTER, [ONE_MORE, TWO_MORE]] = FRESH, ONE_MORE
    for c in (SHORT, LONG):  # an apostrophe that other signs or a blank take along opens no contraction
        to[c, [IN_OTHER, AFTER_BLANK]] = IN_OTHER
    return to


def _monoid(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions that compositions of transitions reach: their composition table, which are constant, and values."""
    found = {tuple(f): i for i, f in enumerate(dict.fromkeys(map(tuple, to.tolist())))}
    of_class = np.array([found[tuple(f)] for f in to.tolist()], dtype=np.uint8)
    todo = list(found)
    gens = list(found)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    every = list(found)
    assert len(every) < 256
    table = np.array([[found[tuple(g[x] for x in f)] for g in every] for f in every], dtype=np.uint8)
    return of_class, table, np.array(every, dtype=np.uint8)


_OF_CLASS, _COMPOSE, _FUNCTIONS = _monoid(_automaton())
_CONSTANT = (_FUNCTIONS == _FUNCTIONS[:, :1]).all(axis=1)


def _opens() -> np.ndarray:
    """Whether a character that isn't white space opens a token, for each (class, state before)."""
    yes = np.ones((8, 8), dtype=bool)
    yes[[END, BLANK, WHITE]] = False
    yes[LETTER, [IN_LETTERS, AFTER_BLANK, ONE_MORE, TWO_MORE]] = False
    yes[NUMBER, [IN_NUMBERS, AFTER_BLANK]] = False
    for c in (OTHER, SHORT, LONG):
        yes[c, [IN_OTHER, AFTER_BLANK]] = False
    return yes


_OPENS = _opens()
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)
        table[_WHITE] = WHITE
        table[0x20] = BLANK
        _classes.append(table)
    return _classes[0]


def scan(kind: np.ndarray) -> np.ndarray:
    """The automaton's state before each character, by an associative scan of transition functions."""
    f = _OF_CLASS[kind]
    flat, wide = _COMPOSE.ravel(), np.uint16(len(_COMPOSE))
    step = 1
    while step < len(f) and not _CONSTANT[f].all():
        f = np.concatenate((f[:step], flat[f[:-step] * wide + f[step:]]))
        step *= 2
    state = np.empty(len(f), dtype=np.uint8)
    state[0] = FRESH
    state[1:] = _FUNCTIONS[f[:-1], FRESH]
    return state


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, start and end of every pre-token in them, and the number of each text's first pre-token."""
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    kind = classes()[code]
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind[stops] = END
    mark = np.flatnonzero(code[:-1] == 0x27)
    if len(mark):
        a = code[np.minimum(mark + 1, len(code) - 1)]
        b = code[np.minimum(mark + 2, len(code) - 1)]
        inside = kind[np.minimum(mark + 1, len(code) - 1)] == LETTER
        kind[mark[inside & np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        two &= inside & (kind[np.minimum(mark + 2, len(code) - 1)] == LETTER)
        kind[mark[two]] = LONG
    state = scan(kind)
    start = _OPENS[kind, state]
    white = (kind == BLANK) | (kind == WHITE)
    after = np.concatenate((kind[1:], [END]))
    last = (after != END) & (after != BLANK) & (after != WHITE)
    start |= white & (((state != AFTER_BLANK) & (state != AFTER_WHITE)) | last)
    begin = np.flatnonzero(start)
    ends = np.concatenate((begin[1:], [len(code)]))
    ends = np.minimum(ends, stops[np.searchsorted(stops, begin)])
    return joined, begin, ends, np.searchsorted(begin, np.concatenate(([0], stops + 1)))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is merged, leftmost first, while there is one."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > 48:
        return _merged_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    far = 1 << 60
    pair = [ranks.get(a + b, far) for a, b in zip(parts, parts[1:])]
    while pair:
        low = min(pair)
        if low == far:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], far)
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], far)
    return [ranks[p] for p in parts]


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n steps: a queue of pairs over a linked list."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = after[i] if end[i] else n
        if not end[i] or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(queue, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(queue, (r, before[i], stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]


#: Pre-tokens of more characters aren't kept.
KEPT_CHARS = 64


class Codec:
    """Ranks, the bytes of every id in one array, and a cache of merged pre-tokens that is emptied at about `most` bytes."""

    def __init__(self, ranks_file: bytes, most: int = 32 << 20):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for word, i in self.ranks.items():
            words[i] = word
        self.bytes = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        self.most = most
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.first = array("I"), array("q", [0])
        self.size = 0

    def _learn(self, piece: str) -> int:
        ids = merged(piece.encode(), self.ranks)
        self.ids.extend(ids)
        self.first.append(len(self.ids))
        if len(piece) <= KEPT_CHARS:  # longer ones hardly occur again
            self.known[piece] = len(self.first) - 2
            self.size += 2 * len(piece) + 150
        self.size += 4 * len(ids) + 8
        return len(self.first) - 2

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin (one more than texts)."""
        joined, begin, end, first = boundaries(texts)
        if self.size > self.most:
            self._empty()
        pieces = [joined[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        known, learn = self.known.get, self._learn
        which = np.array([i if (i := known(p)) is not None else learn(p) for p in pieces], dtype=np.int64)
        # views of the cache, which end before it grows again
        at, every = np.frombuffer(self.first, dtype=np.int64), np.frombuffer(self.ids, dtype=np.uint32)
        n = at[which + 1] - at[which]
        total = np.concatenate(([0], np.cumsum(n)))
        out = every[np.repeat(at[which] - total[:-1], n) + np.arange(total[-1])]
        del at, every
        return out, total[first]

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of each id."""
        return self.at[ids.astype(np.int64) + 1] - self.at[ids]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        n = self.sizes(ids)
        total = np.concatenate(([0], np.cumsum(n)))
        return self.bytes[np.repeat(self.at[ids] - total[:-1], n) + np.arange(total[-1])].tobytes()


_codecs: dict[bytes, Codec] = {}


def codec(ranks_file: bytes) -> Codec:
    """One codec for each vocabulary in a worker."""
    key = hashlib.sha256(ranks_file).digest()
    if key not in _codecs:
        _codecs[key] = Codec(ranks_file)
    return _codecs[key]


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64()))])


def _runs(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    size = at = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            size, at = 0, i + 1
    if at < len(texts):
        yield at, len(texts)


def _encoding(shared):
    """From (doc_id, text) to (doc_id, ids, byte offset of each token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _runs(texts):
                ids, first = tool.encode(texts[a:b])
                place = np.concatenate(([0], np.cumsum(tool.sizes(ids))))
                offsets = place[:-1] - np.repeat(place[first[:-1]], np.diff(first))
                edge = pa.array(first, pa.int32())
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(edge, pa.array(ids.view(np.int32))), pa.ListArray.from_arrays(edge, pa.array(offsets, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema=ENCODED)

    return run


def _digesting(shared):
    """From encoded rows to their digests and those of the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared.value)
        for batch in batches:
            lists = batch.column(1)
            first = lists.offsets.to_numpy()
            ids = lists.values.to_numpy()
            raw, place = tool.decode(ids), np.concatenate(([0], np.cumsum(tool.sizes(ids))))
            rows = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                rows.append((b - a, hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest(), hashlib.sha256(raw[place[a] : place[b]]).hexdigest()))
            n, x, y = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _shared(docs: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids and offsets (the byte at which each token starts) of every whole text.

    docs has doc_id and text; other columns are ignored. Null and empty texts have no tokens. Rows are handled one by
    one, repeated ones too. The vocabulary (a file of base64 tokens and ranks on the driver, a few MB at most) is
    broadcast; the cache of merges in a worker grows to about 32 MB and then starts anew.
    """
    return _texts(docs).mapInArrow(tidy(_encoding(_shared(docs, ranks_path))), "doc_id long, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and text of encoded documents; null ids give null."""
    shared = _shared(encoded, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared.value)
        for batch in batches:
            texts = [None if x is None else tool.decode(np.array(x, dtype=np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Encodes and decodes every text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    shared = _shared(docs, ranks_path)
    first, then = _encoding(shared), _digesting(shared)
    return _texts(docs).mapInArrow(tidy(lambda batches: then(first(batches))), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
