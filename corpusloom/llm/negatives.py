"""Hard negatives from candidate blocks along a Hilbert curve, chosen by zone maps.

Vectors are written as Parquet blocks in the order of their label and their place on a Hilbert curve. A block's zone map
holds the least and the greatest value of each dimension and of the label; a page of zone maps holds those of many
blocks, and is a zone of its own. Interval arithmetic on them bounds the inner products of an anchor with all rows of a
block from both sides: a block is read for an anchor only where these bounds meet one of the anchor's windows of scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import partitions, release, written

#: Rows of a block, blocks of a page of zone maps at least, anchors that meet a block at once, bytes of broadcast zones.
BLOCK, PAGE, TILE, ZONE_BYTES = 1 << 10, 1 << 6, 1 << 9, 1 << 25
#: Components of this size (after scaling by 256) and more would give scores near the end of 64 bits.
LIMIT = 1 << 22
#: Pages, and blocks in each, that are looked at first for a lower bound of the scores.
FIRST = 2
_FAR = 1 << 62

_Batches = Iterator[pa.RecordBatch]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label (changed where vec_id is divisible by 7), d (length) and v (integers) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x")).where("vec_id IS NOT NULL AND label IS NOT NULL AND size(x) > 0")
    rows = rows.where(F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT // 256)), F.lit(False)))
    rows = rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(256 * c).cast("int")).alias("v")).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("r.label") + 1) % 10).otherwise(F.col("r.label"))
    return rows.select("vec_id", label.alias("label"), F.size("r.v").alias("d"), F.col("r.v").alias("v"))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of cells (whole numbers under 2**bits, a column for each dimension) on a Hilbert curve, as bytes that sort.

    Skilling's transformation, on all rows at once.
    """
    x = np.ascontiguousarray(cells.T)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            x[0][flip] ^= q - 1
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    last, q = np.zeros_like(x[-1]), 1 << (bits - 1)
    while q > 1:
        last ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= last
    planes = np.concatenate([(x >> b) & 1 for b in range(bits - 1, -1, -1)])
    return np.packbits(planes.T.astype(np.uint8), axis=1)


def _matrix(values: pa.Array, d: int) -> np.ndarray:
    """Packed rows of d integers."""
    return np.frombuffer(b"".join(values.to_pylist()), dtype=np.int32).reshape(-1, d)


def _by_length(batches: _Batches) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of each length d, with v as a matrix."""
    for batch in batches:
        ds = batch.column("d").to_numpy()
        for d in np.unique(ds).tolist():
            own = batch.filter(pa.array(ds == d))
            yield d, own, own.column("v").flatten().to_numpy().reshape(-1, d)


def _ranges(batches: _Batches) -> _Batches:
    found: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
    for d, _, v in _by_length(batches):
        low, high, n = found.get(d, (v[0], v[0], 0))
        found[d] = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0)), n + len(v)
    for d, (low, high, n) in found.items():
        yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "low": pa.array(low, pa.int32()), "high": pa.array(high, pa.int32()), "n": pa.array([n] * d, pa.int64())})


def _keyed(ranges: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable[[_Batches], _Batches]:
    """Packs each vector and adds its place on the curve, wide dimensions first."""

    def run(batches: _Batches) -> _Batches:
        for d, batch, v in _by_length(batches):
            low, high = ranges[d]
            bits = max(2, min(16, 64 // d))
            wide = np.maximum(1, high.astype(np.int64) - low + 1)
            cells = ((v.astype(np.int64) - low) << bits) // wide
            key = hilbert(cells[:, np.argsort(-wide, kind="stable")], bits)
            pack = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("label"), pack(key), batch.column("vec_id"), pack(v)], ["d", "label", "key", "vec_id", "v"])

    return run


_BLOCKS = "block long, page long, d int, first long, last long, low binary, high binary, ids binary, labels binary, vectors binary"


def _blocks(fan: int) -> Callable[[_Batches], _Batches]:
    """Cuts sorted rows into blocks, and numbers these and the pages of fan blocks."""

    def run(batches: _Batches) -> _Batches:
        part = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        block, page, in_page, before = part, part, 0, None

        def out(d: int) -> pa.RecordBatch:
            nonlocal block, page, in_page, before
            if d != before or in_page == fan:
                page, in_page, before = block, 0, d
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            labels, v = rows.column("label").to_numpy(), _matrix(rows.column("v"), d)
            one = [block, page, d, int(labels.min()), int(labels.max()), v.min(axis=0).tobytes(), v.max(axis=0).tobytes(), rows.column("vec_id").to_numpy().tobytes(), labels.tobytes(), v.tobytes()]
            block, in_page = block + 1, in_page + 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if i == 2 else pa.int64() if i < 5 else pa.binary()) for i, x in enumerate(one)], [c.split()[0] for c in _BLOCKS.split(", ")])

        now, size = -1, 0
        try:
            for batch in batches:
                ds = batch.column("d").to_numpy()
                at = 0
                while at < len(ds):
                    if ds[at] != now and size:
                        yield out(now)
                        size = 0
                    now = int(ds[at])
                    upto = min(at + BLOCK - size, int(np.searchsorted(ds, now, side="right")))
                    held.append(batch.slice(at, upto - at))
                    size, at = size + upto - at, upto
                    if size == BLOCK:
                        yield out(now)
                        size = 0
            if size:
                yield out(now)
        finally:
            release()

    return run


def _page(blocks: pd.DataFrame) -> pd.DataFrame:
    """The zone maps of a page's blocks in one row, and what holds for all of them."""
    blocks = blocks.sort_values("block")
    low, high = (np.frombuffer(b"".join(blocks[c]), dtype=np.int32).reshape(len(blocks), -1) for c in ("low", "high"))
    packed = [blocks[c].to_numpy(dtype=np.int64).tobytes() for c in ("block", "first", "last")]
    one = [blocks["page"].iloc[0], blocks["d"].iloc[0], blocks["first"].min(), blocks["last"].max(), low.min(axis=0).tobytes(), high.max(axis=0).tobytes(), *packed, low.tobytes(), high.tobytes()]
    return pd.DataFrame([one], columns=["page", "d", "first", "last", "low", "high", "blocks", "firsts", "lasts", "lows", "highs"])


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest inner product of each anchor with any vector of each zone, a little wider for rounding."""
    up, down = np.maximum(anchors, 0).astype(np.float64), np.minimum(anchors, 0).astype(np.float64)
    low, high = low.astype(np.float64), high.astype(np.float64)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    return least - 1 - 1e-9 * np.abs(least), most + 1 + 1e-9 * np.abs(most)


def _chosen(anchors: list[dict], d: int, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, few: bool) -> np.ndarray:
    """Which zones (columns) each anchor (rows) must look at; the FIRST best of them if few."""
    v = np.frombuffer(b"".join(a["v"] for a in anchors), dtype=np.int32).reshape(-1, d)
    least, most = bounds(v, low, high)
    label = np.array([a["label"] for a in anchors])[:, None]
    meets = np.zeros(most.shape, dtype=bool)
    for i, a in enumerate(anchors):
        for begin, end in zip(a["lows"], a["highs"]):
            meets[i] |= (most[i] >= begin) & (least[i] <= end)
    meets &= (first <= label) & (label <= last) if same else (first != label) | (last != label)
    if few:
        order = np.argsort(np.where(meets, -most, np.inf), axis=1)[:, :FIRST]
        best = np.zeros_like(meets)
        np.put_along_axis(best, order, True, axis=1)
        meets &= best
    return meets


_ANCHOR = "anchor_id long, label long, d int, v binary, lows array<long>, highs array<long>"


def _to_pages(zones: Broadcast, same: bool, few: bool) -> Callable[[_Batches], _Batches]:
    def run(batches: _Batches) -> _Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                rows = batch.slice(at, TILE)
                for d in rows.column("d").unique().to_pylist():
                    own = rows.filter(pa.array(rows.column("d").to_numpy() == d))
                    page, *zone = zones.value[d]
                    i, j = np.nonzero(_chosen(own.to_pylist(), d, *zone, same, few))
                    if len(i):
                        taken = own.take(pa.array(i))
                        yield pa.RecordBatch.from_arrays([pa.array(page[j]), *taken.columns], ["page", *own.schema.names])

    return run


def _to_blocks(same: bool, few: bool) -> Callable[[_Batches], _Batches]:
    """From rows of anchors with a page's zone maps, those of its blocks with the anchors that must look at them."""

    def run(batches: _Batches) -> _Batches:
        for batch in batches:
            kind = batch.schema.field("anchors").type
            for row in range(batch.num_rows):
                d = batch.column("d")[row].as_py()
                blocks, first, last = (np.frombuffer(batch.column(c)[row].as_py(), dtype=np.int64) for c in ("blocks", "firsts", "lasts"))
                low, high = (np.frombuffer(batch.column(c)[row].as_py(), dtype=np.int32).reshape(-1, d) for c in ("lows", "highs"))
                anchors = batch.column("anchors")[row].values
                meets = _chosen(anchors.to_pylist(), d, first, last, low, high, same, few)
                use = np.flatnonzero(meets.any(axis=0))
                if len(use):
                    lists = [anchors.take(pa.array(np.flatnonzero(meets[:, j]))) for j in use]
                    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(blocks[use]), pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(lists)).cast(kind)], ["block", "anchors"])

    return run


def products(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products: through doubles where no sum can leave their whole numbers."""
    top = int(np.abs(anchors).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(1, anchors.shape[1])
    if top < 1 << 53:
        return (anchors.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return anchors.astype(np.int64) @ vectors.astype(np.int64).T


def _scored(same: bool, most: int) -> Callable[[_Batches], _Batches]:
    """The first `most` rows of a block in each window of its anchors."""

    def run(batches: _Batches) -> _Batches:
        try:
            for batch in batches:
                for row in range(batch.num_rows):
                    d = batch.column("d")[row].as_py()
                    ids, labels = (np.frombuffer(batch.column(c)[row].as_py(), dtype=np.int64) for c in ("ids", "labels"))
                    anchors = batch.column("anchors")[row].as_py()
                    v = np.frombuffer(b"".join(a["v"] for a in anchors), dtype=np.int32).reshape(-1, d)
                    score = products(v, np.frombuffer(batch.column("vectors")[row].as_py(), dtype=np.int32).reshape(-1, d))
                    found: list[tuple[np.ndarray, ...]] = []
                    for a, s in zip(anchors, score):
                        of_kind = (labels == a["label"]) & (ids != a["anchor_id"]) if same else labels != a["label"]
                        may = np.flatnonzero(of_kind & (s >= min(a["lows"])) & (s <= max(a["highs"])))
                        may = may[np.lexsort((ids[may], -s[may]))]
                        falling = -s[may]
                        for w, (low, high) in enumerate(zip(a["lows"], a["highs"])):
                            begin = np.searchsorted(falling, -high)
                            best = may[begin : min(begin + most, np.searchsorted(falling, -low, side="right"))]
                            found.append((np.full(len(best), a["anchor_id"]), np.full(len(best), w), ids[best], s[best]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], ["anchor_id", "w", "vec_id", "score"])
        finally:
            release()

    return run


class Blocks:
    """The written blocks of a table's usable rows, with their zone maps; the anchors among them."""

    def __init__(self, vectors: DataFrame, every: int):
        spark = vectors.sparkSession
        rows = written(usable(vectors))
        ranges = rows.select("d", "v").mapInArrow(_ranges, "d int, i int, low int, high int, n long").groupBy("d", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        found: dict[int, list] = {}
        for r in sorted(ranges.collect()):
            found.setdefault(r.d, []).append(r)
        wide = {d: (np.array([r.low for r in x]), np.array([r.high for r in x])) for d, x in found.items()}
        n = sum(x[0].n for x in found.values())
        # so many blocks to a page that all pages' zones stay under ZONE_BYTES
        fan = max(PAGE, -(-n * 8 * max(found, default=1) // (BLOCK * ZONE_BYTES)))
        keyed = rows.mapInArrow(_keyed(wide), "d int, label long, key binary, vec_id long, v binary")
        order = ["d", "label", "key", "vec_id"]
        self.blocks = written(keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_blocks(fan), _BLOCKS))
        pages = self.blocks.select("page", "block", "d", "first", "last", "low", "high").groupBy("page")
        self.pages = written(pages.applyInPandas(_page, "page long, d int, first long, last long, low binary, high binary, blocks binary, firsts binary, lasts binary, lows binary, highs binary"))
        top = self.pages.select("page", "d", "first", "last", "low", "high").toArrow()
        zones = {}
        for d in found:
            own = top.filter(pa.array(top["d"].to_numpy() == d)).combine_chunks()
            if own.num_rows:
                zones[d] = (*(own[c].to_numpy() for c in ("page", "first", "last")), *(_matrix(own[c].combine_chunks(), d) for c in ("low", "high")))
        self.zones = spark.sparkContext.broadcast(zones)
        self.tiles = max(1, -(-n // (every * TILE)))

    def anchors(self, every: int, most: int) -> DataFrame:
        """Rows whose vec_id is divisible by `every`, with the window in which their first `most` of the same label lie, by their own block."""

        def run(batches: _Batches) -> _Batches:
            for batch in batches:
                for r in batch.to_pylist():
                    ids, labels = (np.frombuffer(r[c], dtype=np.int64) for c in ("ids", "labels"))
                    v = np.frombuffer(r["vectors"], dtype=np.int32).reshape(-1, r["d"])
                    at = np.flatnonzero(ids % every == 0)
                    out = []
                    for i, s in zip(at, products(v[at], v)):
                        others = s[(labels == labels[i]) & (ids != ids[i])]
                        out.append(int(np.partition(others, len(others) - most)[len(others) - most]) if len(others) >= most else -_FAR)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(labels[at]), pa.array([r["d"]] * len(at), pa.int32()), pa.array([v[i].tobytes() for i in at], pa.binary()), pa.array([[x] for x in out], pa.list_(pa.int64())), pa.array([[_FAR]] * len(at), pa.list_(pa.int64()))], [c.split()[0] for c in _ANCHOR.split(", ")])

        return self.blocks.select("d", "ids", "labels", "vectors").mapInArrow(run, _ANCHOR)

    def first(self, anchors: DataFrame, most: int, same: bool, few: bool = False) -> DataFrame:
        """anchor_id, w, place, vec_id, score: the first `most` rows in each window of scores, of the anchor's label or of others.

        With few, only of some blocks whose bounds are highest: what they give are lower bounds.
        """
        tile = F.pmod(F.xxhash64("anchor_id"), F.lit(self.tiles)).alias("tile")
        paged = anchors.mapInArrow(_to_pages(self.zones, same, few), f"page long, {_ANCHOR}").groupBy("page", tile).agg(F.collect_list(F.struct("anchor_id", "label", "v", "lows", "highs")).alias("anchors"))
        asked = paged.join(self.pages.drop("first", "last", "low", "high"), "page").select("d", "blocks", "firsts", "lasts", "lows", "highs", "anchors")
        kind = asked.schema["anchors"].dataType.simpleString()
        blocks = asked.mapInArrow(_to_blocks(same, few), f"block long, anchors {kind}")
        read = blocks.join(self.blocks.select("block", "d", "ids", "labels", "vectors"), "block")
        found = read.select("d", "ids", "labels", "vectors", "anchors").mapInArrow(_scored(same, most), "anchor_id long, w long, vec_id long, score long")
        place = F.row_number().over(W.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("place", place).where(F.col("place") <= most)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors has vec_id, embedding and label; other columns are ignored. Components count as floor(256 * x), scores are
    integer inner products, higher ones first, ties to the smaller vec_id. Anchors are the rows whose vec_id is divisible
    by `every`, an anchor's positives the first `positives` other rows of its label, and its negatives for one of them
    the first `negatives` rows of other labels with 30 * positive_score <= 100 * negative_score <= 90 * positive_score.

    Rows with a null vec_id, label, vector or component, or one that is not finite, take no part, nor do empty vectors
    and those with a component of 16384 or more in size, whose scores could leave 64 bits. Rows that share a vec_id count
    as one, the smallest by label and vector; before that, label becomes (label + 1) % 10 in none of them, after it where
    vec_id is divisible by 7. Only vectors of the anchor's length are compared. An empty table gives an empty result.
    """
    index = Blocks(vectors, every)
    anchors = written(index.anchors(every, positives))
    best = written(index.first(anchors, positives, same=True).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place"))
    best = best.withColumn("low", F.expr("(3 * positive_score + 9) div 10")).withColumn("high", F.expr("(9 * positive_score) div 10")).where("positive_score >= 0")
    listed = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score", "low", "high"))).alias("p"))
    column = lambda c: F.transform("p", lambda x: x[c])
    wanted = written(anchors.drop("lows", "highs").join(listed, "anchor_id").select("anchor_id", "label", "d", "v", column("low").alias("lows"), column("high").alias("highs"), column("positive_id").alias("ids"), column("positive_score").alias("scores")))
    asked = wanted.drop("ids", "scores")
    # the scores that the most promising blocks give already raise the lower ends of the windows
    some = index.first(asked, negatives, same=False, few=True).where(F.col("place") == negatives).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("have"))
    raised = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("have", i.cast("long")), x)))
    asked = written(asked.join(some, "anchor_id", "left").withColumn("lows", raised).drop("have"))
    found = index.first(asked, negatives, same=False)
    at = lambda c: F.get(c, F.col("w").cast("int"))
    return found.join(wanted.select("anchor_id", "ids", "scores"), "anchor_id").select("anchor_id", at("ids").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), at("scores").alias("positive_score"), F.col("score").alias("negative_score"))
