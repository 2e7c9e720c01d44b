"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct shingles of WIDTH words (fewer words: the whole sequence; none: empty). Signatures use
two permutations of the 32-bit numbers: one shuffles the shingles' hashes, the other, shifted circularly by k, gives
coordinate k. Documents with equal sets become one class. Classes that share a band meet in its bucket.

No bucket emits all its pairs. In the buckets of the first bands the smallest member is tested against every other;
members that this links are one component. Only where a bucket still holds several components are further pairs tested:
the next pivot is the smallest member outside the first component, and in buckets of more than LARGE each member is also
tested against its next few in a drawn order; then those pairs that still cross components and that the shingles which
only one of these sets has do not rule out. The order drops no pair: it joins most of a large group of near copies by a
few links a member, so that few pairs of it are left to cross.
Every test is preceded by exact bounds on the sizes and on the symmetric difference, and by the count of equal
coordinates, from which SIGMAS standard deviations are allowed below the threshold. Bands and rows follow from the
threshold: a pair at it shares no band with a probability of MISS at most (independent coordinates). The symmetric
difference has at least one shingle in each of CELLS cells where the parities of two sets differ; for short texts this
is nearly its size. Members of a large bucket meet in blocks of BLOCK, spread over tasks.

Defined results: null and empty texts have no shingles, link with nothing and stay; repeated rows are one class; of a
component the smallest doc_id stays (every row that carries it); rows with a null doc_id take no part and are returned
with a null component and kept; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WIDTH = 5
#: The fewest bands, the most rows of a band and, with two rows or more, the most coordinates.
BANDS, ROWS, COORDINATES = 16, 4, 128
MISS, SIGMAS = 3e-4, 5.84
#: Members of a bucket that one task compares with others of it at a time.
BLOCK = 1000
#: Cells of a set's parities, 64 to a long; a power of two.
CELLS = 1024
#: Bands whose buckets are tested against their smallest member first; most others then hold one component already.
FIRST_BANDS = 4
#: Buckets of more than LARGE members are cut into rings of RING or so, each with an order, in which a member is tested
#: against the NEXT after it.
LARGE, RING, NEXT = 8, 100, 4
#: Ids that may be broadcast to fetch texts (a few MB); beyond it, ids and texts meet by a shuffle.
BROADCAST_IDS = 200_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _permute32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of the 32-bit numbers: shifts and odd multipliers undo each other."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(a)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(b)
    return x ^ (x >> np.uint32(16))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles. bytes.lower() changes A-Z alone, and split() cuts at
    the six blanks alone."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    n = len(h)
    k = min(n, width)
    m = _MULTIPLIERS if width <= len(_MULTIPLIERS) else _mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    s = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        s += _mix64(h[j : j + n - k + 1] * m[j])
    return np.unique(_mix64(s))


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows) for a threshold: as many rows as the coordinates allow."""
    if not 1 <= percent <= 100:
        raise ValueError("the threshold is 1 to 100 per cent")
    for rows in range(ROWS, 0, -1):
        hit = (percent / 100) ** rows
        bands = max(BANDS, math.ceil(math.log(MISS) / math.log1p(-hit))) if hit < 1 else BANDS
        if bands * rows <= COORDINATES or rows == 1:
            return bands, rows


def signature(sh: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k is the least of the second permutation, shifted by k, over the shuffled shingles."""
    x = _permute32((sh >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    for i in range(0, len(x), 4096):
        np.minimum(out, _permute32(x[None, i : i + 4096] + shift, 0x85EBCA6B, 0xC2B2AE35).min(axis=1), out=out)
    return out


def parities(sh: np.ndarray) -> np.ndarray:
    """A bit for each cell: whether an odd number of the shingles falls into it."""
    odd = np.bincount((sh & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(n_a: Column, bits_a: Column, n_b: Column, bits_b: Column, percent: int) -> Column:
    """False only for pairs below the threshold: of d shingles in one set alone, shared is (n_a + n_b - d) / 2 and
    union (n_a + n_b + d) / 2, and d is at least the number of cells whose parities differ."""
    apart = sum((F.bit_count(F.get(bits_a, F.lit(i)).bitwiseXOR(F.get(bits_b, F.lit(i)))) for i in range(CELLS // 64)), F.lit(0))
    return apart * (100 + percent) <= (n_a + n_b) * (100 - percent)


def _sketch(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for b in common.tables(batches):
            n, keys, sigs, buckets, bits = [], [], [], [], []
            for text in common.as_bytes(b.column(1)):
                sh = shingles(text, width)
                n.append(len(sh))
                if not len(sh):
                    keys.append(None)
                    sigs.append(None)
                    buckets.append(None)
                    bits.append(None)
                    continue
                bits.append(parities(sh))
                keys.append(xxhash.xxh3_128_digest(sh.tobytes()))
                sig = signature(sh, bands * rows)
                sigs.append((sig & np.uint32(0xFFFF)).astype("<u2").tobytes())
                cut = sig.reshape(bands, rows)
                buckets.append([xxhash.xxh3_64_intdigest(cut[i].tobytes(), seed=i) - (1 << 63) for i in range(bands)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "sig", "buckets", "bits"])

    return run


def _alike(least: float):
    """Pairs whose share of equal coordinates is least or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for b in batches:
            t = pa.Table.from_batches([b])
            keep = []
            for x, y in zip(t["sig_a"].to_pylist(), t["sig_b"].to_pylist(), strict=True):
                keep.append(int((np.frombuffer(x, "<u2") == np.frombuffer(y, "<u2")).sum()) >= least * (len(x) // 2))
            yield t.filter(pa.array(keep, pa.bool_())).select(["a", "b"]).combine_chunks().to_batches()[0] if any(keep) else pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    return run


def _verify(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        last: dict[str, tuple[int | None, np.ndarray]] = {"a": (None, None), "b": (None, None)}
        for b in common.tables(batches):
            cols = {k: b.column(i) for i, k in enumerate(("a", "b", "text_a", "text_b"))}
            shared, union = [], []
            ids = {k: cols[k].to_pylist() for k in ("a", "b")}
            texts = {k: common.as_bytes(cols[f"text_{k}"]) for k in ("a", "b")}
            for i in range(b.num_rows):
                for k in ("a", "b"):
                    if last[k][0] != ids[k][i]:
                        last[k] = (ids[k][i], shingles(texts[k][i], width))
                x, y = last["a"][1], last["b"][1]
                both = np.concatenate((x, y))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                shared.append(same)
                union.append(len(both) - same)
            yield pa.RecordBatch.from_arrays([cols["a"], cols["b"], pa.array(shared, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "shared", "union"])

    return run


def _explode(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for b in common.tables(batches, 1 << 20):
            sets = [shingles(t, width) for t in common.as_bytes(b.column(1))]
            ids = np.repeat(np.array(b.column(0).to_pylist(), np.int64), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets).view(np.int64) if sets else ids)], ["id", "shingle"])

    return run


@common.narrow
def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_confirmed): links hold if 100 * shared >= percent * union. n_confirmed
    counts the links of the document's class that were tested; links inside a component that is known need no test."""
    spark = docs.sparkSession
    common.arrow_rows(spark)
    bands, rows = bands_for(percent)
    t = percent / 100
    least_equal = max(0.0, t - SIGMAS * (t * (1 - t) / (bands * rows)) ** 0.5)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    all_rows = common.stored(texts.mapInArrow(_sketch(width, bands, rows), "doc_id long, n_shingles long, set_key binary, sig binary, buckets array<long>, bits array<long>"), "sketch")
    known = all_rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    total = known.count()
    first = F.min(F.struct("doc_id", "n_shingles", "sig", "buckets", "bits")).alias("m")
    classes = common.stored(known.groupBy("set_key").agg(first, F.count("*").alias("copies")).select("set_key", "copies", F.col("m.doc_id").alias("id"), F.col("m.n_shingles").alias("n"), F.col("m.sig").alias("sig"), F.col("m.buckets").alias("buckets"), F.col("m.bits").alias("bits")), "classes")
    narrow = classes.select("id", "n", "sig", "bits")
    members = classes.select("id", F.posexplode("buckets").alias("band", "bucket"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The (a, b) that are links, of the pairs."""
        for side in ("a", "b"):
            pairs = pairs.join(narrow.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"), F.col("bits").alias(f"bits_{side}")), side)
        pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        pairs = pairs.where(may_link(F.col("n_a"), F.col("bits_a"), F.col("n_b"), F.col("bits_b"), percent)).select("a", "b", "sig_a", "sig_b")
        pairs = common.stored(pairs.mapInArrow(_alike(least_equal), "a long, b long"), "pairs")
        ends = common.stored(pairs.select(F.col("a").alias("doc_id")).distinct().union(pairs.select("b").distinct()).distinct(), "ends")
        few = ends.count() <= BROADCAST_IDS
        needed = common.stored(texts.join(F.broadcast(ends) if few else ends, "doc_id", "left_semi"), "texts")
        wide = pairs.join(needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        wide = wide.join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        out = common.stored(wide.select("a", "b", "text_a", "text_b").mapInArrow(_verify(width), "a long, b long, shared long, union long").where(F.col("shared") * 100 >= F.col("union") * percent).select("a", "b"), "links")
        common.dropped(needed)
        return out

    def own_shingles(ids: DataFrame) -> DataFrame:
        """(id, n, bits, own): the shingles of each set, and how many of them no other of these sets has. Of two sets the
        intersection has no own shingle and the union has all, which bounds their similarity from above."""
        ids = common.stored(ids, "ids")
        few = ids.count() <= BROADCAST_IDS
        some = texts.join((F.broadcast(ids) if few else ids).withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        each = some.mapInArrow(_explode(width), "id long, shingle long")
        own = each.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("top")).where("id = top").groupBy("id").agg(F.count("*").alias("own"))
        return common.stored(narrow.join(ids, "id", "left_semi").join(own, "id", "left").select("id", "n", "bits", F.coalesce("own", F.lit(0)).alias("own")), "own")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()

    begin = members.where(F.col("band") < FIRST_BANDS).select("id", "bucket")
    members = members.select("id", "bucket")
    pivots = common.stored(begin.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("k")).where("k > 1"), "pivots")
    done = common.stored(ordered(common.with_group_winner(begin, pivots, "bucket", "k", begin.count()).where("id <> a")), "done")
    links = linked(done)
    labels = common.components(links)
    for last in (False, True):
        named = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        mixed = common.stored(named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k")).where("lo < hi").select("bucket", "lo", "k"), "mixed")
        if mixed.isEmpty():
            break
        named = common.stored(common.with_group_winner(named, mixed, "bucket", "k", members.count()), "named")
        if last:
            named = named.join(own_shingles(named.select("id").distinct()), "id")
            blocks = F.ceil(F.col("k") / BLOCK).cast("int")
            named = common.stored(named.withColumn("blocks", blocks).withColumn("block", F.pmod(F.hash("id"), F.col("blocks"))), "named")
            every = named.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))  # each member meets each block of its bucket
            other = every.select("bucket", "block", F.col("id").alias("a"), F.col("label").alias("label_a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"), F.col("own").alias("own_a"))
            most, least = F.least(F.col("n") - F.col("own"), F.col("n_a") - F.col("own_a")), F.greatest(F.col("n") + F.col("own_a"), F.col("n_a") + F.col("own"))
            pairs = named.join(other, ["bucket", "block"]).where((F.col("a") < F.col("id")) & (F.col("label") != F.col("label_a")) & (most * 100 >= least * percent) & may_link(F.col("n_a"), F.col("bits_a"), F.col("n"), F.col("bits"), percent))
        else:
            pivots = common.stored(named.where("label > lo").groupBy("bucket").agg(F.min(F.struct("id", "label")).alias("p"), F.max("k").alias("k")).select("bucket", F.col("p.id").alias("a"), F.col("p.label").alias("label_a"), F.col("k").alias("size")), "pivots")
            pairs = common.with_group_winner(named, pivots, "bucket", "size", named.count()).where("id <> a AND label <> label_a").select("id", "a")
            rings = named.where(F.col("k") > LARGE).join(narrow.select("id", "n", "bits"), "id").withColumn("ring", F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / RING)))
            after = Window.partitionBy("bucket", "ring").orderBy(F.xxhash64("id", "bucket"), "id").rowsBetween(1, NEXT)
            rings = rings.withColumn("after", F.collect_list(F.struct("id", "label", "n", "bits")).over(after))
            near = F.filter("after", lambda x: (x["label"] != F.col("label")) & may_link(F.col("n"), F.col("bits"), x["n"], x["bits"], percent))
            pairs = pairs.unionByName(rings.select("id", F.explode(F.transform(near, lambda x: x["id"])).alias("a")).where("id <> a"))
        pairs = common.stored(ordered(pairs).join(done, ["a", "b"], "left_anti"), "more")
        done = done.unionByName(pairs)
        members = named.select("id", "bucket")
        found = linked(pairs)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = common.components(links)
    links = links.distinct()
    each = links.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")).unionByName(links.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("n")))
    counts = each.groupBy("id").agg(F.sum("n").alias("n_confirmed"))
    judged = classes.select("set_key", "copies", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    judged = common.stored(judged.select("set_key", "copies", F.coalesce("label", "id").alias("component_id"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed")), "judged")
    rows_out = common.with_group_winner(known.select("doc_id", "n_shingles", "set_key"), judged, "set_key", "copies", total).select("doc_id", "n_shingles", "component_id", "n_confirmed")
    alone = all_rows.where("set_key IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_confirmed"))
    out = rows_out.unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "n_confirmed")
