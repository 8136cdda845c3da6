"""Documents whose sets of word shingles are similar: an exact join through parity sketches.

A document's shingles fall by hash into the parts of a sketch, each part the XOR of its shingles. Sketches of two sets differ in at
most as many parts (and a bit sketch in as many bits) as the sets differ in shingles, and similar sets differ in at most
``(a + b) (1 - s) / (1 + s)`` of them. So of the non-empty parts of a document, all but that many stand in the partner's sketch too, and among
the first ``difference + 1`` in any common order one is shared. The order is from rare to frequent, counted
over the whole corpus in a table of fixed size, so that what many documents share is looked at last; any order gives the same links.

Sketches have as many parts as their band of sizes needs; a document enters its own band and those in which a smaller
partner may be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invoiceloom.llm import features as ft
from invoiceloom.llm.components import components
from invoiceloom.llm.rows import column, written

WORDS = 5
PERCENT = 75

BAND_RATIO = 4
PARTS_PER_SHINGLE = 3
SINGLE_BELOW = 64
"""Below this size every shingle is a part of its own."""

COUNT_BITS = 18
BIT_LONGS = 8
SKETCH_BITS_PER_SHINGLE = 4
MIDDLE_BYTES = 256
FILTER_BITS = 24
ORIGINALS_SEED = 1
FIRST_BUCKETS = 4


def most_difference(a: int, b: int, percent: int) -> int:
    """How many shingles similar sets of these sizes can differ in."""
    return (a + b) * (100 - percent) // (100 + percent)


def bands(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, parts, difference) of every band a set of ``n`` enters; a pair meets in the band of the smaller set."""
    low, found = 1, []
    smallest, largest = -(-n * percent // 100), n * 100 // percent
    band = 0
    while low <= n:
        high = low * BAND_RATIO
        if high > smallest:
            own = n < high
            partner = largest if own else high - 1
            parts = 0 if high <= SINGLE_BELOW else low * PARTS_PER_SHINGLE
            found.append((band, parts, most_difference(n, partner, percent)))
        low, band = high, band + 1
    return found


def part_keys(shingles: np.ndarray, band: int, parts: int) -> np.ndarray:
    """A 64-bit key for each non-empty part: its place in the sketch of the band and the XOR of its shingles."""
    seed = np.uint64((band + 1) << 48)
    if parts == 0:
        return ft.mixed(shingles + seed)
    place = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # rises with the sorted hashes
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return ft.mixed(np.bitwise_xor.reduceat(shingles, starts) ^ ft.mixed(place[starts] + seed))


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; a shorter text is one shingle, none without words."""
    data, offsets = ft.string_bytes(column)
    for first, last in ft.runs(offsets):
        at = offsets[first : last + 1]
        found = ft.words_of(data[at[0] : at[-1]], at - at[0], lower=True)
        borders = np.searchsorted(found.doc, np.arange(last - first + 1))
        for i in range(last - first):
            codes = found.hashes[borders[i] : borders[i + 1]]
            n = min(words, len(codes))
            if n == 0:
                yield codes
                continue
            h, _ = ft.ngrams(codes, np.zeros(len(codes), np.int32), n, n)
            h.sort()
            yield h[np.concatenate(([True], h[1:] != h[:-1]))]


def key_slots(keys: np.ndarray) -> np.ndarray:
    """Where keys are counted."""
    return (keys >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def bit_sketch(shingles: np.ndarray) -> np.ndarray:
    """A bit is set where an odd number of shingles falls."""
    at = np.bincount((shingles & np.uint64(BIT_LONGS * 64 - 1)).astype(np.int64), minlength=BIT_LONGS * 64) & 1
    return np.packbits(at.astype(np.uint8), bitorder="little").view("<i8")


def scaled_sketch(shingles: np.ndarray) -> bytes:
    """A bit sketch of at least four bits a shingle; folding it gives the sketch of half its size."""
    size = max(BIT_LONGS * 64, 1 << (SKETCH_BITS_PER_SHINGLE * len(shingles) - 1).bit_length())
    at = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(at.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> bytes:
    """A sketch folded to at most ``size`` bytes."""
    bits = np.frombuffer(sketch, np.uint8)
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits.tobytes()


def sketch_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two scaled sketches differ at the size of the smaller."""
    small, large = sorted((a, b), key=len)
    while len(large) > len(small):
        large = large[: len(large) // 2] ^ large[len(large) // 2 :]
    return int(np.bitwise_count(small ^ large).sum())


PROFILE_DDL = "id long, n long, d1 long, d2 long, bits array<long>, middle binary, sketch binary, slot int, seen long"


def profiles(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """A row per text with size, digest and bit sketch of its set, and rows (slot, seen) that count part keys."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bits", pa.list_(pa.int64())), ("middle", pa.binary()), ("sketch", pa.binary()), ("slot", pa.int32()), ("seen", pa.int64())])
        for batch in batches:
            size, digests, sketches, scaled, slots, held = [], [], [], [], [], 0
            for s in shingle_sets(batch.column(1), words):
                size.append(len(s))
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8"))
                sketches.append(bit_sketch(s))
                scaled.append(scaled_sketch(s) if len(s) else b"")
                for band, parts, _ in bands(len(s), percent) if len(s) else ():
                    slots.append(key_slots(part_keys(s, band, parts)))
                    held += len(slots[-1])
                if held > 200_000:
                    counts += np.bincount(np.concatenate(slots), minlength=len(counts))
                    slots, held = [], 0
            if slots:
                counts += np.bincount(np.concatenate(slots), minlength=len(counts))
            n = batch.num_rows
            if n:
                both = np.concatenate(digests).reshape(n, 2)
                lists = pa.ListArray.from_arrays(np.arange(0, (n + 1) * BIT_LONGS, BIT_LONGS, dtype=np.int32), np.concatenate(sketches))
                none = pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), lists, pa.array([folded(x, MIDDLE_BYTES) for x in scaled], pa.binary()), pa.array(scaled, pa.binary()), *none], schema=schema)
        used = np.flatnonzero(counts)
        for at in range(0, len(used), 50_000):
            part = used[at : at + 50_000]
            empty = [pa.nulls(len(part), schema.field(i).type) for i in range(7)]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(part, pa.int32()), pa.array(counts[part])], schema=schema)

    return texts.mapInArrow(profile, PROFILE_DDL)


def prefix_keys(texts: DataFrame, seen: np.ndarray, copies: np.ndarray, originals: np.ndarray, words: int, percent: int) -> DataFrame:
    """(key, id): the rarest ``difference + 1`` part keys of every text in every band it enters.

    Ids in the bitmap ``copies`` and not in the bitmap ``originals`` are left out.
    """

    def held_in(bitmap: np.ndarray, column: pa.Array) -> np.ndarray:
        slot = np.asarray(column)
        return (bitmap[slot >> 6] >> (slot & 63)) & 1 == 1

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(pa.array(~held_in(copies, whole.column(2)) | held_in(originals, whole.column(3))))
            ids = np.asarray(batch.column(0))
            keys, owners, held = [], [], 0
            for i, s in enumerate(shingle_sets(batch.column(1), words)):
                for band, parts, difference in bands(len(s), percent) if len(s) else ():
                    key = part_keys(s, band, parts)
                    if len(key) > difference + 1:
                        order = (seen[key_slots(key)] << np.uint64(44)) | (key >> np.uint64(20))
                        key = key[np.argpartition(order, difference)[: difference + 1]]
                    keys.append(key)
                    owners.append(np.full(len(key), ids[i]))
                    held += len(key)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], ["key", "id"])
                    keys, owners, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], ["key", "id"])

    return texts.select("id", "text", id_slot(), id_slot(ORIGINALS_SEED)).mapInArrow(keyed, "key long, id long")


def few_enough(n_a: Column, n_b: Column, bits_a: Column, bits_b: Column, percent: int) -> Column:
    """Whether sizes and bit sketches allow two sets to be similar."""
    apart = sum((F.bit_count(bits_a[i].bitwiseXOR(bits_b[i])) for i in range(BIT_LONGS)), F.lit(0))
    sizes = (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))
    return sizes & ((100 + percent) * apart <= (100 - percent) * (n_a + n_b))


def id_slot(seed: int = 0) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << FILTER_BITS))


def id_filter(ids: DataFrame, seed: int = 0) -> np.ndarray:
    """A bitmap of fixed size that holds the hashes of all given ids."""
    rows = (
        ids.select(id_slot(seed).alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("at"))
        .agg(F.expr("bit_or(shiftleft(1L, int(slot & 63)))").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[np.asarray(rows.column("at").combine_chunks())] = np.asarray(rows.column("bits").combine_chunks())
    return out


def possible_pairs(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sketches allow them to be similar: folded ones first, so that few whole ones travel."""
    return allowed_pairs(allowed_pairs(pairs, known, "middle", percent), known, "sketch", percent)


def allowed_pairs(pairs: DataFrame, known: DataFrame, sketch: str, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sketches in the given column allow them to be similar."""

    @F.arrow_udf("boolean")
    def possible(left: pa.Array, right: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for x, y, total in zip(left, right, np.asarray(n), strict=True):
            a, b = (np.frombuffer(c.as_buffer(), np.uint8) for c in (x, y))
            out.append((100 + percent) * sketch_distance(a, b) <= (100 - percent) * int(total))
        return pa.array(out, pa.bool_())

    left = pairs.join(known.select(F.col("id").alias("u"), F.col("n").alias("n_u"), F.col(sketch).alias("left")), "u")
    met = left.join(known.select(F.col("id").alias("v"), F.col("n").alias("n_v"), F.col(sketch).alias("right")), "v")
    return met.where(possible("left", "right", F.col("n_u") + F.col("n_v"))).select("u", "v").distinct()


def similar_pairs(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose texts' sets really are similar, from the sets themselves."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("id"))
    bitmap = id_filter(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            slot = np.asarray(whole.column(2))
            batch = whole.filter(pa.array((bitmap[slot >> 6] >> (slot & 63)) & 1 == 1))
            ids, held, out, which = batch.column(0), 0, [], []
            for i, s in enumerate(shingle_sets(batch.column(1), words)):
                out.append(s.tobytes())
                which.append(i)
                held += 8 * len(s)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), pa.array(out, pa.binary())], ["id", "shingles"])
                    held, out, which = 0, [], []
            if out:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), pa.array(out, pa.binary())], ["id", "shingles"])

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = (np.frombuffer(c.as_buffer(), np.uint64) for c in (x, y))
            both = np.intersect1d(a, b, assume_unique=True).size
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    told = texts.select("id", "text", id_slot().alias("slot")).mapInArrow(sets, "id long, shingles binary")
    left = pairs.join(told.select(F.col("id").alias("u"), F.col("shingles").alias("left")), "u")
    met = left.join(told.select(F.col("id").alias("v"), F.col("shingles").alias("right")), "v")
    return met.where(similar("left", "right")).select("u", "v")


def similar_documents(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(id, n_shingles, component_id) of every row: size of its set, and the smallest id reachable through similar sets.

    Two ids are linked where ``100 * intersection >= percent * union``. First equal sets count as one; then every document is compared with the
    closest of the smallest documents of its buckets; then all pairs that share a bucket and aren't connected yet are compared, each told by
    few of the buckets it shares. So groups of
    near copies never meet in pairs, and every link between different texts that could join two components is tested.

    Null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows that repeat an id are texts of that id: it
    has the links of them all. Rows with a null id link with nothing and have a null component.
    """
    source = df.select(column(id_column).cast("long").alias("id"), F.coalesce(column(text_column), F.lit("")).alias("text"))
    texts = source.where(F.col("id").isNotNull())
    told = written(profiles(source, words, percent), "profiles")
    docs = told.where("slot is null").drop("slot", "seen")
    counted = told.where("slot is not null").groupBy("slot").agg(F.sum("seen").alias("seen")).toArrow()  # at most 2**18 rows
    seen = np.zeros(1 << COUNT_BITS, np.uint64)
    seen[np.asarray(counted.column("slot").combine_chunks())] = np.minimum(np.asarray(counted.column("seen").combine_chunks()), (1 << 20) - 1)

    known = docs.where("id is not null and n > 0")
    copies = written(
        known.groupBy("n", "d1", "d2").agg(F.min("id").alias("first_id"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "copies"
    )
    same = known.join(copies, ["n", "d1", "d2"]).where("id <> first_id").select("id", "first_id").distinct()

    # of equal sets only the first id's goes on: bitmaps leave the others out, and hold back none that is the first of a set
    roles = known.join(copies, ["n", "d1", "d2"], "left").groupBy("id").agg(F.bool_or(F.coalesce(F.col("first_id") == F.col("id"), F.lit(True))).alias("needed"))
    roles = written(roles.withColumn("slot", id_slot()), "roles")
    others = roles.where("not needed")
    unclear = roles.where("needed").join(others.select("slot").distinct(), "slot", "left_semi")
    keys = prefix_keys(texts, seen, id_filter(others), id_filter(unclear, ORIGINALS_SEED), words, percent)
    bucket = Window.partitionBy("key")
    met = keys.select(
        "id",
        F.min("id").over(bucket).alias("pivot"),
        F.max("id").over(bucket).alias("last"),
        F.bit_xor(F.xxhash64("id")).over(bucket).alias("members"),
    ).where("pivot < last")
    # documents that share one key mostly share many: buckets with the same members become one (if others join by chance, they are only compared)
    buckets = written(met.groupBy(F.col("members").alias("key"), "id").agg(F.min("pivot").alias("pivot")), "buckets")

    def described(pairs: DataFrame) -> DataFrame:
        left = known.select(F.col("id").alias("u"), F.col("n").alias("n_u"), F.col("bits").alias("bits_u"), F.xxhash64("d1", "d2").alias("set_u"))
        right = known.select(F.col("id").alias("v"), F.col("n").alias("n_v"), F.col("bits").alias("bits_v"), F.xxhash64("d1", "d2").alias("set_v"))
        return pairs.join(left, "u").join(right, "v")

    # first round: each document and the closest of its buckets' smallest ones
    star = buckets.where("id <> pivot").select(F.col("id").alias("u"), F.col("pivot").alias("v")).distinct()
    apart = sum((F.bit_count(F.col("bits_u")[i].bitwiseXOR(F.col("bits_v")[i])) for i in range(BIT_LONGS)), F.lit(0))
    near = described(star).where(few_enough(F.col("n_u"), F.col("n_v"), F.col("bits_u"), F.col("bits_v"), percent) & (F.col("set_u") != F.col("set_v")))
    best = near.groupBy("u").agg(F.min(F.struct(apart.alias("apart"), "v")).alias("best")).select("u", "best.v")
    linked = written(similar_pairs(written(possible_pairs(best, known, percent), "pairs"), texts, words, percent), "links")
    equal = same.select(F.col("id").alias("u"), F.col("first_id").alias("v"))
    labels = written(components(linked.union(equal)), "labels")

    # second round: whatever shares a bucket and isn't connected yet
    open_keys = buckets.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = open_keys.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    several = written(open_keys.join(mixed, "key", "left_semi").select("key", "id", "component"), "buckets")
    # a pair that shares many buckets is told by the first: not where both know an earlier one in common
    earliest = several.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST_BUCKETS).alias("first"))
    facts = several.join(known.select("id", "n", "bits"), "id").join(earliest, "id")
    a = facts.select("key", *[F.col(c).alias(f"{c}_u") for c in ("id", "component", "n", "bits", "first")])
    b = facts.select("key", *[F.col(c).alias(f"{c}_v") for c in ("id", "component", "n", "bits", "first")])
    earlier = F.exists("first_u", lambda k: (k < a["key"]) & F.array_contains(F.col("first_v"), k))
    cross = a.join(
        b,
        (a["key"] == b["key"]) & (F.col("component_u") < F.col("component_v")) & ~earlier
        & few_enough(F.col("n_u"), F.col("n_v"), F.col("bits_u"), F.col("bits_v"), percent),
    )
    several_pairs = cross.select(F.col("id_u").alias("u"), F.col("id_v").alias("v")).distinct()
    rest = written(possible_pairs(several_pairs, known, percent), "pairs")
    more = similar_pairs(rest, texts, words, percent)
    final = components(labels.select(F.col("id").alias("u"), F.col("component").alias("v")).union(more))
    out = docs.select("id", F.col("n").alias("n_shingles")).join(final, "id", "left")
    return out.select(F.col("id").alias(id_column), "n_shingles", F.coalesce("component", "id").alias("component_id"))
