"""Bloom filters over keys: FNV-1a with 64 bits, double hashing, sizing.

The hash runs on two 32-bit halves in 64-bit columns, so nothing overflows and
no decimals are needed. It is computed once a key, in a projection of its own; a
filter is a table of 64-bit words, so no row holds a whole filter. The modulus is part of the filter; a reloaded filter
probes the same bits that were set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import BITS_PER_KEY

#: Filters of up to so many bits go as one row each where all keys meet all filters; larger ones go by words.
PACKED_BITS = 1 << 23
#: Keys of a block and bits of a group of filters, as they meet; groups there are at least, for the tasks.
BLOCK_KEYS, GROUP_BITS, LEAST_GROUPS = 4096, 1 << 25, 32

#: The halves of the hash's start value, and its prime, 2**40 + 435.
START_HIGH, START_LOW, PRIME_LOW = 0xCBF29CE4, 0x84222325, 435
MASK = 0xFFFFFFFF


def fnv(key: Column) -> Column:
    """The hash of a key's UTF-8 bytes, as a struct of its high (h) and low (l) 32 bits."""
    digits = F.hex(F.encode(key, "UTF-8"))
    n = F.octet_length(key)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    begin = F.struct(F.lit(START_HIGH).cast("long").alias("h"), F.lit(START_LOW).cast("long").alias("l"))

    def step(acc: Column, b: Column) -> Column:
        low = acc["l"].bitwiseXOR(b)
        product = low * PRIME_LOW
        high = acc["h"] * PRIME_LOW + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(MASK)).alias("h"), product.bitwiseAND(F.lit(MASK)).alias("l"))

    return F.aggregate(octets, begin, step)


def fnv1a(key: Column) -> tuple[Column, Column]:
    """(high, low) 32 bits of the hash of a key's UTF-8 bytes."""
    end = fnv(key)
    return end["h"], end["l"]


def num_bits(n: Column, per_key: Column | int = BITS_PER_KEY) -> Column:
    b = per_key if isinstance(per_key, Column) else F.lit(per_key)
    b = F.when(b <= 0, 10).otherwise(b)
    return F.greatest(F.lit(64), F.greatest(n, F.lit(1)) * b).cast("long")


def num_hashes(per_key: Column | int = BITS_PER_KEY) -> Column:
    b = per_key if isinstance(per_key, Column) else F.lit(per_key)
    b = F.when(b <= 0, 10).otherwise(b)
    return F.greatest(F.lit(1), F.least(F.lit(30), F.floor(b * 0.693))).cast("int")


def hash_count(per_key: int) -> int:
    """``num_hashes`` of a plain number."""
    return max(1, min(30, int((10 if per_key <= 0 else per_key) * 0.693)))


def false_positive_rate(n: Column, bits: Column, hashes: Column) -> Column:
    return F.pow(1 - F.exp(-hashes * n / bits), hashes)


def places(hashed: Column, bits: Column, hashes: Column) -> Column:
    """The bits of a key by its hash (``fnv``); the sum of hashes wraps at 32 bits before the modulus is taken."""
    odd = hashed["h"] + F.when(hashed["h"] % 2 == 0, 1).otherwise(0)
    return F.transform(F.sequence(F.lit(0), hashes - 1), lambda i: ((hashed["l"] + i * odd) % (MASK + 1)) % bits)


def positions(key: Column, bits: Column, hashes: Column) -> Column:
    """The bits of a key. For whole tables hash first, in a column of its own, and use ``places``."""
    return places(fnv(key), bits, hashes)


def hashed_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_h``, the hash of ``key``. It is used more than once, so the optimizer leaves it where it is."""
    return rows.withColumn("_h", fnv(F.col("key")))


def hashed_once(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_h``, as ``hashed_keys`` gives it, where a key stands in many rows: each distinct key is hashed once."""
    hashes = hashed_keys(rows.select("key").distinct()).select(F.col("key").alias("_key"), "_h")
    return rows.join(hashes, F.col("key").eqNullSafe(F.col("_key"))).drop("_key")


def place(hashed: Column | dict[str, Column], i: Column | int, bits: Column) -> Column:
    """The ``i``-th of the bits that ``places`` gives, without lambdas."""
    odd = hashed["h"].bitwiseOR(F.lit(1))
    return (hashed["l"] + i * odd).bitwiseAND(F.lit(MASK)) % bits


def exploded(rows: DataFrame) -> DataFrame:
    """``rows`` (with num_bits, num_hash and the key's hash ``_h``) once for each bit of the key, as word and mask."""
    each = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("num_hash") - 1)))
    bit = each.withColumn("_bit", place(F.col("_h"), F.col("_i"), F.col("num_bits"))).drop("_h", "_i")
    return bit.withColumn("word", F.shiftright("_bit", 6)).withColumn("mask", F.expr("shiftleft(1L, cast(_bit % 64 as int))")).drop("_bit")


def filter_sizes(entries: DataFrame, per_key: int = BITS_PER_KEY) -> DataFrame:
    """segment, n_keys, num_bits, num_hash of each segment's filter."""
    keys = entries.select("segment", "key").distinct()
    return keys.groupBy("segment").agg(F.count("*").alias("n_keys")).withColumn("num_bits", num_bits(F.col("n_keys"), per_key)).withColumn("num_hash", num_hashes(per_key))


def build_words(entries: DataFrame, per_key: int = BITS_PER_KEY) -> DataFrame:
    """segment, n_keys, num_bits, num_hash, word, mask: the words of each segment's filter that are not zero."""
    keys = entries.select("segment", "key").distinct()
    hit = exploded(hashed_once(keys).join(filter_sizes(entries, per_key), "segment"))
    return hit.groupBy("segment", "n_keys", "num_bits", "num_hash", "word").agg(F.bit_or("mask").alias("mask"))


def set_places(word: Column, mask: Column) -> Column:
    """The positions of a word's bits."""
    inside = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(mask, i) == 1)
    return F.transform(inside, lambda i: word * 64 + i)


def build(entries: DataFrame, per_key: int = BITS_PER_KEY) -> DataFrame:
    """segment, n_keys, num_bits, num_hash, bits (sorted distinct positions): small filters as one row each."""
    by = ("segment", "n_keys", "num_bits", "num_hash")
    rows = build_words(entries, per_key).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("w"))
    return rows.select(*by, F.flatten(F.transform("w", lambda x: set_places(x["word"], x["mask"]))).alias("bits"))


def probe_words(filters: DataFrame, probes: DataFrame) -> DataFrame:
    """segment, key, maybe: may the segment hold the key? ``filters`` as from ``build_words``; ``probes`` has segment and key. Joins on segment and word."""
    sizes = filters.select("segment", "num_bits", "num_hash").distinct()
    wanted = exploded(hashed_once(probes.distinct()).join(sizes, "segment")).select("segment", "key", "word", F.col("mask").alias("_want"))
    met = wanted.join(filters.select("segment", "word", "mask"), ["segment", "word"], "left")
    return met.groupBy("segment", "key").agg(F.min(F.coalesce(F.col("mask"), F.lit(0)).bitwiseAND(F.col("_want")) != 0).alias("maybe"))


def probe_all(entries: DataFrame, keys: DataFrame, per_key: int = BITS_PER_KEY) -> DataFrame:
    """segment, key, maybe of every key of ``keys`` and the filter of every segment of ``entries``.

    There are as many rows as pairs, so each pair costs a few words looked up and no row of a shuffle: blocks of hashed
    keys meet groups of filters, which are one row each, and are unfolded after that. Filters of more than
    ``PACKED_BITS`` go by ``probe_words``. A null segment has no filter and holds no key. Counts rows when it is called.
    """
    asked, known = keys.select("key").distinct(), entries.where(F.col("segment").isNotNull())
    n = entries.groupBy("segment").count().agg(F.sum("count").alias("rows"), F.max("count").alias("most"), F.max(F.col("segment").isNull()).alias("null")).first()
    n_blocks, n_groups = max(1, -(-asked.count() // BLOCK_KEYS)), max(LEAST_GROUPS, -(-(n["rows"] or 0) * per_key // GROUP_BITS))
    sizes, filters, fits = filter_sizes(known, per_key), build_words(known, per_key), F.col("num_bits") <= PACKED_BITS

    all_words = F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("num_bits") - 1, 6))
    blank = sizes.where(fits).select("segment", "num_bits", F.explode(all_words).alias("word"), F.lit(0).cast("long").alias("mask"))
    words = filters.where(fits).select(*blank.columns).unionByName(blank).repartition("segment").groupBy("segment", "num_bits", "word").agg(F.bit_or("mask").alias("mask"))
    packed = words.groupBy("segment", "num_bits").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "mask"))), lambda w: w["mask"]).alias("words"))
    packed = packed.withColumn("_group", F.pmod(F.xxhash64("segment"), F.lit(n_groups))).withColumn("_block", F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)")))
    blocks = hashed_keys(asked).groupBy(F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("_block")).agg(F.collect_list(F.struct("key", F.col("_h.h"), F.col("_h.l"))).alias("keys"))
    blocks = blocks.withColumn("_group", F.explode(F.expr(f"sequence(0L, {n_groups - 1}L)")))
    # A task holds what one row of the left side makes: a block's keys, not a group of filters times that. A broadcast would hold every copy of the blocks.
    met = packed.hint("merge").join(blocks, ["_block", "_group"]).select("segment", "num_bits", "words", F.inline("keys"))

    def is_set(i: int) -> Column:
        bit = place({c: F.col(c) for c in "hl"}, i, F.col("num_bits"))
        return F.getbit(F.get("words", F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1

    out = met.select("segment", "key", reduce(Column.__and__, map(is_set, range(hash_count(per_key)))).alias("maybe"))
    if n["null"]:
        out = out.unionByName(entries.where(F.col("segment").isNull()).select("segment").distinct().join(asked).withColumn("maybe", F.lit(False)))
    if (n["most"] or 0) * per_key > PACKED_BITS:
        out = out.unionByName(probe_words(filters.where(~fits), sizes.where(~fits).select("segment").join(asked)))
    return out


def probe(filters: DataFrame, probes: DataFrame) -> DataFrame:
    """segment, key, maybe of small filters, as from ``build``."""
    at = hashed_keys(probes.join(filters, "segment")).withColumn("_at", places(F.col("_h"), F.col("num_bits"), F.col("num_hash")))
    return at.select("segment", "key", F.forall("_at", lambda p: F.array_contains("bits", p)).alias("maybe"))
