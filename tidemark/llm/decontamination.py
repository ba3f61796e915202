"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised words, wherever they stand)
and units after a number turn into typed placeholders; punctuation goes. What a
word turns into depends on the word alone (and for a unit on the number before
it), so an item and a text that holds it are cut alike whatever is around.
Windows of ``WINDOW`` template words of the benchmark are hash-joined with those
of the documents, so a question is found again with other numbers or names in
it, also where a name begins a sentence. Windows of the plain words in lower case
are joined beside them, so a passage that stands as it is counts whatever case,
line breaks or the words before it make of its template. Then slots are checked:
along one alignment of a document and an item, each value in the item's slots must
stand for one value in the document, and the other way round. Alignments that fail
with the template windows alone and with the verbatim ones added are dropped,
unless at least ``VERBATIM`` of the item's windows are verbatim.

Template windows with few literal words (less than ``LITERALS`` of ``WINDOW``)
say little alone: they count if they are verbatim, or if the item is there from
end to end and all its slots are consistent. So of an item that is rich in slots,
a part with other values is not found, but the whole of it is. An item without any
literal word is found by its values only.

Everything is DataFrame functions. Windows are made by zipping shifted arrays of
word hashes. The benchmark's windows are broadcast only if they are at most
``MAX_BROADCAST`` rows; more are joined by a shuffle. The documents found are
read a second time for their slot values; no text is moved for the others.

Defined results: null and empty texts and items match nothing; an item with
fewer words than a window is matched at its own length if it has at least
``SHORTEST`` words, else not at all; null ids are kept; equal rows give one
result; a text that matches an item in two places gives one row, that of the
longest match; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, spread, table
from tidemark.runtime import Scratch, materialise

WINDOW, SHORTEST, LITERALS, MIN_WINDOWS = 8, 5, 5, 2
#: The share of an item's windows that flags it if they are verbatim, whatever the other slots say.
VERBATIM = 0.5
MAX_BROADCAST = 2_000_000
#: Words that are units after a number.
UNITS = "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz pound pounds ton tons ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v a j kj cal kcal k c f degree degrees percent dollar dollars euro euros cent cents usd eur gbp b kb mb gb tb m2 m3 km2 kmh mph"
#: Placeholders: a name, a number and a unit are one control character each.
NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells documents apart that have no id or share one."""
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def cleaned(text: Column) -> Column:
    """A text without punctuation, but for points inside numbers."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}\s\u0001-\u0003]+(?!(?<=\d[.,:/])\d)", "")


def split(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != F.lit(""))


def template_words(clean_text: Column) -> Column:
    # Every pattern starts with what is rare in a text, so most places are passed at once.
    t = F.regexp_replace(clean_text, r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{L}*", NAME)
    t = F.regexp_replace(t, r"\d[\d.,:/]*", NUMBER)
    return split(F.regexp_replace(t, r"\u0002\s+(?i:" + UNITS.replace(" ", "|") + r")(?![\p{L}\d\u0001-\u0003])", f"{NUMBER} {UNIT}"))


def plain_words(clean_text: Column) -> Column:
    return split(F.lower(clean_text))


def template(text: Column) -> Column:
    """The template words of a text. They stand one to one with ``values``."""
    return template_words(cleaned(text))


def plain(text: Column) -> Column:
    """The words of a text in lower case. They stand one to one with ``template``."""
    return plain_words(cleaned(text))


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def values(text: Column) -> Column:
    """The words of a text as they stand, without those that have no letter or digit."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.rlike(w, F.lit(r"[\p{L}\p{N}\u0001-\u0003]")))


def clean(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def windows(words: DataFrame, size: int) -> DataFrame:
    """key, pos, t, p: one row for each window of ``size`` hashes of the array columns ``t`` (template) and ``p`` (plain)."""
    shifted = [F.slice(c, F.lit(i + 1), F.greatest(F.size(c) - size + 1, F.lit(0))).alias(f"{c}{i}") for c in "tp" for i in range(size)]
    rows = words.where(F.size("t") >= size).select("key", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w"))
    return rows.select("key", "pos", *(F.xxhash64(*(F.col(f"w.{c}{i}") for i in range(size))).alias(c) for c in "tp"))


def benchmark_windows(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The items with their words, and their windows by size."""
    spark = items.sparkSession
    words = items.select(items[item_col].cast("long").alias("item_id"), template(items[text_col]).alias("words"), hashes(plain(items[text_col])).alias("p"), values(items[text_col]).alias("raw")).where(F.size("words") >= SHORTEST).distinct()
    words = words.withColumn("key", F.xxhash64("item_id", "words", "raw")).withColumn("t", hashes(F.col("words"))).withColumn("size", F.least(F.size("words"), F.lit(WINDOW)))
    sizes = [r["size"] for r in words.select("size").distinct().collect()]  # at most WINDOW - SHORTEST + 1 numbers
    made = {}
    for size in sorted(sizes):
        own = words.where(F.col("size") == size)
        w = windows(own, size).join(own.select("key", "words"), "key")
        literals = lambda words: F.size(F.filter(words, lambda x: ~F.rlike(x, F.lit("[\u0001-\u0003]"))))
        literal = literals(F.slice("words", F.col("pos") + 1, F.lit(size)))
        light = literal >= min(LITERALS, size - 1)
        # Both hashes are equal where the window has no slots.
        exact = F.struct(F.col("p").alias("h"), F.lit(True).alias("exact"), (light & (F.col("t") == F.col("p"))).alias("light"))
        slotted = F.struct(F.col("t").alias("h"), F.lit(False).alias("exact"), light.alias("light"))
        w = w.withColumn("r", F.explode(F.when(F.col("t") == F.col("p"), F.array(exact)).otherwise(F.array(exact, slotted))))
        # A table, since it is counted and joined.
        made[size] = materialise(w.where(F.col("r.exact") | F.col("r.light") | (literals(F.col("words")) > 0)).select(F.col("key").alias("item_key"), F.col("pos").alias("item_pos"), "r.*"), "benchmark-windows")
    return words.select(F.col("key").alias("item_key"), "item_id", "words", "raw", "size"), made


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_windows: int = MIN_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows, share of the item's windows, n_slots and changed (slots with other values than the item's), row_key (``row_key`` of the document)."""
    bench, by_size = benchmark_windows(items, item_col, item_text_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    empty = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows long, share double, n_slots int, changed int, row_key long")
    if not by_size:
        return empty
    hashed = rows.select("key", cleaned(F.col("text")).alias("c")).select("key", hashes(template_words(F.col("c"))).alias("t"), hashes(plain_words(F.col("c"))).alias("p"))
    both = F.when(F.col("t") == F.col("p"), F.array("t")).otherwise(F.array("t", "p"))
    sets = [F.collect_set(F.when(F.col(c), F.col("item_pos"))).alias(c) for c in ("light", "exact")] + [F.collect_set("item_pos").alias("any")]
    found = []
    for size, wanted in by_size.items():
        if wanted.count() <= MAX_BROADCAST:
            wanted = F.broadcast(wanted)
        hits = windows(hashed, size).select("key", "pos", F.explode(both).alias("h")).join(wanted, "h").withColumn("shift", F.col("pos") - F.col("item_pos"))
        found.append(hits.groupBy("key", "item_key", "shift").agg(*sets))
    hits = reduce(DataFrame.unionByName, found).join(bench, "item_key")
    of_item = F.greatest(F.size("words") - F.col("size") + 1, F.lit(1))
    needed = F.least(F.lit(min_windows), of_item)
    whole = F.size("any") == of_item
    hits = hits.where((F.size(F.array_union("light", "exact")) >= needed) | whole)
    # A table, since it is read twice. A text is read again for its values, if its document has hits.
    hits = materialise(hits.select("key", "item_key", "shift", "light", "exact", "any", "item_id", "words", "raw", "size"), "hits")
    texts = rows.join(bounded(hits.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"]).select("key", "doc_id", values(F.col("text")).alias("doc_raw"))
    # Sets of windows that may flag the pair, each with slots of its own.
    readings = F.filter(F.array_distinct(F.array("light", F.array_union("light", "exact"), F.when(whole, F.col("any")).otherwise(F.array().cast("array<int>")))), lambda at: F.size(at) >= needed)
    verbatim = (F.size("exact") >= needed) & (F.size("exact") >= VERBATIM * of_item)
    readings = F.transform(readings, lambda at: F.struct(at.alias("at"), F.lit(False).alias("sure")))
    readings = F.concat(readings, F.when(verbatim, F.array(F.struct(F.col("exact").alias("at"), F.lit(True).alias("sure")))).otherwise(F.filter(readings, lambda _: F.lit(False))))
    joined = hits.withColumn("r", F.explode(readings)).withColumns({"at": F.col("r.at"), "sure": F.col("r.sure")}).join(texts, "key")
    inside = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("size") - 1))))
    pairs = F.array_distinct(
        F.transform(
            F.filter(inside, lambda p: F.rlike(F.element_at("words", p + 1), F.lit("[\u0001-\u0003]"))),
            lambda p: F.struct(clean(F.element_at("raw", p + 1)).alias("b"), clean(F.try_element_at("doc_raw", (p + F.col("shift") + 1).cast("int"))).alias("d")),
        )
    )
    checked = joined.withColumn("pairs", pairs)
    n = F.size("pairs")
    consistent = (F.size(F.array_distinct(F.transform("pairs", lambda x: x["b"]))) == n) & (F.size(F.array_distinct(F.transform("pairs", lambda x: x["d"]))) == n)
    out = checked.where(F.col("sure") | consistent).select(
        F.col("key").alias("row_key"), "doc_id", "item_id", F.size("at").cast("long").alias("n_windows"), (F.size("at") / of_item).alias("share"),
        n.alias("n_slots"), F.size(F.filter("pairs", lambda x: ~x["b"].eqNullSafe(x["d"]))).alias("changed"),
    )
    best = F.max(F.struct("n_windows", "share", "n_slots", (-F.col("changed")).alias("unchanged")))
    grouped = out.groupBy("row_key", "doc_id", "item_id").agg(best.alias("m"))
    return grouped.select("doc_id", "item_id", "m.n_windows", "m.share", "m.n_slots", (-F.col("m.unchanged")).alias("changed"), "row_key")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
        return scratch.result(contaminated(docs, table(spark, sf_dir, "benchmark")).drop("row_key"), "leaks")
