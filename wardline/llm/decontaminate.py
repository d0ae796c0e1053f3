"""Benchmark decontamination by SimHash of item-sized windows.

DataFrame functions only.

1. Windows.  A text is examined wherever it shares a run of ``width`` words with
   an item: the item is laid over the text at that place, and the window of the
   item's length there is a candidate.  A window that shares no run with any
   item has similarity 0, so nothing is lost.
2. Fingerprints.  Windows and items get a 64-bit SimHash of their words.
3. Multi-index Hamming blocks.  Fingerprints are cut into four blocks of 16
   bits.  Two fingerprints at most 15 bits apart differ in at most 3 bits of
   some block, and the index holds every item under all keys up to 3 bits from
   each of its blocks; so an equality join finds all pairs within the radius.
4. Verification.  The shared share of the runs of ``width`` words, each weighted
   by how often it occurs, must be at least ``percent``.

Words are runs of letters and digits, lower-cased.  Items with fewer than
``width`` words, null texts and null item ids match nothing.  The benchmark is a
stated query set; its index is broadcast only below ``max_broadcast`` rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents, free, materialize
from wardline.llm.pii import let

BLOCKS, BITS, NEAR = 4, 16, 3
RADIUS = BLOCKS * (NEAR + 1) - 1
#: All 16-bit patterns with at most NEAR bits set: a rule, not a list.
FLIPS = [sum(1 << b for b in c) for k in range(NEAR + 1) for c in combinations(range(BITS), k)]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def runs(ws: Column, width: int) -> Column:
    """Hash of every run of ``width`` words, in order; none if there are fewer."""
    made = let(ws, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width),
                                         lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])))
    return F.when(F.size(ws) >= width, made).otherwise(F.array().cast("array<bigint>"))


def simhash(ws: Column) -> Column:
    """64-bit SimHash of the words of an array, each as often as it occurs."""
    def of(hashes):
        def bit(b):
            votes = F.aggregate(hashes, F.lit(0), lambda a, h: a + F.getbit(h, b).cast("int") * 2 - 1)
            return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"),
                           lambda a, x: a.bitwiseOR(x))
    return let(F.transform(ws, lambda w: F.xxhash64(w)), of)


def block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def bag(hashes: Column) -> Column:
    """A multiset as a set: each element with the number of its occurrence."""
    return let(F.array_sort(hashes), lambda s: F.transform(
        s, lambda h, i: F.xxhash64(h, i - F.array_position(s, h).cast("int"))))


def similarity(a: Column, b: Column) -> Column:
    """Shared over united weight of two bags, 0 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0)), F.lit(0.0))


def items(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, length, fingerprint, runs, bag) of the items that can match."""
    t = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w"))
         .where(F.col("item_id").isNotNull() & (F.size("w") >= width)).dropDuplicates(["item_id", "w"]))
    t = t.select("item_id", F.size("w").alias("length"), simhash(F.col("w")).alias("fingerprint"), runs(F.col("w"), width).alias("runs"))
    return materialize(t.withColumn("bag", bag(F.col("runs"))), "items")


def index(made: DataFrame) -> DataFrame:
    """(block, key, length, item_id, fingerprint, bag): every item under every
    key within NEAR bits of each of its blocks."""
    keys = F.array(*[F.struct(F.lit(k).alias("block"), block(F.col("fingerprint"), k).alias("key")) for k in range(BLOCKS)])
    flips = F.array(*[F.lit(x) for x in FLIPS])
    near = made.select("item_id", "length", "fingerprint", F.explode(keys).alias("b"))
    near = near.select("item_id", "length", "fingerprint", "b.block", "b.key", F.explode(flips).alias("flip"))
    return near.select(F.col("block"), F.col("key").bitwiseXOR(F.col("flip")).alias("key"), "length", "item_id",
                       F.col("fingerprint").alias("item_fingerprint"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast only if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def windows(docs: DataFrame, made: DataFrame, width: int, max_broadcast: int) -> DataFrame:
    """(doc_id, fingerprint, start, length): places where an item could lie."""
    d = documents(docs).select("doc_id", F.xxhash64("text").alias("print"), words(F.col("text")).alias("w"))
    r = d.select("doc_id", "print", F.size("w").alias("n"), F.posexplode(runs(F.col("w"), width)).alias("at", "run"))
    places = materialize(made.select("length", F.posexplode("runs").alias("offset", "run")).distinct(), "places")
    hit = r.join(small(places, max_broadcast), "run")
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("offset"), F.col("n") - F.col("length")))
    return hit.select("doc_id", "print", start.alias("start"), "length").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80,
          max_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, print, item_id, start, length, similarity): the best window of
    each text and item that reaches ``percent``; of ties, the first window.

    ``print`` is the hash of the text, so rows that repeat an id stay apart; a
    document that is repeated exactly appears once for each item."""
    made = items(benchmark, width)
    found = materialize(windows(docs, made, width, max_broadcast), "windows")
    per_doc = found.groupBy("doc_id", "print").agg(F.collect_set(F.struct("start", "length")).alias("at")).select(
        F.col("doc_id").alias("i"), F.col("print").alias("p"), "at")
    d = documents(docs).select("doc_id", F.xxhash64("text").alias("print"), "text")
    cut = (d.join(per_doc, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("print") == F.col("p")))
           .select("doc_id", "print", words(F.col("text")).alias("w"), F.col("at"))
           .select("doc_id", "print", F.explode(let(F.struct("w", "at"), lambda z: F.transform(
               z["at"], lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"),
                                           F.slice(z["w"], x["start"] + 1, x["length"]).alias("w"))))).alias("x"))
           .select("doc_id", "print", "x.start", "x.length", "x.w"))
    cut = materialize(cut.select("doc_id", "print", "start", "length", simhash(F.col("w")).alias("fingerprint"),
                                 bag(runs(F.col("w"), width)).alias("bag")).distinct(), "window-prints")

    keys = F.array(*[F.struct(F.lit(k).alias("block"), block(F.col("fingerprint"), k).alias("key")) for k in range(BLOCKS)])
    probes = cut.select("doc_id", "print", "start", "length", "fingerprint", "bag", F.explode(keys).alias("b")).select(
        "doc_id", "print", "start", "length", "fingerprint", "bag", "b.block", "b.key")
    near = probes.join(index(made), ["block", "key", "length"]).where(
        F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= RADIUS)
    near = near.dropDuplicates(["doc_id", "print", "start", "length", "item_id"])
    bags = made.select("item_id", "length", F.col("bag").alias("item_bag"))
    checked = near.join(bags, ["item_id", "length"]).withColumn("similarity", F.round(similarity(F.col("bag"), F.col("item_bag")), 6))
    return (checked.where(F.col("similarity") * 100 >= percent).groupBy("doc_id", "print", "item_id")
            .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "length")).alias("best"))
            .select("doc_id", "print", "item_id", "best.start", "best.length", (-F.col("best.s")).alias("similarity")))


def remove(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``docs`` without the texts that hold a window of an item."""
    i, p = free(docs, "_i", "_p")
    gone = leaks(docs, benchmark, **params).select(F.col("doc_id").alias(i), F.col("print").alias(p)).distinct()
    on = (docs["doc_id"].cast("long").eqNullSafe(F.col(i))
          & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(p)))
    return docs.join(gone, on, "left_anti")
