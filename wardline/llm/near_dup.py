"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

1. Each text's shingle set gives a signature, band keys and a 128-bit hash of
   the set.  Texts with equal sets are one node from here on.
2. In each band bucket every node is paired with one leader; pairs whose sizes
   and odd sketches allow the similarity are verified on the full sets.  Leaders
   change from round to round; a round only pairs nodes that are in different
   groups so far, and rounds go on while they add a twentieth of the links.
3. Buckets that still hold nodes of different groups (few) are finished pair by
   pair, across groups only, so no link that shares a band is lost.

An odd sketch bounds from below how many elements two sets differ in.  The bound
never errs, so no link is lost by it, and it is tight: what it lets through is
within a point or two of the threshold.
4. Groups are the connected components of the verified links, found by least
   labels that hop along their own labels until nothing changes.

Every step is linear in the rows of a bucket except 3, which compares the
sketches of a bucket's nodes, but only verifies pairs that pass.  With 42 bands of 6 rows a pair of similarity 0.85 shares none with probability
2e-9, one of 0.8 with 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents, materialize
from wardline.llm.shingles import bands, chunks, mix, odd_sketch, shingle_sets, superminhash

SLOTS, ROWS = 256, 6
#: Bytes of text that a task hashes at once, and rows that it is given at once.
CHUNK, BATCH = 1 << 18, 1000


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, h1, h2, odd, keys) of every row; empty sets have n = 0."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode() for t in b["text"]]
            for lo, hi in chunks(texts, CHUNK):
                sets = shingle_sets(texts[lo:hi], width)
                sig = superminhash(sets, SLOTS)
                h1 = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                h2 = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[lo:hi].to_numpy(), "n": [len(s) for s in sets], "h1": h1, "h2": h2,
                                    "odd": [odd_sketch(s) for s in sets], "keys": list(bands(sig, ROWS))})

    d = documents(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = d.mapInPandas(run, "doc_id string, n long, h1 long, h2 long, odd array<long>, keys array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def set_table(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the documents that stand for ``nodes(node, h1, h2)``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode() for t in b["text"]]
            for lo, hi in chunks(texts, CHUNK):
                sets = shingle_sets(texts[lo:hi], width)
                same = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) == h for s, h in zip(sets, b["h1"].iloc[lo:hi])]
                yield pd.DataFrame({"node": b["node"].iloc[lo:hi].to_numpy()[same],
                                    "shingles": [s.view(np.int64) for s, ok in zip(sets, same) if ok]})

    # one plan at every size: texts are dealt by id, whether or not the nodes could be broadcast
    d = documents(docs).join(nodes.select("node", "h1").hint("merge"), F.col("doc_id") == F.col("node")).select("node", "h1", "text")
    return d.dropDuplicates(["node", "text"]).mapInPandas(run, "node long, shingles array<long>")


def plausible(n1: Column, n2: Column, odd1: Column, odd2: Column, percent: int) -> Column:
    """Sizes and odd sketches allow the similarity; true for every linked pair.

    Sets of sizes a and b with 100 * shared >= percent * union differ in at most
    (a + b) * (100 - percent) / (100 + percent) elements.  Their sketches have
    one length or one is twice as long, at these sizes."""
    def folded(x: Column, other: Column) -> Column:
        half = F.size(other)
        return F.when(F.size(x) > half, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)
    differ = F.aggregate(F.zip_with(folded(odd1, odd2), folded(odd2, odd1), lambda p, q: F.bit_count(p.bitwiseXOR(q))),
                         F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return sizes(n1, n2, percent) & ((100 + percent) * differ <= (100 - percent) * (n1 + n2))


def sizes(n1: Column, n2: Column, percent: int) -> Column:
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def measure(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` with the similarity of the full sets and whether it is
    enough for a link."""
    sa = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(sa, "a").join(sb, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return both.select("a", "b", common.alias("common"), union.alias("union")).select(
        "a", "b", (F.col("common") / F.col("union")).alias("similarity"),
        (100 * F.col("common") >= percent * F.col("union")).alias("linked"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least label reachable over ``edges(a, b)``.

    ``nodes`` has (node, label) to start from; labels are node ids, and nodes
    with one label are one group already.  So the links are drawn between the
    labels of their ends, and a group moves as a whole."""
    at_a = nodes.select(F.col("node").alias("a"), F.col("label").alias("la"))
    at_b = nodes.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    ends = edges.select("a", "b").join(at_a, "a").join(at_b, "b").where("la <> lb")
    links = materialize(ends.select(F.explode(F.array(F.struct(F.col("la").alias("a"), F.col("lb").alias("b")),
                                                      F.struct(F.col("lb").alias("a"), F.col("la").alias("b")))).alias("x"))
                        .select("x.a", "x.b").distinct(), "links")
    merged = _least(links).where("label < node").select(F.col("node").alias("label"), F.col("label").alias("least"))
    return materialize(nodes.join(merged, "label", "left").select("node", F.coalesce("least", "label").alias("label")), "labels")


def _least(links: DataFrame) -> DataFrame:
    """(node, label) of every end of ``links(a, b)``, which has each link in
    both directions.  Every node starts with its own id: only then is a label
    that equals all its neighbours' the label of the whole component."""
    now = links.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("label"))
    while True:
        seen = now.select(F.col("node").alias("b"), F.col("label").alias("seen"))
        least = links.join(seen, "b").groupBy("a").agg(F.min("seen").alias("seen"))
        # a label learnt by a node also lowers what the node's old label stands for
        offers = (now.join(least, now["node"] == least["a"]).where(F.col("seen") < F.col("label"))
                  .select(F.explode(F.array("node", "label")).alias("node"), F.col("seen").alias("offer"))
                  .groupBy("node").agg(F.min("offer").alias("offer")))
        got = now.join(offers, "node", "left").select("node", F.least("label", F.coalesce("offer", "label")).alias("new"), "label")
        got = materialize(got, "labels")
        if not got.where("new < label").limit(1).count():
            return got.select("node", F.col("new").alias("label"))
        for _ in range(2):  # hop along labels
            up = got.select(F.col("node").alias("new"), F.col("new").alias("further"))
            got = got.join(up, "new", "left").select("node", F.least("new", F.coalesce("further", "new")).alias("new"))
        now = materialize(got.select("node", F.col("new").alias("label")), "labels")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Two texts are linked if 100 * shared >= percent * union of their shingle
    sets; component_id is the least doc_id reachable, kept marks that document.
    Texts without words and rows without an id are linked with nothing (their
    component_id is their own id).  Rows that repeat an id are judged by the
    text of each, and all of them carry the id's mark."""
    base = materialize(sketch(docs, width), "sketch", BATCH)
    real = base.where("n > 0 AND doc_id IS NOT NULL")
    nodes = materialize(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"),
                                                     F.first("odd").alias("odd"), F.first("keys").alias("keys")), "nodes")
    slim = nodes.select("node", "n", "odd")
    buckets = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("c")).where("c > 1").select("band", "key")
    buckets = materialize(buckets.join(shared, ["band", "key"]), "buckets")

    def allowed(pairs: DataFrame) -> DataFrame:
        x = slim.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("odd").alias("odda"))
        y = slim.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("oddb"))
        return (pairs.distinct().join(x, "a").join(y, "b")
                .where(plausible(F.col("na"), F.col("nb"), F.col("odda"), F.col("oddb"), percent)).select("a", "b"))

    members = buckets.select("node").distinct()
    label = members.select("node", F.col("node").alias("label"))
    # the texts move once, for the sets of all nodes that share a bucket
    sets = materialize(set_table(docs, nodes.join(members, "node"), width), "sets", BATCH)
    tried, rounds, links = None, 0, 0
    while True:
        here = buckets.join(label, "node") if rounds else buckets.withColumn("label", F.col("node"))
        if rounds:  # only buckets that hold several groups
            mixed = here.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
            here = materialize(here.join(mixed.select("band", "key"), ["band", "key"]), "mixed")
        order = F.struct("label", "node") if not rounds else F.struct(F.xxhash64(F.lit(rounds), "label"), F.xxhash64(F.lit(rounds), "node"), "node")
        first = here.groupBy("band", "key").agg(F.min_by(F.struct("node", "label"), order).alias("lead"))
        pairs = (here.join(first, ["band", "key"]).where(F.col("label") != F.col("lead.label"))
                 .select(F.greatest("node", "lead.node").alias("a"), F.least("node", "lead.node").alias("b")))
        if tried is not None:
            pairs = pairs.distinct().join(tried, ["a", "b"], "left_anti")
        pairs = materialize(allowed(pairs), "pairs")
        if not pairs.limit(1).count():
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = materialize(measure(pairs, sets, percent), "edges").where("linked")
        n = found.count()
        rounds, links = rounds + 1, links + n
        if n:
            label = components(label, found)
        if 20 * n < links:
            break
    if rounds:
        label = _finish(nodes, buckets, label, tried, sets, percent)
    ids = nodes.select("h1", "h2", "node").join(label, "node", "left").select(
        "h1", "h2", F.coalesce("label", "node").alias("component"))
    return (base.join(ids, ["h1", "h2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _finish(nodes, buckets, label, tried, sets, percent: int) -> DataFrame:
    """Pairs across groups in buckets that still hold several: each pair once,
    in the first band that it shares, if sizes and sketches allow it."""
    here = buckets.join(label, "node")
    mixed = here.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    here = here.join(mixed.select("band", "key"), ["band", "key"]).join(nodes.select("node", "n", "odd", "keys"), "node")
    here = materialize(here, "mixed")
    x = here.select("band", "key", *[F.col(c).alias(f"x_{c}") for c in ("node", "label", "n", "odd", "keys")])
    y = here.select("band", "key", *[F.col(c).alias(f"y_{c}") for c in ("node", "label", "n", "odd", "keys")])
    first = F.array_position(F.zip_with("x_keys", "y_keys", lambda p, q: p == q), F.lit(True)) - 1
    pairs = (x.join(y, ["band", "key"]).where((F.col("x_label") < F.col("y_label"))
                                              & plausible(F.col("x_n"), F.col("y_n"), F.col("x_odd"), F.col("y_odd"), percent)
                                              & (F.col("band") == first))
             .select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")))
    pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "last-pairs")
    if not pairs.limit(1).count():
        return label
    found = materialize(measure(pairs, sets, percent).where("linked"), "edges")
    return components(label, found) if found.limit(1).count() else label
