"""Personal data: fixed patterns, and bootstrapped contextual extraction.

DataFrame functions only.  The fixed patterns find e-mail addresses, IP
addresses, card and phone numbers; these are the seeds.  Every word, or group of
neighbouring words, that looks like an identifier (digits in it) is an instance,
and the two words of the text before it are its context.  Contexts and instances
score each other on their graph for a few rounds: a context is as good as the
known share of its distinct instances and their number, its shapes count less,
and an instance is as good as its patterns (context and shape) together.
Instances of patterns that end with a high score, and that no seed covers, are
new identifiers of kind ``id``.

Offsets are code points, end exclusive.  Null and empty texts have no span; of
repeated rows each gets the same spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import documents, free, materialize

#: The base patterns in the order of their kinds.  They match what
#: `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`, `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`,
#: `[0-9]([\x20-]?[0-9])+` and `\+[0-9][\x20().0-9-]+[0-9]` match, but possessively and only
#: from the start of a run, so that no text makes them backtrack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "id")

#: A number up to 255, whatever its leading zeros.
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A word with a digit in it, and those that follow a digit, bracket or capital and one space.
CANDIDATE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+(?:(?<=[0-9)A-Z])\x20(?=[(+]?\p{L}{0,4}+[0-9])\S++)*+"
#: Most doublings of its known instances that count for a context, and what a shape adds at most.
DOUBLINGS, SHAPE = 3.0, 0.5
BLOCK = 256


def _append(acc: Column, x: Column) -> Column:
    return F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))


def _prefix(lengths: Column, start: Column) -> Column:
    """Sum of what comes before each element, plus ``start``."""
    zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(lengths, zero, _append, lambda a: a["all"])


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once; a column named inside a lambda
    would be computed again for every element."""
    return F.get(F.transform(F.array(value), fn), 0)


def starts(lengths: Column) -> Column:
    """Exclusive running sums of an int array.  In blocks, so that a very long
    text with very many matches does not copy one growing array for each."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
                         lambda k: F.slice(lengths, k * BLOCK + 1, F.lit(BLOCK)))

    def add(b):
        sums = F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
        return F.flatten(F.zip_with(b, _prefix(sums, F.lit(0)), _prefix))
    return let(blocks, add)


def matches(text: Column, regex: str) -> Column:
    """array<struct<start, end, match, before>>: all matches, leftmost and
    non-overlapping, with the text since the match before."""
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))

    def one(x):
        first = x["at"] + F.length(x["b"])
        return F.struct(first.alias("start"), (first + F.length(x["m"])).alias("end"), x["m"].alias("match"), x["b"].alias("before"))

    def place(pairs):
        lengths = F.transform(pairs, lambda x: F.length(x["b"]) + F.length(x["m"]))
        at = let(lengths, starts)
        return F.transform(F.zip_with(pairs, at, lambda x, y: F.struct(x["m"].alias("m"), x["b"].alias("b"), y.alias("at"))), one)

    def pair(ms):
        pieces = F.slice(F.split(text, regex, -1), F.lit(1), F.size(ms))
        return let(F.zip_with(ms, pieces, lambda m, b: F.struct(m.alias("m"), b.alias("b"))), place)

    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")
    return let(found, lambda ms: F.when(F.size(ms) > 0, pair(ms)).otherwise(none))


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""),
                    lambda d, i: F.when(i % 2 == 0, d.cast("int"))
                    .otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        d = F.regexp_replace(m, "[^0-9]", "")
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind_no, end, kind>> of the fixed patterns, in order."""
    parts = []
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>")
    for no, (kind, regex, needs) in enumerate([("email", EMAIL, "@"), ("ip", IP, "."), ("card", CARD, None), ("phone", PHONE, "+")]):
        ok = F.filter(matches(text, regex), lambda x: _valid(kind, x["match"]))
        spans = F.transform(ok, lambda x: F.struct(x["start"], F.lit(no).alias("kind_no"), x["end"], F.lit(kind).alias("kind")))
        parts.append(F.when(F.contains(text, F.lit(needs)), spans).otherwise(none) if needs else spans)
    return F.array_sort(F.concat(*parts))


def shape(token: Column) -> Column:
    """Runs of digits to 9, of letters to a; other characters stay."""
    return F.regexp_replace(F.regexp_replace(token, "[0-9]+", "9"), r"\p{L}+", "a")


def instances(text: Column) -> Column:
    """array<struct<start, end, instance, context, shape, part>> of identifier-like
    words and groups: five letters or digits at least, three of them digits.
    The first word of a group also comes alone, as a part."""
    word = lambda x: F.regexp_replace(x, r"^(?:(?!\([0-9]+\))[^\p{L}0-9+])+|[^\p{L}0-9]+$", "")
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    marks = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}0-9]", ""))
    # the text before a candidate begins with the candidate before it
    whole = lambda ms: F.transform(ms, lambda x, i: x.withField(
        "before", F.concat(F.coalesce(F.right(F.get(ms, i - 1)["match"], F.lit(80)), F.lit("")), F.right(x["before"], F.lit(80)))))
    alone = lambda ms: F.transform(F.filter(ms, lambda x: F.contains(x["match"], F.lit(" "))), lambda x: x.withField(
        "match", F.substring_index(x["match"], " ", 1)).withField("part", F.lit(True)))
    both = lambda ms: let(F.transform(whole(ms), lambda x: x.withField("part", F.lit(False))), lambda m: F.concat(m, alone(m)))
    likely = F.filter(let(matches(text, CANDIDATE), both), lambda x: (digits(x["match"]) >= 3) & (marks(x["match"]) >= 5))

    def one(x):
        w = word(x["match"])
        lead = F.position(w, x["match"]) - 1
        ws = F.split(F.rtrim(F.regexp_replace(F.lower(F.right(x["before"], F.lit(80))), r"\s+", " ")), " ")
        two = F.concat_ws(" ", F.coalesce(F.get(ws, F.size(ws) - 2), F.lit("")), F.get(ws, F.size(ws) - 1))
        return F.struct((x["start"] + lead).alias("start"), (x["start"] + lead + F.length(w)).alias("end"),
                        F.lower(w).alias("instance"), F.regexp_replace(two, "[0-9]+", "9").alias("context"), shape(w).alias("shape"), x["part"])

    # numbers alone are no context
    return F.filter(F.transform(likely, one), lambda x: x["context"].rlike("[^ 9]"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, base, found): base spans and instances, written
    once; ``found`` says of each instance whether a base span overlaps it."""
    d = documents(docs).select("doc_id", F.xxhash64("text").alias("fingerprint"), base_spans(F.col("text")).alias("base"),
                               instances(F.col("text")).alias("found"))
    known = F.transform("found", lambda x: x.withField(
        "seed", F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    # a part stands for its group only if a base span covers another part of that
    kept = let(known, lambda all_: F.filter(all_, lambda x: ~x["part"] | (~x["seed"] & F.exists(
        all_, lambda y: (y["start"] == x["start"]) & ~y["part"] & y["seed"]))))
    return materialize(d.withColumn("found", kept), "pii-found")


def score_patterns(found: DataFrame, rounds: int = 3, min_support: int = 3, accept: float = 0.8) -> DataFrame:
    """(context, shape, confidence) of the patterns that end at ``accept`` or more.

    The graph has one edge per distinct context and instance.  Seeds have score
    1 and keep it.  The share of a context is the sum of its instances' scores
    over their number plus one; it is 0 with fewer than ``min_support``
    instances that score a half or more.  Its confidence is
    1 - (1 - share) ** d, d the doublings of those instances, at most DOUBLINGS;
    the share of a shape over all contexts closes SHAPE of what is left open at
    most.  A context and shape whose own share reaches ``accept`` need no more.
    An instance's score is one minus the product of what its accepted patterns
    leave open."""
    edges = materialize(found.select(F.explode("found").alias("x")).select("x.context", "x.shape", "x.instance", "x.seed")
                        .groupBy("context", "shape", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    seeds = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    scored = edges.select("context", "shape", "instance").join(seeds, "instance")
    share = F.col("known") / (F.col("n") + 1)
    for r in range(rounds):
        strong = F.sum((F.col("score") >= 0.5).cast("int"))
        pairs = materialize(scored.groupBy("context", "shape").agg(F.sum("score").alias("known"), F.count("*").alias("n"), strong.alias("support")),
                            f"pii-pairs-{r}")
        shapes = (scored.select("instance", "shape", "score").distinct().groupBy("shape")
                  .agg((F.sum("score") / (F.count("*") + 1)).alias("of_shape")))
        own = pairs.where((F.col("support") >= min_support) & (share >= accept)).select("context", "shape", share.alias("confidence"))
        doublings = F.least(F.log2(F.col("support") + 1), F.lit(DOUBLINGS))
        # a context that even a fully known shape would not lift to accept is left out early
        contexts = (pairs.groupBy("context").agg(*[F.sum(c).alias(c) for c in ("known", "n", "support")])
                    .where(F.col("support") >= min_support).select("context", (1 - F.pow(1 - share, doublings)).alias("of_context"))
                    .where(F.col("of_context") + (1 - F.col("of_context")) * SHAPE >= accept))
        wide = (pairs.select("context", "shape").join(contexts, "context").join(shapes, "shape")
                .select("context", "shape", (F.col("of_context") + (1 - F.col("of_context")) * SHAPE * F.col("of_shape")).alias("confidence"))
                .where(F.col("confidence") >= accept))
        patterns = materialize(own.unionByName(wide).groupBy("context", "shape").agg(F.max("confidence").alias("confidence")),
                               f"pii-patterns-{r}")
        if r == rounds - 1:
            return patterns
        left_open = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        reached = edges.join(patterns, ["context", "shape"]).groupBy("instance").agg((1 - left_open).alias("reached"))
        scores = (seeds.join(reached, "instance", "left")
                  .select("instance", F.greatest("score", F.coalesce("reached", F.lit(0.0))).alias("score")))
        scored = edges.select("context", "shape", "instance").join(scores, "instance")
    raise ValueError("rounds must be 1 or more")


def discovered(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, new): spans of kind ``id`` that accepted patterns
    find and no seed covers, one row per document that has any."""
    loose = (found.select("doc_id", "fingerprint", F.explode(F.filter("found", lambda x: ~x["seed"])).alias("x"))
             .select("doc_id", "fingerprint", "x.start", "x.end", "x.context", "x.shape"))
    return (loose.join(patterns, ["context", "shape"])
            .groupBy("doc_id", "fingerprint")
            .agg(F.collect_set(F.struct("start", F.lit(4).alias("kind_no"), "end", F.lit("id").alias("kind"))).alias("new")))


def pii_spans(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, fingerprint, base, spans): base spans, and all spans in order."""
    found = find(docs)
    new = discovered(found, score_patterns(found, **params)).select(F.col("doc_id").alias("i"), F.col("fingerprint").alias("f"), "new")
    joined = found.join(new, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("fingerprint") == F.col("f")), "left")
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>")
    return joined.select("doc_id", "fingerprint", "base",
                         F.array_sort(F.concat("base", F.coalesce("new", none))).alias("spans"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digest(docs: DataFrame, **params) -> DataFrame:
    """Counts per base kind, the hash of the base spans, and all spans joined."""
    s = pii_spans(docs, **params)
    n = [F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return s.select("doc_id", *n, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def _united(spans: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, cuts): overlapping spans of a text as one, under the
    name of the first, in order.  Rows of one text stand in one window; there is
    one for each span, never for each character."""
    one = spans.select("doc_id", "fingerprint", F.posexplode("spans").alias("nth", "s"))
    text = Window.partitionBy("doc_id", "fingerprint").orderBy("nth")
    reach = F.max("s.end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum("new").over(text)
    marked = one.withColumn("new", (F.coalesce(reach, F.lit(0)) <= F.col("s.start")).cast("int")).withColumn("group", group)
    cuts = marked.groupBy("doc_id", "fingerprint", "group").agg(
        F.min("s.start").alias("start"), F.max("s.end").alias("end"), F.min_by("s.kind", "nth").alias("kind"))
    return cuts.groupBy("doc_id", "fingerprint").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))


def mask(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with each span of its texts replaced by ``[KIND]``; overlapping
    spans are replaced together, under the name of the first.  Rows without a
    span are unchanged."""
    i, f, m, c = free(docs, "_i", "_f", "_m", "_c")
    spans = pii_spans(docs, **params).where(F.size("spans") > 0).dropDuplicates(["doc_id", "fingerprint"])
    cuts = _united(spans).select(F.col("doc_id").alias(i), F.col("fingerprint").alias(f), F.col("cuts").alias(m))
    on = (docs["doc_id"].cast("long").eqNullSafe(F.col(i))
          & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(f)))
    # the text is taken apart once; what lies between two cuts is a slice of its characters
    chars = F.when(F.col(m).isNotNull(), F.split(docs["text"], "", -1))
    joined = docs.join(cuts, on, "left").withColumn(c, chars)

    def between(lo: Column, hi: Column) -> Column:
        return F.array_join(F.slice(c, lo + 1, hi - lo), "")
    before = lambda k: F.when(k > 0, F.get(F.col(m), k - 1)["end"]).otherwise(F.lit(0))
    parts = F.transform(m, lambda s, k: F.concat(between(before(k), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    tail = between(F.element_at(m, -1)["end"], F.size(c))
    masked = F.when(F.col(m).isNotNull(), F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("text"))
    return joined.withColumn("text", masked).select(*[F.col(f"`{x}`") for x in docs.columns])
