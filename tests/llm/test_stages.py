"""Pipeline stages at the edges: clashing names, missing ids and texts, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardline.llm import near_dup, pii, quality_model, quality_rules, toxicity

SF = "/root/testdata/sf0.001"
NAMES = ["_i", "_f", "_m", "_p", "_c", "_s", "_n", "_h", "_q", "_prior", "kept", "spans", "found", "cuts", "nth"]


@pytest.fixture()
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    return d.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_columns_that_clash_with_its_own(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    extra = spark.createDataFrame([(None, "no id", "en", "s", 5), (900001, None, None, None, None), (900001, "", "en", "s", 0)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.unionByName(extra.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)]))
    out = stage(spark, both, SF)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[n] == k for r in rows for k, n in enumerate(NAMES))
    if name in ("near_duplicates", "decontamination", "personal_data"):
        assert sum(r["doc_id"] is None for r in rows) == 1 and sum(r["doc_id"] == 900001 for r in rows) == 2
    assert stage(spark, both.limit(0), SF).collect() == []


def test_stage_quality_is_the_verdict_of_the_operator(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in quality_model.quality(d, labels).collect()}
    good = {r["doc_id"] for r in quality_model.good(d, labels).collect()}
    assert good == {i for i, k in verdict.items() if k} and 0 < len(good) < len(verdict)


def masked(text, spans):
    out, at = "", 0
    for s, e, kind in spans:
        out, at = out + text[at:s] + f"[{kind.upper()}]", e
    return out + text[at:]


def test_mask_of_many_and_overlapping_spans(spark):
    many = "é😀 ".join(f"user{i}@mail{i}.org" for i in range(400))
    rows = [(1, many), (2, "nothing"), (3, "x +49 170 1234567890 y a@b.cd"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert got[1] == "é😀 ".join(["[EMAIL]"] * 400) and got[2] == "nothing" and got[4] is None
    spans = spark.createDataFrame([(1, 5, [(0, 3, "a"), (2, 9, "b"), (4, 6, "c"), (9, 11, "d")])],
                                  "doc_id long, fingerprint long, spans array<struct<start:int,end:int,kind:string>>")
    cuts = pii._united(spans).first()["cuts"]
    assert [tuple(c) for c in cuts] == [(0, 9, "a"), (9, 11, "d")]
    assert masked("0123456789abc", [tuple(c) for c in cuts]) == "[A][D]bc"


def test_near_duplicates_of_very_long_texts(spark):
    base = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, base), (2, base + " tail"), (3, base.replace("w7", "v7")), (4, "other " * 30_000)]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == 1 and got[4] == 4


def test_cascade_measures_rules_on_what_reaches_them():
    tried = []
    for t in range(100):  # a and b reject the same texts; c few others, cheaply
        tried += [(t, "a", t < 40, 1.0), (t, "b", t < 42, 1.2), (t, "c", t >= 90, 0.5)]
    order = quality_rules.greedy(tried)
    assert [r for r, _, _ in order] == ["a", "c", "b"]
    shares = {r: s for r, s, _ in order}
    assert shares["a"] == 0.4 and shares["c"] == pytest.approx(10 / 60) and shares["b"] == pytest.approx(2 / 50)


def test_rejected_text_pays_for_no_later_rule():
    asked = []

    def rule(name, result):
        return name, lambda t: asked.append(name) or result
    rules = dict([rule("x", False), rule("y", True), rule("z", True)])
    assert quality_rules.verdict(quality_rules.Text("a b"), ["x", "y", "z"], rules) == ("y", 2) and asked == ["x", "y"]
    t = quality_rules.Text("# a\n# a\n")
    assert t.n_symbols() == t.n_symbols() == 2 and t._symbols == 2 and t.n_dup_lines() == 1


def test_fit_takes_one_row_for_each_id(spark):
    d = spark.createDataFrame([(i, "bad word here" if i % 2 else "fine text") for i in range(40)] + [(1, "bad word here")] * 200, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    m = toxicity.fit(d, labels)
    assert m["weights"] and "bad" in m["weights"]
    q = quality_model.fit(d, labels.withColumnRenamed("toxic", "quality"))
    assert q["base"] == 0.5
