"""Identifiers in space-separated groups, of other shapes than the seeds."""

from wardline.llm import pii

SEEDS = {
    "phone number": [f"+1 704 555 47{k:02d}" for k in range(6)],
    "call me at": [f"+49 170 12345{k:02d}" for k in range(6)],
    "account number": ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004",
                       "4012 8888 8888 1881", "5105 1051 0510 5100"],
}
UNSEEN = {
    "phone number": ["704 555 4709", "(704) 555-4701", "0170 44 55 66"],
    "call me at": ["(704) 555-4709", "555 47 11", "020 7946 0958"],
    "account number": ["12 345678 90123456", "DE89 3704 0044 0532 0130 00", "AB-77 1204"],
}


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["spans"] for r in pii.pii_digest(df).collect()}


def test_groups_of_unseen_shape_are_found_whole(spark):
    known = [f"you may use {c} {v} today" for c, vs in SEEDS.items() for v in vs]
    unseen = [(f"in 2019 you may use {c} ", v) for c, vs in UNSEEN.items() for v in vs]
    # a context that is known for a quarter only, and numbers that follow numbers
    loose = [f"the total of +1 704 555 48{k:02d} here" for k in range(5)] + [f"the total of {k}04 555 4711 here" for k in range(15)]
    column = ["+1 704 555 4900\n12345678\n23456789"]
    got = spans(spark, known + [a + b + " today" for a, b in unseen] + loose + column)
    for k, (a, b) in enumerate(unseen, len(known)):
        assert f"id:{len(a)}:{len(a) + len(b)}" in got[k].split(","), (a, b, got[k])
    rest = range(len(known) + len(unseen), len(got))
    assert not [got[k] for k in rest if "id:" in got[k]]


def test_a_group_ends_at_a_word_without_digits_and_at_a_small_letter(spark):
    df = spark.createDataFrame([("ids a1@x.org 704 555 and 12 345, 678901",)], "text string")
    found = df.select(pii.matches(df["text"], pii.CANDIDATE).alias("m")).first()["m"]
    assert [x["match"] for x in found] == ["a1@x.org", "704 555", "12 345,", "678901"]


def test_a_word_before_a_seed_is_still_found(spark):
    known = [f"Please reach host address 10.1.{i}.7 for this" for i in range(12)]
    got = spans(spark, [*known, "Please reach host address 10.1.999.7 10.2.3.4 for this"])
    assert got[12] == "id:26:36,ip:37:45"
