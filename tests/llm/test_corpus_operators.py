"""Operators that compare documents: against brute force on small fixtures."""

import hashlib
import random
import re

import pytest

from wardline.llm import chat, decontaminate, near_dup, pii, quality_model, substrings


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'s' AS source", "'l' AS lang", "1 AS n", "2 AS node", "3 AS a", "4 AS bytes", "5 AS found")


# ---------------------------------------------------------------- repeated strings

def cut(rows):
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            if t[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(t[p:p + 100])
        kept = bytes(c for c, x in zip(t, gone) if not x)
        out[i] = (len(t), len(t) - len(kept), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_strings_match_brute_force(spark):
    random.seed(8)
    base = ["".join(random.choice("abc e") for _ in range(350)) for _ in range(4)]
    rows = []
    for i in range(60):
        t = "".join(random.choice("xyz ") for _ in range(random.randint(0, 50)))
        for _ in range(random.randint(0, 4)):
            lo = random.randint(0, 200)
            t += random.choice(base)[lo:lo + random.randint(60, 150)] + "".join(random.choice("xyzé") for _ in range(random.randint(0, 30)))
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "a" * 2000), (103, "ab" * 500), (104, "a" * 400), (105, rows[3][1] * 3)]
    got = {r[0]: tuple(r)[1:] for r in substrings.remove_repeats(frame(spark, rows).repartition(3)).collect()}
    assert got == cut(rows)


def test_hot_anchor_is_compared_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 5)
    r = random.Random(1)
    line = "".join(r.choice("abcdefgh ") for _ in range(140))
    rows = [(i, f"{i:05d}" * 12 + line + f"{i * 7:05d}" * 12) for i in range(80)]
    df = frame(spark, rows)
    docs = substrings.numbered(df)
    made = substrings.pieces(docs, substrings.anchor_rows(docs).selectExpr("*", "true AS hot"))
    tiny = substrings.sort_buckets(made, rows_per_bucket=20)
    assert tiny.where("kind = 1").count()  # anchors at bucket ends
    got = {r[0]: tuple(r)[1:] for r in substrings.remove_repeats(df).collect()}
    assert got == cut(rows)


def test_repeated_strings_edges(spark):
    assert substrings.remove_repeats(frame(spark, []).limit(0)).count() == 0
    r = random.Random(2)
    long = "".join(r.choice("abcdefgh") for _ in range(300))
    got = substrings.remove_repeats(frame(spark, [(1, long), (1, long), (None, long)]), keep_text=True).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 300), (1, 0), (1, 0)]
    assert all(bytes(r["kept"]) == (b"" if r["doc_id"] is None else long.encode()) for r in got)


def test_multikey_sort_is_a_sort():
    import numpy as np
    rows = np.random.default_rng(0).integers(0, 3, (500, 4)).astype(np.uint64)
    order, group = substrings.multikey_sort(rows)
    assert [tuple(x) for x in rows[order]] == sorted(map(tuple, rows))
    assert len(set(group)) == len(set(map(tuple, rows)))


# ---------------------------------------------------------------- near duplicates

def groups(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_groups_match_brute_force(spark, width, percent):
    r = random.Random(3)
    word = lambda: "w%d" % r.randint(0, 5000)
    rows, i = [], 0
    for size in (40, 8, 3, 1, 1):
        text = [word() for _ in range(150)]
        for _ in range(size):
            copy = list(text)
            for _ in range(r.randint(0, 9)):
                copy[r.randrange(150)] = word()
            rows.append((i, " ".join(copy)))
            i += 1
    r.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    rows += [(900, None), (901, ""), (902, "One two"), (903, "one TWO"), (904, "one"), (905, rows[0][1])]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dup.near_duplicates(frame(spark, rows), width, percent).collect()}
    want = groups(rows, width, percent)
    assert {k: v for k, v in got.items() if v[0]} == {k: v for k, v in want.items() if v[0]}
    assert got[900] == (0, 900) and got[901] == (0, 901)


def test_near_duplicate_edges(spark):
    assert near_dup.near_duplicates(frame(spark, []).limit(0)).count() == 0
    got = near_dup.near_duplicates(frame(spark, [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [
        ("7", "7", True), ("7", "7", True), ("None", "None", True)]


# ---------------------------------------------------------------- personal data

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def right(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def spans(t):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, t) if right(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_base_spans_match_the_plain_patterns(spark):
    r = random.Random(6)
    bits = ["a", "b.", "@", "1", "22", "255", ".", "+", "-", " ", "(", "é", "😀", "4111 1111 1111 1111", "x@y.z", "1.2.3.4", "%", "\n",
            "+1 (704) 555-4709"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 50)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "1 " * 5000), (1003, "a" * 20000 + "@"), (1004, "1.2.3.4 " * 1500), (1004, "1.2.3.4 " * 1500)]
    texts = {i: t or "" for i, t in rows}
    got = pii.pii_digest(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for x in got:
        want = spans(texts[x["doc_id"]])
        assert x["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(x["spans"].split(","))


def test_patterns_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"Please reach host address 10.1.{i}.7 for this") for i in range(12)]
    rows += [(100, "Please reach host address 10.1.999.7 for this"), (101, "some other words 10.1.998.7 for this")]
    got = {r["doc_id"]: r["spans"] for r in pii.pii_digest(frame(spark, rows)).collect()}
    assert got[100] == "id:26:36" and got[101] == "" and got[3] == "ip:26:34"


def test_mask_replaces_spans_and_keeps_columns(spark):
    df = frame(spark, [(1, "mail a@b.cd, or 1.2.3.4!"), (2, "none"), (None, None), (3, "é +49 170 1234567")])
    out = pii.mask(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "mail [EMAIL], or [IP]!", 2: "none", None: None, 3: "é [PHONE]"}
    assert pii.mask(df.limit(0)).count() == 0


# ---------------------------------------------------------------- decontamination

def test_leaks_match_brute_force(spark):
    r = random.Random(9)
    word = lambda: "w%d" % r.randint(0, 400)
    items = [[word() for _ in range(r.randint(12, 60))] for _ in range(8)] + [["too", "short"]]
    docs = []
    for i in range(40):
        text = [word() for _ in range(r.randint(0, 120))]
        if i % 3 == 0:
            item = list(items[i % 8])
            if i % 2 and len(item) > 40:
                item[len(item) // 2] = "edited"
            k = r.randint(0, len(text))
            text = text[:k] + item + text[k:]
        docs.append((i, " ".join(text).capitalize() + "."))
    docs += [(100, None), (101, ""), (102, " ".join(items[0][:6])), (None, " ".join(items[1])), (103, " ".join(items[1])), (103, " ".join(items[1]))]
    runs = lambda w: [tuple(w[k:k + 5]) for k in range(len(w) - 4)]

    def bag(w):
        seen, out = {}, set()
        for x in runs(w):
            seen[x] = seen.get(x, 0) + 1
            out.add((x, seen[x]))
        return out
    want = set()
    for i, t in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for k, item in enumerate(items):
            b = bag(item)
            if any(b and len(b & bag(w[s:s + len(item)])) >= 0.8 * len(b | bag(w[s:s + len(item)]))
                   for s in range(max(1, len(w) - len(item) + 1))):
                want.add((i, k))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(None, "a b c d e f"), (50, None)], "item_id long, text string")
    df = frame(spark, docs)
    got = decontaminate.leaks(df, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(got) == len(want)
    left = decontaminate.remove(df, bench)
    assert left.columns == df.columns and left.count() == len(docs) - sum(any(i == x for x, _ in want) for i, _ in docs)
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_blocks_hold_every_fingerprint_within_the_radius():
    r = random.Random(2)
    for _ in range(300):
        diff = sum(1 << b for b in r.sample(range(64), r.randint(0, decontaminate.RADIUS)))
        parts = [(diff >> (16 * k)) & 0xFFFF for k in range(decontaminate.BLOCKS)]
        assert any(x in set(decontaminate.FLIPS) for x in parts)


# ---------------------------------------------------------------- chat

SCHEMAS = {"f": {"type": "object", "required": ["x"], "additionalProperties": False,
                 "properties": {"x": {"type": "integer", "minimum": 1}, "y": {"type": "array", "items": {"type": "string"}}}}}


def test_chat_links_orders_and_validates(spark):
    import json
    call = lambda i, args, name="f": {"id": i, "name": name, "arguments": args}
    rows = [(1, 0, "user", "hi é", None, None),
            (1, 1, "assistant", "", json.dumps([call("a", {"x": {"$call": "b"}}), call("e", {"x": 1})]), None),
            (1, 2, "assistant", "", json.dumps([call("b", {"y": ["q"], "x": 3})]), None),
            (1, 3, "tool", "ra", None, "a"), (1, 4, "tool", "rb", None, "b"), (1, 5, "tool", "rb again", None, "b"),
            (1, 6, "tool", "lost", None, "zz"),
            (2, 0, "assistant", None, json.dumps([call("a", {"x": {"$call": "c"}}), call("c", {"x": {"$call": "a"}}), call("d", {"x": {"$call": "a"}})]), None),
            (2, 1, "assistant", None, json.dumps([call("g", {"x": 0, "z": 1}), call("h", {}, "no"), call("g", {"x": 2}), call("i", {"x": {"$call": "?"}})]), None),
            (None, None, None, None, "not json", None)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tool_calls string, call_id string")
    m = m.selectExpr("*", "1 AS item", "'z' AS line", "0 AS depth")
    got = chat.format_chat(m, SCHEMAS).collect()
    at = {(r["conv_id"], r["kind"], r["id"], r["turn"], r["item"]): r for r in got}
    assert (at[1, "call", "a", 1, 0]["after_turn"], at[1, "call", "a", 1, 0]["depth"]) == (2, 1)
    assert at[1, "call", "b", 2, 0]["fault"] is None and at[1, "call", "e", 1, 1]["fault"] == "no result"
    assert at[1, "result", "b", 5, 0]["fault"] == "repeated result" and at[1, "result", "zz", 6, 0]["fault"] == "no call"
    assert {at[2, "call", i, 0, k]["fault"] for k, i in enumerate("acd")} == {"cycle"}
    assert at[2, "call", "g", 1, 0]["fault"] == ".x: below minimum; .z: unknown" and at[2, "call", "h", 1, 1]["fault"] == "unknown tool"
    assert at[2, "call", "g", 1, 2]["fault"] == "repeated id" and at[2, "call", "i", 1, 3]["fault"] == "unknown call"
    assert at[1, "call", "b", 2, 0]["line"] == '{"role":"assistant","tool_call":{"arguments":{"x":3,"y":["q"]},"id":"b","name":"f"}}'
    assert any(r["fault"] == "malformed calls" for r in got)
    order = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["after_turn"], r["depth"], r["turn"], r["item"]))
    ids = [(r["kind"], r["id"]) for r in order]
    assert ids.index(("call", "b")) < ids.index(("call", "a")) < ids.index(("result", "a"))
    assert chat.format_chat(m.limit(0), SCHEMAS).count() == 0


# ---------------------------------------------------------------- quality classifier

def test_sparse_sites_shrink_and_labels_are_learnt(spark):
    good = "plain words that make up a normal sentence here, and some more of them. " * 4
    bad = "### $$$ *** buy | now | cheap | !!! " * 6
    rows = [(i, bad if i % 4 == 0 else good + str(i), f"h{i % 3}", "p") for i in range(120)]
    rows += [(500, bad, "new", None), (501, good, None, "p"), (502, None, None, None), (502, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS p", "'k' AS host", "0 AS fingerprint")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 120, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = quality_model.quality(df, labels)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    assert all(got[i]["kept"] == (i % 4 != 0) for i in range(120)) and not got[500]["kept"] and got[501]["kept"]
    overall = sum(r["p"] for r in out.collect()) / len(rows)
    assert abs(got[500]["site"] - overall) < 0.15  # one document says little about its site
    left = quality_model.good(df, labels)
    assert left.columns == df.columns and 0 not in {r["doc_id"] for r in left.collect()}
    assert quality_model.quality(df.limit(0), labels).count() == 0
    assert all(r["kept"] for r in quality_model.quality(df, labels.limit(0)).collect())
