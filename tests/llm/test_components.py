"""Components from groups made earlier, against plain union-find."""

import random

import pytest

from wardline.llm import near_dup


def brute(labels: dict, links: list) -> dict:
    top = {n: n for n in labels}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in [*labels.items(), *links]:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return {n: find(n) for n in labels}


def given(seed: int) -> tuple[dict, list]:
    """Groups held together by labels alone, and a few links between nodes."""
    rng = random.Random(seed)
    nodes = rng.sample(range(1000), 60)
    labels = {}
    while nodes:
        part = [nodes.pop() for _ in range(min(len(nodes), rng.randint(1, 6)))]
        labels |= {n: min(part) for n in part}
    return labels, [tuple(sorted(rng.sample(sorted(labels), 2), reverse=True)) for _ in range(rng.randint(0, 18))]


def advised() -> tuple[dict, list]:
    return {20: 20, 21: 20, 22: 20, 10: 10, 11: 10, 0: 0, 1: 0}, [(21, 11), (22, 1)]


@pytest.mark.parametrize("case", [advised(), *[given(k) for k in range(5)]])
def test_groups_made_earlier_stay_whole(spark, case):
    labels, links = case
    nodes = spark.createDataFrame(list(labels.items()), "node long, label long")
    edges = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["label"] for r in near_dup.components(nodes, edges).collect()}
    assert got == brute(labels, links)
