import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdial.llm.neardup import BKTree, NearDuplicates, _search, radius
from loomdial.llm.splits import assign_splits, components, linked_topics, split_records


def runs(t):
    return {t[i : i + 5] for i in range(len(t) - 4)}


def alike(rows, threshold=0.6):
    rows = sorted({r for r in rows if r[0] is not None and r[1]})
    out = set()
    for k, (i, a) in enumerate(rows):
        for j, b in rows[k + 1 :]:
            x, y = runs(a), runs(b)
            if i != j and x and y and len(x & y) >= threshold * len(x | y):
                out.add((i, j))
    return out


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        p = rng.randrange(len(t))
        t[p : p + 1] = rng.choice([[], [rng.choice("甲乙丙丁")], [t[p], "戊"]])
    return "".join(t)


def corpus(rng, n=120):
    letters = [chr(0x4E00 + i) for i in range(300)]
    rows = []
    for i in range(n):
        base = "".join(rng.choice(letters) for _ in range(rng.randrange(40, 200)))
        rows.append((len(rows), base))
        for _ in range(rng.randrange(3)):
            rows.append((len(rows), edited(rng, base, rng.randrange(0, len(base) // 12 + 1))))
    return [*rows, (len(rows), ""), (len(rows) + 1, "短"), (None, rows[0][1]), (len(rows) + 2, None), rows[5]]


def test_bk_tree_finds_all_within_the_radius(rng):
    numbers = [rng.getrandbits(192) for _ in range(200)]
    numbers += [n ^ sum(1 << rng.randrange(192) for _ in range(20)) for n in numbers[:100]]
    tree = BKTree()
    for i, n in enumerate(numbers):
        tree.add(n, i)
    for q in numbers[:40]:
        assert set(tree.within(q, 60)) == {i for i, n in enumerate(numbers) if (n ^ q).bit_count() <= 60}


def test_blocks_are_compared_with_each_other_only():
    prints = np.zeros((4, 3), dtype=np.int64)
    assert len(_search([1, 2, 3, 4], prints, np.array([-1] * 4), 5)) == 6
    assert {tuple(sorted(p)) for p in _search([1, 2, 3, 4], prints, np.array([0, 0, 1, 1]), 5)} == {(1, 3), (1, 4), (2, 3), (2, 4)}
    assert 50 < radius(0.6) < 80


def test_pairs_against_brute_force(spark, rng):
    rows = corpus(rng)
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {(r["id_a"], r["id_b"]) for r in NearDuplicates(df).pairs().collect()}
    assert got == alike(rows)


def test_hot_shards_are_split(spark, rng, monkeypatch):
    monkeypatch.setattr("loomdial.llm.neardup.BLOCK", 4)
    monkeypatch.setattr("loomdial.llm.neardup._SAMPLE", 1)
    base = "".join(chr(0x4E00 + rng.randrange(300)) for _ in range(150))
    rows = [(i, edited(rng, base, 4)) for i in range(40)] + [(100 + i, base) for i in range(20)]
    n = NearDuplicates(spark.createDataFrame(rows, "id bigint, text string"))
    assert n.hot.count() > 0
    assert {(r["id_a"], r["id_b"]) for r in n.pairs().collect()} == alike(rows)
    assert n.classes().where("id >= 100").select("representative").distinct().count() == 1
    assert n.groups().select("group").distinct().count() == 1


def test_no_records(spark):
    n = NearDuplicates(spark.createDataFrame([], "id bigint, text string"))
    assert n.pairs().count() == 0 and n.groups().count() == 0


@pytest.mark.parametrize("kind", ["random", "chain", "star", "clusters"])
def test_components_against_union_find(spark, kind):
    rng = random.Random(3)
    edges = {
        "random": [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(110)],
        "chain": [(f"n{i}", f"n{i + 1}") for i in range(60)],
        "star": [("n0", f"n{i}") for i in range(1, 80)],
        "clusters": [(f"{c}_{i}", f"{c}_{j}") for c in range(6) for i in range(5) for j in range(i)],
    }[kind] + [("x", None), (None, "y"), ("z", "z")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            parent[find(a)] = find(b)
    want = {}
    for x in parent:
        want.setdefault(find(x), set()).add(x)
    got = {}
    for r in components(spark.createDataFrame(edges, "a string, b string")).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(k == min(v) for k, v in got.items())


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


FLAT = "row_no bigint, conv_id string, single_turn_metadata map<string,string>"
ROWS = [
    (1, "c1", {"topic_id": "topic_1"}), (2, " C1 ", {"topic_id": "Topic 02"}), (3, "c2", {"topic_id": "topic_2"}), (4, "c2", {"topic_id": "topic_3"}), (5, "c3", {"topic_id": "topic_9"}),
    (6, "ext", {"source": "x"}), (7, "ext", None), (8, None, None), (9, "c3", {}), (1, "c1", {"topic_id": "topic_1"}),
]


def test_linked_topics(spark):
    flat = spark.createDataFrame(ROWS, FLAT)
    topics = spark.createDataFrame([("topic_1",), ("topic_2",), ("topic_3",), ("topic_9",), (None,)], "topic_id string")
    assert sorted((r[0], r[1]) for r in linked_topics(flat, topics).collect()) == [("topic_1", "topic_2"), ("topic_1", "topic_3"), ("topic_2", "topic_3")]
    assert linked_topics(flat.limit(0), topics).count() == 0


def test_split_keeps_related_rows_together(spark):
    flat = spark.createDataFrame(ROWS, FLAT)
    s = spark.createDataFrame([(1, "TOPIC-3"), (2, "topic_9"), (3, None)], "session_no bigint, topic_id string")
    got = {(r["table_name"], r["row_no"]): (r["group"], r["split"]) for r in split_records(flat, s).collect()}
    assert len(got) == 12
    assert len({got["flat_rows", i] for i in (1, 2, 3, 4)} | {got["sessions", 1]}) == 1
    assert got["flat_rows", 5] == got["flat_rows", 9] == got["sessions", 2]
    assert got["flat_rows", 6] == got["flat_rows", 7]


def test_split_shares(spark):
    g = spark.range(4000).select(F.col("id").cast("string").alias("group"), F.lit(3).cast("bigint").alias("n"))
    got = {r["split"]: r["s"] / 12000 for r in assign_splits(g, (("train", 0.8), ("validation", 0.1), ("test", 0.1))).groupBy("split").agg(F.sum("n").alias("s")).collect()}
    assert got["train"] == pytest.approx(0.8, abs=0.01) and got["test"] == pytest.approx(0.1, abs=0.01)
    assert assign_splits(g.limit(0)).count() == 0
