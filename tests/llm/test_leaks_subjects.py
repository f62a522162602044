import random

import numpy as np
import pytest

from loomdial.llm.leaks import Items, SuffixArray, clean_documents, leaks, quoted, seed_length, suffix_matches, windows
from loomdial.llm.subjects import SubjectClassifier, composition, features

LETTERS = [chr(0x4E00 + i) for i in range(400)]


def text(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


@pytest.mark.parametrize("most", [4_000_000, 7])
def test_suffix_matches_against_find(rng, monkeypatch, most):
    """Every place of every seed, for items of all lengths, whole or in small parts."""
    monkeypatch.setattr("loomdial.llm.leaks.MATCHES", most)
    docs = [text(rng, 60) for _ in range(5)] + ["", "短", "哈" * 90, "ab" * 40]
    items = [docs[0][10:40], docs[1][5:20] + text(rng, 10), text(rng, 20), docs[0][12:25], docs[2][:9], docs[3] * 2, "哈" * 40, "ab" * 9, "短短短短"]
    parts = list(suffix_matches(SuffixArray(docs), Items.of(list(enumerate(items)))))
    found = [m for part in parts for m in zip(*(x.tolist() for x in part))]
    n = [seed_length(len(t), 0.5) for t in items]
    want = {(d, p, i, j) for i, t in enumerate(items[:-1]) for j in range(len(t) - n[i] + 1) for d, s in enumerate(docs) for p in range(len(s) - n[i] + 1) if s[p : p + n[i]] == t[j : j + n[i]]}
    assert set(found) == want and len(found) == len(want)
    pairs = [{m[::2] for m in zip(*(x.tolist() for x in part))} for part in parts]
    assert sum(map(len, pairs)) == len(set().union(*pairs))  # all matches of a document and an item are in one part


def test_items_of_every_script_and_short_ones(spark, rng):
    items = [
        (1, "つきのみちかけはたいようとちきゅうのいちかんけいでおこります"), (2, "Луна обращается вокруг Земли примерно за двадцать семь суток и восемь часов"), (3, "달은 지구 둘레를 돌면서 모양이 날마다 조금씩 달라져 보입니다"),
        (4, "चंद्रमा पृथ्वी के चारों ओर घूमता है और उसका आकार बदलता दिखता है"), (5, text(rng, 12)), (6, text(rng, 20)), (7, text(rng, 6)),
    ]
    docs = [(i, text(rng, 200) + "「" + t.upper() + "」" + text(rng, 100)) for i, t in items] + [(16, text(rng, 90) + items[5][1][4:16] + text(rng, 90)), (17, text(rng, 90) + items[6][1][:4])]
    df, ev = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks(df, ev).collect()} == {(i, i) for i in range(1, 8)} | {(16, 6)}


def test_alignment():
    a = "一二三四五六七八九十甲乙丙丁戊己庚辛壬癸"
    got = quoted([(a, "前" + a + "后"), (a, a[:10]), (a, a[:8] + "错" + a[9:]), (a, "毫不相干的文字"), (a, a[:9] + "多" + a[9:])])
    assert got.tolist() == [20, 10, 19, 0, 19.25]


def test_leaks_against_known_cases(spark, rng):
    items = [(i, text(rng, rng.randrange(80, 160))) for i in range(20)]
    docs, want = [], set()
    for d in range(200):
        base = text(rng, 300)
        i, item = rng.choice(items)
        kind = d % 5
        if kind == 0:
            part = item
        elif kind == 1:
            part = item[: int(len(item) * 0.65)]
        elif kind == 2:  # whole with a few characters changed, wrapped and marked
            t = list(item)
            for p in rng.sample(range(len(t)), 4):
                t[p] = rng.choice(LETTERS)
            part = "\n> ".join("".join(t)[k : k + 17] for k in range(0, len(t), 17))
        elif kind == 3:
            part = item[: int(len(item) * 0.3)]
        else:
            part = ""
        if kind < 3:
            want.add((d, i))
        docs.append((d, base[:150] + "<p>" + part + "</p>" + base[150:]))
    docs += [(900, None), (901, ""), (None, items[0][1])]
    df, ev = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*items, (77, ""), (78, None)], "item_id bigint, text string")
    found = leaks(df, ev)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    assert found.where("longest < 8").count() == 0
    assert clean_documents(df, ev).count() == len(docs) - len({d for d, _ in want})


def test_every_passage_of_an_item_is_aligned(spark, rng):
    item = text(rng, 120)
    changed = "".join("错" if k % 13 == 12 else c for k, c in enumerate(item[40:]))
    phrase = text(rng, 30)
    other = phrase + text(rng, 90)
    thinned = "".join("错" if k % 12 == 11 else c for k, c in enumerate(other))
    docs = [
        (1, item[:55] + text(rng, 300) + changed),  # the denser window falls short
        (2, changed + text(rng, 300) + item[:55]),
        (3, item[:55] + text(rng, 300)),
        (4, phrase * 20 + text(rng, 300) + thinned),  # a phrase said often is one part of the item only
        (5, phrase * 20),
    ]
    df, ev = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item), (2, other)], "item_id bigint, text string")
    found = leaks(df, ev).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 1), (2, 1), (4, 2)]
    assert {r["doc_id"]: round(r["share"] * 120) for r in found if r["item_id"] == 1} == {1: 72, 2: 72}  # the last two characters, behind a changed one, do not raise the score


def test_windows_against_all_windows(rng):
    for _ in range(200):
        n = rng.randrange(1, 40)
        p, q = np.array([rng.randrange(60) for _ in range(n)]), np.array([rng.randrange(30) for _ in range(n)])
        width, cover = rng.randrange(1, 20), rng.randrange(8, 30)
        inside = lambda low: {(int(a), int(b)) for a, b in zip(p, q) if low <= a - b <= low + width}  # noqa: E731, B023
        full = [w for w in (inside(low) for low in range(-40, 70)) if len({b + k for _, b in w for k in range(8)}) >= cover]
        want = {(min(a - b for a, b in w), max(a - b for a, b in w)) for w in full if not any(w < v for v in map(inside, range(-40, 70)))}
        assert set(windows(p, q, width, cover)) == want


def test_short_items_blocks_and_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(1, "这里有三个字吧"), (2, "没有")], "doc_id bigint, text string")
    ev = spark.createDataFrame([(1, "三个字"), (2, "四个字")], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in leaks(df, ev).collect()] == [(1, 1)]
    monkeypatch.setattr("loomdial.llm.leaks.ITEM_BLOCK", 3)
    assert [(r["doc_id"], r["item_id"]) for r in leaks(df, ev).collect()] == [(1, 1)]
    assert leaks(df.limit(0), ev).count() == 0 and leaks(df, ev.limit(0)).count() == 0


def test_width_case_and_marks_do_not_count(spark):
    ev = spark.createDataFrame([(1, "The device saved once every 66 seconds, and 2 records vanished.")], "item_id bigint, text string")
    df = spark.createDataFrame([(1, "xx THE  device saved\nonce every ６６ seconds and ２ records Vanished yy")], "doc_id bigint, text string")
    assert leaks(df, ev).count() == 1


def test_features():
    assert len(features("")) == 0 and len(features("123 !")) == 0
    assert len(features("电流")) == 1 and len(features("电流表")) == 3
    assert set(features("apple pie").tolist()) >= set(features("apple").tolist())


def subject_corpus(rng, n):
    terms = {1: ["电流", "电阻", "电压", "磁场"], 2: ["唐诗", "韵脚", "散文", "比喻句"], 3: ["solvent", "catalyst", "reaction", "alkaline"]}
    docs, labels = [], []
    for d in range(n):
        subjects = rng.sample([1, 2, 3], rng.choice([0, 1, 1, 1, 2]))
        words = [w for s in subjects for w in rng.choices(terms[s], k=12)] + [text(rng, 3) for _ in range(20)]
        rng.shuffle(words)
        docs.append((d, " ".join(words)))
        labels += [(d, s) for s in subjects] or [(d, 0)]
    return docs, labels


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(1)
    docs, labels = subject_corpus(rng, 700)
    truth = {x for x in labels if x[1]}
    df = spark.createDataFrame([*docs, (9999, None), (9998, ""), (None, "电流")], "doc_id bigint, text string")
    known = spark.createDataFrame([x for x in labels if x[0] < 500] + [(8888, 1), (None, 2), (3, 77)], "doc_id bigint, subject_id int")
    areas = spark.createDataFrame([(1,), (2,), (3,)], "subject_id int")
    c = SubjectClassifier(df, known, areas)
    got = {(r["doc_id"], r["subject_id"]) for r in c.assign(df).collect()}
    new = {x for x in got if 500 <= x[0] < 9000}
    want = {x for x in truth if x[0] >= 500}
    f1 = 2 * len(new & want) / (len(new) + len(want))
    assert f1 > 0.9, f1
    shares = {r["subject_id"]: r["documents"] for r in composition(c.assign(df), df.where("doc_id is not null")).collect()}
    assert shares[0] > 0


def test_without_labels_nothing_is_assigned(spark):
    df = spark.createDataFrame([(1, "电流")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, subject_id int")
    areas = spark.createDataFrame([(1,)], "subject_id int")
    assert SubjectClassifier(df, none, areas).assign(df).count() == 0


def test_features_of_every_script():
    for t in ("луна обращается вокруг земли", "달은 지구 둘레를 돈다", "つきはちきゅうをまわる", "الأرض تدور حول الشمس"):
        assert len(features(t)) >= 3
