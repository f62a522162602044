import random
from itertools import product
from re import _parser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdial.llm.canonical import Trie, canonical_values, limit, map_to_entries
from loomdial.llm.defects import ORDER, REFUSALS_EN, REFUSALS_OTHER, REFUSALS_ZH, is_refusal, with_defects
from loomdial.sources.readers import ANNOTATION

VOCABULARY = [(1, "f", "追问", "follow-up questioning", ["续问", "连续追问"]), (2, "f", "提示", "hint", ["启发"]), (3, "f", "引导推理", "reasoning guidance", ["引导思考"]), (4, "f", "理解", "understand", None)]


def distance(a, b):
    """Edits with adjacent transpositions, by the full table."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc追问", min_size=1, max_size=14), min_size=1, max_size=8), st.text("abc追问", min_size=1, max_size=14))
def test_automaton_against_the_full_table(names, word):
    got = Trie([(n, i) for i, n in enumerate(names)]).search(word)
    want = {}
    for i, n in enumerate(names):
        allowed = limit(min(len(n), len(word)) if max(len(n), len(word)) < 12 else max(len(n), len(word)))
        if distance(n, word) <= allowed:
            want[i] = distance(n, word)
    assert got == want


@pytest.mark.parametrize(
    ("value", "entry"),
    [("追问", 1), ("追文", 1), ("迫问", 1), ("追 问", 1), ("追​问", 1), ("追問", 1), ("追问（课堂）", 1), ("主要是追问", 1), ("追问为主", 1), ("#续问", 1), ("FOLLOW-UP  QUESTIONING", 1), ("follow_up_questioning", 1),
     ("folow-up questioinng", 1), ("提示(hint)", 2), ("hnit", 2), ("analogy-提示", 2), ("引导推", 3), ("引推导理", 3), ("提示1", 2), ("理解層", 4), ("点名", 0), ("todo", 0), ("", 0), (None, 0), ("。", 0)],
)
def test_values(spark, value, entry):
    v = spark.createDataFrame(VOCABULARY, "vocab_id int, field_name string, label_zh string, label_en string, aliases array<string>")
    df = spark.createDataFrame([("f", value, 7)], "field string, value string, vocab_id int")  # a clashing column
    assert map_to_entries(df, v, "field", "value").first()["vocab_id"] == entry


def test_ties_unknown_fields_and_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(1, "f", "甲乙", None, []), (2, "f", "甲丙", None, None)], "vocab_id int, field_name string, label_zh string, label_en string, aliases array<string>")
    df = spark.createDataFrame([("f", "甲丁"), ("g", "甲乙"), ("f", "甲乙")], "field string, value string")
    want = [0, 0, 1]
    assert [r["vocab_id"] for r in map_to_entries(df, v, "field", "value").collect()] == want
    monkeypatch.setattr("loomdial.llm.canonical.MAX_NAMES", 1)
    assert [r["vocab_id"] for r in map_to_entries(df, v, "field", "value").collect()] == want
    assert [r["vocab_id"] for r in map_to_entries(df, v.limit(0), "field", "value").collect()] == [0, 0, 0]


def test_exact_labels_and_copies_are_left_out(spark):
    v = spark.createDataFrame([(1, "teaching_strategy", "追问", "x", []), (2, "teacher_intent", "引出概念", "y", [])], "vocab_id int, field_name string, label_zh string, label_en string, aliases array<string>")
    a = [("教师", "u", ' "引出概念" ', "追问，追文,追问", "", "", "", "", "")]
    s = spark.createDataFrame([(1, a), (1, a), (2, None), (3, [])], f"session_no bigint, annotations array<{ANNOTATION}>")
    got = [(r["session_no"], r["field_name"], r["pos"], r["vocab_id"]) for r in canonical_values(s, v).collect()]
    assert got == [(1, "teaching_strategy", 1, 1)]


Q_ZH, Q_EN = "老师，为什么木板会和电流有关系？", "Is it true that friction is just a solar eclipse?"
PAIRS = [
    (Q_ZH, None, "empty"), (Q_ZH, " ​\n", "empty"), (Q_ZH, "……", "empty"), (Q_ZH, "N/A", "empty"), (Q_ZH, "**教师**：", "empty"), (Q_ZH, "[结束]", "empty"), (Q_EN, "<br>", "empty"),
    (Q_ZH, "抱歉，我没法回答这个问题。", "refusal"), (Q_ZH, "你好！根据相关规定，此类提问不予解答。", "refusal"), (Q_EN, "I'm sorry, but I can't help with that.", "refusal"), (Q_EN, "Unfortunately I must decline to talk about murals.", "refusal"),
    (Q_ZH, Q_ZH, "copied_question"), (Q_ZH, "你问的是：" + Q_ZH, "copied_question"), (Q_ZH, Q_ZH + Q_ZH, "copied_question"), (Q_EN, "You said: " + Q_EN.lower(), "copied_question"),
    (Q_ZH, "Which of the steps would you try first?", "other_language"), (Q_EN, "你会先试哪一步？", "other_language"), (Q_EN, "Halte bitte nur eine Bedingung fest.", "other_language"), (Q_ZH, "まず形をよく見て、何が変わるか教えてください。", "other_language"), (Q_EN, "Почему ты думаешь, что результат другой?", "other_language"),
    (Q_ZH, "你刚才的推理里，哪一步最需要电", "truncated"), (Q_ZH, "咱们慢一点。首先，", "truncated"), (Q_ZH, "我听明白了一半（注意这里", "truncated"), (Q_EN, "Hold that thought for a mom", "truncated"), (Q_ZH, "你能不能先猜一个…", "truncated"),
    (Q_ZH, "你会先试哪一步？可以画图。", None), (Q_ZH, "同样的道理还成立吗", None), (Q_ZH, "我不能直接告诉你结论，不过你可以先看看路灯。哪里不一样？", None), (Q_ZH, "抱歉刚才说得太快了，我们重新来。你先说说看。", None),
    (Q_ZH + "请用英语回答我。", "Which step would you try first?", None), (Q_ZH, f"你问“{Q_ZH}”，我换个问法：你觉得电流从哪里来？先画一张图再说。", None), (Q_EN, "I am unable to see your sketch, so describe it to me.", None),
    (Q_ZH, "很好，你用7个证据说明了盆地。[结束]", None), (None, "你会先试哪一步？", None),
]


def test_defect_rules(spark):
    df = spark.createDataFrame([(i, q, a) for i, (q, a, _) in enumerate(PAIRS)], "i int, q string, a string")
    got = {r["i"]: r["defects"] for r in with_defects(df).collect()}
    for i, (q, a, want) in enumerate(PAIRS):
        assert (got[i][0] if got[i] else None) == want, (q, a, got[i])
        assert got[i] == sorted(got[i], key=ORDER.index)


def test_very_long_texts(spark):
    q = "。".join(f"第{i}句话说的是不同的事" for i in range(3000)) + "。"
    df = spark.createDataFrame([(1, q, q), (2, q, "别的回答。" * 5000), (3, "短问题是什么？", q)], "i int, q string, a string")
    got = {r["i"]: list(r["defects"]) for r in with_defects(df).select("i", F.col("defects")).collect()}
    assert got == {1: ["copied_question"], 2: [], 3: []}


def phrases(pattern):
    """The texts of a regular expression: each alternative, repeats at their least and most, x for any character."""

    def expand(parts):
        return ["".join(x) for x in product(*[of(*p) for p in parts])]

    def of(op, arg):
        op = str(op)
        if op == "LITERAL":
            return [chr(arg)]
        if op in ("ANY", "NOT_LITERAL") or (op == "IN" and str(arg[0][0]) == "NEGATE"):
            return ["x"]
        if op == "IN":
            return [chr(v) for _, v in arg]
        if op == "BRANCH":
            return [t for branch in arg[1] for t in expand(branch)]
        if op == "SUBPATTERN":
            return expand(arg[-1])
        assert op == "MAX_REPEAT", op
        return [t for n in sorted({arg[0], arg[1]}) for t in expand(list(arg[2]) * n)]

    return expand(_parser.parse(pattern))


def test_every_refusal_phrase_passes_the_cheap_test(spark):
    texts = [t for p in REFUSALS_ZH + REFUSALS_EN + REFUSALS_OTHER for t in phrases(p)]
    df = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "t string")
    assert df.count() > 500
    assert [r["t"] for r in df.where(~is_refusal(F.col("t"))).collect()] == []


@pytest.mark.parametrize(
    ("q", "a"),
    [(Q_EN, "I'm sorry, but I can't assist with that."), (Q_EN, "I cannot assist with that."), (Q_EN, "I can't discuss this topic."), (Q_EN, "Sorry, I won't talk about that."), (Q_EN, "I cant assist with that."), ("왜 그럴까요?", "도와드릴 수 없어요.")],
)
def test_refusals_without_common_letters(spark, q, a):
    assert with_defects(spark.createDataFrame([(q, a)], "q string, a string")).first()["defects"][0] == "refusal"


def changed(text, every):
    return "".join("变" if k % every == every - 1 else c for k, c in enumerate(text))


def test_copies_of_any_length_and_number(spark):
    names = [chr(0x4E00 + i) for i in range(3000)]
    q = {n: "".join(names[(7 * k * k + 3 * k) % 2999] for k in range(n)) for n in (20, 590, 610, 2000)}
    english = "Is it true that friction is just a solar eclipse?"
    rows = [(q[n], "。".join(c[i : i + 15] for i in range(0, n, 15)) + "。", True) for n in q for c in [changed(q[n], 10)]]
    rows += [(q[n], changed(q[n], 3) + "。", False) for n in q] + [(q[n], q[n][: n // 2] + "。", False) for n in q]
    rows += [(q[20], (q[20] + "。") * t, True) for t in (2, 3, 4, 7)] + [(q[610], "你问的是：" + changed(q[610], 8) * 3 + "。", True)]
    rows += [(q[20], changed(q[20], 6) * 5 + "。", True), (q[20], changed(q[20], 3) * 5 + "。", False), (english, english * 3, True), (english, "You said: " + english * 5, True)]
    rows += [(english, "It is said that the moon hides the sun for a while, but is that a force at all? Rub your hands and tell me what it is that you feel.", False), ("", "你好。", False), (None, "你好。", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, q string, a string")
    got = {r["i"]: "copied_question" in r["defects"] for r in with_defects(df).collect()}
    assert [got[i] for i in range(len(rows))] == [r[2] for r in rows]


def test_copies_against_every_number_of_repetitions(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        q = "".join(rng.choice("abcdef") for _ in range(rng.randrange(4, 9)))
        a = list(q * rng.randrange(1, 6))
        for _ in range(rng.randrange(1 + len(a) // 3)):
            k = rng.randrange(len(a))
            a[k : k + 1] = rng.choice([[], [a[k], "g"], ["a"], ["h"]])
        rows.append((q, "".join(a) or "x"))

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    want = [any(edits(q * t, a) <= -(-len(q) * t * 22 // 100) for t in range(1, 40) if len(q) * t < 3 * len(a) + 9) for q, a in rows]
    df = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(rows)], "i int, q string, a string")
    got = {r["i"]: "copied_question" in r["defects"] for r in with_defects(df).collect()}
    assert 30 < sum(want) < 290 and [got[i] for i in range(len(rows))] == want


def test_rules_hold_at_any_length(spark):
    """No rule looks at a part of a text only: phrases anywhere, long glosses, many closing marks, long lead-ins, refusals without any common word."""
    q = "为什么月食不是每个月都发生，而要等到太阳、地球和月亮排成一条直线的时候才能看到呢"
    filler = "想一想这里的关系，" * 9000
    rows = [
        (Q_EN, "I may not discuss this topic with you.", "refusal"), (Q_EN, "Sorry, I cant help with that.", "refusal"), ("왜 그럴까요?", "죄송하지만 답변할 수 없어요.", "refusal"),
        (q, filler + "不过这个问题我不便讨论。" + filler + "好。", "refusal"), (q, filler + "你觉得是哪一个？（" + "原文见课本" * 40 + "）", None), (q, filler + "你觉得是哪一个？" + "”" * 60, None),
        (q, filler + "你觉得是哪一个？（" + "原文见课本" * 40, "truncated"), (q, filler, "truncated"), (q, filler + "你说呢？" + " " * 50000, None),
        (q, "刚才你提出来的那个我觉得大家都应该再仔细想一想的问题是：" + "".join(q[i] if i % 8 else "变" for i in range(len(q))) * 20 + "。", "copied_question"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, q string, a string")
    got = {r["i"]: r["defects"] for r in with_defects(df).collect()}
    for i, (_, _, want) in enumerate(rows):
        assert (want in got[i]) if want else got[i] == [], (i, got[i])
