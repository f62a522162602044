import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdial.functions import canon
from loomdial.functions.lenient import coerce, first_array, json_or_literal, parse_lenient
from loomdial.functions.registry import get, register
from loomdial.functions.text import id_key, strip
from loomdial.operators import dialogue
from loomdial.sources import readers, writers
from loomdial.streaming.ingest import append_to, once_within, stream_files
from loomdial.streaming.simulate import simulate


def one(spark, c, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(c(F.col("v"))).collect()]


def test_id_key(spark):
    assert one(spark, id_key, "Topic 7", "topic-007", " TOPIC_７", "topic７", None, " ", "0") == ["topic7"] * 4 + [None, None, "0"]


def test_small_functions(spark):
    assert one(spark, strip, "​　a b ") == ["a b"]
    assert one(spark, canon.model_name, "G010", "g12", "dpo5", " x ") == ["g10", "g12", "dpo_5", "x"]
    assert one(spark, canon.is_ablation, "G010", "g12", "g0") == [True, False, False]
    assert one(spark, canon.score_from_display, "35.00%", "0.7", "", "x", " 5% ") == [0.35, 0.7, 0.0, 0.0, 0.05]
    assert one(spark, canon.strip_state_label, "（2）状态\n你好", "你好") == ["你好", "你好"]
    assert one(spark, canon.clean_url, " http://h/v1/chat/completions ", "http://h/v1//", " ") == ["http://h/v1", "http://h/v1", None]
    assert one(spark, canon.parse_flag, "Yes", "off", "maybe") == [True, False, None]
    assert one(spark, canon.bloom_level, "分析（Analyze）", "记住", "", None, "x") == [4, 1, 0, 0, 0]
    assert one(spark, canon.canonical_intent, "检测理解", "引发迁移", None) == ["check_understanding", None, None]
    assert one(spark, lambda c: canon.toggle_item(c, "追问"), "追问，提示", "提示", None) == ["提示", "提示,追问", "追问"]
    assert one(spark, canon.display_text, "好[结束]", "[结束]") == ["好", "（对话已结束）"]


def test_rolling_hash_against_a_loop(spark):
    def js(text):
        h = 0
        units = text.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = (h * 31 + units[i] * 256 + units[i + 1]) & 0xFFFFFFFF
        h = abs(h - (1 << 32) if h >= 1 << 31 else h)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"
        out = ""
        while h:
            out, h = digits[h % 36] + out, h // 36
        return out or "0"

    texts = ["", "a", "对话", "x" * 50, "emoji 😀 end"]
    assert one(spark, canon.rolling_hash, *texts) == [js(t) for t in texts]


def test_messages_hash_is_that_of_json(spark):
    import hashlib

    m = [{"role": "学生", "content": '他说 "好"\n\\'}, {"role": "t", "content": "b"}]
    df = spark.createDataFrame([([(x["role"], x["content"]) for x in m],)], f"m {dialogue.MESSAGES}")
    want = hashlib.md5(json.dumps(m, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:8]
    assert df.select(canon.messages_hash(F.col("m"))).first()[0] == want


def test_lenient_json():
    assert parse_lenient("x {'a': '''q\"''', b: [1, 2,], \"c\": TRUE, 'd': '123', 'e': '1e5'} y") == {"a": 'q"', "b": [1, 2], "c": True, "d": 123, "e": 1e5}
    assert coerce("null") is None and coerce("1.5") == 1.5 and coerce("x") == "x"
    assert first_array("a [1, [2], '] x") == "[1, [2], ']"[:0] or first_array("a [1, [2]] x") == "[1, [2]]"
    assert json_or_literal("{'a': (1, None)}") == {"a": (1, None)}
    for bad in ("", "no", "{'a'", "{a 1}"):
        with pytest.raises(ValueError):
            parse_lenient(bad)


json_values = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text("abc 你\"'\\\n", max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab", min_size=1, max_size=3), x, max_size=3), max_leaves=8)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=4), json_values, max_size=4))
def test_lenient_reads_strict_json(value):
    assert parse_lenient(json.dumps(value)) == value


def test_scan_counts_bad_lines(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.jsonl").write_text('{"topic_id": "t1"}\n\nbroken\n[{"topic_id": "x"}]\n{"topic_id": "t2"}\n')
    (tmp_path / ".hidden.jsonl").write_text('{"topic_id": "no"}\n')
    (tmp_path / "b.jsonl").write_text('{"topic_id": "t3"}\n')
    lines = readers.scan_lines(spark, str(tmp_path))
    rows, rejects = readers.parse_lines(lines, readers.SESSION)
    assert sorted(r["topic_id"] for r in rows.collect()) == ["t1", "t2", "t3"]
    assert sorted(r["reason"] for r in rejects.collect()) == ["json_errors", "schema_error"]
    assert [r["topic_id"] for r in readers.whole_file_rows(lines, readers.SESSION).collect()] == ["t3"]
    assert readers.scan_lines(spark, str(tmp_path / "none")).count() == 0
    assert readers.nonblank_count(spark, str(tmp_path / "sub" / "a.jsonl")) == 4


def test_round_trip_and_defaults(spark, tmp_path, data):
    s = spark.read.parquet(f"{data}/sessions.parquet").select(*[c.split(" ")[0] for c in "student_id student_type scenario topic_id topic_text repeat_id dialogue annotations quality_score".split()])
    writers.write_jsonl(s, str(tmp_path / "out"))
    assert readers.read_sessions(spark, str(tmp_path / "out")).count() == s.count()
    (tmp_path / "one.json").write_text('[{"topic_id": "a"}, {"quality_score": 0.5}]')
    got = readers.read_sessions(spark, str(tmp_path / "one.json")).collect()
    assert [(r["topic_id"], r["quality_score"], r["dialogue"]) for r in got] == [("a", 0.0, []), ("", 0.5, [])]


def test_append_new_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    path = str(tmp_path / "log")
    assert writers.append_new(df, path, "k") == 2
    assert writers.append_new(df, path, "k") == 0


def test_parts_are_written(spark, tmp_path):
    df = spark.createDataFrame([("f", i, "x" * 50) for i in range(10)], "file string, ord int, body string")
    writers.write_parts(df, str(tmp_path / "p"), "file", "ord", 200)
    assert spark.read.text(str(tmp_path / "p")).select("part").distinct().count() > 1


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("x/final/g01/run.jsonl", '{"a": 1}\nbad\n{"a": 2}\n')
        z.writestr("metrics/g1.json", "{}")
        z.writestr("metrics/g1_per_file_metrics/run_metrics.json", "[]")
        z.writestr("__MACOSX/final/g1/run.jsonl", "{}")
    e = readers.read_archives(spark, str(tmp_path))
    kinds = sorted(r[0] for r in e.select(readers.tree_kind(F.col("path"))["kind"]).where("1=1").collect() if r[0])
    assert kinds == ["detail", "final", "summary"]
    assert [(r["model"], r["file"], r["row_index"]) for r in readers.final_rows(e).orderBy("row_index").collect()] == [("g01", "run", 0), ("g01", "run", 1)]


def test_metric_entry(spark):
    got = one(spark, readers.metric_entry, '{"score": 0.5, "display": "50%", "raw_value": 2}', "0.25", '"35.00%"', None)
    assert [r["score"] for r in got] == [0.5, 0.25, 0.35, 0.0] and got[0]["raw_value"] == 2


def test_shape_sniffing(spark):
    assert readers.shape(spark.createDataFrame([], readers.DPO)) == "dpo"
    assert readers.shape(spark.createDataFrame([], readers.NESTED)) == "nested"
    assert readers.shape(spark.createDataFrame([], readers.FLAT)) == "flat"
    with pytest.raises(ValueError):
        readers.shape(spark.range(1))


def test_external_answers(spark):
    rows = [("q", "in", "long enough answer"), ("q", None, "short"), (None, None, "long enough answer")]
    got = readers.external_answers(spark.createDataFrame(rows, "instruction string, input string, output string"), "ext").collect()
    assert [r["prompt"][0]["content"] for r in got] == ["q\nin"]


def test_registry():
    with pytest.raises(ValueError):
        get("no such metric")
    with pytest.warns(UserWarning):
        register("length")(get("length"))


def test_simulation_stops(spark):
    df = spark.createDataFrame([(1, [("user", "hi")]), (2, [])], f"id int, history {dialogue.MESSAGES}")
    got = {r["id"]: (len(r["history"]), r["active"]) for r in simulate(df, budget=8).collect()}
    assert got[1] == (7, False) and got[2] == (7, False)
    assert {r["active"] for r in simulate(df, budget=2).collect()} == {True}

    def broken(h, r):
        raise RuntimeError("down")

    assert {r["error"] for r in simulate(df, broken, 3).collect()} == {"down"}


def test_stream_keeps_each_session_once(spark, tmp_path, data):
    src = tmp_path / "in"
    s = spark.read.parquet(f"{data}/sessions.parquet").select("session_no", "topic_id", "ingested_at")
    s.repartition(3).write.parquet(str(src))
    q = append_to(once_within(stream_files(spark, str(src), s.schema), "session_no", "ingested_at", "3650 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("session_no").distinct().count() == s.select("session_no").distinct().count()
