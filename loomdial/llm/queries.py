"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdial.llm.canonical import canonical_values, unmatched_values
from loomdial.llm.defects import answer_defects
from loomdial.llm.leaks import clean_documents, leaks
from loomdial.llm.mixing import Mixture
from loomdial.llm.neardup import similar_sessions
from loomdial.llm.sampling import session_sample
from loomdial.llm.splits import linked_topics, split_records
from loomdial.llm.subjects import SubjectClassifier, composition
from loomdial.session import read


def _sample(spark, d):
    return session_sample(read(spark, d, "sessions"), read(spark, d, "sample_targets"))


def p1_found(spark, d):
    return _sample(spark, d).shortfalls().select("target_id")


def p1_sample(spark, d):
    return _sample(spark, d).sample()


def p1_report(spark, d):
    return _sample(spark, d).report()


def p2_found(spark, d):
    return canonical_values(read(spark, d, "sessions"), read(spark, d, "vocabulary")).select("session_no", "ann_no", "field_name", "pos", "vocab_id")


def p2_unmatched(spark, d):
    return unmatched_values(read(spark, d, "sessions"), read(spark, d, "vocabulary"))


def p4_found(spark, d):
    found = answer_defects(read(spark, d, "flat_rows"), read(spark, d, "dpo_pairs"))
    return found.select("table_name", "row_no", "field_name", F.element_at("defects", 1).alias("defect"))


def p4_all(spark, d):
    found = answer_defects(read(spark, d, "flat_rows"), read(spark, d, "dpo_pairs"))
    return found.select("table_name", "row_no", "field_name", F.explode("defects").alias("defect"))


def p5_found(spark, d):
    pairs = similar_sessions(read(spark, d, "sessions")).pairs()
    return pairs.select(F.col("id_a").alias("session_a"), F.col("id_b").alias("session_b"))


def p5_groups(spark, d):
    groups = similar_sessions(read(spark, d, "sessions")).groups()
    return groups.select(F.col("id").alias("session_no"), "representative", "group")


def p6_found(spark, d):
    return linked_topics(read(spark, d, "flat_rows"), read(spark, d, "topics"))


def p6_splits(spark, d):
    return split_records(read(spark, d, "flat_rows"), read(spark, d, "sessions")).select("table_name", "row_no", "split")


def p7_found(spark, d):
    return leaks(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p7_matches(spark, d):
    return leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p7_clean(spark, d):
    return clean_documents(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "source")


def _mixture(spark, d):
    return Mixture(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p8_found(spark, d):
    return _mixture(spark, d).shortfalls()


def p8_mixture(spark, d):
    return _mixture(spark, d).mixture().select("doc_id", "source", "copy_no", "n_tokens", "mix_key")


def p8_report(spark, d):
    return _mixture(spark, d).report()


def _assigned(spark, d):
    documents = read(spark, d, "documents")
    return SubjectClassifier(documents, read(spark, d, "subject_labels"), read(spark, d, "subject_areas")).assign(documents)


def p9_found(spark, d):
    return _assigned(spark, d).select("doc_id", "subject_id").distinct()


def p9_composition(spark, d):
    return composition(_assigned(spark, d).select("doc_id", "subject_id").distinct(), read(spark, d, "documents").select("doc_id").distinct())


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "p" and k[1].isdigit()}

# --- SQL of the queries that SQL can express, for DuckDB

# Fixed values, written out here so that the SQL does not depend on the operators.
UNKNOWN = ("未知", "未记录", "不详", "无", "暂无", "未填", "未定", "unknown", "na", "none", "null")
TRADITIONAL = "優識學習導問設語層點類憶應創價評誤錯檢測總結發遷勵開觀動時長師題說課講讀寫話對錯達難階無複饋確認記錄進論證據斷聯繫統義現實驗標準過這個們來為與後裡還會嗎讓從將當經變關係圖書館體號計備務啟維"
SIMPLIFIED = "优识学习导问设语层点类忆应创价评误错检测总结发迁励开观动时长师题说课讲读写话对错达难阶无复馈确认记录进论证据断联系统义现实验标准过这个们来为与后里还会吗让从将当经变关系图书馆体号计备务启维"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = ("".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ").replace("'", "''")


def _id(c: str) -> str:
    bare = f"regexp_replace(lower(translate({c}, '{_WIDE}', '{_NARROW}')), '[\\s_\\-]+', '', 'g')"
    return f"nullif(regexp_replace({bare}, '([^0-9]|^)0+([0-9])', '\\1\\2', 'g'), '')"


def _label(c: str) -> str:
    k = f"regexp_replace(translate(lower(translate({c}, '{_WIDE}', '{_NARROW}')), '{TRADITIONAL}', '{SIMPLIFIED}'), '[\\s]+', '', 'g')"
    k = f"regexp_replace({k}, '^[“”\"\\[【]*(场景)?([(（]?[0-9]{{1,2}}[)）]?[.、:：,，]?|[①-⑳])', '')"
    k = f"regexp_replace({k}, '[^一-龥a-z0-9]', '', 'g')"
    k = f"regexp_replace(regexp_replace(regexp_replace({k}, '的?学生$', ''), '^学生', ''), '型$', '')"
    return f"CASE WHEN {k} NOT IN ('', {', '.join(repr(u) for u in UNKNOWN)}) THEN {k} END"


_ONCE = "(SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY {1} ORDER BY ingested_at) = 1)"
_LINKS = f"""
e AS (SELECT DISTINCT {_id('conv_id')} AS c, {_id("single_turn_metadata['topic_id']")} AS t FROM flat_rows),
l AS (SELECT DISTINCT a.t AS x, b.t AS y FROM e a JOIN e b USING (c) WHERE a.t <> b.t),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT {_id('topic_id')} AS k, min(topic_id) AS topic_id FROM topics GROUP BY 1)"""

ORACLE: dict[str, str] = {
    "p1_found": f"""
WITH s AS (SELECT {_label('student_type')} AS ty, {_label('scenario')} AS sc, {_id('topic_id')} AS tp FROM {_ONCE.format('sessions', 'session_no')}),
t AS (SELECT target_id, target_permille, min_rows, student_type IS NULL AS ny, scenario IS NULL AS ns, topic_id IS NULL AS nt, {_label('student_type')} AS ty, {_label('scenario')} AS sc, {_id('topic_id')} AS tp FROM sample_targets)
SELECT target_id FROM t WHERE (SELECT count(*) FROM s WHERE (ny OR s.ty = t.ty) AND (ns OR s.sc = t.sc) AND (nt OR s.tp = t.tp))
  < greatest(min_rows, ceil(target_permille * floor((SELECT count(*) FROM s) / 5) / 1000.0))""",
    "p5_found": f"""
WITH s AS (SELECT session_no, regexp_replace(lower(array_to_string(list_transform(dialogue, lambda q: coalesce(q.content, '')), '')), '[^一-龥a-z0-9]', '', 'g') AS x FROM {_ONCE.format('sessions', 'session_no')}),
g AS (SELECT session_no, unnest(list_distinct(list_transform(range(1, len(x) - 3), lambda i: x[i:i + 4]))) AS r FROM s WHERE length(x) >= 5),
n AS (SELECT session_no, count(*) AS n FROM g GROUP BY 1),
b AS (SELECT a.session_no AS session_a, b.session_no AS session_b, count(*) AS c FROM g a JOIN g b ON a.r = b.r AND a.session_no < b.session_no GROUP BY 1, 2)
SELECT session_a, session_b FROM b JOIN n na ON na.session_no = session_a JOIN n nb ON nb.session_no = session_b WHERE c >= 0.6 * (na.n + nb.n - c)""",
    "p6_found": f"WITH RECURSIVE {_LINKS} SELECT DISTINCT a.topic_id AS topic_a, b.topic_id AS topic_b FROM r JOIN n a ON a.k = r.x JOIN n b ON b.k = r.y WHERE a.topic_id < b.topic_id",
    # no case depends on the tokenizer, so characters stand for tokens here
    "p8_found": """
WITH d AS (SELECT source, sum(length(text)) AS t FROM documents WHERE source IN (SELECT source FROM mix_targets) GROUP BY 1)
SELECT m.source FROM mix_targets m LEFT JOIN d USING (source) WHERE coalesce(d.t, 0) * max_repeats * 1000 < weight_permille * (SELECT sum(t) FROM d)""",
}
ORACLE["p1_report"] = (
    ORACLE["p1_found"].split("SELECT target_id FROM t WHERE")[0].replace("SELECT target_id, target_permille,", "SELECT target_id, target_set, target_permille,")
    + """, p AS (SELECT target_id, target_set, target_permille, min_rows, (SELECT floor(count(*) / 5)::BIGINT FROM s) AS sample_size,
  (SELECT count(*) FROM s WHERE (ny OR s.ty = t.ty) AND (ns OR s.sc = t.sc) AND (nt OR s.tp = t.tp)) AS available FROM t),
n AS (SELECT *, greatest(min_rows, ceil(target_permille * sample_size / 1000.0))::BIGINT AS needed FROM p)
SELECT *, least(needed, available) AS taken, available < needed AS short, round(least(needed, available) * 1000.0 / sum(least(needed, available)) OVER (PARTITION BY target_set), 3) AS reached_permille FROM n"""
)
ORACLE["p5_groups"] = f"""
WITH RECURSIVE pr AS ({ORACLE['p5_found']}),
c AS (SELECT session_no, min(session_no) OVER (PARTITION BY x) AS representative FROM
  (SELECT session_no, regexp_replace(lower(array_to_string(list_transform(dialogue, lambda q: coalesce(q.content, '')), '')), '[^一-龥a-z0-9]', '', 'g') AS x FROM {_ONCE.format('sessions', 'session_no')}) WHERE length(x) >= 5),
l AS (SELECT DISTINCT a.representative AS x, b.representative AS y FROM pr JOIN c a ON a.session_no = session_a JOIN c b ON b.session_no = session_b),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
g AS (SELECT x, min(y) AS y FROM r GROUP BY 1)
SELECT session_no, representative, coalesce(least(g.y, representative), representative) AS "group" FROM c LEFT JOIN g ON g.x = representative"""
