"""SQL that an independent engine (DuckDB) runs on the same tables: name of a query -> text."""

from __future__ import annotations

# Fixed values, written out here so that the SQL does not depend on the library.
BLOOM_EXACT = {"记忆": 1, "理解": 2, "应用": 3, "分析": 4, "评价": 5, "创造": 6}
BLOOM_PATTERNS = (
    (6, "创造|生成|create|generate"),
    (5, "评价|评估|evaluate"),
    (4, "分析|分解|analyze|synthesis"),
    (3, "应用|apply|practice"),
    (2, "理解|understand|explain|interpret"),
    (1, "记忆|记住|remember|recall|identify"),
)
INTENT_PATTERNS = (
    ("introduce", "引入|引出|介绍|introduce|present|initiate|开始"),
    ("check_understanding", "检测|检查|理解|核实|understand|verify|check|assess"),
    ("guide_reasoning", "引导|推理|推导|思考|guide|reason|deduce|infer|analyze"),
    ("summarize_enhance", "总结|汇总|提升|归纳|consolidate|summarize|enhance|conclude"),
)
STRATEGY_PATTERNS = (
    ("invalid_echo", "无效复读|复读|echo|parrot|repeat"),
    ("scenario_questioning", "情境|场景|scenario|context|situate"),
    ("follow_up_questioning", "追问|续问|follow.?up|extend|further|probe"),
    ("analogies", "类比|比喻|analogies?|metaphor|simile"),
    ("hints", "提示|暗示|启发|hints?|cue|clue|suggestion"),
    ("break_down", "拆解|分解|拆分|break.?down|decompose|simplify"),
    ("encourage_responses", "鼓励|激励|正向|encourage|praise|affirm|respond"),
    ("corrective_feedback", "纠正|正误|反馈|纠|corrective?|feedback|error|wrong|incorrect"),
    ("reasoning_guidance", "引导|引发|迁移|思考|导向|guide|reason|transfer|think|infer"),
)
REQUIRED_INTENTS = ("引出概念", "引导推理", "引发迁移", "总结提升")

BL = r"[\s\x{3000}\x{a0}\x{85}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{1680}]"


def strip(c):
    return rf"regexp_replace({c}, '^{BL}+|{BL}+$', '', 'g')"


def case(c, patterns, default="NULL"):
    q = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    return "(CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{p}') THEN {q(v)}" for v, p in patterns) + f" ELSE {default} END)"


def items(c):
    return f"list_filter(list_transform(string_split(replace(coalesce({c}, ''), '，', ','), ','), lambda i: {strip('i')}), lambda i: i <> '')"


def once(table, key, cols="*"):
    return f"(SELECT {cols} FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ingested_at) = 1)"


S = f"s AS {once('sessions', 'session_no')}"
F = f"f AS {once('flat_rows', 'row_no')}"
A = f"{S}, a AS (SELECT session_no, ann_no, unnest(x) FROM (SELECT session_no, unnest(annotations) AS x, unnest(range(len(annotations))) AS ann_no FROM s))"
T = f"{S}, t AS (SELECT session_no, turn_no, role, content, score, len FROM (SELECT session_no, turn_no, len, unnest(x) FROM (SELECT session_no, len(dialogue) AS len, unnest(dialogue) AS x, unnest(range(len(dialogue))) AS turn_no FROM s)))"
TEACHER, STUDENT = "('教师','teacher','assistant')", "('学生','student','user')"
TRUE = "('是','yes','true','1')"
PARTS = ("strategy_density", "strategy_variety", "ikt", "bloom_progression", "structure_completeness", "l3_guidance_rate", "cognitive_correction_rate")
TOTAL = (
    "0.15::DOUBLE*strategy_density + 0.10::DOUBLE*strategy_variety + 0.15::DOUBLE*ikt + 0.15::DOUBLE*bloom_progression"
    " + 0.15::DOUBLE*structure_completeness + 0.10::DOUBLE*l3_guidance_rate + 0.20::DOUBLE*cognitive_correction_rate"
)
ROUNDED = ", ".join(f"round({p}, 6) AS {p}" for p in PARTS)



def _metrics_a(head, table="s"):
    return f"""
WITH {head}, k AS (SELECT *, coalesce(lower(speaker) IN {TEACHER}, false) AS te, coalesce(lower(speaker) IN {STUDENT}, false) AS st FROM a),
st AS (SELECT session_no, ann_no, {case('i', STRATEGY_PATTERNS)} AS c FROM (SELECT session_no, ann_no, unnest({items('teaching_strategy')}) AS i FROM k WHERE te)),
sc AS (SELECT session_no, count(DISTINCT ann_no) FILTER (WHERE c IS NOT NULL) AS turns, count(DISTINCT c) AS classes FROM st GROUP BY 1),
tt AS (SELECT session_no, count(*) AS n, count(*) FILTER (WHERE {strip('lower(discipline_transfer)')} IN {TRUE}) AS tr, count(*) FILTER (WHERE contains(teacher_guidance_level, 'L3')) AS l3,
  max(CASE WHEN {case('teacher_intent', INTENT_PATTERNS)} = 'introduce' THEN 1 ELSE 0 END) + max(CASE WHEN {case('teacher_intent', INTENT_PATTERNS)} = 'guide_reasoning' THEN 1 ELSE 0 END)
  + max(CASE WHEN {case('teacher_intent', INTENT_PATTERNS)} = 'summarize_enhance' THEN 1 ELSE 0 END) + max(CASE WHEN contains(teacher_intent, '迁移') OR contains(lower(teacher_intent), 'transfer') THEN 1 ELSE 0 END) AS buckets
  FROM k WHERE te GROUP BY 1),
ss AS (SELECT session_no, coalesce(max(b) - min(b), 0) AS spread, count(*) FILTER (WHERE e) AS errors, count(*) FILTER (WHERE e AND nc) AS fixed FROM (
  SELECT session_no, nullif({case('cognitive_level', BLOOM_PATTERNS, '0')}, 0) AS b, regexp_matches(coalesce(student_cognition_state, 'None'), '错误|Incorrect|Error|Vague|模糊') AS e,
  regexp_matches(lead(coalesce(student_cognition_state, 'None')) OVER (PARTITION BY session_no ORDER BY ann_no), '清晰|Clear|高阶|Higher-order') AS nc FROM k WHERE st) GROUP BY 1),
m AS (SELECT s.session_no, len(s.annotations) AS n_ann,
  CASE WHEN tt.n > 0 THEN coalesce(turns, 0) / tt.n ELSE 0.0 END::DOUBLE AS strategy_density, least(coalesce(classes, 0) / 8, 1.0)::DOUBLE AS strategy_variety,
  CASE WHEN tt.n > 0 THEN least(tr / tt.n, 1.0) ELSE 0.0 END::DOUBLE AS ikt, (coalesce(spread, 0) / 5)::DOUBLE AS bloom_progression, (coalesce(buckets, 0) / 4)::DOUBLE AS structure_completeness,
  CASE WHEN tt.n > 0 THEN l3 / tt.n ELSE 0.0 END::DOUBLE AS l3_guidance_rate, CASE WHEN coalesce(errors, 0) > 0 THEN least(fixed / errors, 1.0) ELSE 1.0 END::DOUBLE AS cognitive_correction_rate
  FROM {table} s LEFT JOIN sc USING (session_no) LEFT JOIN tt USING (session_no) LEFT JOIN ss USING (session_no))
"""


_METRICS_A = _metrics_a(A)


def _exact(split):
    used = (
        f"(SELECT session_no, count(DISTINCT i) AS classes FROM (SELECT session_no, unnest({items('teaching_strategy')}) AS i FROM a WHERE speaker = '教师') GROUP BY 1)"
        if split
        else "(SELECT session_no, count(DISTINCT teaching_strategy) FILTER (WHERE teaching_strategy <> '') AS classes FROM a WHERE speaker = '教师' GROUP BY 1)"
    )
    intent = strip("teacher_intent") if split else "teacher_intent"
    bloom = "CASE cognitive_level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in BLOOM_EXACT.items()) + " END"
    return f"""
WITH {A}, sc AS {used},
tt AS (SELECT session_no, count(*) FILTER (WHERE speaker = '教师') AS n, count(*) FILTER (WHERE discipline_transfer = '是') AS tr, count(*) FILTER (WHERE speaker = '教师' AND teacher_guidance_level = 'L3') AS l3,
  count(*) FILTER (WHERE speaker = '教师' AND teaching_strategy <> '') AS used,
  count(DISTINCT CASE WHEN speaker = '教师' AND {intent} IN {REQUIRED_INTENTS} THEN {intent} END) AS buckets FROM a GROUP BY 1),
ss AS (SELECT session_no, coalesce(max(b) - min(b), 0) AS spread, count(*) FILTER (WHERE e = '错误回答') AS errors, count(*) FILTER (WHERE e = '错误回答' AND nx IN ('高阶思考', '清晰理解')) AS fixed FROM (
  SELECT session_no, {bloom} AS b, student_cognition_state AS e, lead(student_cognition_state) OVER (PARTITION BY session_no ORDER BY ann_no) AS nx FROM a WHERE speaker = '学生') GROUP BY 1),
m AS (SELECT tt.session_no, topic_id,
  CASE WHEN n > 0 THEN used / n ELSE 0.0 END::DOUBLE AS strategy_density, (coalesce(classes, 0) / 8)::DOUBLE AS strategy_variety, CASE WHEN n > 0 THEN tr / n ELSE 0.0 END::DOUBLE AS ikt,
  (coalesce(spread, 0) / 5)::DOUBLE AS bloom_progression, (buckets / 4)::DOUBLE AS structure_completeness, CASE WHEN n > 0 THEN l3 / n ELSE 0.0 END::DOUBLE AS l3_guidance_rate,
  CASE WHEN coalesce(errors, 0) > 0 THEN fixed / errors ELSE 1.0 END::DOUBLE AS cognitive_correction_rate
  FROM tt LEFT JOIN sc USING (session_no) LEFT JOIN ss USING (session_no) LEFT JOIN s ON s.session_no = tt.session_no),
b AS (SELECT *, {TOTAL} AS total_score FROM m)
"""


B, C = _exact(False), _exact(True)
ALL = [*PARTS, "total_score"]
MEANS = ", ".join(f"round(avg({p}), 6) AS {p}" for p in ALL)

LEAK = "regexp_matches(x, '答案(是|为)|结果(是|为|等于)|正确选项|选[A-D]') OR (contains(x, '综上所述') AND turn_no < len - 1)"
_FORMAT = f"""
fr AS (SELECT session_no, arg_min(r, turn_no) AS r FROM (SELECT session_no, turn_no, CASE WHEN coalesce(lower(role), '') NOT IN ('学生','教师','teacher','student') THEN 'invalid_role_' || coalesce(role, '')
  WHEN coalesce({strip('content')}, '') = '' THEN 'empty_content' WHEN lower(role) = lag(lower(role)) OVER (PARTITION BY session_no ORDER BY turn_no) THEN 'role_repetition' END AS r FROM t) WHERE r IS NOT NULL GROUP BY 1),
ff AS (SELECT s.session_no, CASE WHEN coalesce(len(dialogue), 0) < 3 THEN 'too_short_turns' ELSE r END AS r FROM s LEFT JOIN fr USING (session_no))"""
_CONTENT = f"""
cr AS (SELECT session_no, arg_min(r, turn_no) AS r FROM (SELECT session_no, turn_no, CASE
  WHEN lower(role) IN ('教师','teacher') THEN CASE WHEN length(x) < 4 THEN 'teacher_too_short' WHEN length(x) > 800 THEN 'teacher_lecture_mode_too_long' WHEN {LEAK} THEN 'leaked_answer_pattern' END
  WHEN lower(role) IN ('学生','student') AND length(x) > 800 THEN 'student_too_verbose' END AS r FROM (SELECT *, {strip('content')} AS x FROM t)) WHERE r IS NOT NULL GROUP BY 1)"""
_SAFETY = f"""
sr AS (SELECT session_no, 'model_refusal_or_identity' AS r FROM t WHERE lower(role) IN {TEACHER}
  AND regexp_matches(content, '(?i)作为(一|名|个).*(AI|模型|程序)|As an AI language model|我(无法|不能)回答|违反.*(政策|规定)|I cannot answer|涉及.*(敏感|政治)|截止日期是') GROUP BY 1)"""


def complete(x):
    has = lambda f: f"coalesce({strip(f'{x}.{f}')} <> '', false)"
    return f"""({has('speaker')} AND {has('utterance')} AND CASE WHEN lower({x}.speaker) IN {TEACHER} THEN {has('teacher_intent')} OR {has('teaching_strategy')} OR {has('teacher_guidance_level')}
  WHEN lower({x}.speaker) IN {STUDENT} THEN {has('student_cognition_state')} OR {has('cognitive_level')} ELSE true END)"""


_METRICS_COMPLETE = _metrics_a(
    f"{T}, s1 AS (SELECT s.* REPLACE (list_filter(annotations, lambda q: {complete('q')}) AS annotations) FROM s), a AS {A.partition(', a AS ')[2].replace('FROM s))', 'FROM s1))')}", "s1"
)
_FUNNEL = f"""{_METRICS_COMPLETE}, {_FORMAT}, {_CONTENT}, {_SAFETY},
g AS (SELECT m.session_no, coalesce(ff.r, cr.r, sr.r, CASE WHEN coalesce(n_ann, 0) = 0 OR ikt <= 0 THEN 'ikt_zero' WHEN strategy_variety < 0.5 THEN 'low_strategy_variety' ELSE 'pass' END) AS reason,
  round(CASE WHEN n_ann > 0 THEN {TOTAL} ELSE 0.0 END, 4) AS total_score
  FROM m LEFT JOIN ff USING (session_no) LEFT JOIN cr USING (session_no) LEFT JOIN sr USING (session_no))"""

DIGEST = lambda m: f"md5(array_to_string(list_transform({m}, lambda q: coalesce(q.role, '') || ':' || coalesce(q.content, '')), '||'))"
ROLE = lambda r: f"CASE WHEN lower({r}) IN {TEACHER} THEN 'assistant' ELSE 'user' END"
JSON = r"""replace(replace(replace(replace(replace(%s, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""
CONV = (
    "concat_ws('_', coalesce(topic_id, 'None'), coalesce(student_id, 'None'), coalesce(repeat_id, 'None'), left(md5('[' || array_to_string(list_transform(dialogue, lambda q: "
    + "'{\"content\": ' || coalesce('\"' || " + JSON % "q.content" + " || '\"', 'null') || ', \"role\": ' || coalesce('\"' || q.role || '\"', 'null') || '}'), ', ') || ']'), 8))"
)
SAMPLES = f"""p AS (SELECT session_no, turn_no AS turn_id, role, content, coalesce(score, q) AS score, list(struct_pack(role := r, content := content)) OVER (PARTITION BY session_no ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prompt, r
  FROM (SELECT t.*, {ROLE('role')} AS r, quality_score AS q FROM t JOIN s USING (session_no)))"""

TURNS_D = f"""
WITH {A}, k AS (SELECT *, list_distinct(list_filter(list_transform({items('teaching_strategy')}, lambda i: {case('i', STRATEGY_PATTERNS)}), lambda i: i IS NOT NULL)) AS cl, {case('teacher_intent', INTENT_PATTERNS)} AS ci FROM a WHERE lower(speaker) IN {TEACHER}),
w AS (SELECT *, flatten(list(cl) OVER p) AS old, list(ci) OVER p AS oldi FROM k WINDOW p AS (PARTITION BY session_no ORDER BY ann_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT session_no, ann_no, list_contains(cl, 'invalid_echo') AS echo, coalesce(teaching_strategy <> '', false) AS has_s, len(list_filter(cl, lambda i: NOT list_contains(coalesce(old, []), i))) > 0 AS new_s,
  coalesce({strip('lower(discipline_transfer)')} IN {TRUE}, false) AS tr, ci IS NOT NULL AND NOT coalesce(list_contains(oldi, ci), false) AS new_i, coalesce(contains(teacher_guidance_level, 'L3'), false) AS l3 FROM w),
q AS (SELECT session_no, ann_no, (has_s AND NOT echo)::INT::DOUBLE AS has_strategy, new_s::INT::DOUBLE AS new_strategy, tr::INT::DOUBLE AS transfer, new_i::INT::DOUBLE AS new_intent, (l3 AND NOT echo)::INT::DOUBLE AS l3, echo::INT::DOUBLE AS invalid_echo FROM r)
SELECT * EXCLUDE (x), round(CASE WHEN invalid_echo > 0 THEN greatest(x - 0.15::DOUBLE, 0.0) ELSE x END, 4) AS total_score FROM (SELECT *, 0.25::DOUBLE * has_strategy + 0.15::DOUBLE * new_strategy + 0.2::DOUBLE * transfer + 0.2::DOUBLE * new_intent + 0.2::DOUBLE * l3 AS x FROM q)
"""

ORACLE = {
    "session_metrics_a": f"{_METRICS_A} SELECT session_no, {', '.join(f'CASE WHEN n_ann > 0 THEN round({p}, 6) END AS {p}' for p in PARTS)}, CASE WHEN n_ann > 0 THEN round({TOTAL}, 4) ELSE 0.0 END AS total_score FROM m",
    "session_metrics_b": f"{B} SELECT session_no, {ROUNDED}, round(total_score, 6) AS total_score FROM b",
    "session_metrics_c": f"{C} SELECT session_no, {ROUNDED}, round(total_score, 6) AS total_score FROM b",
    "metric_summary": f"{B} SELECT count(*) AS n, {MEANS} FROM b",
    "metric_summary_by_group": f"{B} SELECT topic_id, count(*) AS n, {MEANS} FROM b GROUP BY 1",
    "weighted_rewards": f"{B} SELECT session_no, round(0.5::DOUBLE * ikt + 0.3::DOUBLE * bloom_progression + 0.2::DOUBLE * l3_guidance_rate, 6) AS reward FROM b",
    "metric_rows_long": f"{B} SELECT session_no, metric, round(score, 6) AS score FROM (UNPIVOT (SELECT session_no, {', '.join(ALL)} FROM b) ON {', '.join(ALL)} INTO NAME metric VALUE score)",
    "chart_axis": f"{B} SELECT max(x) AS best, greatest(1.0, ceil(max(x) * 4) / 4) AS top FROM (SELECT round(avg(total_score), 6) AS x FROM b GROUP BY topic_id)",
    "score_spread": f"WITH {F} SELECT conv_id, count(score) AS n, round(avg(score), 6) AS mean, round(coalesce(CASE WHEN count(score) > 1 THEN stddev_samp(score) END, 0.0), 6) AS deviation FROM f GROUP BY 1",
    "turn_scores_d": TURNS_D,
    "last_turn_score": f"SELECT session_no, arg_max(total_score, ann_no) AS total_score FROM ({TURNS_D}) GROUP BY 1",
    "turn_scores_e": f"""
WITH {T}, {A[len(S) + 2 :]}, key AS (SELECT session_no, ann_no, regexp_replace(coalesce(utterance, ''), '[^一-龥a-zA-Z0-9]', '', 'g') AS k, teaching_strategy, teacher_intent, discipline_transfer, teacher_guidance_level FROM a),
last AS (SELECT * FROM key WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY session_no, k ORDER BY ann_no DESC) = 1),
j AS (SELECT t.session_no, t.turn_no, l.k, l.discipline_transfer, l.teacher_guidance_level, len(list_distinct(list_filter(list_transform({items('teaching_strategy')}, lambda i: {case('i', STRATEGY_PATTERNS)}), lambda i: i IS NOT NULL))) AS cs,
  len(list_distinct(list_filter(list_transform({items('teacher_intent')}, lambda i: {case('i', INTENT_PATTERNS)}), lambda i: i IS NOT NULL))) AS ci
  FROM t JOIN s USING (session_no) LEFT JOIN last l ON l.session_no = t.session_no AND lower(t.role) IN {TEACHER} AND l.k = regexp_replace(coalesce(t.content, ''), '[^一-龥a-zA-Z0-9]', '', 'g') WHERE len(s.annotations) > 0)
SELECT session_no, turn_no, CASE WHEN k IS NOT NULL THEN round(0.35::DOUBLE + (0.15::DOUBLE * CASE WHEN cs > 0 THEN 1 ELSE 0 END + 0.10::DOUBLE * least(cs / 8, 1) + 0.15::DOUBLE * CASE WHEN discipline_transfer IN ('是', 'Yes') THEN 1 ELSE 0 END
  + 0.15::DOUBLE * least(ci / 4, 1) + 0.10::DOUBLE * CASE WHEN contains(teacher_guidance_level, 'L3') THEN 1 ELSE 0 END), 4) END AS turn_score FROM j
""",
    "drop_reasons_format": f"WITH {T}, {_FORMAT} SELECT coalesce(r, 'pass') AS reason, count(*) AS n FROM ff GROUP BY 1",
    "drop_reasons_content": f"WITH {T}, {_CONTENT} SELECT coalesce(r, 'pass') AS reason, count(*) AS n FROM s LEFT JOIN cr USING (session_no) GROUP BY 1",
    "drop_reasons_safety": f"WITH {T}, {_SAFETY} SELECT coalesce(r, 'pass') AS reason, count(*) AS n FROM s LEFT JOIN sr USING (session_no) GROUP BY 1",
    "funnel_reasons": f"{_FUNNEL} SELECT session_no, reason FROM g",
    "pipeline": f"{_FUNNEL} SELECT session_no, total_score FROM (SELECT *, row_number() OVER (ORDER BY total_score DESC NULLS LAST, session_no) AS rn, count(*) OVER () AS n FROM g WHERE reason = 'pass') WHERE rn <= greatest(floor(n * 0.35::DOUBLE), least(n, 100))",
    "annotations_complete": f"WITH {S} SELECT session_no, len(annotations) AS n, len(list_filter(annotations, lambda q: {complete('q')})) AS complete FROM s WHERE len(annotations) > 0",
    "nonblank_turns": f"WITH {S} SELECT session_no, len(dialogue) AS n, len(list_filter(dialogue, lambda q: coalesce({strip('q.content')} <> '', false))) AS filled FROM s",
    "quality_stats": f"WITH {S} SELECT count(quality_score) AS n, min(quality_score) AS least, max(quality_score) AS most, round(avg(quality_score), 6) AS mean FROM s",
    "top_percentile": f"WITH {S} SELECT session_no, quality_score FROM (SELECT session_no, quality_score, row_number() OVER (ORDER BY quality_score DESC NULLS LAST, session_no) AS rn, count(*) OVER () AS n FROM s) WHERE rn <= greatest(floor(n * 0.35::DOUBLE), least(n, 100))",
    "balanced_sample": f"""
WITH {S}, r AS (SELECT session_no, topic_id, quality_score, row_number() OVER (PARTITION BY topic_id ORDER BY quality_score DESC NULLS LAST, session_no) AS rn FROM s WHERE topic_id IS NOT NULL),
g AS (SELECT topic_id, row_number() OVER (ORDER BY topic_id) - 1 AS ix, row_number() OVER (ORDER BY max(quality_score) DESC, topic_id) AS bx, count(*) OVER () AS k FROM r GROUP BY topic_id),
q AS (SELECT r.*, CASE WHEN 300 >= k THEN floor(300 / k) + CASE WHEN ix < 300 % k THEN 1 ELSE 0 END ELSE CASE WHEN bx <= 300 THEN 1 ELSE 0 END END AS quota FROM r JOIN g USING (topic_id)),
c AS (SELECT session_no, topic_id FROM q WHERE rn <= quota),
fill AS (SELECT session_no, topic_id, row_number() OVER (ORDER BY quality_score DESC NULLS LAST, session_no) AS fr FROM q WHERE rn > quota)
SELECT * FROM c UNION ALL SELECT session_no, topic_id FROM fill WHERE fr <= 300 - (SELECT count(*) FROM c)
""",
    "role_normalize": f"WITH {T} SELECT {ROLE('role')} AS role, count(*) AS n FROM t GROUP BY 1",
    "speaker_counts": f"WITH {T} SELECT session_no, count(*) AS turns, count(*) FILTER (WHERE lower(role) IN {TEACHER}) AS teacher, count(*) FILTER (WHERE lower(role) IN {STUDENT}) AS student FROM t GROUP BY 1",
    "transcript_digest": f"WITH {F} SELECT row_no, md5(array_to_string(list_transform(list_filter(prompt, lambda q: q.role <> 'system'), lambda q: '**' || upper(left(q.role, 1)) || q.role[2:] || '**: ' || coalesce(q.content, '')), chr(10))) AS digest FROM f",
    "prefix_history": f"WITH {T}, {SAMPLES} SELECT session_no, turn_id, {DIGEST('prompt')} AS digest, score FROM p WHERE r = 'assistant' AND turn_id > 0",
    "nested_roundtrip": f"WITH {T} SELECT session_no, count(*) AS samples, sum(length(content)) AS characters FROM t WHERE lower(role) IN {TEACHER} AND turn_no > 0 GROUP BY 1",
    "first_exchange": f"""
WITH {T}, u AS (SELECT session_no, min(turn_no) AS a, arg_min(content, turn_no) AS prompt FROM t WHERE coalesce(content, '') <> '' AND {ROLE('role')} = 'user' GROUP BY 1),
v AS (SELECT t.session_no, arg_min(content, turn_no) AS completion FROM t JOIN u USING (session_no) WHERE turn_no > a AND coalesce(content, '') <> '' AND {ROLE('role')} = 'assistant' GROUP BY 1)
SELECT s.session_no, coalesce(prompt, topic_text, '') AS prompt, coalesce(completion, '') AS completion FROM s LEFT JOIN u USING (session_no) LEFT JOIN v USING (session_no)
""",
    "conv_id_hash": f"WITH {S} SELECT session_no, {CONV} AS conv_id FROM s",
    "grouped_responses": f"WITH {F} SELECT conv_id, turn_id, count(*) AS n, md5(string_agg(coalesce(completion, ''), '|' ORDER BY row_no)) AS digest FROM f GROUP BY 1, 2",
    "context_window": f"WITH {F}, x AS (SELECT row_no, list_filter(prompt, lambda q: q.role = 'system') AS a, list_filter(prompt, lambda q: q.role <> 'system') AS b FROM f), u AS (SELECT *, list_filter(range(1, len(b) + 1), lambda i: b[i].role = 'user') AS p FROM x), y AS (SELECT row_no, list_concat(a, b[(CASE WHEN len(p) >= 4 THEN p[len(p) - 3] ELSE 1 END):]) AS m FROM u) SELECT row_no, len(m) AS messages, {DIGEST('m')} AS digest FROM y",
    "viewpoint_messages": f"WITH {F}, x AS (SELECT row_no, prompt, list_transform(list_filter(prompt, lambda q: coalesce({strip('q.content')} <> '', false)), lambda q: struct_pack(role := CASE WHEN q.role = 'user' THEN 'assistant' ELSE 'user' END, content := q.content)) AS m FROM f) SELECT row_no, {DIGEST('m')} AS digest, CASE WHEN prompt[-1].role = 'user' THEN 'assistant' ELSE 'user' END AS next_role FROM x",
    "persona_inject": f"WITH {F}, x AS (SELECT row_no, list_concat([struct_pack(role := 'system', content := ['gentle', 'strict', 'curious'][(row_no % 3)::INT + 1])], list_filter(prompt, lambda q: q.role <> 'system')) AS m FROM f) SELECT row_no, {DIGEST('m')} AS digest FROM x",
    "pair_windows": f"WITH {T} SELECT session_no, (turn_no // 2)::INT AS pair_no, sum(length(coalesce(content, ''))) AS characters FROM t GROUP BY 1, 2 HAVING count(*) = 2",
    "metadata_overlay": f"WITH {F} SELECT row_no, 'merged' AS source, single_turn_metadata['topic_id'] AS topic, len(list_filter(map_keys(single_turn_metadata), lambda k: k NOT IN ('source', 'round'))) + 2 AS n FROM f",
    "sft_best": f"""WITH {F}, b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id DESC, score DESC NULLS LAST, row_no) AS rn FROM f)
SELECT conv_id, row_no, {DIGEST("list_append(prompt, struct_pack(role := 'assistant', content := completion))")} AS digest FROM b WHERE rn = 1 AND score >= 0.3""",
    "dpo_from_flat": f"""WITH {F}, b AS (SELECT *, first_value(row_no) OVER w AS best, first_value(score) OVER w AS top FROM f WHERE score IS NOT NULL WINDOW w AS (PARTITION BY conv_id, turn_id ORDER BY score DESC, row_no))
SELECT conv_id, turn_id, best AS chosen_row_no, top AS score_chosen, row_no AS rejected_row_no, score AS score_rejected, round(top - score, 6) AS margin FROM b WHERE row_no <> best AND top - score >= 0.05""",
    "dpo_from_lineitem": """WITH b AS (SELECT *, row_number() OVER w AS rn, first_value(l_extendedprice) OVER w AS top FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_quantity))
SELECT l_orderkey, count(*) AS pairs, max(top) AS best, round(sum(top - l_extendedprice), 2) AS margin FROM b WHERE rn > 1 AND top - l_extendedprice >= 1000 GROUP BY 1""",
    "inputs_dedup": f"WITH {F} SELECT conv_id, turn_id, row_no, {DIGEST('prompt')} AS digest FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, turn_id ORDER BY row_no) = 1",
    "uniform_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= floor(0.1::DOUBLE * count(*) OVER ()) THEN 'eval' ELSE 'train' END AS split FROM documents",
    "split_sizes": "SELECT split, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= floor(0.1::DOUBLE * count(*) OVER ()) THEN 'eval' ELSE 'train' END AS split FROM documents) GROUP BY 1",
    "sample_without_replacement": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) <= 200",
    "repeat_sample": "SELECT topic_id, floor(1000 / n) + CASE WHEN rn <= 1000 % n THEN 1 ELSE 0 END AS copies FROM (SELECT topic_id, row_number() OVER (ORDER BY md5('11:' || topic_id), topic_id) AS rn, count(*) OVER () AS n FROM topics) WHERE floor(1000 / n) + CASE WHEN rn <= 1000 % n THEN 1 ELSE 0 END > 0",
    "mix_external": f"""WITH {F}, g AS (SELECT *, coalesce(single_turn_metadata['source'], 'unknown') AS source FROM f), n AS (SELECT ceil(count(DISTINCT conv_id) * 0.1::DOUBLE / (1 - 0.1::DOUBLE)) AS k FROM g WHERE source = 'SID'),
o AS (SELECT source, conv_id, row_number() OVER (ORDER BY md5('42:' || row_no), row_no) AS rn FROM g WHERE source <> 'SID')
SELECT source, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM (SELECT source, conv_id FROM g WHERE source = 'SID' UNION ALL SELECT source, conv_id FROM o WHERE rn <= (SELECT k FROM n)) GROUP BY 1""",
    "outer_merge": f"""{B}, u AS (SELECT session_no, total_score FROM b WHERE session_no % 3 <> 0)
SELECT CASE WHEN u.total_score >= 0.3 THEN 'uploaded' WHEN s.topic_id IS NULL THEN 'computed' WHEN u.session_no IS NOT NULL THEN 'partial' ELSE 'none' END AS metrics_source, s.session_no IS NOT NULL AS has_row, u.session_no IS NOT NULL AS has_metrics, count(*) AS n
FROM s FULL JOIN u USING (session_no) GROUP BY ALL""",
    "count_mismatch": f"WITH {F} SELECT conv_id, count(*) AS n_rows, count(score) AS n_metrics FROM f GROUP BY 1 HAVING count(*) <> count(score)",
    "missing_summary": "WITH u AS (SELECT source, count(*) AS n FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL GROUP BY 1 HAVING count(*) >= 100) SELECT * FROM u UNION ALL SELECT source, count(*) FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM u) GROUP BY 1",
    "merge_rewrites": f"WITH p AS {once('dpo_pairs', 'pair_no')} SELECT pair_no, md5(coalesce(CASE WHEN pair_no % 4 = 1 THEN 'rewritten ' || pair_no ELSE chosen END, '')) AS chosen, pair_no % 4 = 1 AND chosen IS NOT NULL AS rewritten FROM p",
    "dim_lookup": "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1, 2",
    "topic_distribution": f"WITH {S} SELECT coalesce(student_type, 'unknown') AS student_type, count(*) AS n, count(DISTINCT topic_id) AS topics FROM s GROUP BY 1",
    "strategy_frequency": f"WITH {A} SELECT strategy, count(*) AS n FROM (SELECT unnest({items('teaching_strategy')}) AS strategy FROM a) GROUP BY 1",
    "canonical_labels": f"WITH {A} SELECT coalesce({case('teaching_strategy', STRATEGY_PATTERNS)}, '-') AS strategy, coalesce({case('teacher_intent', INTENT_PATTERNS)}, '-') AS intent, {case('cognitive_level', BLOOM_PATTERNS, '0')} AS bloom, count(*) AS n FROM a GROUP BY 1, 2, 3",
    "correction_rate": "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'error' AND nx IN ('click', 'purchase')) AS corrected FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) GROUP BY 1",
    "props_json": "SELECT event_type, count(*) AS n, sum((props->>'$.k')::INT) AS k, count(*) FILTER (WHERE (props->>'$.k') IS NULL) AS bad FROM events GROUP BY 1",
    "text_stats": "SELECT coalesce(source, 'unknown') AS source, count(*) AS n, sum(length(text)) AS characters, floor(sum(length(text)) / 2) AS tokens, max(length(text)) AS longest FROM documents GROUP BY 1",
    "filename_codec": "SELECT doc_id, translate(to_base64(encode(coalesce(source, 'none') || '-' || doc_id || '?>.jsonl')), '+/', '-_') AS code, true AS same, doc_id AS dialogue, 3 AS pair FROM documents",
    "digests": f"WITH {F} SELECT row_no, md5(coalesce(single_turn_prompt, '')) AS digest FROM f",
    "keyword_search": "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'biology')",
    "round_robin": "SELECT doc_id, ix, ix % 4 AS model, least(floor(ix / greatest(1, floor(n / 7))), 6) AS shard, ix < floor(n * 0.25::DOUBLE) AS alternate FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ix, count(*) OVER () AS n FROM documents)",
    "generation_grid": "SELECT topic_id, student, repeat, ('0x' || left(md5(topic_id || ':' || student || ':' || repeat), 6))::BIGINT % 3 AS style FROM topics, range(1, 6) a(student), range(1, 3) b(repeat)",
    "finished_sessions": f"WITH {S} SELECT session_no, len(list_filter(dialogue, lambda q: coalesce(contains(q.content, '[结束]'), false))) > 0 AS finished, md5(coalesce(nullif({strip("replace(dialogue[-1].content, '[结束]', '')")}, ''), '（对话已结束）')) AS last FROM s",
    "path_and_model_names": "SELECT doc_id, coalesce(source, 'none') AS file, 'g' || (doc_id % 15) AS model, doc_id % 15 BETWEEN 1 AND 11 AS ablation, false AS junk FROM documents",
    "display_scores": "SELECT l_linenumber || '.5%' AS display, (l_linenumber || '.5')::DOUBLE / 100 AS score, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "lenient_json": "SELECT event_type AS kind, '[1, 2,]' AS a, count(*) AS n, sum(event_id) AS total FROM events GROUP BY 1",
    "annotate_udf": f"WITH {F} SELECT CASE WHEN completion IS NULL THEN NULL WHEN regexp_matches(completion, '[?？]') THEN 1.0 ELSE 0.0 END AS score, count(*) AS n FROM f GROUP BY 1",
    "session_summaries": f"""WITH {S}, x AS (SELECT *, flatten(list_transform(coalesce(annotations, []), lambda q: {items('q.teaching_strategy')})) AS st FROM s)
SELECT session_no, len(dialogue) AS turns, coalesce(len(annotations), 0) AS annotation_count, len(list_filter(dialogue, lambda q: lower(q.role) IN {TEACHER})) AS teacher_turns, len(list_filter(dialogue, lambda q: lower(q.role) IN {STUDENT})) AS student_turns,
  len(st) AS strategy_count, len(list_distinct(st)) AS strategy_kinds, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(annotations, lambda q: q.discipline), lambda v: v <> ''))), ','), '') AS disciplines,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(annotations, lambda q: q.teacher_guidance_level), lambda v: v <> ''))), ','), '') AS levels,
  coalesce(len(dialogue) > 0 AND len(annotations) > 0, false) AS consistent, len(list_filter(dialogue, lambda q: coalesce(contains(q.content, '[结束]'), false))) > 0 AS finished FROM x""",
    "baseline_pairs": f"""WITH {T}, n AS (SELECT session_no, row_number() OVER w - 1 AS ix, {ROLE('role')} AS r, content, list(struct_pack(role := {ROLE('role')}, content := content)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prompt
  FROM t WHERE coalesce({strip('content')}, '') <> '' WINDOW w AS (PARTITION BY session_no ORDER BY turn_no))
SELECT n.session_no, ix AS turn_id, {DIGEST('prompt')} AS digest, md5(n.content) AS chosen, 1.0 AS margin FROM n JOIN s USING (session_no) WHERE r = 'assistant' AND ix > 0 AND ix % 3 > 0 AND ix < len(s.dialogue)""",
    "row_titles": f"WITH {T}, u AS (SELECT session_no, coalesce(arg_min(content, turn_no) FILTER (WHERE lower(role) IN {STUDENT} AND content IS NOT NULL), arg_min(content, turn_no), '') AS x FROM t GROUP BY 1) SELECT session_no, CASE WHEN length(x) > 20 THEN left(x, 20) || '…' ELSE x END AS title FROM u",
    "latest_delivery": "SELECT topic_id, arg_max(session_no, ingested_at) AS session_no FROM sessions WHERE topic_id IS NOT NULL GROUP BY 1",
}

ORACLE["request_parts"] = """
WITH RECURSIVE r AS (SELECT coalesce(source, 'none') AS source, doc_id, strlen(coalesce(text, '')) AS bytes, row_number() OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id) AS rn FROM documents),
w AS (SELECT source, rn, bytes AS used, 0 AS part FROM r WHERE rn = 1
  UNION ALL SELECT r.source, r.rn, CASE WHEN used > 0 AND used + bytes > 30000 THEN bytes ELSE used + bytes END, part + CASE WHEN used > 0 AND used + bytes > 30000 THEN 1 ELSE 0 END
  FROM w JOIN r ON r.source = w.source AND r.rn = w.rn + 1)
SELECT r.source, doc_id, bytes, part FROM r JOIN w USING (source, rn)"""
# the 31-polynomial over UTF-16 units, 32 bits with sign, its absolute value in base 36; topics hold characters of the basic plane only
ORACLE["rolling_hashes"] = """
WITH RECURSIVE h AS (SELECT topic_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(topic, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS u FROM topics),
s AS (SELECT topic_id, abs(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) AS v FROM h),
b AS (SELECT topic_id, v // 36 AS v, substr('0123456789abcdefghijklmnopqrstuvwxyz', (v % 36 + 1)::INT, 1) AS hash FROM s
  UNION ALL SELECT topic_id, v // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', (v % 36 + 1)::INT, 1) || hash FROM b WHERE v > 0)
SELECT topic_id, hash FROM b WHERE v = 0"""
ORACLE["metric_variant_gap"] = f"""
WITH x AS (SELECT session_no, total_score AS a FROM ({ORACLE['session_metrics_a']})), y AS (SELECT session_no, total_score AS b FROM ({ORACLE['session_metrics_b']})), z AS (SELECT session_no, total_score AS c FROM ({ORACLE['session_metrics_c']}))
SELECT count(*) AS n, round(avg(a), 5) AS mean_a, round(avg(b), 5) AS mean_b, round(avg(c), 5) AS mean_c, round(avg(abs(b - c)), 5) AS gap_b_c FROM x JOIN y USING (session_no) JOIN z USING (session_no)"""
