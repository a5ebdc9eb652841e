"""The same queries as plain SQL over the given tables. Only fixed texts, character classes and the
parameters of the queries are shared with the Spark side; all logic is written again.

Each statement is put together from common table expressions, so that a definition stands once."""

from __future__ import annotations

from answergauge import texts
from answergauge.functions.text import HAN, HAN_BREAK, WHITESPACE, WS
from answergauge.operators import changes
from answergauge.plans import derive, workloads
from answergauge.rules import STOP_WORDS
from answergauge.sources import history

RULES = derive.DOC_RULES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def list_of(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]::VARCHAR[]"


def round2(x: str) -> str:
    return f"CAST({fixed2(x)} AS DOUBLE)"


def fixed2(x: str) -> str:
    return f"format('{{:.2f}}', CAST({x} AS DOUBLE))"


def code_text(code: int) -> str:
    return texts.CODE_TEXTS[code]


SPACE = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


def blank(x: str) -> str:
    return f"(coalesce({strip(x)}, '') = '')"


def toks(x: str) -> str:
    return (
        f"list_distinct(list_filter(regexp_split_to_array({x}, '[{WS}]+'), "
        r"lambda w: length(w) >= 2 AND regexp_matches(w, '[\p{L}\p{Nl}\p{No}]')))"
    )


def sorted_join(x: str) -> str:
    return f"array_to_string(list_sort({x}), ' ')"


def without(a: str, b: str) -> str:
    return f"list_filter({a}, lambda w: NOT list_contains({b}, w))"


# ---- Derived tables --------------------------------------------------------------


def _removed(letters: str) -> str:
    return rf"regexp_replace(text, '[^ \n]*[{letters}][^ \n]*', '', 'g')"


DOC_CASES = f"""
doc_cases AS (
  SELECT doc_id AS case_pos,
    CASE WHEN source <> 'src4' THEN concat('doc_', doc_id) ELSE {lit(texts.UNKNOWN_CASE_ID)} END AS case_id,
    CASE WHEN source <> 'src11' THEN concat(lang, '/', source) ELSE {lit(texts.UNKNOWN_CASE_DESC)} END
      AS case_desc,
    CASE WHEN source <> 'src6' THEN concat('Write in ', lang, ' for ', source) END AS prompt,
    CASE WHEN source = 'src3' THEN ''
      WHEN source = 'src5' THEN {_removed('sSrRtT')}
      WHEN lang = 'en' THEN {_removed('mM')}
      WHEN lang = 'fr' THEN {_removed('aA')}
      ELSE {_removed('cC')} END AS standard_answer,
    CASE WHEN source <> 'src7' THEN {list_of(derive.KEYWORDS)} ELSE []::VARCHAR[] END AS expect_keywords,
    concat('batch_', source) AS batch_id,
    text
  FROM documents)"""

DOC_ANSWERS = f"""
doc_answers AS (
  SELECT doc_id AS case_pos,
    CASE source WHEN 'src8' THEN {texts.TIMEOUT} WHEN 'src9' THEN {texts.BODY_NOT_JSON} ELSE 0 END AS code,
    CASE WHEN source NOT IN ('src8', 'src10') THEN text END AS data,
    CASE source WHEN 'src8' THEN 'failed with {texts.TIMEOUT}' WHEN 'src9'
      THEN 'failed with {texts.BODY_NOT_JSON}' ELSE 'ok' END AS msg,
    n_chars * CASE WHEN source = 'src1' THEN 20000::DOUBLE ELSE 0.5::DOUBLE END AS cost_ms
  FROM documents)"""


def _case_of(pick: str, values) -> str:
    return f"CASE {pick} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


DOC_JUDGEMENTS = f"""
doc_judgements AS (
  SELECT doc_id AS case_pos,
    CASE WHEN source = 'src12' THEN {texts.HTTP_ERROR} ELSE 0 END AS code,
    replace({_case_of(f"n_chars % {len(derive.REPLIES)}", derive.REPLIES)}, '@', concat(lang, ' ', source)) AS data
  FROM documents)"""

CHAT_CASES = f"""
chat_cases AS (
  SELECT conv_id * {derive.TURNS_PER_CONVERSATION} + turn AS case_pos,
    concat(conv_id, '-', turn) AS case_id, {lit(texts.UNKNOWN_CASE_DESC)} AS case_desc,
    text AS prompt, '' AS standard_answer, string_split(text, ' ') AS expect_keywords
  FROM conversations WHERE role = 'user')"""

CHAT_ANSWERS = f"""
chat_answers AS (
  SELECT conv_id * {derive.TURNS_PER_CONVERSATION} + turn - 1 AS case_pos, 0 AS code, text AS data,
    'ok' AS msg, length(text)::DOUBLE AS cost_ms
  FROM conversations WHERE role = 'assistant')"""

ATTEMPTS = r"""
attempts AS (
  SELECT event_id // 3 AS request_id, CAST(event_id % 3 AS INTEGER) AS attempt_no,
    CASE event_type WHEN 'error' THEN 'timeout' WHEN 'view' THEN 'connect' WHEN 'signup' THEN 'other' END
      AS error_kind,
    CASE WHEN event_type = 'click' THEN 200 WHEN event_type = 'purchase' AND value > 50 THEN 500
      WHEN event_type = 'purchase' THEN 200 END AS http_status,
    CASE WHEN event_type = 'click'
      THEN concat('{"choices":[{"message":{"content":"user ', user_id, '"}}]}') ELSE props END AS body,
    CASE event_type WHEN 'signup' THEN 'bad handshake' WHEN 'purchase' THEN '500 Server Error' ELSE '' END
      AS error_text,
    epoch_us(ts) AS started, epoch_us(ts) + CAST(round(value * 10000) AS BIGINT) AS ended
  FROM events)"""

HISTORY = r"""
details AS (
  SELECT concat('batch_', user_id) AS batch_id, event_id AS case_pos, concat(event_type, '_', event_id) AS case_id,
    event_type AS case_desc, concat('Explain ', event_type) AS prompt,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS execute_timestamp, CAST(NULL AS VARCHAR) AS thread_id,
    value AS api_cost_ms, CAST(NULL AS DOUBLE) AS compute_cost_ms, CAST(NULL AS DOUBLE) AS request_cost_ms,
    CASE WHEN event_type <> 'error' THEN props ELSE '' END AS answer_content,
    event_type <> 'error' AS success_flag,
    CASE WHEN event_type <> 'error' THEN '' ELSE '请求超时' END AS error_msg,
    event_type <> 'error' AND value > 5 AS is_valid, event_type <> 'error' AND value < 150 AS is_compliant,
    '' AS validity_msg, '' AS compliance_msg,
    CASE WHEN event_type <> 'error' THEN least(value, 100) ELSE 0 END AS total_score,
    CASE WHEN event_type <> 'error' THEN CAST(format('{:.2f}', least(value, 100) / 2) AS DOUBLE) ELSE 0 END
      AS relevance_score,
    CASE WHEN event_type <> 'error' THEN CAST(format('{:.2f}', least(value, 100) / 3) AS DOUBLE) ELSE 0 END
      AS completeness_score,
    CASE event_type WHEN 'view' THEN '无' WHEN 'click' THEN '低' WHEN 'purchase' THEN '中' WHEN 'error' THEN ''
      ELSE '高' END AS hallucination_level,
    '' AS hallucination_msg
  FROM events),
batches AS (
  SELECT batch_id, max(execute_timestamp) AS execute_time, concat('model of ', batch_id) AS model_name,
    count(*) AS total_cases, count(*) FILTER (success_flag) AS success_count,
    length(batch_id) * 2.5::DOUBLE AS total_time,
    CAST(format('{:.2f}', count(*) FILTER (success_flag) / count(*) * 100) AS DOUBLE) AS success_rate,
    CAST(format('{:.2f}', sum(CAST(total_score AS DECIMAL(20, 2))) FILTER (success_flag)::DOUBLE
      / nullif(count(*) FILTER (success_flag), 0)) AS DOUBLE) AS avg_total_score
  FROM details GROUP BY batch_id)"""

# ---- Validity of a table ``texts(key, content)`` ---------------------------------

CHAR_SHARE = """
chars AS (SELECT key, unnest(regexp_extract_all(s, '(?s).')) AS ch FROM stripped WHERE s <> ''),
char_counts AS (SELECT key, ch, count(*) AS n FROM chars GROUP BY key, ch),
shares AS (SELECT key, max(n) / sum(n)::DOUBLE AS share FROM char_counts GROUP BY key)"""


def _blocks(size: int) -> str:
    return f"""
    SELECT key, {size} AS size, unnest(b) AS block, generate_subscripts(b, 1) AS pos
    FROM (SELECT key, regexp_extract_all(s, '(?s).{{{size}}}') AS b FROM stripped WHERE length(s) >= {2 * size})"""


PHRASE_RUNS = f"""
blocks AS ({" UNION ALL ".join(_blocks(n) for n in (2, 3, 4))}),
islands AS (
  SELECT *, pos - row_number() OVER (PARTITION BY key, size, block ORDER BY pos) AS island FROM blocks),
runs AS (
  SELECT key, size, block, min(pos) AS start, count(*) AS times FROM islands
  GROUP BY key, size, block, island HAVING count(*) > 2),
phrase_runs AS (
  SELECT key, times, block AS phrase FROM runs
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY times DESC, size, start) = 1)"""

VALIDITY = f"""
stripped AS (SELECT key, content, {strip('content')} AS s FROM given),
{CHAR_SHARE},
{PHRASE_RUNS},
banned AS (
  SELECT key, list_filter({list_of(RULES.sensitive_words)}, lambda w: contains(content, w)) AS hits FROM given),
checks AS (
  SELECT key, CASE
      WHEN coalesce(s, '') = '' THEN {lit(code_text(texts.EMPTY_ANSWER))}
      WHEN length(s) < {RULES.min_length} THEN concat('{code_text(texts.SHORT_ANSWER)}，仅', length(s),
        '字,低于阈值:{RULES.min_length}字')
      WHEN share > {RULES.max_repeat_rate}::DOUBLE THEN concat('{code_text(texts.REPETITIVE_ANSWER)}：',
        {fixed2('share')}, '，高于阈值：{RULES.max_repeat_rate}')
      WHEN times IS NOT NULL THEN concat('{code_text(texts.REPETITIVE_ANSWER)}：短语「', phrase, '」连续重复', times,
        '次，超过阈值：{RULES.max_continuous_repeat}次')
      ELSE {lit(texts.VALID_TEXT)} END AS validity_msg,
    CASE WHEN len(hits) > 0 THEN concat('{code_text(texts.BANNED_WORD)}：', array_to_string(hits, ','))
      ELSE {lit(texts.COMPLIANT_TEXT)} END AS compliance_msg
  FROM stripped LEFT JOIN shares USING (key) LEFT JOIN phrase_runs USING (key) JOIN banned USING (key)),
validity AS (
  SELECT *, validity_msg = {lit(texts.VALID_TEXT)} AS is_valid,
    compliance_msg = {lit(texts.COMPLIANT_TEXT)} AS is_compliant FROM checks)"""

# ---- Scores of a table ``gradable(key, content, standard_answer, expect_keywords)`` ----

def _scores(whitelist, rules=RULES) -> str:
    level_score = "CASE level " + " ".join(
        f"WHEN {lit(k)} THEN {v}::DOUBLE" for k, v in texts.LEVEL_SCORES.items()
    ) + f" ELSE {texts.OTHER_LEVEL_SCORE}::DOUBLE END"

    def told(opening: str, closing: str, k: int) -> str:
        return (
            f"concat('{opening}', n_extra, '个（占比', format('{{:.1f}}', ratio * 100), '%{closing}', "
            f"array_to_string(list_sort(extra)[1:{k}], ','))"
        )

    return f"""
token_sets AS (
  SELECT key, content, standard_answer, expect_keywords, {toks('content')} AS a, {toks('standard_answer')} AS b
  FROM gradable),
compared AS (
  SELECT *, len(a) AS n_a, len(b) AS n_b, len(list_filter(a, lambda w: list_contains(b, w))) AS n_common,
    list_filter({without('a', 'b')}, lambda w: NOT list_contains({list_of(whitelist)}, w)) AS extra
  FROM token_sets),
kw AS (SELECT key, unnest(expect_keywords) AS k FROM gradable),
kw_hits AS (
  SELECT kw.key, count(*) FILTER (CASE WHEN len({toks('k')}) = 0 THEN contains(content, k)
      ELSE len({without(toks('k'), 'a')}) = 0 END) AS hits, count(*) AS n_kw
  FROM kw JOIN token_sets ON kw.key = token_sets.key GROUP BY kw.key),
leveled AS (
  SELECT compared.*, len(extra) AS n_extra, coalesce(len(extra) / nullif(n_a, 0)::DOUBLE, 0) AS ratio,
    CASE WHEN {blank('content')} THEN 0 WHEN n_kw IS NULL THEN 100
      ELSE {round2('hits / n_kw::DOUBLE * 100')} END AS relevance_score,
    CASE WHEN {blank('content')} THEN 0 WHEN {blank('standard_answer')} OR n_b = 0 THEN 80
      ELSE {round2('(least(n_a / n_b::DOUBLE, 1::DOUBLE) * 0.4::DOUBLE + n_common / n_b::DOUBLE * 0.6::DOUBLE) * 100')}
      END AS completeness_score
  FROM compared LEFT JOIN kw_hits USING (key)),
graded AS (
  SELECT *, CASE WHEN {blank('content')} THEN '无' WHEN {blank('standard_answer')} THEN '未知' WHEN n_extra = 0 THEN '无'
      WHEN ratio < {rules.extra_ratio_threshold}::DOUBLE OR n_extra <= {rules.low_risk_threshold} THEN '低'
      WHEN n_extra <= {rules.high_risk_threshold} THEN '中' ELSE '高' END AS level
  FROM leveled),
scores AS (
  SELECT key, extra, n_extra, ratio, relevance_score, completeness_score, level AS hallucination_level,
    {level_score} AS level_score,
    {round2(f"relevance_score * {rules.weight_relevance}::DOUBLE + completeness_score * {rules.weight_completeness}::DOUBLE + {level_score} * {rules.weight_compliance}::DOUBLE")}
      AS total_score,
    CASE WHEN {blank('content')} THEN {lit(texts.BLANK_RISK_TEXT)}
      WHEN level = '未知' THEN {lit(code_text(texts.NO_STANDARD))}
      WHEN level = '无' THEN {lit(texts.NO_RISK_TEXT)}
      WHEN level = '低' THEN {told('疑似新增事实点', '）：', 3)}
      WHEN level = '中' THEN {told('存在较多未核实内容，共', '）：', 5)}
      ELSE {told('存在大量未核实内容，共', '），高幻觉风险：', 5)} END AS hallucination_msg
  FROM graded)"""


GIVEN_DOCS = "given AS (SELECT doc_id AS key, text AS content FROM documents)"
GRADABLE_CASES = (
    "gradable AS (SELECT case_pos AS key, text AS content, standard_answer, expect_keywords FROM doc_cases)"
)


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select


def _doc_scores(columns: str) -> str:
    return _with(
        DOC_CASES, GRADABLE_CASES, _scores(RULES.whitelist), select=f"SELECT key AS case_pos, {columns} FROM scores"
    )


RESULT_SELECT = """
results AS (
  SELECT c.case_pos, {keep} c.case_id, c.case_desc, coalesce(c.prompt, '') AS prompt,
    '{stamp}' AS execute_timestamp, CAST(NULL AS VARCHAR) AS thread_id,
    CASE WHEN c.prompt IS NULL THEN 0 ELSE coalesce(a.cost_ms, 0) END AS api_cost_ms,
    CAST(NULL AS DOUBLE) AS compute_cost_ms, CAST(NULL AS DOUBLE) AS request_cost_ms,
    CASE WHEN ok THEN a.data ELSE '' END AS answer_content,
    ok AS success_flag,
    CASE WHEN c.prompt IS NULL THEN '执行异常：''prompt''' WHEN ok AND a.data IS NULL THEN '执行异常：{null_text}'
      WHEN ok THEN '' WHEN a.case_pos IS NULL THEN '{no_outcome}' ELSE a.msg END AS error_msg,
    coalesce(v.is_valid, FALSE) AS is_valid, coalesce(v.is_compliant, FALSE) AS is_compliant,
    coalesce(v.validity_msg, '') AS validity_msg, coalesce(v.compliance_msg, '') AS compliance_msg,
    coalesce(s.total_score, 0) AS total_score, coalesce(s.relevance_score, 0) AS relevance_score,
    coalesce(s.completeness_score, 0) AS completeness_score,
    coalesce(s.hallucination_level, '') AS hallucination_level,
    coalesce(s.hallucination_msg, '') AS hallucination_msg
  FROM called c LEFT JOIN {answers} a USING (case_pos)
    LEFT JOIN validity v ON v.key = c.case_pos LEFT JOIN scores s ON s.key = c.case_pos)"""


def _called(cases: str, answers: str) -> str:
    """Cases with ``ok``, and the gradable ones in the shape the checks and scores take."""
    return f"""
called AS (
  SELECT c.*, coalesce(c.prompt IS NOT NULL AND a.code = 0, FALSE) AS ok, a.data AS answer
  FROM {cases} c LEFT JOIN {answers} a USING (case_pos)),
gradable AS (
  SELECT case_pos AS key, answer AS content, standard_answer, expect_keywords FROM called
  WHERE ok AND answer IS NOT NULL),
given AS (SELECT key, content FROM gradable)"""


def _doc_results(select: str) -> str:
    return _with(
        DOC_CASES, DOC_ANSWERS, _called("doc_cases", "doc_answers"), VALIDITY, _scores(RULES.whitelist),
        RESULT_SELECT.format(
            keep="c.batch_id,", stamp=derive.STAMP, answers="doc_answers",
            null_text=texts.NULL_ANSWER_FAULT.replace("'", "''"), no_outcome=texts.NO_OUTCOME_TEXT,
        ),
        select=select,
    )


def _chat_results() -> str:
    # The chat cases run with default rules: no banned words, no whitelist.
    unbanned = VALIDITY.replace(
        f"ELSE {lit(texts.COMPLIANT_TEXT)} END AS compliance_msg", f"ELSE {lit(texts.COMPLIANCE_SKIPPED_TEXT)} END AS compliance_msg"
    ).replace(
        f"compliance_msg = {lit(texts.COMPLIANT_TEXT)}", f"compliance_msg = {lit(texts.COMPLIANCE_SKIPPED_TEXT)}"
    ).replace(list_of(RULES.sensitive_words), "[]::VARCHAR[]")
    return _with(
        CHAT_CASES, CHAT_ANSWERS, _called("chat_cases", "chat_answers"), unbanned, _scores(()),
        RESULT_SELECT.format(
            keep="", stamp=derive.STAMP, answers="chat_answers",
            null_text=texts.NULL_ANSWER_FAULT_NO_WORDS.replace("'", "''"), no_outcome=texts.NO_OUTCOME_TEXT,
        ),
        select="SELECT * FROM results",
    )


def _judge_override() -> str:
    judged = f"""
judged AS (
  SELECT c.case_pos, j.data,
    CASE WHEN json_type(doc, '$.level') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(doc ->> '$.level' AS DOUBLE)
      WHEN json_type(doc, '$.level') = 'BOOLEAN' THEN CAST(CAST(doc ->> '$.level' AS BOOLEAN) AS DOUBLE) END AS n,
    CASE WHEN json_type(doc, '$.reason') IS NULL THEN {lit(texts.JUDGE_DEFAULT_TEXT)}
      ELSE doc ->> '$.reason' END AS reason
  FROM (SELECT *, CASE WHEN json_valid(data) AND json_type(data) = 'OBJECT' THEN data::JSON END AS doc
        FROM doc_judgements WHERE code = 0) j
  JOIN called c ON c.case_pos = j.case_pos
  WHERE c.ok AND c.answer IS NOT NULL AND NOT {blank('c.standard_answer')}),
accepted AS (SELECT * FROM judged WHERE n IN (0, 1, 2, 3))"""
    base = _doc_results("")
    return (
        base.rstrip() + ",\n" + DOC_JUDGEMENTS.strip() + ",\n" + judged.strip() + """
SELECT r.case_pos,
  CASE WHEN a.n IS NOT NULL THEN CASE a.n WHEN 0 THEN '无' WHEN 1 THEN '低' WHEN 2 THEN '中' ELSE '高' END
    ELSE hallucination_level END AS hallucination_level,
  CASE WHEN a.n IS NOT NULL THEN a.reason ELSE hallucination_msg END AS hallucination_msg, total_score
FROM results r LEFT JOIN accepted a USING (case_pos)"""
    )


def _judge_prompt() -> str:
    before, rest = texts.JUDGE_TEMPLATE.split("{standard_answer}")
    between, after = rest.split("{answer_content}")
    return _with(
        DOC_CASES, DOC_ANSWERS,
        select=f"""SELECT case_pos, concat({lit(before)}, standard_answer, {lit(between)}, coalesce(data, 'None'),
  {lit(after)}) AS judge_prompt
FROM doc_cases LEFT JOIN doc_answers USING (case_pos)
WHERE prompt IS NOT NULL AND NOT {blank('standard_answer')}""",
    )


# ---- Calls -----------------------------------------------------------------------

REPLY_BODIES = r"""
bodies AS (
  SELECT conv_id, turn, CASE
    WHEN role = 'system' THEN text
    WHEN role = 'assistant' THEN concat('{"choices":[{"message":{"content":', to_json(text), '}}]}')
    WHEN turn = 0 THEN concat('{"choices":[],"note":', to_json(text), '}')
    WHEN turn = 2 THEN '{"choices":[{"message":{"content":null}}]}'
    WHEN turn = 4 THEN '{"choices":[{"message":{}}]}'
    WHEN turn = 6 THEN concat('{"choices":[{"message":{"content":', to_json(text), '}}]} oops')
    WHEN turn = 8 THEN repeat(concat('{"choices":[{"message":{"content":', to_json(text), '}}]}'), 2)
    WHEN turn = 10 THEN concat('{"choices":[{"message":{"content":', to_json(text), '}}]} and {x}')
    ELSE '{"error":"busy"}' END AS body
  FROM conversations)"""


def _parsed(body: str) -> dict[str, str]:
    doc = f"(CASE WHEN json_valid({body}) THEN {body} END)"
    kind = f"json_type({doc}, '$.choices[0].message.content')"
    return {
        "code": f"CASE WHEN {doc} IS NULL THEN {texts.BODY_NOT_JSON} WHEN {kind} IS NULL THEN"
        f" {texts.NO_ANSWER_IN_BODY} ELSE 0 END",
        "data": f"CASE WHEN {doc} IS NULL OR {kind} IS NULL THEN {body} WHEN {kind} = 'VARCHAR' THEN"
        f" json_extract_string({doc}, '$.choices[0].message.content') END",
        "msg": f"CASE WHEN {doc} IS NULL THEN '{code_text(texts.BODY_NOT_JSON)}，预期为JSON格式'"
        f" WHEN {kind} IS NULL THEN concat('{code_text(texts.NO_ANSWER_IN_BODY)}：', CASE"
        f" WHEN json_type({doc}, '$.choices') IS NULL THEN '''choices'''"
        f" WHEN json_type({doc}, '$.choices[0]') IS NULL THEN 'list index out of range'"
        f" WHEN json_type({doc}, '$.choices[0].message') IS NULL THEN '''message''' ELSE '''content''' END)"
        f" ELSE '{code_text(texts.SUCCESS)}' END",
    }


def _reply_body() -> str:
    parts = ", ".join(f"{sql} AS {name}" for name, sql in _parsed("body").items())
    return _with(REPLY_BODIES, select=f"SELECT conv_id, turn, {parts} FROM bodies")


def _final(max_retry: int) -> str:
    return f"""
kept AS (SELECT *, coalesce(error_kind IN ('timeout', 'connect'), FALSE) AS retry FROM attempts
  WHERE attempt_no <= {max_retry}),
final AS (
  SELECT *, {round2("(ended - min(started) OVER (PARTITION BY request_id)) / 1000::DOUBLE")} AS cost_ms
  FROM kept QUALIFY row_number() OVER (PARTITION BY request_id
    ORDER BY retry, CASE WHEN retry THEN -attempt_no ELSE attempt_no END) = 1)"""


def _outcome_code() -> str:
    body = _parsed("body")
    failed = [
        ("error_kind = 'timeout'", texts.TIMEOUT, "NULL", lit(f"{code_text(texts.TIMEOUT)}，超时限制30秒")),
        ("error_kind = 'connect'", texts.CONNECT_ERROR, "NULL", lit(f"{code_text(texts.CONNECT_ERROR)}，无法访问接口地址")),
        ("http_status >= 400", texts.HTTP_ERROR, "body", f"concat('{code_text(texts.HTTP_ERROR)}：', error_text)"),
        ("error_kind IS NOT NULL", texts.OTHER_ERROR, "NULL", f"concat('{code_text(texts.OTHER_ERROR)}：', error_text)"),
    ]

    def case(i: int, name: str) -> str:
        return "CASE " + " ".join(f"WHEN {f[0]} THEN {f[i]}" for f in failed) + f" ELSE {body[name]} END AS {name}"

    return _with(
        ATTEMPTS, _final(2),
        select=f"SELECT request_id AS case_pos, {case(1, 'code')}, {case(2, 'data')}, {case(3, 'msg')} FROM final",
    )


# ---- Summaries -------------------------------------------------------------------


def _summary_columns(seconds: str) -> dict[str, str]:
    n, ok = "count(*)", "count(*) FILTER (success_flag)"

    def pct(test: str) -> str:
        part = f"count(*) FILTER (success_flag AND {test})"
        return f"CASE WHEN {ok} > 0 THEN concat({fixed2(f'{part} / nullif({ok}, 0)::DOUBLE * 100')}, '%') END"

    made = {
        "total": n,
        "success": ok,
        "failed": f"{n} - {ok}",
        "success_rate": f"coalesce({round2(f'{ok} / nullif({n}, 0)::DOUBLE * 100')}, 0)",
        "total_time": seconds,
        "avg_time_per_case": f"coalesce({round2(f'({seconds}) / nullif({n}, 0)')}, 0)",
        "valid_rate": pct("is_valid"),
        "compliant_rate": pct("is_compliant"),
    }
    for score in ("total", "relevance", "completeness"):
        total = f"sum(CAST({score}_score AS DECIMAL(20, 2))) FILTER (success_flag)::DOUBLE"
        made[f"avg_{score}"] = round2(f"{total} / nullif({ok}, 0)")
    for name, level in texts.SUMMARY_LEVELS.items():
        made[f"{name}_count"] = f"count(*) FILTER (success_flag AND hallucination_level = {lit(level)})"
        made[f"{name}_ratio"] = pct(f"hallucination_level = {lit(level)}")
    return made


def _summary(columns: list[str], by_batch: bool) -> str:
    made = _summary_columns("length(batch_id) * 1.37::DOUBLE" if by_batch else "123.45::DOUBLE")
    wanted = ["batch_id"] * by_batch + [f"{made[c]} AS {c}" for c in columns]
    return _doc_results(f"SELECT {', '.join(wanted)} FROM results" + (" GROUP BY batch_id" if by_batch else ""))


COUNTS = ["total", "success", "failed", "success_rate", "total_time", "avg_time_per_case"]
MEANS = ["avg_total", "avg_relevance", "avg_completeness"]
LEVELS = [f"{n}_{part}" for n in texts.SUMMARY_LEVELS for part in ("count", "ratio")]
PASSES = ["valid_rate", "compliant_rate"]


def _history(select: str, *more: str) -> str:
    return _with(HISTORY, *more, select=select)


def _detail_view() -> str:
    from answergauge.schemas import BATCH_COLUMNS

    lines = " UNION ALL ".join(
        f"SELECT {i} AS line, {lit(c)} AS key, CAST({c} AS VARCHAR) AS value FROM batches"
        f" WHERE batch_id = {lit(workloads.BATCH)}"
        for i, c in enumerate(BATCH_COLUMNS)
    )
    return _history(lines)


def _compare_batches() -> str:
    change = ", ".join(
        f"{round2(f'new.{c}_score - old.{c}_score')} AS {c}_score_change"
        for c in ("total", "relevance", "completeness")
    )
    return _history(f"""
SELECT coalesce(new.case_pos, old.case_pos) AS case_pos, coalesce(new.case_id, old.case_id) AS case_id,
  CASE WHEN new.case_pos IS NULL THEN 'baseline' WHEN old.case_pos IS NULL THEN 'candidate' ELSE 'both' END AS side,
  old.total_score AS old_total_score, new.total_score AS new_total_score, {change},
  old.hallucination_level AS old_hallucination_level, new.hallucination_level AS new_hallucination_level,
  old.hallucination_level <> new.hallucination_level AS level_changed,
  old.success_flag AS old_success_flag, new.success_flag AS new_success_flag
FROM (SELECT * FROM details WHERE case_desc <> 'signup') old
FULL JOIN (SELECT case_pos, case_id, relevance_score AS total_score, total_score AS relevance_score,
  completeness_score, CASE WHEN total_score > 50 THEN '低' ELSE hallucination_level END AS hallucination_level,
  success_flag FROM details WHERE case_desc <> 'error') new ON old.case_pos = new.case_pos""")


def _regression_verdict() -> str:
    weight = " + ".join(f"CASE WHEN u >= {b} THEN 1 ELSE 0 END" for b in history.poisson_bounds())
    return _history(f"""
SELECT CAST(coalesce(max(n) FILTER (r = 0), 0) AS BIGINT) AS n_cases, max(m) FILTER (r = 0) AS mean_change,
  any_value(lo) AS lower, any_value(hi) AS upper,
  CASE WHEN any_value(lo) IS NULL THEN 'no common cases' WHEN any_value(lo) > 0 THEN 'better'
    WHEN any_value(hi) < 0 THEN 'worse' ELSE 'no clear change' END AS verdict
FROM (
  SELECT *, (SELECT list(m ORDER BY m)[CAST(floor((count(*) - 1) * {(1 - 0.95) / 2!r}::DOUBLE) AS INTEGER) + 1] FROM means WHERE r > 0) AS lo,
    (SELECT list(m ORDER BY m)[CAST(floor((count(*) - 1) * {1 - (1 - 0.95) / 2!r}::DOUBLE) AS INTEGER) + 1] FROM means WHERE r > 0) AS hi
  FROM means)""", f"""
paired AS (
  SELECT old.case_pos, CAST((CAST(new.relevance_score AS DECIMAL(20, 4)) - CAST(old.total_score AS DECIMAL(20, 4))) * 10000 AS BIGINT)
    AS change
  FROM (SELECT * FROM details WHERE case_desc <> 'signup' AND success_flag) old
  JOIN (SELECT * FROM details WHERE case_desc <> 'error' AND success_flag) new ON old.case_pos = new.case_pos),
drawn AS (
  SELECT change, r, CAST(concat('0x', substr(md5(concat('1:', case_pos, ':', (r - 1) // 8)), 4 * ((r - 1) % 8) + 1, 4)) AS INTEGER) AS u
  FROM paired, range(1, {history.REPLICATES} + 1) t(r)),
means AS (
  SELECT r, sum(w) AS n, CAST(sum(w * change) AS DOUBLE) / CAST(sum(w) AS DOUBLE) / 10000::DOUBLE AS m
  FROM (SELECT 0 AS r, change, 1 AS w FROM paired UNION ALL SELECT r, change, {weight} AS w FROM drawn)
  GROUP BY r HAVING sum(w) > 0)""")


def _summary_rollup() -> str:
    """Over the result rows themselves, at every level."""
    own = "CASE WHEN place = 1 THEN CAST(length(batch_id) * 2.5 AS DECIMAL(20, 6)) ELSE 0 END"
    made = _summary_columns(f"sum({own})::DOUBLE")
    levels = {0: "batch", 1: "model and day", 3: "model", 5: "day", 7: "all"}
    level = " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in levels.items())
    return _history(f"""
SELECT CASE grouping_id(model_name, day, batch_id) {level} END AS level, model_name, day, batch_id,
  count(*) FILTER (place = 1) AS n_batches, 0::BIGINT AS n_uncounted,
  {", ".join(f"{made[c]} AS {c}" for c in (*COUNTS, *MEANS, *LEVELS, *PASSES))}
FROM (
  SELECT d.*, concat('model ', right(batch_id, 1)) AS model_name, left(execute_time, 10) AS day,
    row_number() OVER (PARTITION BY batch_id ORDER BY case_pos) AS place
  FROM details d JOIN (SELECT batch_id, execute_time FROM batches) USING (batch_id))
GROUP BY GROUPING SETS ((model_name, day, batch_id), (model_name, day), (model_name), (day), ())""")


def _model_trend() -> str:
    change = ", ".join(
        f"{round2(f'{c} - lag({c}) OVER w')} AS {c}_change" for c in ("success_rate", "avg_total_score")
    )
    return _history(f"""
SELECT concat('model ', right(batch_id, 1)) AS model_name, CAST(row_number() OVER w AS INTEGER) AS run, batch_id,
  execute_time, success_rate, avg_total_score, {change}
FROM batches WINDOW w AS (PARTITION BY right(batch_id, 1) ORDER BY execute_time, batch_id)""")


def _model_changes() -> str:
    """The splits of all segments of one depth at a time."""
    shifted = f"CAST(right(batch_id, 1) AS INTEGER) % 2 = 1 AND execute_time >= {lit(workloads.LEVEL_SHIFT)}"
    earlier = "w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    tried = """
  SELECT l.model_name, l.a, l.n, l.s0, l.s1, l.q0, l.q1, r.run, r.batch_id, r.execute_time, r.s, r.q,
    (r.s - l.s0) / (r.run - l.a)::DOUBLE AS t0, (l.s1 - r.s) / (l.n - r.run + l.a)::DOUBLE AS t1,
    (r.run - l.a)::DOUBLE * (l.n - r.run + l.a)::DOUBLE / l.n::DOUBLE * ((t0 - t1) * (t0 - t1)) AS gain,
    greatest(l.q1 - l.q0 - (l.s1 - l.s0) * (l.s1 - l.s0) / l.n::DOUBLE - gain, 0::DOUBLE) AS inside
  FROM levels l JOIN runs r ON r.model_name = l.model_name"""
    at = f"r.run - l.a >= {changes.LEAST_RUNS} AND l.n - r.run + l.a >= {changes.LEAST_RUNS}"
    holds = f"gain > 0 AND gain * (n - 2)::DOUBLE >= {changes.LEAST_RATIO!r}::DOUBLE * inside"
    made = _history("""
SELECT model_name, run, batch_id, execute_time, runs_before, runs_after, m0 / 100 AS mean_before, m1 / 100 AS mean_after,
  m1 / 100 - m0 / 100 AS change, ratio
FROM levels WHERE side = 1""", f"""
scored AS (
  SELECT concat('model ', CAST(right(batch_id, 1) AS INTEGER) % 2) AS model_name, batch_id, execute_time,
    CAST(round(CASE WHEN {shifted} THEN {round2("avg_total_score / 2")} ELSE avg_total_score END * 100) AS BIGINT) AS p
  FROM batches),
runs AS (
  SELECT *, row_number() OVER w AS run, coalesce(sum(p) OVER ({earlier}), 0)::DOUBLE AS s,
    coalesce(sum(p * p) OVER ({earlier}), 0)::DOUBLE AS q
  FROM scored WHERE p IS NOT NULL WINDOW w AS (PARTITION BY model_name ORDER BY execute_time, batch_id, p)),
levels AS (
  SELECT model_name, 1::BIGINT AS a, count(*) AS n, 0::DOUBLE AS s0, sum(p)::DOUBLE AS s1, 0::DOUBLE AS q0,
    sum(p * p)::DOUBLE AS q1, 0 AS side, 0::BIGINT AS run, '' AS batch_id, '' AS execute_time, 0::BIGINT AS runs_before,
    0::BIGINT AS runs_after, 0::DOUBLE AS m0, 0::DOUBLE AS m1, 0::DOUBLE AS ratio
  FROM runs GROUP BY model_name
  UNION ALL
  SELECT model_name, CASE WHEN side = 1 THEN run ELSE a END, CASE WHEN side = 1 THEN a + n - run ELSE run - a END,
    CASE WHEN side = 1 THEN s ELSE s0 END, CASE WHEN side = 1 THEN s1 ELSE s END,
    CASE WHEN side = 1 THEN q ELSE q0 END, CASE WHEN side = 1 THEN q1 ELSE q END,
    side, run, batch_id, execute_time, run - a, a + n - run, t0, t1,
    CASE WHEN inside > 0 THEN gain * (n - 2)::DOUBLE / inside END
  FROM (SELECT * FROM ({tried} AND {at}) QUALIFY row_number() OVER (PARTITION BY model_name, a ORDER BY gain DESC, run) = 1),
    (VALUES (0), (1)) v(side)
  WHERE {holds})""")
    return made.replace("WITH ", "WITH RECURSIVE ", 1)


def _csv_rows() -> str:
    from answergauge.schemas import RESULT_FIELDS
    from answergauge.sources.report import REPORT_COLUMNS

    def shown(name: str) -> str:
        text = f"CAST({name} AS VARCHAR)"
        if RESULT_FIELDS[name] == "BOOLEAN":
            text = f"CASE WHEN {name} THEN 'True' ELSE 'False' END"
        elif name.endswith("_score"):
            text = f"CASE WHEN success_flag AND error_msg = '' THEN {text} ELSE '0' END"
        elif name == "api_cost_ms":
            text = f"CASE WHEN {name} = 0 THEN '0' ELSE {text} END"
        return f"coalesce({text}, '') AS {name}"

    return _doc_results("SELECT case_pos, " + ", ".join(shown(c) for c in REPORT_COLUMNS) + " FROM results")


def _placeholders() -> str:
    env = workloads.PLACEHOLDERS
    value = "CASE event_type " + " ".join(
        f"WHEN {lit(k)} THEN {lit(v)}" for k, v in env.items() if k != "region-1"
    ) + " ELSE concat('${', event_type, '}') END"
    return (
        f"SELECT event_id, concat('user ', user_id, ' did ', {value}, ' in ', {lit(env['region-1'])},"
        " ' for $', value, ' ${', props) AS filled FROM events"
    )


def _han_tokens() -> str:
    pairs = (
        "list_filter(list_transform(list_zip(c[1:len(c) - 1], c[2:]), lambda z: concat(z[1], z[2])),"
        f" lambda p: regexp_matches(p, '^[{HAN}]{{2}}$') AND NOT list_contains({list_of(STOP_WORDS)}, p))"
    )
    rest = toks(f"regexp_replace(h, '{HAN_BREAK}', ' ', 'g')")
    words = f"CASE WHEN regexp_matches(h, '[{HAN}]') THEN list_distinct(list_concat({pairs}, {rest})) ELSE {toks('h')} END"
    return f"""WITH han AS (
  SELECT doc_id, translate(text, '{derive.LATIN_LETTERS}', '{derive.HAN_LETTERS}') AS h FROM documents),
split AS (SELECT doc_id, h, regexp_extract_all(h, '(?s).') AS c FROM han),
words AS (SELECT doc_id, {words} AS t FROM split)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, {sorted_join('t')} AS tokens FROM words"""


def _lexicon_tokens() -> str:
    lexicon = "|".join(sorted(derive.LEXICON, key=lambda w: (-len(w), w)))
    stop = list_of(STOP_WORDS)
    found = (
        f"list_filter(regexp_extract_all(h, '{lexicon}|[{HAN}]'), lambda w: len(w) >= 2 AND NOT list_contains({stop}, w))"
    )
    pairs = (
        "list_filter(list_transform(list_zip(c[1:len(c) - 1], c[2:]), lambda z: concat(z[1], z[2])),"
        f" lambda p: regexp_matches(p, '^[{HAN}]{{2}}$') AND NOT list_contains({stop}, p))"
    )
    rest = toks(f"regexp_replace(h, '{HAN_BREAK}', ' ', 'g')")
    words = (
        f"CASE WHEN regexp_matches(h, '[{HAN}]') THEN list_distinct(list_concat({found}, {pairs}, {rest}))"
        f" ELSE {toks('h')} END"
    )
    return f"""WITH han AS (
  SELECT doc_id, translate(text, '{derive.LATIN_LETTERS}', '{derive.HAN_LETTERS}') AS h FROM documents),
split AS (SELECT doc_id, h, regexp_extract_all(regexp_replace(h, '{lexicon}', ' ', 'g'), '(?s).') AS c FROM han),
words AS (SELECT doc_id, {words} AS t FROM split)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, {sorted_join('t')} AS tokens FROM words"""


def _segmented(select: str) -> str:
    """The best path of each run, one character a turn; lists hold the best ends of as many characters back as the longest
    word has."""
    return f"""WITH RECURSIVE han AS (
  SELECT doc_id, translate(text, '{derive.LATIN_LETTERS}', '{derive.HAN_LETTERS}') AS h FROM documents),
runs AS (
  SELECT doc_id, h, regexp_extract_all(h, '[{HAN}]+') AS rs FROM han),
items AS (
  SELECT unnest(regexp_extract_all(translate(text, '{derive.LATIN_LETTERS}', '{derive.HAN_LETTERS}'), '[{HAN}]+')) AS run
  FROM benchmark),
counted AS (
  SELECT word, count(*)::DOUBLE AS freq FROM (SELECT unnest([run, left(run, 2), right(run, 3)]) AS word FROM items)
  GROUP BY word),
lexicon AS (
  SELECT word, CAST(floor(ln(freq / (SELECT sum(freq) FROM counted)) * 1000000) AS BIGINT) AS w FROM counted),
fixed AS (
  SELECT (SELECT max(length(word)) FROM counted) AS longest,
    (SELECT CAST(floor(ln(1.0::DOUBLE / sum(freq)) * 1000000) AS BIGINT) FROM counted) AS unseen),
distinct_runs AS (
  SELECT DISTINCT run, length(run) AS n FROM (SELECT unnest(rs) AS run FROM runs)),
spans AS (
  SELECT run, last, unnest(range(1, least(last, longest) + 1)) AS k
  FROM (SELECT run, longest, unnest(range(1, n + 1)) AS last FROM distinct_runs, fixed)),
edges AS (
  SELECT run, last, list({{'k': k, 'w': coalesce(w, unseen)}}) AS es
  FROM (SELECT *, substr(run, last - k + 1, k) AS word FROM spans) LEFT JOIN lexicon USING (word), fixed
  WHERE w IS NOT NULL OR k = 1 GROUP BY run, last),
walk AS (
  SELECT run, CAST(0 AS BIGINT) AS last, [CAST(0 AS BIGINT)] AS scores, [''] AS paths FROM distinct_runs
  UNION ALL
  SELECT run, last, list_prepend(best.s, scores)[1:longest],
    list_prepend(concat(paths[best.k], ' ', substr(run, last - best.k + 1, best.k)), paths)[1:longest]
  FROM (
    SELECT w.run, e.last, scores, paths, longest,
      list_reverse_sort(list_transform(es, lambda x: {{'s': scores[x.k] + x.w, 'k': x.k}}))[1] AS best
    FROM walk w JOIN edges e ON e.run = w.run AND e.last = w.last + 1, fixed)),
best AS (
  SELECT walk.run, ltrim(paths[1]) AS path FROM walk JOIN distinct_runs d ON d.run = walk.run AND d.n = walk.last),
numbered AS (
  SELECT doc_id, unnest(rs) AS run, unnest(range(len(rs))) AS i FROM runs),
told AS (
  SELECT doc_id, list(path ORDER BY i) AS paths FROM numbered JOIN best USING (run) GROUP BY doc_id)
{select}"""


def _segmented_tokens() -> str:
    singles = (
        f"list_filter(string_split(replace(regexp_replace(array_to_string(paths, '|'), '[{HAN}]{{2,}}', '|', 'g'), ' ', ''), '|'),"
        " lambda s: length(s) >= 2)"
    )
    pairs = f"flatten(list_transform({singles}, lambda s: list_transform(range(1, length(s)), lambda i: substr(s, i, 2))))"
    words = "list_filter(string_split(replace(array_to_string(paths, '|'), '|', ' '), ' '), lambda w: length(w) >= 2)"
    rest = toks(f"regexp_replace(h, '{HAN_BREAK}', ' ', 'g')")
    of_han = f"list_filter(list_concat({words}, {pairs}, {rest}), lambda w: NOT list_contains({list_of(STOP_WORDS)}, w))"
    return _segmented(
        f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, {sorted_join('t')} AS tokens FROM (
  SELECT doc_id, CASE WHEN paths IS NULL THEN {toks('h')} ELSE list_distinct({of_han}) END AS t
  FROM runs LEFT JOIN told USING (doc_id))"""
    )


def _ask_with_retries() -> str:
    failed = texts.HTTP_ERROR_TEXT.format(detail="503 Server Error")
    other = texts.OTHER_ERROR_TEXT.format(detail="bad handshake")
    return f"""SELECT conv_id * {derive.TURNS_PER_CONVERSATION} + turn AS case_pos,
  CAST(CASE WHEN k < 3 THEN k + 1 WHEN k = 3 THEN 3 ELSE 1 END AS BIGINT) AS tries,
  CAST(CASE k WHEN 3 THEN {texts.TIMEOUT} WHEN 4 THEN {texts.HTTP_ERROR} WHEN 5 THEN {texts.OTHER_ERROR}
    ELSE 0 END AS INTEGER) AS code,
  CASE WHEN k < 3 THEN concat(k, ' ', text) WHEN k = 4 THEN concat('busy with ', text) WHEN k = 6
    THEN concat('0 ', text) END AS data,
  CASE k WHEN 3 THEN {lit(texts.TIMEOUT_TEXT.format(seconds=30))} WHEN 4 THEN {lit(failed)} WHEN 5 THEN {lit(other)}
    ELSE {lit(code_text(texts.SUCCESS))} END AS msg
FROM (SELECT *, length(text) % 7 AS k FROM conversations WHERE role = 'user' AND text IS NOT NULL)"""


def all_sql() -> dict[str, str]:
    batch = lit(workloads.BATCH)
    doc_stripped = f"stripped AS (SELECT doc_id AS key, text AS content, {strip('text')} AS s FROM documents)"
    return {
        "tokens": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, {sorted_join('t')} AS tokens"
        f" FROM (SELECT doc_id, {toks('text')} AS t FROM documents)",
        "han_tokens": _han_tokens(),
        "lexicon_tokens": _lexicon_tokens(),
        "han_segments": _segmented(
            "SELECT doc_id, CAST(len(rs) AS INTEGER) AS n_runs, coalesce(array_to_string(paths, '/'), '') AS segments"
            " FROM runs LEFT JOIN told USING (doc_id)"
        ),
        "segmented_tokens": _segmented_tokens(),
        "ask_with_retries": _ask_with_retries(),
        "numbered_cases": f"""WITH {CHAT_CASES.strip()}
SELECT row_number() OVER (ORDER BY case_pos) - 1 AS case_pos, case_id, prompt, array_to_string(expect_keywords, '|') AS keywords
FROM chat_cases""",
        "compliance_long_list": f"""SELECT doc_id, CASE WHEN len(hits) > 0
    THEN concat({', '.join(lit(p) for p in texts.BANNED_TEXT.split('{words}')[:1])}, array_to_string(hits, ','),
      {lit(texts.BANNED_TEXT.split('{words}')[1])}) ELSE {lit(texts.COMPLIANT_TEXT)} END AS compliance_msg
FROM (SELECT doc_id, list_filter({list_of(derive.LONG_LIST)}, lambda w: contains(text, w)) AS hits FROM documents)""",
        "compliance_word_table": f"""WITH words AS (
  SELECT item_id, regexp_split_to_array(text, '[ \\n]') AS ws FROM benchmark),
singles AS (
  SELECT item_id * {derive.TURNS_PER_CONVERSATION} + 2 * i AS pos, ws[i + 1] AS word
  FROM (SELECT *, unnest(range(len(ws))) AS i FROM words)),
pairs AS (
  SELECT item_id * {derive.TURNS_PER_CONVERSATION} + 2 * i + 1 AS pos, concat(ws[i + 1], ' ', ws[i + 2]) AS word
  FROM (SELECT *, unnest(range(len(ws) - 1)) AS i FROM words)),
listed AS (
  SELECT word, min(pos) AS pos FROM (SELECT * FROM singles UNION ALL SELECT * FROM pairs) GROUP BY word),
hits AS (
  SELECT doc_id, string_agg(word, ',' ORDER BY pos) AS found FROM documents JOIN listed ON contains(text, word) GROUP BY doc_id)
SELECT doc_id, CASE WHEN found IS NULL THEN {lit(texts.COMPLIANT_TEXT)} ELSE
  concat({lit(texts.BANNED_TEXT.split('{words}')[0])}, found, {lit(texts.BANNED_TEXT.split('{words}')[1])}) END AS compliance_msg
FROM documents LEFT JOIN hits USING (doc_id)""",
        "validity_blank_len": f"""SELECT doc_id, CAST(length(s) AS INTEGER) AS stripped_chars,
  CASE WHEN s = '' THEN {lit(code_text(texts.EMPTY_ANSWER))}
    WHEN length(s) < 50 THEN concat('{code_text(texts.SHORT_ANSWER)}，仅', length(s), '字,低于阈值:50字')
    ELSE {lit(texts.VALID_TEXT)} END AS validity_msg
FROM (SELECT doc_id, {strip('text')} AS s FROM documents)""",
        "char_repeat": _with(
            doc_stripped, CHAR_SHARE,
            select="SELECT stripped.key AS doc_id, share AS top_share, coalesce(share > 0.7::DOUBLE, FALSE)"
            " AS is_repetitive FROM stripped LEFT JOIN shares USING (key)",
        ),
        "phrase_repeat": _with(
            doc_stripped, PHRASE_RUNS,
            select="SELECT stripped.key AS doc_id, CAST(times AS INTEGER) AS times, phrase"
            " FROM stripped LEFT JOIN phrase_runs USING (key)",
        ),
        "validity": _with(GIVEN_DOCS, VALIDITY, select="SELECT key AS doc_id, is_valid, validity_msg FROM validity"),
        "compliance": _with(
            GIVEN_DOCS, VALIDITY, select="SELECT key AS doc_id, is_compliant, compliance_msg FROM validity"
        ),
        "case_defaults": _with(
            DOC_CASES,
            select="SELECT case_pos, case_id, case_desc, prompt, CAST(length(standard_answer) AS INTEGER) AS"
            " standard_chars,"
            " array_to_string(expect_keywords, '|') AS keywords FROM doc_cases",
        ),
        "relevance": _doc_scores("relevance_score"),
        "completeness": _doc_scores("completeness_score"),
        "unsupported_terms": _doc_scores(
            f"CAST(n_extra AS INTEGER) AS n_extra, ratio AS extra_ratio, {sorted_join('extra')} AS extra_terms"
        ),
        "risk_level": _doc_scores("hallucination_level, level_score"),
        "risk_message": _doc_scores("hallucination_msg"),
        "total_score": _doc_scores("total_score"),
        "results": _doc_results("SELECT * FROM results"),
        "chat_results": _chat_results(),
        "judge_prompt": _judge_prompt(),
        "judge_override": _judge_override(),
        "request_body": """SELECT conv_id, turn, concat('{"model":"some-model","messages":[{"role":"user","content":',
  to_json(text), '}],"temperature":0.7}') AS request_body FROM conversations""",
        "reply_body": _reply_body(),
        "attempt_final": _with(
            ATTEMPTS, _final(1), select="SELECT request_id, attempt_no, error_kind, http_status, cost_ms FROM final"
        ),
        "outcome_code": _outcome_code(),
        "slow_calls": _with(
            ATTEMPTS, _final(2),
            select="SELECT request_id AS case_pos, cost_ms, error_kind IS NULL AND coalesce(http_status < 400, TRUE)"
            " AND cost_ms > 1000 AS is_slow FROM final",
        ),
        "generate_answers": _with(
            CHAT_CASES,
            select="SELECT case_pos, 0 AS code, concat('You said: ', prompt) AS data, 'ok' AS msg,"
            " length(prompt)::DOUBLE AS cost_ms FROM chat_cases",
        ),
        "placeholders": _placeholders(),
        "summary_counts": _summary(COUNTS, True),
        "summary_scores": _summary(MEANS, True),
        "summary_levels": _summary(LEVELS, True),
        "summary_pass_rates": _summary(PASSES, True),
        "summary": _summary(COUNTS + MEANS + LEVELS + PASSES, False),
        "batch_latest": _history("SELECT * FROM batches ORDER BY execute_time DESC, batch_id LIMIT 10"),
        "batch_by_id": _history(f"SELECT * FROM batches WHERE batch_id = {batch}"),
        "batch_cases": _history(f"SELECT * FROM details WHERE batch_id = {batch} ORDER BY case_pos"),
        "batch_details": _history(
            "SELECT batch_id, execute_time, case_pos, case_id, total_score, avg_total_score"
            " FROM batches JOIN details USING (batch_id)"
        ),
        "batch_delete": _history(f"SELECT * FROM batches WHERE batch_id <> {batch}"),
        "details_delete": _history(
            "SELECT batch_id, case_pos, total_score FROM (SELECT * REPLACE ("
            "CASE WHEN case_desc <> 'view' THEN batch_id END AS batch_id) FROM details)"
            f" WHERE batch_id IS DISTINCT FROM {batch}"
        ),
        "compare_batches": _compare_batches(),
        "regression_verdict": _regression_verdict(),
        "model_trend": _model_trend(),
        "model_changes": _model_changes(),
        "summary_rollup": _summary_rollup(),
        "batch_list_view": _history(
            "SELECT batch_id, execute_time, model_name, total_cases, success_rate, avg_total_score FROM batches"
            " ORDER BY execute_time DESC, batch_id LIMIT 25"
        ),
        "batch_detail_view": _detail_view(),
        "case_overview": _history(
            f"SELECT case_id, CASE WHEN success_flag THEN '{texts.STATUS_OK}' ELSE '{texts.STATUS_FAILED}' END"
            f" AS status, total_score, hallucination_level, case_desc FROM details WHERE batch_id = {batch}"
            " ORDER BY case_pos"
        ),
        "csv_rows": _csv_rows(),
    }
