"""Codes, labels and message texts that results must carry literally."""

# ---- Fixed values: outcome codes and their texts --------------------------------
CODE_TEXTS = {
    0: "执行成功",
    2001: "请求超时",
    2002: "网络连接失败",
    2003: "接口返回HTTP错误状态码",
    2004: "响应内容解析失败",
    2005: "未知网络异常",
    3001: "回答内容为空",
    3002: "回答长度不足",
    3003: "回答重复率过高",
    3004: "检测到敏感词",
    4001: "模型回答提取失败",
    4002: "无标准答案，无法执行检测",
}

SUCCESS = 0
TIMEOUT = 2001
CONNECT_ERROR = 2002
HTTP_ERROR = 2003
BODY_NOT_JSON = 2004
OTHER_ERROR = 2005
EMPTY_ANSWER = 3001
SHORT_ANSWER = 3002
REPETITIVE_ANSWER = 3003
BANNED_WORD = 3004
NO_ANSWER_IN_BODY = 4001
NO_STANDARD = 4002

# ---- Fixed values: verdict texts, with slots for what was found -------------------
VALID_TEXT = "有效性校验通过"
SHORT_TEXT = "回答长度不足，仅{length}字,低于阈值:{limit}字"
CHAR_REPEAT_TEXT = "回答重复率过高：{rate}，高于阈值：{limit}"
PHRASE_REPEAT_TEXT = "回答重复率过高：短语「{phrase}」连续重复{times}次，超过阈值：{limit}次"
COMPLIANT_TEXT = "合规性校验通过"
COMPLIANCE_SKIPPED_TEXT = "未配置敏感词库，跳过合规性校验"
BANNED_TEXT = "检测到敏感词：{words}"
BLANK_RISK_TEXT = "回答内容为空，无幻觉风险"
NO_RISK_TEXT = "未检测到疑似幻觉内容"
LOW_RISK_TEXT = "疑似新增事实点{count}个（占比{ratio}）：{sample}"
MEDIUM_RISK_TEXT = "存在较多未核实内容，共{count}个（占比{ratio}）：{sample}"
HIGH_RISK_TEXT = "存在大量未核实内容，共{count}个（占比{ratio}），高幻觉风险：{sample}"
LOW_SAMPLE = 3
HIGHER_SAMPLE = 5
JUDGE_DEFAULT_TEXT = "LLM评判完成"

# ---- Fixed values: what failed calls and faults report ----------------------------
TIMEOUT_TEXT = "请求超时，超时限制{seconds}秒"
CONNECT_ERROR_TEXT = "网络连接失败，无法访问接口地址"
HTTP_ERROR_TEXT = "接口返回HTTP错误状态码：{detail}"
OTHER_ERROR_TEXT = "未知网络异常：{detail}"
BODY_NOT_JSON_TEXT = "响应内容解析失败，预期为JSON格式"
NO_ANSWER_IN_BODY_TEXT = "模型回答提取失败：{detail}"
FAULT_TEXT = "执行异常：{fault}"
MISSING_PROMPT_FAULT = "'prompt'"
# A NULL answer, with and without a list of banned words.
NULL_ANSWER_FAULT = "argument of type 'NoneType' is not iterable"
NULL_ANSWER_FAULT_NO_WORDS = "'NoneType' object has no attribute 'strip'"

# ---- Fixed values: risk levels and the score each one is worth -------------------
LEVEL_NONE = "无"
LEVEL_LOW = "低"
LEVEL_MEDIUM = "中"
LEVEL_HIGH = "高"
LEVEL_UNKNOWN = "未知"

LEVEL_SCORES = {
    LEVEL_NONE: 100,
    LEVEL_LOW: 60,
    LEVEL_MEDIUM: 40,
    LEVEL_HIGH: 20,
    LEVEL_UNKNOWN: 80,
}
OTHER_LEVEL_SCORE = 80

JUDGE_LEVELS = {0: LEVEL_NONE, 1: LEVEL_LOW, 2: LEVEL_MEDIUM, 3: LEVEL_HIGH}

SUMMARY_LEVELS = {
    "none": LEVEL_NONE,
    "low": LEVEL_LOW,
    "medium": LEVEL_MEDIUM,
    "high": LEVEL_HIGH,
    "unknown": LEVEL_UNKNOWN,
}

# ---- Fixed values: case defaults, case status and the judge's prompt -------------
UNKNOWN_CASE_ID = "unknown_id"
UNKNOWN_CASE_DESC = "unknown_desc"
STATUS_OK = "成功"
STATUS_FAILED = "失败"

JUDGE_TEMPLATE = """【参考原文】
{standard_answer}

【待检测回答】
{answer_content}

请输出校验结果JSON。
"""

# ---- Our own texts, for states only a table can have ----------------------------
NO_OUTCOME_TEXT = "没有该用例的调用结果"
