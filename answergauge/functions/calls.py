"""Model calls as data: request bodies, reply bodies, failed calls."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from answergauge import texts
from answergauge.functions.text import fill_template, parse_json

ANSWER_PATH = "$.choices[0].message.content"

# Request settings.
TEMPERATURE = 0.7
SLOW_CALL_MS = 1500
TIMEOUT_SECONDS = 30
MAX_RETRY = 1


def request_body(prompt: Column, model: str | None = None) -> Column:
    """JSON body of a one-message chat request. Without ``model``, the environment variable
    ``LLM_MODEL`` names it; no vendor's model is assumed, so without either the name is ``unknown``."""
    model = model or os.environ.get("LLM_MODEL", "unknown")
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.array(message).alias("messages"),
            F.lit(TEMPERATURE).alias("temperature"),
        )
    )


def _outcome(code: int, data: Column, msg: Column | None = None) -> Column:
    msg = F.lit(texts.CODE_TEXTS[code]) if msg is None else msg
    return F.struct(F.lit(code).alias("code"), data.cast("string").alias("data"), msg.alias("msg"))


def parse_body(body: Column) -> Column:
    """``struct<code, data, msg>`` of a reply body: the answer text, or why there is none.

    A JSON null answer is a successful call with a NULL answer; so is an answer that is not text."""
    parsed = parse_json(body)
    answer = F.try_variant_get(parsed, ANSWER_PATH, "variant")
    kind = F.schema_of_variant(answer)

    def absent(path: str) -> Column:
        return F.try_variant_get(parsed, path, "variant").isNull()

    # Names the first step of the path that the body lacks.
    step = (
        F.when(absent("$.choices"), "'choices'")
        .when(absent("$.choices[0]"), "list index out of range")
        .when(absent("$.choices[0].message"), "'message'")
        .otherwise("'content'")
    )
    not_json = F.lit(texts.BODY_NOT_JSON_TEXT)
    no_answer = fill_template(texts.NO_ANSWER_IN_BODY_TEXT, {"detail": step})
    return (
        F.when(parsed.isNull(), _outcome(texts.BODY_NOT_JSON, body, not_json))
        .when(answer.isNull(), _outcome(texts.NO_ANSWER_IN_BODY, body, no_answer))
        .when(kind == "STRING", _outcome(texts.SUCCESS, F.try_variant_get(parsed, ANSWER_PATH, "string")))
        .otherwise(_outcome(texts.SUCCESS, F.lit(None)))
    )


def is_retryable(error_kind: Column) -> Column:
    """Only lost connections and timeouts are worth another try."""
    return F.coalesce(error_kind.isin("timeout", "connect"), F.lit(False))


def got_reply(error_kind: Column, http_status: Column) -> Column:
    """The server answered, and not with an HTTP error."""
    return error_kind.isNull() & F.coalesce(http_status < 400, F.lit(True))


def call_outcome(
    error_kind: Column,
    http_status: Column,
    body: Column,
    error_text: Column,
    timeout_seconds: int = TIMEOUT_SECONDS,
) -> Column:
    """``struct<code, data, msg>`` of one call, failed or not."""

    detail = {"detail": F.coalesce(error_text, F.lit(""))}
    timed_out = fill_template(texts.TIMEOUT_TEXT, {"seconds": timeout_seconds})
    nothing = F.lit(None)
    return (
        F.when(error_kind == "timeout", _outcome(texts.TIMEOUT, nothing, timed_out))
        .when(
            error_kind == "connect", _outcome(texts.CONNECT_ERROR, nothing, F.lit(texts.CONNECT_ERROR_TEXT))
        )
        .when(
            http_status >= 400,
            _outcome(texts.HTTP_ERROR, body, fill_template(texts.HTTP_ERROR_TEXT, detail)),
        )
        .when(
            error_kind.isNotNull(),
            _outcome(texts.OTHER_ERROR, nothing, fill_template(texts.OTHER_ERROR_TEXT, detail)),
        )
        .otherwise(parse_body(body))
    )
