"""The queries of the operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answergauge.llm import capture_index, chat_format, divergence, language_id, lattice_lm, line_quality, mixing, packing, pii, spelling, suffix_dedup, topk, weighted_minhash
from answergauge.llm.common import id_remainder, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture, tickets = mixing.mix(table(spark, sf_dir, "documents"))
    return mixture.plan(tickets)


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id",
        "start",
        F.expr("octet_length(ids) div 4").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "tier",
        "step_id",
    )


def op2_pack_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


OP3_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5
"""


def op4_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held_out = id_remainder("doc_id", 7) == 2
    return lattice_lm.score(table(spark, sf_dir, "documents"), held_out, public_tokenizers.path("piece_bpe_32k.model"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.classes(table(spark, sf_dir, "documents"))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.measures(table(spark, sf_dir, "documents"))


# The rules of line_quality.py in the terms of DuckDB. Windows are told apart by their text.
OP7_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), windows AS (
  SELECT k, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT k, words, unnest(range(1, len(words) - 6)) AS i FROM parts)
), twice AS (
  SELECT k, win FROM windows GROUP BY k, win HAVING count(*) > 1
), covered AS (
  SELECT k, count(DISTINCT i + o) AS n FROM windows JOIN twice USING (k, win), range(8) r(o) GROUP BY k
), lined AS (
  SELECT *, list_filter(lines, lambda l: NOT (
      (len(regexp_extract_all(lower(l), '{notices}')) > 0 AND len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))
        <= {per_notice} * len(regexp_extract_all(lower(l), '{notices}')))
      OR (len(regexp_extract_all(lower(l), '{invitations}')) > 0 AND len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))
        <= {per_invitation} * len(regexp_extract_all(lower(l), '{invitations}')))
      OR len(regexp_extract_all(l, '[#*$%&|<>]')) * 2 > len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))
      OR (NOT regexp_matches(l, '{ending}') AND len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) < {unended} AND length(lower(l)) < {unended_chars})
      OR (len(regexp_extract_all(l, '{separators}')) >= {least_separators}
        AND len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) <= {per_separator} * len(regexp_extract_all(l, '{separators}')))
      OR (len(regexp_extract_all(l, '{shouts}')) >= {least_shouts}
        AND len(regexp_extract_all(l, '{shouts}')) * 2 > len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))))) AS good
  FROM parts
), figures AS (
  SELECT k, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) - len(good) AS BIGINT) AS n_failed_lines,
    length(coalesce(array_to_string(lines, ''), '')) AS chars, length(coalesce(array_to_string(good, ''), '')) AS kept_chars
  FROM lined LEFT JOIN covered USING (k)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (chars - kept_chars) <= 50 * chars AS kept
FROM figures
""".format(
    notices=line_quality.phrases(line_quality.NOTICES).replace("'", "''"),
    invitations=line_quality.phrases(line_quality.INVITATIONS).replace("'", "''"),
    per_notice=line_quality.WORDS_PER_NOTICE,
    per_invitation=line_quality.WORDS_PER_INVITATION,
    ending=line_quality.ENDING.replace("'", "''"),
    separators=line_quality.SEPARATORS,
    least_separators=line_quality.LEAST_SEPARATORS,
    per_separator=line_quality.WORDS_PER_SEPARATOR,
    shouts=line_quality.SHOUTS,
    least_shouts=line_quality.LEAST_SHOUTS,
    unended=line_quality.UNENDED_WORDS,
    unended_chars=line_quality.UNENDED_CHARS,
)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 3) == 1
    model = language_id.train(docs.where(~held_out))
    return model.predict(docs).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op9_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = capture_index.archive_and_read(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), firsts AS (
  SELECT *, min(CASE WHEN payload_bytes >= 100 THEN page_id END) OVER (PARTITION BY html) AS first FROM sized
)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""


def op10_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = {f"n_{k}": F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long") for k in pii.BASE_KINDS}
    return found.select(
        "doc_id",
        *[c.alias(name) for name, c in counts.items()],
        F.sha2(pii.digest(F.col("spans"), pii.BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        pii.digest(F.col("spans")).alias("spans"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), found AS (
  SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM found GROUP BY lang, term HAVING count(DISTINCT k) >= 10
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), dense AS (
  SELECT lang, source, term, lang_n, coalesce(n, 0) AS n
  FROM groups JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)
), totals AS (
  SELECT lang, source, sum(n) AS total, sum(lang_n) AS lang_total, count(*) AS v FROM dense GROUP BY ALL
), chances AS (
  SELECT lang, source, term, n,
    1 + (1000000000 * (n + 2)::HUGEINT) // (total + 2 * v)::HUGEINT AS p,
    1 + (1000000000 * (lang_n + 2)::HUGEINT) // (lang_total + 2 * v)::HUGEINT AS q
  FROM dense JOIN totals USING (lang, source)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM chances a JOIN chances b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
  FROM chances WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 10
"""


def chat_records(turns: DataFrame) -> DataFrame:
    """The rows of ``conversations`` as records in the layouts that data of this kind has: by conversation, rows as they
    are, lists of messages under two sets of names, prompts with completions, instructions with outputs."""
    role, text = F.col("role"), F.coalesce("text", F.lit(""))

    def fields(**names: str) -> Column:
        """A field named after the role; other roles stand in a list of messages."""
        named = F.lit(None).cast("string")
        for of, name in names.items():
            named = F.when(role == of, F.to_json(F.struct(text.alias(name)))).otherwise(named)
        return F.coalesce(named, messages)

    def listed(at: str, who: Column, role_name: str, text_name: str) -> Column:
        item = F.struct(who.alias(role_name), text.alias(text_name), F.col("turn").alias("weight"))
        return F.to_json(F.struct(F.array(item).alias(at), F.col("conv_id").alias("id")))

    messages = listed("messages", role, "role", "content")
    speaker = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    known = role.isin("user", "assistant", "system")
    kind = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(5))
    record = (
        F.when(kind == 1, messages)
        .when((kind == 2) & known, listed("conversations", speaker, "from", "value"))
        .when(kind == 3, fields(system="system", user="prompt", assistant="completion"))
        .when(kind == 4, fields(system="system", user="instruction", assistant="output"))
        .otherwise(F.to_json(F.struct(F.coalesce(role, F.lit("")).alias("role"), text.alias("text"), "conv_id", "turn")))
    )
    return turns.select("conv_id", "turn", record.alias("record"))


HARD_TEXT = "\\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = [(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)]
    turns = turns.unionByName(spark.createDataFrame(hard, turns.schema))
    return chat_format.read_back(chat_format.format_turns(chat_format.turns_of(chat_records(turns))))


OP13_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(replace(replace(role, '', '\'), chr(10), '
'))
    + length(replace(replace(text, '### ', '\### '), '</turn>', '\</turn>')) + 15 AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return own | {"pipeline": corpus_pipeline.run}


def all_sql() -> dict[str, str]:
    return {
        "op3_exact_topk": OP3_SQL, "op7_line_quality": OP7_SQL, "op9_capture_index": OP9_SQL,
        "op12_source_divergence": OP12_SQL,
        "op13_chat_format": OP13_SQL,
    }
