"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm import (
    bpe_stream, conversation_repair, decontamination, exact_dedup, html_text, lang_id, mixing, periodic_runs, secret_scan,
    simhash, substring_dedup, token_output, toxicity,
)
from reelquery.llm.common import crc_class, table

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labelled = lang_id.language_of(docs, lang_id.train(docs))
    return labelled.select("doc_id", (crc_class(lang_id.FOLDS) == 0).alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP3_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
    AS text_sha256
  FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op5_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return token_output.token_output(table(spark, folder, "documents"), vocabulary(WORD_VOCABULARY))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM starts),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM windows)
  WHERE nth > 1
), covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM repeated),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS text
  FROM words ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.toxicity(docs, toxicity.train(docs, table(spark, folder, "labels")))
    held_out = crc_class(toxicity.FOLDS) == toxicity.HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op9_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_stream.encode_decode(table(spark, folder, "documents"), vocabulary(BYTE_VOCABULARY))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secrets(table(spark, folder, "documents"))


def op11_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.periodic_runs(periodic_runs.planted(table(spark, folder, "documents")))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repaired(conversation_repair.damaged(table(spark, folder, "conversations")))


#: crc32 has no SQL function: its table of 256 entries, from its polynomial, and a fold over the letters.
CRC_SQL = """
crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))
)"""
OP12_SQL = f"""
WITH {CRC_SQL}, texts AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents, crc
), planted AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
      ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE ws END AS words
  FROM (SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM (SELECT *, len(ws) AS n, h // 10 % greatest(len(ws), 1) AS a FROM texts))
), grams AS (
  SELECT doc_id, i, array_to_string(words[i + 1:i + 16], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(len(words) - 15)) AS i FROM planted WHERE len(words) >= 24)
), again AS (
  SELECT doc_id, i, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS m FROM grams) WHERE m > 1
), stretches AS (
  -- Runs of neighbouring places whose 16 words come again at one distance.
  SELECT doc_id, d, min(i) AS s, count(*) + 15 + d AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS g
    FROM (SELECT a.doc_id, a.i, b.i - a.i AS d FROM again a JOIN again b ON a.doc_id = b.doc_id AND a.k = b.k AND b.i > a.i))
  GROUP BY doc_id, d, g
), runs AS (
  SELECT * FROM stretches x WHERE n >= greatest(24, 3 * d) AND NOT EXISTS (SELECT 1 FROM stretches y
    WHERE y.doc_id = x.doc_id AND y.d < x.d AND x.d % y.d = 0 AND y.s <= x.s AND y.s + y.n >= x.s + x.n)
), told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', n, ',', d, chr(10)), '' ORDER BY s, d) AS lines FROM runs GROUP BY doc_id
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n / d DESC, s, d) = 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(s + d, s + n)) AS i FROM runs),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM planted),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, n AS length, d AS period, 1000 * n // d AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM planted p LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL}, keyed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(concat(conv_id, ':', turn), ''),
    lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 AS k
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g')
      ELSE coalesce(text, ' ') END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM keyed WHERE k <> 0
), numbered AS (
  SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS ini,
    lag(left(role, 1)) OVER o AS before,
    regexp_replace(text, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS core
  FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), marked AS (
  SELECT *, core = '' AS blank, core <> '' AND nth > 1 AS duplicate,
    core <> '' AND nth = 1 AND right(core, 1) NOT IN ('.', '!', '?') AS truncated
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM numbered)
), ways AS (
  -- Cost, audit and lines to go, for the states start, system, user, assistant.
  SELECT conv_id, n + 1 AS i, [{{'c': 0::BIGINT, 's': '', 'r': ''}}, {{'c': 4, 's': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}},
    {{'c': 2, 's': 'I', 'r': chr(10) || 'assistant:'}}, {{'c': 0, 's': '', 'r': ''}}] AS v
  FROM (SELECT DISTINCT conv_id, n FROM marked)
  UNION ALL
  SELECT conv_id, i, list_transform([1, 2, 3, 4], lambda st: list_sort([w[st], {{'c': 2 + x[t[st]].c, 's': 'I' || x[t[st]].s,
    'r': chr(10) || names[t[st]] || ':' || x[t[st]].r}}])[1])
  FROM (SELECT *, list_transform([1, 2, 3, 4], lambda st: list_sort([w[st], {{'c': 2 + w[t[st]].c, 's': 'I' || w[t[st]].s,
      'r': chr(10) || names[t[st]] || ':' || w[t[st]].r}}])[1]) AS x
    FROM (SELECT m.conv_id, m.i, [3, 3, 4, 3] AS t, ['', '', 'user', 'assistant'] AS names,
        list_transform([1, 2, 3, 4], lambda st: list_sort(list_filter([
          {{'c': 3 + v[st].c, 's': 'D' || v[st].s, 'r': v[st].r}},
          CASE WHEN NOT (blank OR duplicate) AND ini = 's' AND st = 1 THEN {{'c': truncated::BIGINT + v[2].c, 's': 'K' || v[2].s,
              'r': chr(10) || role || ':' || text || v[2].r}}
            WHEN NOT (blank OR duplicate) AND ini = 'u' AND st <> 3 THEN {{'c': truncated::BIGINT + v[3].c, 's': 'K' || v[3].s,
              'r': chr(10) || role || ':' || text || v[3].r}}
            WHEN NOT (blank OR duplicate) AND ini = 'a' AND st = 3 THEN {{'c': truncated::BIGINT + v[4].c, 's': 'K' || v[4].s,
              'r': chr(10) || role || ':' || text || v[4].r}} END,
          CASE WHEN NOT (blank OR duplicate) THEN {{'c': 2 + truncated::BIGINT + v[CASE st WHEN 3 THEN 4 ELSE 3 END].c,
            's': 'R' || v[CASE st WHEN 3 THEN 4 ELSE 3 END].s, 'r': chr(10) || CASE st WHEN 3 THEN 'assistant' ELSE 'user' END
              || ':' || text || v[CASE st WHEN 3 THEN 4 ELSE 3 END].r}} END
        ], lambda y: y IS NOT NULL))[1]) AS w
      FROM ways JOIN marked m ON m.conv_id = ways.conv_id AND m.i = ways.i - 1))
), counted AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v[1].c, 0) AS cost,
  coalesce(v[1].s, '') AS audit, sha256(coalesce(substr(v[1].r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counted USING (conv_id)
LEFT JOIN (SELECT conv_id, v FROM ways WHERE i = 1) USING (conv_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_html_text": op4_html_text,
    "op5_token_output": op5_token_output,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_secret_scan": op10_secret_scan,
    "op11_source_mix": op11_source_mix,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL, "op6_substring_dedup": OP6_SQL, "op12_periodic_runs": OP12_SQL, "op13_conversation_repair": OP13_SQL,
}
