"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from tessera.llm import chat
from tessera.llm.mixing import RATE_STEP, TERMS
from tessera.llm.queries import MIX_WEIGHTS, SHARDS


def _escaped(c: str) -> str:
    for a, b in chat.ESCAPES:
        c = f"replace({c}, '{a}', '{b}')"
    return c


OP2 = f"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(chat.OPEN + chat.CLOSE + chat.END)} + length({_escaped('role')}) + length({_escaped('text')}))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

_WEIGHT = "CASE " + " ".join(f"WHEN source = '{k}' THEN {v}" for k, v in MIX_WEIGHTS.items()) + " ELSE 1.0 END"

OP4 = f"""
WITH RECURSIVE sources AS (
  SELECT source, sum(coalesce(strlen(text), 0) + 1)::DOUBLE AS size, ({_WEIGHT})::DOUBLE AS weight FROM documents GROUP BY source
), totals AS (SELECT sum(weight) AS w, sum(size) AS n FROM sources),
rates AS (
  SELECT source, weight / w * n / size AS rate, greatest(ceil(weight / w * n / size / {RATE_STEP}), 1)::INT AS draws
  FROM sources, totals
), cdf(source, k, mean, p, c) AS (
  SELECT source, 0, rate / draws, exp(-(rate / draws)), exp(-(rate / draws)) FROM rates
  UNION ALL
  SELECT source, k + 1, mean, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k + 1 < {TERMS}
), tables AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
counted AS (
  SELECT d.doc_id, d.source, d.text, r.rate,
    list_sum(list_transform(range(1, draws + 1), lambda j: len(list_filter(cs,
      lambda c: c <= ('0x' || substr(md5(d.doc_id || '|' || j || '|copies-42'), 1, 8))::BIGINT / 4294967296.0)))) AS n
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
  JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
), copies AS (SELECT doc_id, source, text, rate, unnest(range(1, n::BIGINT + 1))::INT AS copy FROM counted)
SELECT doc_id, source, text, copy, rate, md5(doc_id || '|' || copy || '|order-42') AS order_key FROM copies
"""

# CRC-32 (reflected polynomial 0xEDB88320), one table step a byte
OP6 = f"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
                          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))
), bytes AS (
  SELECT doc_id, source, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents
), base AS (
  SELECT doc_id, source, size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) AS text_crc32,
    md5(doc_id || '|shard-42') AS h FROM bytes, crc
), ranked AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1) + 1)::DOUBLE
            / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS fraction FROM base
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, h, doc_id) - 1 AS position, count(*) OVER () AS n FROM ranked
), cut AS (SELECT *, (position * {SHARDS}) // n AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, position - (shard * n + {SHARDS - 1}) // {SHARDS} AS slot,
       NULL::INT AS grown_shard, source, position FROM cut
"""

ORACLES = {"op2_chat_formatting": OP2, "op4_poisson_mixing": OP4, "op6_stratified_interleaving": OP6}
