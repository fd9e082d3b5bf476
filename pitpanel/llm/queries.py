"""Registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from pitpanel.llm.decontaminate import op6_benchmark_decontamination
from pitpanel.llm.embedding_dedup import op8_embedding_near_dedup
from pitpanel.llm.html_extract import op10_html_main_text
from pitpanel.llm.language_masks import op13_language_masks
from pitpanel.llm.lines import op1_line_dedup
from pitpanel.llm.minhash import op2_minhash_near_dedup
from pitpanel.llm.mixing import BUDGET, SWEEPS, TEMPER, op3_target_mixture
from pitpanel.llm.ranked_search import K, op11_ranked_search
from pitpanel.llm.secrets import op9_secret_ledger
from pitpanel.llm.shards import op5_stratified_shards
from pitpanel.llm.suffix_dedup import op7_suffix_array_dedup
from pitpanel.llm.token_alignment import op12_token_alignment
from pitpanel.llm.toxicity import op4_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_minhash_near_dedup,
        op3_target_mixture,
        op4_toxicity,
        op5_stratified_shards,
        op6_benchmark_decontamination,
        op7_suffix_array_dedup,
        op8_embedding_near_dedup,
        op9_secret_ledger,
        op10_html_main_text,
        op11_ranked_search,
        op12_token_alignment,
        op13_language_masks,
    )
}

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"



def _raking() -> str:
    """The sweeps of op3, one CTE per sweep and dimension."""
    out, last = [], "w0"
    for k in range(SWEEPS):
        for d in TEMPER:
            now = f"w{k + 1}_{d}"
            held = f"sum(weight) OVER (PARTITION BY {d})"
            out.append(
                f"{now} AS (SELECT * REPLACE (CASE WHEN {held} > 0 THEN weight * target_{d} / {held} ELSE 0 END AS weight) FROM {last})"
            )
            last = now
    return ",\n".join(out) + f", fitted AS (SELECT * FROM {last})"


def _targets() -> str:
    parts = []
    for d, power in TEMPER.items():
        parts.append(
            f"t_{d} AS (SELECT {d}, pow(m, {power}) / sum(pow(m, {power})) OVER () AS target_{d} FROM "
            f"(SELECT {d}, sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM cells) AS m FROM cells GROUP BY {d}))"
        )
    return ",\n".join(parts)


ORACLE_SQL = {
    "op11_ranked_search": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
whole AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
weighed AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, whole GROUP BY term, docs),
q AS (
  SELECT item_id, text, term, count(*) AS times
  FROM (SELECT item_id, text,
               unnest(regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
scored AS (
  SELECT item_id, text, rid, doc_id,
         sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN weighed USING (term) JOIN p USING (term), whole GROUP BY ALL),
ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST, rid)::INT AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}
""",
    "op6_benchmark_decontamination": rf"""
WITH b AS (
  SELECT cast(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM b WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
pos AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT rid, i, n, item FROM pos JOIN win USING (n, gram)),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN items USING (rid)
""",
    "op5_stratified_shards": r"""
WITH crc AS (
  SELECT list(c ORDER BY b) AS t
  FROM (SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS b))),
bytes AS (
  SELECT row_number() OVER () AS rid, doc_id, source, octet_length(encode(coalesce(text, ''))) + 16 AS size,
         hex(encode(coalesce(text, ''))) AS h
  FROM documents),
rows AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS source, size,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT,
             list_transform(range(1, (size - 15)::BIGINT), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) AS text_crc32,
         md5('shards-1|' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM bytes, crc),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id, text_crc32, size) AS rank,
         count(*) OVER (PARTITION BY source) AS rows
  FROM rows),
placed AS (
  SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY (2 * rank - 1)::DOUBLE / (2 * rows), source, draw,
         doc_id, text_crc32, size) - 1 AS position
  FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position * 40 // n)::INT AS shard,
       position - ((position * 40 // n) * n + 39) // 40 AS slot, NULL::INT AS grown_shard
FROM placed
""",
    "op1_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT rid, source, p, line FROM (SELECT rid, source, unnest(lines) AS line, unnest(range(len(lines))) AS p FROM d)),
total AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
held AS (SELECT source, trim(line) AS line, count(DISTINCT rid) AS holders FROM l WHERE trim(line) <> '' GROUP BY ALL),
bad AS (SELECT h.source, h.line FROM held h JOIN total t ON h.source IS NOT DISTINCT FROM t.source
        WHERE holders >= 5 AND holders > 0.02 * pages),
kept AS (SELECT l.rid, l.p, l.line FROM l WHERE NOT EXISTS (
           SELECT 1 FROM bad b WHERE b.source IS NOT DISTINCT FROM l.source AND b.line = trim(l.line))),
k AS (SELECT rid, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS text FROM kept GROUP BY rid)
SELECT doc_id, source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(len(lines), 0) AS n_lines, coalesce(len(lines), 0) - coalesce(n, 0) AS n_dropped
FROM d LEFT JOIN k USING (rid)
""",
    "op3_target_mixture": rf"""
WITH t AS (
  SELECT doc_id, source, lang, text,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda w: w <> '')) AS tokens
  FROM documents),
d AS (
  SELECT doc_id, source, lang, tokens,
         CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '%%%') THEN 'noisy'
              WHEN tokens < 100 THEN 'short' WHEN tokens >= 2000 THEN 'long' ELSE 'prose' END AS topic
  FROM t),
cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL),
{_targets()},
w0 AS (SELECT c.*, target_source, target_lang, target_topic,
              tokens::DOUBLE / (SELECT sum(tokens) FROM cells) AS share,
              tokens::DOUBLE / (SELECT sum(tokens) FROM cells) AS weight
       FROM cells c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
{_raking()},
p AS (SELECT source, lang, topic, least(1.0::DOUBLE, {BUDGET}::DOUBLE * weight / share) AS p FROM fitted)
SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability,
       ('0x' || substr(md5('mix-1|' || doc_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < p AS kept
FROM d JOIN p USING (source, lang, topic)
""",
}
