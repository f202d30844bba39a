"""The queries that SQL can express, as DuckDB SQL over whole tables."""

from __future__ import annotations

# Sketches hold up to 2048 values exactly, so the plain order statistics are the same there.
QUALITY = r"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), counts AS (
  SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(lines) AS n_lines, length(regexp_replace(text, '[^\p{Lu}!]+', '', 'g')) AS n_shouted
  FROM words LEFT JOIN covered USING (doc_id)
), measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols::DOUBLE / greatest(n_words, 1)::DOUBLE AS symbol_ratio,
         n_dup_lines::DOUBLE / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio,
         n_repeat_words::DOUBLE / greatest(n_words, 1)::DOUBLE AS repeat_ratio,
         n_shouted::DOUBLE / greatest(word_chars, 1)::DOUBLE AS shout_ratio,
         word_chars::DOUBLE / greatest(n_words, 1)::DOUBLE AS word_length
  FROM counts
), long AS (
  SELECT lang, source, m.name AS metric, m.value AS value FROM (
    SELECT lang, source, unnest([
      {'name': 'symbol_ratio', 'value': symbol_ratio}, {'name': 'dup_line_ratio', 'value': dup_line_ratio},
      {'name': 'repeat_ratio', 'value': repeat_ratio}, {'name': 'shout_ratio', 'value': shout_ratio},
      {'name': 'word_length', 'value': word_length}]) AS m
    FROM measured WHERE NOT base_failed)
), spread AS (
  SELECT * FROM (VALUES ('symbol_ratio', 0.02), ('dup_line_ratio', 0.15), ('repeat_ratio', 0.1),
                        ('shout_ratio', 0.05), ('word_length', 0.5)) AS t(metric, least)
), own AS (
  SELECT lang, source, metric, count(*) AS n, list_sort(list(value)) AS v FROM long GROUP BY ALL
), of_lang AS (
  SELECT lang, metric, count(*) AS n, list_sort(list(value)) AS v FROM long GROUP BY ALL
), whole AS (
  SELECT metric, list_sort(list(value)) AS v FROM long GROUP BY ALL
), each AS (
  SELECT own.lang, own.source, own.metric,
         (own.n::DOUBLE * own.n) * (own.n::DOUBLE * own.n)
           / ((own.n::DOUBLE * own.n) * (own.n::DOUBLE * own.n) + 6250000.0::DOUBLE) AS own_weight,
         (of_lang.n::DOUBLE * of_lang.n) * (of_lang.n::DOUBLE * of_lang.n)
           / ((of_lang.n::DOUBLE * of_lang.n) * (of_lang.n::DOUBLE * of_lang.n) + 6250000.0::DOUBLE) AS lang_weight,
         own.v AS own_v, of_lang.v AS lang_v, whole.v AS all_v
  FROM own JOIN of_lang ON own.lang IS NOT DISTINCT FROM of_lang.lang AND own.metric = of_lang.metric
  JOIN whole ON own.metric = whole.metric
), quartile AS (
  SELECT lang, source, metric, own_weight, lang_weight, q,
         own_v[ceil(len(own_v) * q)::INT] AS own_q, lang_v[ceil(len(lang_v) * q)::INT] AS lang_q,
         all_v[ceil(len(all_v) * q)::INT] AS all_q
  FROM each, (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) AS t(q)
), quartiles AS (
  SELECT lang, source, metric,
         max(v) FILTER (q = 0.25) AS q1, max(v) FILTER (q = 0.75) AS q3
  FROM (SELECT *, own_q * own_weight + (lang_q * lang_weight + all_q * (1 - lang_weight)) * (1 - own_weight) AS v
        FROM quartile)
  GROUP BY ALL
), fences AS (
  SELECT lang, source, metric, q3 + 3.0::DOUBLE * greatest(q3 - q1, least::DOUBLE) AS high,
         q1 - 3.0::DOUBLE * greatest(q3 - q1, least::DOUBLE) AS low
  FROM quartiles JOIN spread USING (metric)
), wide AS (
  SELECT lang, source,
         max(high) FILTER (metric = 'symbol_ratio') AS symbol_high,
         max(high) FILTER (metric = 'dup_line_ratio') AS dup_high,
         max(high) FILTER (metric = 'repeat_ratio') AS repeat_high,
         max(high) FILTER (metric = 'shout_ratio') AS shout_high,
         max(high) FILTER (metric = 'word_length') AS length_high,
         max(low) FILTER (metric = 'word_length') AS length_low
  FROM fences GROUP BY lang, source
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbol_ratio <= symbol_high AND dup_line_ratio <= dup_high
         AND repeat_ratio <= repeat_high AND shout_ratio <= shout_high
         AND word_length <= length_high AND word_length >= length_low, true) AS kept
FROM measured m LEFT JOIN wide f
  ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
"""

MIXING = """
WITH sizes AS (
  SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS size FROM documents GROUP BY source
), weighed AS (
  SELECT *, CASE WHEN size > 0 THEN pow(size, 0.5) ELSE 0 END AS weight FROM sizes
), rates AS (
  SELECT source, (SELECT sum(size) FROM weighed) * weight / (SELECT sum(weight) FROM weighed) / size AS rate
  FROM weighed WHERE size > 0
), masses AS (
  SELECT source, k, exp(-rate + k * ln(rate) - sum(ln(greatest(k, 1))) OVER (PARTITION BY source ORDER BY k)) AS mass
  FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM rates)
), steps AS (
  SELECT source, k, sum(mass) OVER (PARTITION BY source ORDER BY k) AS step FROM masses
), drawn AS (
  SELECT *, (('0x' || substr(md5('count 17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5)
            / 4503599627370496.0::DOUBLE AS u
  FROM documents
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*)::INT AS n_copies
  FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.step < d.u GROUP BY ALL
)
SELECT *, md5('order 17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1))::INT AS copy FROM counted)
"""

ORACLE = {"op1_quality_rules": QUALITY, "op8_mixing": MIXING}
