"""The queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelforge.llm import host_rules, jaccard_join, language, minhash, mixing, perplexity, phrases, pieces, pii, repair, simhash, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select_epochs(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_rules.host_verdicts(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_docs", "host_failed", "host_off")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents")).drop("piece_ids")


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.keep_fluent(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(_table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {f.__name__: f for f in (op1_warc, op2_mixing, op3_simhash, op4_host_rules, op5_sentencepiece, op6_perplexity, op7_toxicity, op8_language, op9_jaccard_join, op10_pii, op11_repair, op12_collocations, op13_minhash)}

# Rules of op4 as its operator has them; its host step fits a beta prior by moments.
_OP1 = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
  h AS (SELECT page_id, url, octet_length(encode(payload))::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id, payload_bytes >= 100 AND page_id <> first_id AS again FROM h)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to, url FROM f"""

_OP4 = r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
  g AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
  twice AS (SELECT doc_id, unnest(list(i)) AS i FROM (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM g) GROUP BY doc_id, win HAVING count(*) > 1),
  rep AS (SELECT doc_id, sum(step)::BIGINT AS n_repeat_words FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM twice) GROUP BY 1),
  c AS (SELECT doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len([x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')]) AS n_lines, len(list_distinct([x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')])) AS n_unlike FROM w),
  r AS (SELECT doc_id, host, n_words, word_chars, n_symbols, (n_lines - n_unlike)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed FROM c LEFT JOIN rep USING (doc_id)),
  rules AS (SELECT doc_id, host, k.rule, k.failed FROM r, LATERAL (VALUES ('few', n_words < 20), ('repeats', 100 * n_repeat_words > 30 * n_words), ('symbols', 100 * n_symbols > 10 * n_words),
    ('lines', 100 * n_dup_lines > 30 * n_words), ('length', n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 40 * n_words))) k(rule, failed)),
  h AS (SELECT host, rule, count(*)::DOUBLE AS n, count_if(failed)::DOUBLE AS bad FROM rules GROUP BY 1, 2),
  m AS (SELECT rule, sum(bad) / sum(n) AS mean, sum(n) AS docs, count(*) AS hosts, sum(n) - sum(n * n) / sum(n) AS room, sum(bad * bad / n) AS square FROM h GROUP BY 1),
  v AS (SELECT rule, mean, least(greatest(CASE WHEN room > 0 THEN (square - docs * mean * mean - (hosts - 1) * mean * (1 - mean)) / room ELSE 0 END, 1e-9), greatest(mean * (1 - mean), 1e-9)) AS between_hosts FROM m),
  p AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / between_hosts - 1, 1), 1000) AS strength, least(mean + 2 * greatest(sqrt(between_hosts), 0.025), 0.5) AS most FROM v),
  q AS (SELECT host, rule, n, bad, (bad + mean * strength) / (n + strength) AS rate, most FROM h JOIN p USING (rule)),
  o AS (SELECT doc_id, max(n)::BIGINT AS host_docs, max(bad)::BIGINT AS host_failed, bool_or(rate > most AND (failed OR rate > 0.5)) AS host_off FROM rules JOIN q USING (host, rule) GROUP BY doc_id)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_off AS kept, host, host_docs, host_failed, host_off FROM r JOIN o USING (doc_id)"""

_OP9 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles FROM w),
  t AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
  both_in AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n + b.n) AS n, count(*) AS shared FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS MATERIALIZED (SELECT x, y FROM both_in WHERE 100 * shared >= 80 * (n - shared)),
  reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
  SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""

# Rows of a conversation are taken from its end; f0 to f3 are the least (cost, audit, lines) from each state of the grammar.
_OP11 = r"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT),
      lambda crc, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295::BIGINT), 4294967295) % 20 AS draw FROM conversations),
  e AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE draw WHEN 0 THEN []::BIGINT[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d),
  n AS (SELECT conv_id, turn, role, text, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS mark, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM e),
  r AS (SELECT *, mark = '' AS blank, mark <> '' AND again AS duplicate, mark NOT IN ('', '.', '!', '?') AND NOT again AS truncated,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM n),
  t AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank, count_if(duplicate)::BIGINT AS duplicate,
    count_if(truncated)::BIGINT AS truncated, count_if(illegal)::BIGINT AS illegal FROM r GROUP BY conv_id),
  x AS (SELECT conv_id, i, role, text, initial, blank OR duplicate AS gone, CASE WHEN truncated THEN 3 ELSE 0 END::BIGINT AS more FROM r),
  f AS (SELECT conv_id, rows + 1 AS i, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS f0, {'c': 6::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']} AS f1,
      {'c': 3::BIGINT, 'a': 'I', 't': ['assistant:']} AS f2, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS f3 FROM t
    UNION ALL SELECT conv_id, i, least(b0, {'c': b2.c + 3, 'a': 'I' || b2.a, 't': ['user:'] || b2.t}, {'c': b3.c + 6, 'a': 'II' || b3.a, 't': ['user:', 'assistant:'] || b3.t}),
      least(b1, {'c': b2.c + 3, 'a': 'I' || b2.a, 't': ['user:'] || b2.t}, {'c': b3.c + 6, 'a': 'II' || b3.a, 't': ['user:', 'assistant:'] || b3.t}),
      least(b2, {'c': b3.c + 3, 'a': 'I' || b3.a, 't': ['assistant:'] || b3.t}), least(b3, {'c': b2.c + 3, 'a': 'I' || b2.a, 't': ['user:'] || b2.t}) FROM
      (SELECT conv_id, i,
        least({'c': f0.c + 4, 'a': 'D' || f0.a, 't': f0.t}, {'c': CASE WHEN gone THEN 1000000000000 ELSE f2.c + more + 3 END, 'a': 'R' || f2.a, 't': ['user:' || text] || f2.t},
          {'c': CASE WHEN gone OR initial <> 'u' THEN 1000000000000 ELSE f2.c + more END, 'a': 'K' || f2.a, 't': [role || ':' || text] || f2.t},
          {'c': CASE WHEN gone OR initial <> 's' THEN 1000000000000 ELSE f1.c + more END, 'a': 'K' || f1.a, 't': [role || ':' || text] || f1.t}) AS b0,
        least({'c': f1.c + 4, 'a': 'D' || f1.a, 't': f1.t}, {'c': CASE WHEN gone THEN 1000000000000 ELSE f2.c + more + 3 END, 'a': 'R' || f2.a, 't': ['user:' || text] || f2.t},
          {'c': CASE WHEN gone OR initial <> 'u' THEN 1000000000000 ELSE f2.c + more END, 'a': 'K' || f2.a, 't': [role || ':' || text] || f2.t}) AS b1,
        least({'c': f2.c + 4, 'a': 'D' || f2.a, 't': f2.t}, {'c': CASE WHEN gone THEN 1000000000000 ELSE f3.c + more + 3 END, 'a': 'R' || f3.a, 't': ['assistant:' || text] || f3.t},
          {'c': CASE WHEN gone OR initial <> 'a' THEN 1000000000000 ELSE f3.c + more END, 'a': 'K' || f3.a, 't': [role || ':' || text] || f3.t}) AS b2,
        least({'c': f3.c + 4, 'a': 'D' || f3.a, 't': f3.t}, {'c': CASE WHEN gone THEN 1000000000000 ELSE f2.c + more + 3 END, 'a': 'R' || f2.a, 't': ['user:' || text] || f2.t},
          {'c': CASE WHEN gone OR initial <> 'u' THEN 1000000000000 ELSE f2.c + more END, 'a': 'K' || f2.a, 't': [role || ':' || text] || f2.t}) AS b3
        FROM (SELECT f.*, x.role, x.text, x.initial, x.gone, x.more, x.i AS j FROM f JOIN x ON x.conv_id IS NOT DISTINCT FROM f.conv_id AND x.i = f.i - 1) _(conv_id, k, f0, f1, f2, f3, role, text, initial, gone, more, i)))
  SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(f0.c, 0) AS cost, coalesce(f0.a, '') AS audit, sha256(coalesce(array_to_string(f0.t, chr(10)), '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = 1"""

_OP12 = r"""WITH s AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM s),
  g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM p, (VALUES (1), (2), (3), (4)) _(k) WHERE len(w) >= k),
  f AS MATERIALIZED (SELECT lang, phrase, any_value(k) AS k, count(*) AS a FROM g GROUP BY 1, 2),
  n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
  c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 30),
  cuts AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
  scored AS (SELECT x.lang, x.phrase, x.a, l.a AS l, r.a AS r, x.cut, (2000000 * x.a::HUGEINT // (l.a::HUGEINT + r.a))::BIGINT AS score FROM cuts x
    JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1:], ' ')),
  worst AS (SELECT lang, phrase, a, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, a, w, k, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) _(m) WHERE m < k) GROUP BY 1, 2),
  kept AS (SELECT worst.* FROM worst LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""

_OP13 = f"SELECT *, doc_id = component_id AS kept FROM ({_OP9.replace('100 * shared >= 80 *', '100 * shared >= 85 *')})"

ORACLES: dict[str, str] = {"op1_warc": _OP1, "op4_host_rules": _OP4, "op9_jaccard_join": _OP9, "op11_repair": _OP11, "op12_collocations": _OP12, "op13_minhash": _OP13}
