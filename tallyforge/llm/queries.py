"""The queries of the training-data operators, each over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import bpe, conversations, line_dedup, main_text, media, merkle, minhash, packing, quality_classifier, quality_rules, sharding, token_counts, token_files
from tallyforge.llm.common import scratch

VOCABULARY = "byte_bpe_50k.json"
#: The id behind each document in token files, and the tokens from which on a document is over the limit.
END_ID, TOKEN_LIMIT = 2, 1024
#: The hash of no lines.
NOTHING = hashlib.sha256().hexdigest()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, quality_classifier.quality_labels(labels))
    out = quality_classifier.score(docs.select("doc_id", "text"), model, "score")
    return out.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=4)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as room:
        parts = token_files.write_tokens(_table(spark, sf_dir, "documents"), room.path, public_tokenizers.path(VOCABULARY), END_ID)
        return token_files.read_tokens(spark, parts).checkpoint()


def op6_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page of its lines with its own payload as a figure; position is the figure's place in the page's
    sequence of texts and media."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    with scratch(spark) as room:
        stored = media.store(room, docs.select("text"))
        found = room.keep(media.look_at(stored))
        name = F.coalesce(F.col("doc_id").cast("string"), F.lit("without id"))
        caption = F.concat(F.lit("Document "), name, F.lit(" of "), F.coalesce(F.length("text"), F.lit(0)).cast("string"), F.lit(" signs"))
        refs = media.references(media.parse(docs.select("doc_id", media.page_of(F.col("text"), caption).alias("html")), "html"))
        columns = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        return media.resolve(refs, found).select("doc_id", *(F.col("payload")[c].alias(c) for c in columns), F.col("items.position").alias("position"), F.col("items.caption").alias("caption")).checkpoint()


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.with_dedup(_table(spark, sf_dir, "documents"), "lines")
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.md5(F.col("lines.clean")).alias("clean_md5"), F.octet_length("lines.clean").cast("long").alias("clean_bytes"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.with_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "quality")
    return out.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row against the manifest; of every fifth one by the checksum of its id, a copy with small letters is held against it."""
    docs = _table(spark, sf_dir, "documents")
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    shown = merkle.leaf(**{c: F.when(tampered, small).otherwise(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS})
    with scratch(spark) as room:
        out = merkle.manifest(room, docs, carry={"shown": shown})
        out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), merkle.folded(F.col("shown"), F.col("path")).alias("folded_root"))
        return out.withColumn("verified", F.col("folded_root") == F.col("root")).checkpoint()


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.extract(pages, main_text.train(pages))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, also those of which the damage leaves nothing."""
    turns = _table(spark, sf_dir, "conversations")
    found = conversations.repair(conversations.damage(turns))
    none = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": NOTHING}
    every = turns.groupBy(F.col("conv_id").alias("conv_id_")).agg(F.lit(True).alias("there"))
    out = every.join(found, F.col("conv_id_").eqNullSafe(F.col("conv")), "left").select(F.col("conv_id_").alias("conv_id"), *found.columns[1:])
    return out.select("conv_id", *(F.coalesce(F.col(c), F.lit(x).cast(found.schema[c].dataType)).alias(c) for c, x in none.items()))


def rules_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10_quality_rules that SQL can express."""
    return quality_rules.base_counts(_table(spark, sf_dir, "documents"))


RULES_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), tri AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id
), rows_ AS (
  SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN hit ON w.doc_id = hit.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM rows_
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN comp ON w.doc_id = comp.doc_id LEFT JOIN sizes ON w.doc_id = sizes.doc_id
"""

OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
), word_lines AS (
  SELECT *, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ws FROM lines
), totals AS (
  SELECT source, count(*) AS total FROM documents GROUP BY source
), counts AS (
  SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(ws)) AS line FROM word_lines) GROUP BY ALL
), bad AS (
  SELECT c.source, list(line) AS bs FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE n >= 3 AND n > 0.03 * total GROUP BY c.source
), cleaned AS (
  SELECT doc_id, text, ws, ls, list_filter(ls, lambda x: bs IS NULL OR NOT list_contains(bs, x) OR NOT regexp_matches(x, '[^\x20\x09-\x0D]')) AS rest
  FROM word_lines w LEFT JOIN bad b ON w.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ws) END AS n_lines, CASE WHEN text IS NULL THEN 0 ELSE len(ls) - len(rest) END AS n_dropped,
  CASE WHEN text IS NULL THEN NULL ELSE md5(array_to_string(rest, chr(10))) END AS clean_md5,
  CASE WHEN text IS NULL THEN NULL ELSE strlen(array_to_string(rest, chr(10))) END AS clean_bytes
FROM cleaned
"""

#: The checksum of an id goes bit by bit: the polynomial is that of crc32. Levels go on until each group has one node.
_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda s: CAST(ascii(s) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)))"""

OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, n_chars, lang, source, text, CASE WHEN doc_id IS NULL THEN 1 ELSE {CRC} % 5 END AS fifth FROM documents
), mixed AS (
  SELECT *, CASE WHEN fifth = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS shown_text FROM crc
), heads AS (
  SELECT doc_id, source, text, shown_text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM mixed
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(shown_text) || ':' || shown_text, '-')) AS shown FROM heads
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves
), lower_ AS (
  SELECT 0 AS level, source, i, n, leaf AS digest FROM placed
  UNION ALL SELECT level + 1, source, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM lower_ WHERE n > 1 GROUP BY level, source, i // 16, n
), subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM lower_ WHERE n = 1
), upper_ AS (
  SELECT 0 AS level, j, m, subroot AS digest FROM subroots
  UNION ALL SELECT level + 1, j // 16, (m + 15) // 16, sha256(string_agg(digest, '' ORDER BY j)) FROM upper_ WHERE m > 1 GROUP BY level, j // 16, m
), low_runs AS (
  SELECT level, source, i // 16 AS up, list(digest ORDER BY i) AS ds FROM lower_ WHERE n > 1 GROUP BY ALL
), up_runs AS (
  SELECT level, j // 16 AS up, list(digest ORDER BY j) AS ds FROM upper_ WHERE m > 1 GROUP BY ALL
), up_paths AS (
  SELECT s.j, u.level, s.j // (16 ** u.level)::BIGINT % 16 AS pos, ds FROM subroots s JOIN up_runs u ON s.j // (16 ** (u.level + 1))::BIGINT = u.up
), steps AS (
  SELECT p.doc_id, p.leaf, p.i, p.source, l.level, array_to_string(ds[1 : (p.i // (16 ** l.level)::BIGINT % 16)], '') AS lt, array_to_string(ds[(p.i // (16 ** l.level)::BIGINT % 16) + 2 :], '') AS rt
  FROM placed p JOIN low_runs l ON p.source IS NOT DISTINCT FROM l.source AND p.i // (16 ** (l.level + 1))::BIGINT = l.up
  UNION ALL
  SELECT p.doc_id, p.leaf, p.i, p.source, 100 + u.level, array_to_string(ds[1 : pos], ''), array_to_string(ds[pos + 2 :], '')
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source JOIN up_paths u ON s.j = u.j
), whole AS (
  SELECT p.doc_id, p.leaf, p.shown, s.subroot, coalesce(list({'lt': lt, 'rt': rt} ORDER BY level) FILTER (WHERE level IS NOT NULL), []) AS path
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN steps t ON p.source IS NOT DISTINCT FROM t.source AND p.i = t.i GROUP BY p.doc_id, p.leaf, p.shown, s.subroot, p.source, p.i
), done AS (
  SELECT *, (SELECT digest FROM upper_ WHERE m = 1) AS root, sha256(array_to_string(list_transform(path, lambda x: x.lt || x.rt), '')) AS proof_sha256,
    list_reduce(list_transform(path, lambda x: {'a': '', 'lt': x.lt, 'rt': x.rt}), lambda c, x: {'a': sha256(x.lt || c.a || x.rt), 'lt': '', 'rt': ''}, {'a': shown, 'lt': '', 'rt': ''}).a AS folded_root FROM whole
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done
""".replace("{CRC}", _CRC.format("CAST(doc_id AS VARCHAR)"))

#: What the pages of the tables mark as their article: the text that the field, which isn't told, should find. These references
#: also count without their semicolon, as HTML has it.
OP12_SQL = r"""
WITH bare AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g') AS t FROM pages
), plain AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM bare
)
SELECT page_id, url, text, length(text) AS n_chars FROM plain
"""


def _cheapest(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _way(state: str, cost: str, edit: str, line: str = "") -> str:
    """A state with one more edit; a line is appended, with a newline unless it is the first."""
    text = f"{state}.x || {'' if state == 'n' else 'chr(10) || '}{line}" if line else f"{state}.x"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 't': {state}.t || '{edit}', 'x': {text}}} END"


def _taken(role: str, name: str, states: str) -> list[str]:
    keep = [f"CASE WHEN ok AND left(role, 1) = '{role}' THEN {_way(s, 'more', 'K', 'line')} END" for s in states]
    return keep + ([f"CASE WHEN ok THEN {_way(s, '3 + more', 'R', f"'{name}:' || text")} END" for s in states] if name else [])


#: One row of each conversation in each step of the recursion, its four states as columns: n (nothing), s, u, a.
OP13_SQL = rf"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM placed
), turns AS (
  SELECT conv_id, k, role, text, role || ':' || text AS line, fault NOT IN ('blank', 'duplicate') AS ok, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM judged
), walk AS (
  SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 't': '', 'x': ''}} AS n, NULL::STRUCT(c BIGINT, t VARCHAR, x VARCHAR) AS s, {{'c': 3::BIGINT, 't': 'I', 'x': 'user:'}} AS u, {{'c': 6::BIGINT, 't': 'II', 'x': 'user:' || chr(10) || 'assistant:'}} AS a
  FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT conv_id, k, n, s, u, {_cheapest("a", _way("u", "3", "I", "'assistant:'"))} AS a FROM (
    SELECT conv_id, k, n, s, a, {_cheapest("u", *(_way(x, "3", "I", "'user:'") for x in "nsa"))} AS u FROM (
      SELECT w.conv_id, t.k, {_way("n", "4", "D")} AS n, {_cheapest(_way("s", "4", "D"), *_taken("s", "", "n"))} AS s, {_cheapest(_way("u", "4", "D"), *_taken("u", "user", "nsa"))} AS u, {_cheapest(_way("a", "4", "D"), *_taken("a", "assistant", "u"))} AS a
      FROM walk w JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.k = w.k + 1))
), ends AS (
  SELECT conv_id, unnest({_cheapest("n", "a")}) FROM walk QUALIFY k = max(k) OVER (PARTITION BY conv_id)
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, c AS cost, t AS audit, sha256(x) AS repaired_sha256
FROM ends e LEFT JOIN counts n ON e.conv_id IS NOT DISTINCT FROM n.conv_id
"""

QUERIES = {
    "op1_length_buckets": op1_length_buckets,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_near_dedup": op3_near_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_token_files": op5_token_files,
    "op6_balanced_shards": op6_balanced_shards,
    "op7_media_columns": op7_media_columns,
    "op8_line_dedup": op8_line_dedup,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_html_extraction": op12_html_extraction,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
    "rules_base_counts": rules_base_counts,
}
SQL = {"op3_near_dedup": OP3_SQL, "op11_merkle_manifest": OP11_SQL, "op12_html_extraction": OP12_SQL, "op13_conversation_repair": OP13_SQL, "op8_line_dedup": OP8_SQL, "rules_base_counts": RULES_SQL}
