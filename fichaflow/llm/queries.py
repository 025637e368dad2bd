"""Registered queries of the operators, and the SQL each must match where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fichaflow.llm import (
    class_lm, decontaminate, filter_audit, jaccard_join, language_id, pieces, quality_rules, secret_scan, sharding, source_mix, substring_dedup,
    url_filter, vector_codes,
)
from fichaflow.llm.storage import discard_stored, stored
from fichaflow.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under a name, with its SQL if it has one."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepared(spark), folder)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def prepared(spark: SparkSession) -> SparkSession:
    """Arrow batches of few rows, as texts are long."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- 1: secret scan


def _kind_sql(rule: secret_scan.Rule, number: int) -> str:
    """Spans of one rule: the texts between and in matches, as lengths, give the positions."""
    pattern = rule.pattern.replace("'", "''")
    least = f"length(x.g) >= {rule.min_group}" if rule.group else f"x.e - x.s >= {rule.min_length}"
    return f"""
    SELECT doc_id, '{rule.kind}' AS kind, {number} AS number, x.s, x.e
    FROM (SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
            s := coalesce(list_sum(list_transform(p[1:i], lambda y: length(y))), 0)
               + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0),
            e := coalesce(list_sum(list_transform(p[1:i], lambda y: length(y))), 0)
               + coalesce(list_sum(list_transform(m[1:i], lambda y: length(y))), 0),
            g := g[i]))) AS x
          FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m,
                       regexp_extract_all(text, '{pattern}', {rule.group}) AS g
                FROM documents WHERE regexp_matches(text, '{pattern}')))
    WHERE {least}"""


OP1_SQL = f"""
WITH spans AS ({' UNION ALL '.join(_kind_sql(r, i) for i, r in enumerate(secret_scan.RULES))}),
found AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(concat(kind, ':', s::BIGINT, ':', e::BIGINT), ',' ORDER BY s, number)
           FILTER (number < {len(secret_scan.BASE_RULES)}) AS base,
         string_agg(concat(kind, ':', s::BIGINT, ':', e::BIGINT), ',' ORDER BY s, number) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN found USING (doc_id)"""


@query("op1_secret_scan", OP1_SQL)
def op1(spark, folder):
    found = secret_scan.scan_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    base = tuple(r.kind for r in secret_scan.BASE_RULES)
    number = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(number(k).alias(f"n_{k}") for k in base),
        F.sha2(secret_scan.joined(F.col("secrets"), base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("secrets")).alias("spans"),
    )


# ---- 2: url filter


@query("op2_url_filter")
def op2(spark, folder):
    return url_filter.judge_urls(table(spark, folder, "pages"))


# ---- 3: language identification


@query("op3_language_id")
def op3(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = language_id.fold("doc_id", 4) == 2
    model = language_id.fit(docs.filter(~held_out))
    found = language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


# ---- 4: substring dedup

OP4_SQL = """
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs)),
later AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM later)),
gone_lists AS (SELECT doc_id, list(j) AS j FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(j), 0)::BIGINT AS n_removed,
         CASE WHEN j IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(j, i)) END AS k
  FROM docs LEFT JOIN gone_lists USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""


@query("op4_substring_dedup", OP4_SQL)
def op4(spark, folder):
    cleaned = substring_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


# ---- 5: SentencePiece encoding and decoding

PIECES_FILE = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")


@query("op5_sentencepiece")
def op5(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    both = pieces.decode_ids(pieces.encode_texts(docs, PIECES_FILE), PIECES_FILE)
    return both.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"), "ids")


# ---- 6: sharding


@query("op6_sharding")
def op6(spark, folder):
    placed = sharding.shard_documents(table(spark, folder, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


# ---- 7: class-based language model


@query("op7_class_lm")
def op7(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    train = docs.filter(language_id.fold("doc_id", 10) != 0).select("text")
    start, words = class_lm.learn(train)
    discard_stored(words)
    model, counts = class_lm.place_words(train, start)
    parts = class_lm.encode(docs, model)
    filled = stored(class_lm.with_classes(parts, model, counts), "classes")
    discard_stored(parts)
    model = class_lm.learn_context(filled.filter(language_id.fold("id", 10) != 0), model, counts)
    return class_lm.score_filled(filled, model).select(
        F.col("id").alias("doc_id"), (language_id.fold("id", 10) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


# ---- 8: n-gram Jaccard join

OP8_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.r)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


@query("op8_jaccard_join", OP8_SQL)
def op8(spark, folder):
    return jaccard_join.link_sets(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


# ---- 9: benchmark decontamination

OP9_SQL = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
items AS (
  SELECT item_id, w, len(w) AS size, greatest(len(w) - 4, 1) AS m, m - ceil(160 * m / 180)::INT AS slack
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE len(w) > 0),
item_shingles AS (
  SELECT item_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, m + 1)) AS i FROM items)),
item_counts AS (SELECT item_id, s, count(*) AS k FROM item_shingles GROUP BY ALL),
doc_shingles AS (
  SELECT doc_id, p, s, n FROM (
    SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS s, len(w) AS n
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM docs WHERE len(w) > 0))
  WHERE s IN (SELECT s FROM item_shingles)),
windows AS (
  SELECT DISTINCT doc_id, item_id, greatest(0, least(b, n - size)) AS start, size, m, n FROM (
    SELECT doc_id, item_id, unnest(range(p - i - slack, p - i + slack + 1)) AS b, size, m, n
    FROM doc_shingles JOIN item_shingles USING (s) JOIN items USING (item_id))),
shared AS (
  SELECT x.doc_id, x.item_id, x.start, x.size, any_value(x.m) AS m, any_value(x.n) AS n, s, count(*) AS k
  FROM windows x JOIN doc_shingles d ON d.doc_id = x.doc_id AND d.p > x.start AND d.p <= x.start + x.m
  GROUP BY ALL),
scored AS (
  SELECT doc_id, item_id, start, size, sum(least(shared.k, c.k)) AS common, any_value(m) AS m,
         any_value(greatest(least(size, n) - 4, 1)) AS own
  FROM shared JOIN item_counts c USING (item_id, s) GROUP BY doc_id, item_id, start, size)
SELECT doc_id, item_id, max(common / (m + own - common)) AS similarity, arg_min(start, (-(common / (m + own - common)), start))::BIGINT AS start,
       any_value(size)::BIGINT AS size
FROM scored WHERE common / (m + own - common) >= 0.8 - 1e-12 GROUP BY doc_id, item_id"""


@query("op9_decontamination", OP9_SQL)
def op9(spark, folder):
    found = decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "similarity", F.col("start").cast("long"), F.col("size").cast("long"))


# ---- 10: quality rules

_Q = quality_rules
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP10_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + {_Q.WINDOW - 1}], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {_Q.WINDOW - 2})) AS i FROM words)),
twice AS (SELECT doc_id, k FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (
    SELECT doc_id, unnest(range(i, i + {_Q.WINDOW})) AS j FROM windows JOIN twice USING (doc_id, k)) GROUP BY 1),
lines AS (
  SELECT doc_id, line, trim(line, {_SPACES}) AS t,
         len(regexp_extract_all(line, '{_Q.SEPARATORS}'))
         + greatest(0, len(regexp_extract_all(line, '»')) - len(regexp_extract_all(line, '«'))) AS marks, regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g') AS c,
         regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)),
judged AS (
  SELECT doc_id, line, length(c) AS size,
         10 * len(regexp_extract_all(t, '{_Q.SYMBOLS}')) > length(c)
         OR marks >= {_Q.MENU_MARKS} AND {_Q.MENU_SPAN} * marks >= length(c)
         OR 2 * len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > len(w)
         OR length(c) <= {_Q.SHORT_LINE} AND regexp_matches(
              translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_Q.PHRASES}')
         OR NOT regexp_matches(t, '{_Q.SENTENCE_END.replace("'", "''")}') AS failed
  FROM lines WHERE t <> ''),
per_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (failed) AS n_failed_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         coalesce(sum(size) FILTER (NOT failed), 0) AS kept_chars
  FROM judged GROUP BY 1),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '{_Q.SYMBOLS}'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(kept_chars, 0)::BIGINT AS kept_chars,
         len(w) < {_Q.MIN_WORDS} OR 100 * coalesce(covered.n, 0) > {_Q.MAX_REPEATED_PERCENT} * len(w) AS base_failed
  FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN per_doc USING (doc_id))
SELECT *, NOT base_failed AND 100 * kept_chars >= {_Q.MIN_KEPT_PERCENT} * word_chars AS kept FROM counts"""


@query("op10_quality_rules", OP10_SQL)
def op10(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules.clean_lines(docs, with_text=False).drop("text")


# ---- 11: filter interaction audit

_A = filter_audit
OP11_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
least AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
failing AS (
  SELECT part, [len(w) < {_A.MIN_WORDS}, 100 * len(list_distinct(w)) < {_A.MIN_DISTINCT_PERCENT} * len(w),
                100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {_A.MAX_UPPER_PERCENT} * length(text),
                regexp_matches(text, '{_A.MARKS}'), coalesce(doc_id > first, false)] AS fails,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = words.doc_id AND quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = words.doc_id AND toxic = 1) AS toxic
  FROM words JOIN least USING (text)),
counts AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failing GROUP BY ALL),
orders AS (
  SELECT a || b || c || d || e AS filter_order
  FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS b),
       (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS d),
       (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS e)
  WHERE len(list_distinct([a, b, c, d, e])) = 5),
steps AS (SELECT filter_order, step, [instr('ABCDE', filter_order[i]) FOR i IN range(1, step)] AS earlier, instr('ABCDE', filter_order[step]) AS own
          FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
cases AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS failed,
         len(list_filter(earlier, lambda f: fails[f])) > 0 AS gone, len(list_filter(fails, lambda f: f)) = 1 AS alone
  FROM steps, counts),
summed AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND failed), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND failed), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failed AND alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND failed), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND failed), 0)::BIGINT AS toxic_lost
  FROM cases GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM summed"""


@query("op11_filter_audit", OP11_SQL)
def op11(spark, folder):
    return filter_audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


# ---- 12: mixing sources to target weights

#: A running total gives each document its place; what a quota takes of it follows without slots.
OP12_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(concat(coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))) AS digest
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM docs GROUP BY source),
share AS (
  SELECT (SELECT sum(source_size)::BIGINT FROM sources) AS rest, (SELECT sum(weight)::BIGINT FROM sources) AS heavy
  UNION
  SELECT (SELECT sum(source_size)::BIGINT - coalesce(sum(3 * source_size) FILTER ((3 * source_size)::DOUBLE <= weight * (rest::DOUBLE / heavy)), 0)::BIGINT FROM sources),
         (SELECT sum(weight) FILTER ((3 * source_size)::DOUBLE > weight * (rest::DOUBLE / heavy))::BIGINT FROM sources)
  FROM share WHERE rest > 0),
targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * coalesce((SELECT max(rest::DOUBLE / heavy) FROM share), 0)) AS target FROM sources),
placed AS (
  SELECT d.doc_id, d.size, source_size, target, floor(target + 0.5)::BIGINT AS quota,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS begin
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       list_sum(list_transform([0, 1, 2], lambda k: greatest(0, least(begin + k * source_size + size, quota) - (begin + k * source_size))))::BIGINT AS taken
FROM placed"""


@query("op12_source_mix", OP12_SQL)
def op12(spark, folder):
    found = source_mix.mix_sources(table(spark, folder, "documents")).documents
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


# ---- 13: vector code compression


def _assign_sql(books: str) -> str:
    """Nearest entry of each part by all distances."""
    return f"""
  SELECT key, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d, any_value(v) AS v FROM (
    SELECT p.key, p.part, p.v, b.entry, coalesce(list_sum([(p.v[i] - b.v[i]) * (p.v[i] - b.v[i]) FOR i IN range(1, len(p.v) + 1)]), 0) AS d
    FROM parts p JOIN {books} b USING (part)) GROUP BY key, part"""


def _round_sql(number: int) -> str:
    """Floored means of the parts of each entry; unused entries stay."""
    return f"""
near{number} AS MATERIALIZED ({_assign_sql(f'books{number}')}),
means{number} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT part, entry, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS i FROM near{number})
    GROUP BY part, entry, i) GROUP BY part, entry),
books{number + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, b.v) AS v FROM books{number} b LEFT JOIN means{number} m USING (part, entry)),"""


OP13_SQL = f"""
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, v) AS key, vec_id, label, v FROM (
    SELECT vec_id, label, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS MATERIALIZED (
  SELECT key, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS v FROM whole, (SELECT unnest([0, 1, 2, 3]) AS part)),
books0 AS MATERIALIZED (SELECT part, key - 1 AS entry, v FROM parts WHERE key <= 256),
{''.join(_round_sql(k) for k in range(4))}
final AS MATERIALIZED ({_assign_sql('books4')}),
codes AS (
  SELECT key, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM final GROUP BY key)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM books4) AS codebooks_sha256
FROM whole JOIN codes USING (key)"""


@query("op13_vector_codes", OP13_SQL)
def op13(spark, folder):
    codes, books = vector_codes.compress(table(spark, folder, "embeddings"))
    return vector_codes.with_label_error(codes).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))
