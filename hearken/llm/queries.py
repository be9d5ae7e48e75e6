"""One query per operator over its whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm import decontam, langid, licenses, lines, negatives, phrases, pieces, pivots, quality, simhash, toxicity, urls, warc
from hearken.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def is_held_out() -> Column:
    """For results: false where there is no doc_id. Rows without one are no training rows either."""
    return F.coalesce(langid.held_out(), F.lit(False))


@query("op3_simhash_golay")
def simhash_golay(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.groups(table(spark, folder, "documents").select("doc_id", "text"))


LINE_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, line, no, {LINE_KEY} AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.line, k.no, f.key IS NOT NULL AND k.doc_id > f.first AS gone FROM keyed k LEFT JOIN firsts f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op10_line_dedup", LINE_DEDUP_SQL)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


BASE_32 = " || ".join(f"to_base(CAST('0x' || substr(hex, {i}, 5) AS BIGINT), 32, 4)" for i in range(1, 41, 5))

WARC_SQL = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), bits AS (
  SELECT page_id, first, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p
)
SELECT page_id, payload_bytes, translate({BASE_32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""


@query("op1_warc", WARC_SQL)
def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages").select("page_id", "url", "html"))


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

URL_SQL = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}), split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (page_id)
"""


@query("op8_url_digests", URL_SQL)
def url_digests(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, folder, "pages").select("page_id", "url"), rules)


@query("op5_language_cnn")
def language_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    judged = langid.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


@query("op9_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    stats = materialize(quality.with_statistics(table(spark, folder, "documents")), "statistics")
    labels = table(spark, folder, "labels").filter(~langid.held_out()).select("doc_id", F.col("quality").alias("label"))
    rules = quality.fit(materialize(stats.join(labels, "doc_id").select("stats", "label"), "labelled"))
    scored = stats.select("doc_id", is_held_out().alias("held_out"), quality.score(rules, F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op6_cgk_decontamination")
def cgk_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


PIVOT_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(id, node) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT id, b FROM reach JOIN links ON node = a
), component AS (
  SELECT id AS vec_id, min(node) AS component_id FROM reach GROUP BY id
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""


@query("op4_pivot_range_join", PIVOT_SQL)
def pivot_range_join(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, folder, "embeddings"))


def license_sql() -> str:
    """Every rule is one step: it is looked for in what the rules before it have left."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    ids, ordered = licenses.table_of(licenses.RULES)
    steps = "bars"
    found = []
    for licence, seq in ordered:
        seq = text(seq.replace("|", "||")[1:-1])
        found.append(f"CASE WHEN contains({steps}, {seq}) THEN {text(licence)} END")
        steps = f"replace({steps}, {seq}, '#')"
    known = ", ".join(f"({text(s)}, {text(i)})" for s, i in ids.items())
    marks = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return f"""
WITH known(sentence, sid) AS (VALUES {known}), cut AS (
  SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?;:])[' || {marks} || ']+', chr(92) || '1' || chr(10), 'g'), '[' || chr(10) || chr(13) || ']+') AS raw
  FROM documents
), spread AS (
  SELECT doc_id, unnest(raw) AS sentence, unnest(range(len(raw))) AS pos FROM cut
), hits AS (
  SELECT doc_id, pos, sid FROM (
    SELECT doc_id, pos, trim(regexp_replace(translate(sentence, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS sentence
    FROM spread) JOIN known USING (sentence)
), per_text AS (
  SELECT doc_id, string_agg(sid, ' ' ORDER BY pos) AS sentences, string_agg('|' || sid || '|', '' ORDER BY pos) AS bars FROM hits GROUP BY doc_id
), judged AS (
  SELECT doc_id, sentences, list_filter([{", ".join(found)}], lambda x: x IS NOT NULL) AS found FROM per_text
)
SELECT doc_id, coalesce(sentences, '') AS sentences,
  coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ' '), '') AS licenses
FROM documents LEFT JOIN judged USING (doc_id)
"""


@query("op2_license_sentences", license_sql())
def license_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op7_piece_scan")
def piece_scan(spark: SparkSession, folder: str) -> DataFrame:
    encoded = pieces.round_trip(table(spark, folder, "documents").select("doc_id", "text"))
    return encoded.select("doc_id", "n_ids", "ids", "round_trip", pieces.n_chunks(F.col("text")).alias("n_chunks"))


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 3
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


PHRASES_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?' || chr(10) || '-' || chr(13) || ']')) AS piece
  FROM documents WHERE text IS NOT NULL
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^ ' || chr(9) || ']+') AS ws FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM worded, (VALUES (1), (2), (3)) sizes(m) WHERE len(ws) >= m)
), counts AS (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
), keyed AS (
  SELECT lang || chr(10) || phrase AS key, f FROM counts WHERE f >= 10
), sums AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE m > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN keyed x ON x.key = c.lang || chr(10) || array_to_string(c.ws[:k], ' ')
  JOIN keyed y ON y.key = c.lang || chr(10) || array_to_string(c.ws[k + 1:], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covered AS (
  SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM candidates WHERE m = 3
), kept AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM covered o WHERE o.lang = c.lang AND o.phrase = c.phrase AND 100 * o.a >= 50 * c.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN sums USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


@query("op13_phrase_parse", PHRASES_SQL)
def phrase_parse(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine(table(spark, folder, "documents").select("lang", "text"))


@query("op12_toxic_clauses")
def toxic_clauses(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").filter(~langid.held_out()).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.predict(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
