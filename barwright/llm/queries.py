"""The corpus queries, op1 to op13 and the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decision_list, decontaminate, filter_audit, id_shards, line_spread, near_dup, repeats, sentpiece, site_bayes, suffix_lm, token_lengths, url_rules, vector_codes
from .common import cut, small_batches, table

#: Folder of the public vocabularies; a parameter, as the files stay outside the repository.
TOKENIZERS = "/opt/tokenizers"
#: Pre-tokenisation pattern that belongs to the byte-level vocabulary (fixed value).
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

URL_RULES = [
    url_rules.parse_rule("block", "com/en/"),
    url_rules.parse_rule("allow", "example.com/en/7"),
    url_rules.parse_rule("allow", "net/de/"),
    url_rules.parse_rule("block", "example.net/de/8"),
    url_rules.parse_rule("block", "org/es/"),
]


#: Of twenty sites, those on which a line makes it boilerplate.
MIN_SITES = 10


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link_documents(table(spark, sf_dir, "documents"), width=2).drop("row_key")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("low"), (F.col("toxic") == 1).alias("toxic"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return site_bayes.classify(docs, targets, ["low", "toxic"], F.col("source"), F.col("lang"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_spread.remove_boilerplate(docs, MIN_SITES).select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256")
    )


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), 50)
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = token_lengths.length_histogram(
        table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", BYTE_PATTERN
    )
    return token_lengths.length_sums(cut(hist, "lengths"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    return decision_list.with_quality(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_no"
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    small_batches(spark, 1000, 8)
    docs = table(spark, sf_dir, "documents").select("doc_id", sentpiece.encode_checked(F.col("text"), model).alias("e"))
    return docs.select("doc_id", F.size("e.ids").cast("long").alias("n_pieces"), F.xxhash64("e.ids").alias("ids_hash"), "e.round_trip")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rule, verdict, rhost, rpath) AS (VALUES
  ('com/en/', 'block', 'com', '/en/'), ('example.com/en/7', 'allow', 'example.com', '/en/7'),
  ('net/de/', 'allow', 'net', '/de/'), ('example.net/de/8', 'block', 'example.net', '/de/8'),
  ('org/es/', 'block', 'org', '/es/')),
fits AS (
  SELECT page_id, max_by({'rule': r.rule, 'verdict': r.verdict}, length(r.rule)) AS best
  FROM parts p JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.best.rule AS rule, coalesce(f.best.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f USING (page_id)
"""


OP1_SQL = """
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) > 1 THEN w[s] || ' ' || w[s + 1] ELSE w[1] END AS sh
  FROM doc_words, unnest(range(1, greatest(len(w), 2))) t(s) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS met FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id)
  JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * met >= 80 * (x.n + y.n - met)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.other),
low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN low l ON l.doc_id = d.doc_id
"""

OP3_SQL = """
WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
places AS (SELECT doc_id, p, hex(b[p + 1 : p + 50]) AS string FROM bytes, unnest(range(0, greatest(n - 49, 0))) t(p)),
firsts AS (SELECT string, min(doc_id) AS low FROM places GROUP BY string HAVING count(DISTINCT doc_id) > 1),
starts AS (SELECT doc_id, p FROM places JOIN firsts USING (string) WHERE low < doc_id),
marked AS (SELECT doc_id, p, sum(begins) OVER (PARTITION BY doc_id ORDER BY p) AS run
           FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS begins FROM starts)),
runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS z FROM marked GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, z AS a, lead(a, 1, NULL) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM (SELECT doc_id, a, z FROM runs UNION ALL SELECT doc_id, -1, 0 FROM bytes)),
kept AS (SELECT p.doc_id, string_agg(hex(b[p.a + 1 : coalesce(p.z, n)]), '' ORDER BY p.a) AS h FROM pieces p JOIN bytes USING (doc_id) GROUP BY p.doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM bytes b LEFT JOIN (SELECT doc_id, sum(z - a) AS gone, count(*) AS k FROM runs GROUP BY doc_id) r ON r.doc_id = b.doc_id LEFT JOIN kept ON kept.doc_id = b.doc_id
"""

OP2_SQL = """
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS gram
  FROM item_words, unnest(range(0, greatest(len(w) - 10, 0) + 1)) t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_grams AS (
  SELECT doc_id, z.n, s AS pos, array_to_string(w[s + 1 : s + z.n], ' ') AS gram
  FROM doc_words, sizes z, unnest(range(0, greatest(len(w) - z.n + 1, 0))) t(s)),
hits AS (SELECT doc_id, item_id, pos, d.n FROM doc_grams d JOIN item_windows i ON d.n = i.n AND d.gram = i.gram),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(pos, pos + n)) t(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP7_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents),
worded AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
wide AS (SELECT line, min(struct_pack(doc_id := doc_id, pos := pos)) AS first FROM worded
         GROUP BY line HAVING count(DISTINCT coalesce('s' || source, '-')) >= {MIN_SITES}),
gone AS (SELECT doc_id, pos FROM worded JOIN wide USING (line) WHERE struct_pack(doc_id := doc_id, pos := pos) <> first),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(length(k.text) AS BIGINT) AS kept_chars, sha256(k.text) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score_documents(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(coded).select(
        "vec_id", vector_codes.hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256")
    )


def _op11_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Codebooks as lists; a round is a pair of steps: codes of all parts by their nearest entries, then floored means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
n{r} AS MATERIALIZED (
  SELECT row, part, min_by({{'e': entry, 'd': d}}, {{'d': d, 'e': entry}}) AS best
  FROM (SELECT x.row, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts x JOIN b{r} b ON x.part = b.part)
  GROUP BY row, part)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT part, entry, list(m ORDER BY pos) AS v FROM (
    SELECT x.part, n.best.e AS entry, pos, (sum(x.v[pos]) - ((sum(x.v[pos]) % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM parts x JOIN n{r} n ON n.row = x.row AND n.part = x.part, unnest(range(1, len(x.v) + 1)) t(pos) GROUP BY ALL) GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, CAST(coalesce(m.v, b.v) AS BIGINT[]) AS v FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)""")
    return f"""
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT row, p AS part, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM whole, unnest(range({parts})) t(p)),
b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= {entries}),{",".join(steps)},
coded AS (
  SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM n{rounds} GROUP BY row),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM whole JOIN coded USING (row), books
"""


OP11_SQL = _op11_sql()


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


OP12_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
low AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e
  FROM (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM texts) JOIN low USING (text) LEFT JOIN marks USING (doc_id)),
masks AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM flags GROUP BY ALL),
letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM letters v, letters w, letters x, letters y, letters z WHERE v.bit | w.bit | x.bit | y.bit | z.bit = 31),
steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, bits[s] AS bit, CAST(coalesce(list_sum(bits[1 : s - 1]), 0) AS INTEGER) AS before FROM orders, unnest(range(1, 6)) t(s)),
counts AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counts
"""


def op13_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = id_shards.write_shards(docs, f"{TOKENIZERS}/word_bpe_49k.json", end=2)
    return id_shards.lookup(shards, docs.select("doc_id"), with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_decontamination, op3_repeated_passages, op4_token_counts, op5_quality_rules, op6_quality_classifier, op7_line_dedup, op8_sentencepiece, op9_url_filter, op10_lm_score, op11_vector_codes, op12_filter_audit, op13_id_shards)}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": OP1_SQL, "op2_decontamination": OP2_SQL, "op3_repeated_passages": OP3_SQL, "op7_line_dedup": OP7_SQL, "op9_url_filter": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_filter_audit": OP12_SQL}
