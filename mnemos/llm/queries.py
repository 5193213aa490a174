"""The registered queries of the operators, with SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.llm import bpe_trie, conversation_repair, decontaminate, licenses, ngram_join, packing, quality_crf, quality_rules, simhash, token_counts, toxicity, url_filter, whitening
from mnemos.llm.common import fold, table

#: Fixed values of the contract.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, pad_id=50256)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_crf.train(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    scored = quality_crf.score_documents(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_trie.encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), arrays=False)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(conversation_repair.damage(table(spark, sf_dir, "conversations")), copies="copies")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1,
    "op2_quality_rules": op2,
    "op3_token_packing": op3,
    "op4_quality_crf": op4,
    "op5_bpe_trie": op5,
    "op6_decontamination": op6,
    "op7_toxicity": op7,
    "op8_simhash": op8,
    "op9_token_counts": op9,
    "op10_license_scan": op10,
    "op11_conversation_repair": op11,
    "op12_ngram_join": op12,
    "op13_embedding_whitening": op13,
}

_TARGET = r"""CASE WHEN contains(t, '://') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(key, '^([^:/?#]+:)//', 1) || t
    WHEN starts_with(t, '/') THEN regexp_extract(key, '^[^:/?#]+://[^/?#]*') || t END"""
_SPLIT = """CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"""


def _judged(source: str, url: str) -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return f"""(SELECT s.*, r.rule, r.rv FROM (
      SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM (SELECT *, coalesce({_SPLIT.format(u=url)}, '') AS rest FROM {source})) s
    LEFT JOIN LATERAL (SELECT h || p AS rule, v AS rv FROM (VALUES {rules}) AS rules(v, h, p)
      WHERE (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, p) ORDER BY length(h || p) DESC LIMIT 1) r ON true)"""


_TEMPLATES = ", ".join("('{}', {}, {}, [{}])".format(n, i, len(licenses.normalised_words(licenses.TEMPLATES[n])), ", ".join(f"'{g}'" for g in b)) for i, (n, b) in enumerate(licenses.template_bigrams(licenses.TEMPLATES)))

ORACLES: dict[str, str] = {
    "op1_url_filters": rf"""
WITH RECURSIVE keyed AS (SELECT regexp_extract(url, '^[^#]*') AS key, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g') AS html FROM pages WHERE contains(url, '://')),
tags AS (SELECT key, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM keyed),
named AS (
  SELECT key, CASE
    WHEN regexp_matches(tag, '(?is)^<link\b[^>]*\brel\s*=\s*["'']?(?:[a-z]+\s+)*canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) END AS t FROM tags),
aimed AS (SELECT key, regexp_extract({_TARGET}, '^[^#]*') AS dst FROM named WHERE t <> ''),
edges AS (SELECT DISTINCT key AS a, dst AS b FROM aimed WHERE dst <> '' AND dst <> key),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
own AS (SELECT n.a AS node, j.rv FROM (SELECT DISTINCT a FROM both_ways) n JOIN {_judged("(SELECT DISTINCT a FROM both_ways)", "a")} j ON j.a = n.a),
reach AS (SELECT node, rv FROM own WHERE rv IS NOT NULL UNION SELECT b, rv FROM reach JOIN both_ways ON a = node),
heard AS (SELECT node, min(rv) AS hv FROM reach GROUP BY node)
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.rv, h.hv, 'allow') AS verdict
FROM {_judged("pages", "url")} p LEFT JOIN heard h ON h.node = regexp_extract(p.url, '^[^#]*')
""",
    "op10_license_scan": rf"""
WITH templates AS (SELECT *, len(grams) AS nb FROM (VALUES {_TEMPLATES}) AS t(name, k, m, grams)),
clean AS (SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x01-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), chr(10)) AS lines, row_number() OVER () AS r FROM documents),
lines AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM clean),
tokens AS (SELECT r, i, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM lines),
grams AS (SELECT r, i, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS g FROM tokens WHERE len(w) >= 2),
scores AS (SELECT r, i, name, k, 2.0 * len(list_intersect(g, grams)) / (len(g) + nb) AS dice FROM grams g, templates t WHERE len(list_intersect(g.g, t.grams)) > 0),
best_lines AS (SELECT r, i, max(dice) AS dice, arg_min(name, (-dice, k)) AS name, arg_min(k, (-dice, k)) AS k FROM scores WHERE dice >= {licenses.THRESHOLD} GROUP BY r, i),
spread AS (SELECT r, i, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM tokens),
placed AS (SELECT r, i, word, row_number() OVER (PARTITION BY r ORDER BY i, j) - 1 AS p, count(*) OVER (PARTITION BY r) AS n FROM spread),
pairs AS (SELECT r, i, p, n, word || ' ' || lead(word) OVER (PARTITION BY r ORDER BY p) AS gram FROM placed),
wanted AS (SELECT name, k, m, nb, unnest(grams) AS gram FROM templates),
met AS (SELECT r, p, n, k, name, m, nb, gram FROM pairs JOIN wanted USING (gram)),
starts AS (SELECT DISTINCT r, k, name, m, nb, unnest(range(greatest(0, p - m + 2), least(p, greatest(0, n - m)) + 1)) AS s FROM met),
shared AS (SELECT a.r, a.k, a.name, a.m, a.nb, a.s, count(DISTINCT b.gram) AS both FROM starts a JOIN met b ON a.r = b.r AND a.k = b.k AND b.p BETWEEN a.s AND a.s + a.m - 2 GROUP BY ALL HAVING count(DISTINCT b.gram) * (2 - {licenses.THRESHOLD}) >= {licenses.THRESHOLD} * a.nb - 1e-9),
sized AS (SELECT a.r, a.k, a.name, a.s, 2.0 * a.both / (count(DISTINCT c.gram) + a.nb) AS dice FROM shared a JOIN pairs c ON a.r = c.r AND c.p BETWEEN a.s AND a.s + a.m - 2 AND c.gram IS NOT NULL GROUP BY a.r, a.k, a.name, a.s, a.both, a.nb),
at_line AS (SELECT z.r, z.k, z.name, z.dice, q.i FROM sized z JOIN placed q ON q.r = z.r AND q.p = z.s WHERE z.dice >= {licenses.THRESHOLD}),
best AS (SELECT r, i, dice, name, k FROM best_lines UNION ALL SELECT r, arg_min(i, (-dice, i)) AS i, max(dice) AS dice, name, k FROM at_line GROUP BY r, name, k),
by_doc AS (SELECT r, arg_min(name, (-dice, i, k)) AS license, round(max(dice), 6) AS dice, arg_min(i, (-dice, i, k)) AS line, count(DISTINCT i) AS n_matches, array_to_string(list_sort(list(DISTINCT name)), ',') AS licenses FROM best GROUP BY r)
SELECT c.doc_id, b.license, CAST(coalesce(b.dice, 0.0) AS DOUBLE) AS dice, CAST(b.line AS BIGINT) AS line, coalesce(b.n_matches, 0) AS n_matches, coalesce(b.licenses, '') AS licenses
FROM clean c LEFT JOIN by_doc b USING (r)
""",
    "op6_decontamination": r"""
WITH doc_words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
doc_windows AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM doc_words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
found AS (SELECT d.r, d.i, d.k, x.item FROM doc_windows d JOIN windows x ON x.win = d.win AND x.k = d.k),
hits AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM found) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item)) AS ids FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
""",
}
