"""The queries of this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_main_text, language_id, license_scan, mixing, near_dup, personal_data, quality_rules, repeated_bytes, sharding, spelling, url_filters, whitening
from .common import shared_dir, table

#: The rules that op3 judges by.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_main_text.extract(pages, html_main_text.fit(pages))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rule_table(spark, URL_RULES))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.remove_repeats(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, version = sharding.shard(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/crawlspark/shards-{uuid.uuid4().hex}")
    return store.read(version).select("row.doc_id", F.col("_bytes").alias("n_bytes"), "shard", "tier", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), F.lit(version).cast("bigint").alias("version"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_html_main_text,
        op3_url_filters,
        op4_near_duplicates,
        op5_language_id,
        op6_mixing,
        op7_repeated_bytes,
        op8_license_scan,
        op9_sharding,
        op10_decontamination,
        op11_spelling_variants,
        op12_embedding_whitening,
        op13_personal_data,
    )
}

WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
HASH_SQL = "('0x' || substr(md5({}::VARCHAR), 1, 15))::BIGINT"

ORACLE = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') t, {WORDS_SQL} w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') g FROM l, unnest(generate_series(1, len(w) - 4)) AS u(i) WHERE len(w) >= 5),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) n FROM twice, unnest([0, 1, 2, 3, 4]) AS k(k) GROUP BY doc_id),
f AS (SELECT l.doc_id, lang AS stratum, len(w)::BIGINT n_words, (length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')))::BIGINT word_chars,
 len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT n_dup_lines, coalesce(rep.n, 0)::BIGINT n_repeat_words,
 len(lines) n_lines, len(regexp_extract_all(t, '[A-Z]')) n_upper, t FROM l LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
 [n_symbols / greatest(word_chars, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1), n_upper / greatest(word_chars, 1)] s FROM f),
lab AS (SELECT doc_id, min(quality) >= 1 good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
u AS (SELECT stratum, md5(t) k, min(doc_id) doc_id, bool_and(good) good, any_value(s) s FROM b JOIN lab USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
j AS (SELECT stratum, s, good, {HASH_SQL.format("doc_id")} % 2 = 0 holdout FROM u),
cell AS (SELECT stratum, r, c, count(*) FILTER (holdout AND good) n, count(*) FILTER (holdout AND good AND s[r] > c) k, count(*) FILTER (NOT holdout AND NOT good AND s[r] > c) caught
 FROM j, unnest([1, 2, 3, 4]) AS rr(r), unnest({list(quality_rules.GRID)}::DOUBLE[]) AS cc(c) GROUP BY ALL HAVING caught > 0),
tail AS (SELECT stratum, r, c, (SELECT count(*) FROM cell) m, coalesce((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.0125) + (n - i) * ln(0.9875))) FROM unnest(generate_series(0, k)) AS u(i)), 1) p, k, n FROM cell),
cut AS (SELECT stratum, r, min(c) c FROM tail WHERE k < n * 0.0125 AND p <= 0.05 / m GROUP BY stratum, r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT EXISTS (SELECT 1 FROM cut WHERE cut.stratum IS NOT DISTINCT FROM b.stratum AND b.s[cut.r] > cut.c) AS kept FROM b""",
    "op3_url_filters": r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
 coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') path, row_number() OVER () k FROM pages),
r AS (SELECT v, rule, split_part(rule, '/', 1) h, substr(rule, instr(rule, '/')) p FROM (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')) t(v, rule)),
m AS (SELECT k, v, rule, row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC) n FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (k)""",
    "op4_near_duplicates": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+1], ' ') g FROM d, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS node, a AS seen FROM e2 UNION SELECT r.node, e2.b FROM r JOIN e2 ON e2.a = r.seen),
c AS (SELECT node, min(seen) comp FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp, d.doc_id) AS component_id, coalesce(comp, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id""",
    "op6_mixing": rf"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL})::BIGINT size, {HASH_SQL.format("doc_id")} h FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] w, row_number() OVER (ORDER BY source NULLS LAST) i FROM d GROUP BY source),
o AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY source_size / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) level FROM s),
lv AS (SELECT arg_min(level, (source_size / w, i)) level FROM o WHERE 2 * source_size >= level * w),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, lv.level * w) target FROM o, lv),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END base FROM t),
x AS (SELECT d.*, source_size, target, base, target - base * source_size budget, sum(size) OVER (PARTITION BY d.source ORDER BY h) upto, sum(size) OVER (PARTITION BY d.source, h) n FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (base + CASE WHEN budget > 0 AND (upto <= budget OR (upto - n <= budget AND 2 * (budget - (upto - n)) >= n)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x""",
    "op10_decontamination": r"""
WITH i AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '') w FROM benchmark),
si AS (SELECT DISTINCT item_id, least(5, len(w)) k, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') g FROM i, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS u(p) WHERE len(w) > 0),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '') w FROM documents WHERE text IS NOT NULL),
sd AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') g FROM d, (SELECT DISTINCT k FROM si), unnest(generate_series(1, len(w) - k + 1)) AS u(p) WHERE len(w) >= k),
n AS (SELECT item_id, count(*) n_item FROM si GROUP BY item_id)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n_item)::BIGINT AS n_item, count(*) / any_value(n_item) AS containment
FROM si JOIN sd USING (k, g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)""",
    "op11_spelling_variants": """
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) ORDER BY i) t FROM range(256) r(i)),
r AS (SELECT doc_id, translate(u.run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low, count(*) k FROM documents, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS u(run) WHERE length(u.run) >= 5 GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || low, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END)) bytes FROM r),
h AS (SELECT low, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes::BIGINT[]), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]))) h FROM b, crc),
c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(low, 1, (h % length(low))::INT) || substr(low, (h % length(low))::INT + 2) ELSE low END word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
d AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) short FROM w, unnest(generate_series(1, length(word))) AS u(i)),
s AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) gap FROM w, unnest(generate_series(1, length(word))) AS u(i)),
p AS (SELECT d.word, w.word near, w.n near_n FROM d JOIN w ON w.word = short UNION ALL SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = short UNION ALL SELECT x.word, y.word, y.n FROM s x JOIN s y USING (gap) WHERE x.word <> y.word),
g AS (SELECT word, count(*) n_near, min({'m': -near_n, 'w': near}) best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT n_near, CASE WHEN -best.m >= 2 * w.n THEN best.w END form, CASE WHEN -best.m >= 2 * w.n THEN (-best.m)::BIGINT END form_n FROM w LEFT JOIN g USING (word)),
e AS (SELECT word, form AS top, 1 AS k FROM f WHERE form IS NOT NULL UNION ALL SELECT e.word, f.form, k + 1 FROM e JOIN f ON f.word = e.top WHERE f.form IS NOT NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN (SELECT word, arg_max(top, k) root FROM e GROUP BY word) USING (word)""",
}
