"""The registered queries over the text tables, and SQL where it can express them."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from manyfold.llm import (
    conversation_repair,
    decontaminate,
    html_text,
    language_id,
    line_dedup,
    mixing,
    neighbours,
    packing,
    prefix_trie,
    simhash_dedup,
    substring_dedup,
    token_counts,
    url_filter,
)
from manyfold.sources.settled import settle

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def public_file(name: str) -> str:
    found = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(found.origin) if found and found.origin else "/opt/tokenizers", name)


def vocabulary_path() -> str:
    """The public piece vocabulary; PIECE_VOCABULARY names another file."""
    return os.environ.get("PIECE_VOCABULARY", public_file("piece_bpe_32k.model"))


def tokenizer_path() -> str:
    """The public tokenizer for packing; WORD_TOKENIZER names another file."""
    return os.environ.get("WORD_TOKENIZER", public_file("word_bpe_49k.json"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mix_sources(spark, folder):
    thin = table(spark, folder, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    mixed = mixing.mix(settle(thin, "sizes"), size="size")
    first = F.get("passes", F.lit(0))
    rows = mixed.select("row.doc_id", "size", "source_size", "target", "taken", first["position"].alias("position"))
    ordered = settle(rows, "mix").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return ordered.drop("position")


def op2_substring_dedup(spark, folder):
    out = substring_dedup.drop_repeats(table(spark, folder, "documents"))
    return out.select("row.doc_id", "text", "removed", "words_removed")


def op3_html_text(spark, folder):
    return html_text.extract(table(spark, folder, "pages"))


def op4_neighbours(spark, folder):
    return neighbours.neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_language(spark, folder):
    return language_id.identify(table(spark, folder, "documents"), vocabulary_path())


def op6_line_dedup(spark, folder):
    out = line_dedup.drop_site_lines(table(spark, folder, "documents"))
    return out.select("row.doc_id", "row.source", "text", "n_lines", "n_dropped")


def op7_url_filter(spark, folder):
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return url_filter.filter_urls(table(spark, folder, "pages"), rules)


def op8_token_counts(spark, folder):
    return token_counts.count_tokens(table(spark, folder, "documents"), vocabulary_path())


def op9_simhash(spark, folder):
    found = simhash_dedup.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_decontaminate(spark, folder):
    leaks = decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return leaks.select("doc_id", "item_id", "containment")


def op11_pack(spark, folder):
    pieces = packing.token_pieces(table(spark, folder, "documents"), tokenizer_path())
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op12_repair(spark, folder):
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.summaries(conversation_repair.repair(conversation_repair.damage(given)))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    every = given.select("conv_id").distinct().withColumn("key", name("conv_id")).join(found, "key", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    texts = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")]
    return every.select("conv_id", *counts, *texts)


def op13_prefix_trie(spark, folder):
    return prefix_trie.trie(table(spark, folder, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_substring_dedup,
        op3_html_text,
        op4_neighbours,
        op5_language,
        op6_line_dedup,
        op7_url_filter,
        op8_token_counts,
        op9_simhash,
        op10_decontaminate,
        op11_pack,
        op12_repair,
        op13_prefix_trie,
    )
}

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight FROM s),
c AS (SELECT *, 2 * source_size::DOUBLE AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM w),
r AS (SELECT *, row_number() OVER q AS place,
             coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
             sum(weight) OVER () - coalesce(sum(weight) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
      FROM c WINDOW q AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT *, (total - given) / rest AS rate FROM r),
g AS (SELECT *, min(place) FILTER (cap > rate * weight) OVER () AS first_open FROM f),
t AS (SELECT source, source_size, CASE WHEN first_open IS NULL OR place < first_open THEN cap
      ELSE weight * max(CASE WHEN place = first_open THEN rate END) OVER () END AS target FROM g),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS b
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(least(size, round(target)::BIGINT - b), 0) + greatest(least(size, round(target)::BIGINT - b - source_size), 0))::BIGINT AS taken
FROM p
"""

LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS own FROM documents),
n AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
l AS (SELECT DISTINCT r, source, line FROM (SELECT r, source, trim(unnest(own), ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM d) WHERE line <> ''),
bad AS (SELECT l.source, line FROM l JOIN n ON l.source IS NOT DISTINCT FROM n.source GROUP BY l.source, line, pages HAVING count(*) >= 5 AND count(*) > 0.1 * pages),
b AS (SELECT source, list(line) AS lines FROM bad GROUP BY source),
k AS (SELECT d.doc_id, d.source, own, CASE WHEN b.lines IS NULL THEN own ELSE
      list_filter(own, lambda x: NOT list_contains(b.lines, trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)))) END AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CASE WHEN own IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END AS text,
       coalesce(len(own), 0)::INTEGER AS n_lines, (coalesce(len(own), 0) - coalesce(len(kept), 0))::INTEGER AS n_dropped
FROM k
"""


def url_sql() -> str:
    """All rounds of the propagation written out one after another."""
    rule_rows = ", ".join(f"('{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}')" for r, v in RULES)
    rounds = "".join(
        f"""
s{k + 1} AS MATERIALIZED (SELECT host, sum(t) AS trust, sum(x) AS distrust FROM (
  SELECT host, trust AS t, distrust AS x FROM s0
  UNION ALL SELECT e.dst, 0.85 * s.trust / o.n, 0 FROM e JOIN s{k} s ON e.src = s.host JOIN o ON o.src = e.src
  UNION ALL SELECT e.src, 0, 0.85 * s.distrust / o.n FROM e JOIN s{k} s ON e.dst = s.host JOIN o ON o.src = e.src) GROUP BY host),"""
        for k in range(url_filter.ROUNDS)
    )
    return rf"""
WITH rules(rule, h, p, verdict) AS (VALUES {rule_rows}),
a AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT row_number() OVER () AS r, page_id, html, regexp_extract(rest, '^[^/?#]*') AS raw,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
d AS (SELECT r, page_id, html, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
f AS MATERIALIZED (SELECT d.*, (SELECT min({{'length': -length(rule), 'rule': rule, 'verdict': verdict}}) FROM rules
        WHERE (d.host = h OR ends_with(d.host, '.' || h)) AND starts_with(d.path, p)) AS fit FROM d),
names AS (SELECT DISTINCT host FROM d),
up AS (SELECT host AS src, substr(host, instr(host, '.') + 1) AS dst FROM names
       WHERE instr(host, '.') > 0 AND substr(host, instr(host, '.') + 1) IN (SELECT host FROM names)),
e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (
       SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:https?:)?//([^/"''?#\s>]+)', 1)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM d
       UNION ALL SELECT src, dst FROM up UNION ALL SELECT dst, src FROM up) WHERE src <> dst AND src <> '' AND dst <> ''),
o AS MATERIALIZED (SELECT src, count(*) AS n FROM e GROUP BY src),
s0 AS MATERIALIZED (SELECT host, 0.15 * avg(CASE WHEN fit.verdict = 'allow' THEN 1.0 ELSE 0 END) AS trust,
       0.15 * avg(CASE WHEN fit.verdict = 'block' THEN 1.0 ELSE 0 END) AS distrust FROM f GROUP BY host),{rounds}
last AS (SELECT host, distrust - trust >= 0.075 - 1e-12 AND host <> '' AS bad FROM s{url_filter.ROUNDS})
SELECT page_id, f.host, path, fit.rule AS rule, coalesce(fit.verdict, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
FROM f JOIN last USING (host)
"""


SQL = {"op1_mix_sources": MIX_SQL, "op6_line_dedup": LINES_SQL, "op7_url_filter": url_sql()}
