"""The operators over the given tables, with the columns their checks name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.llm import (
    exact_dedup,
    mixing,
    neighbours,
    packing,
    prefix_trie,
    quality_rules,
    ranking,
    secrets,
    simhash,
    spans,
    toxicity,
    url_rules,
    whitening,
)
from wardbook.llm.shared import read
from wardbook.session import configure, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL where there is one."""

    def register(run: Query) -> Query:
        def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(configure(spark), sf_dir)

        QUERIES[run.__name__] = configured
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def tokenizer_path() -> str:
    """The public vocabulary file of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of the secrets in every document."""
    spans = F.col("spans")

    def joined(found):
        named = F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(named, ",")

    def number(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["kind"].isin(*secrets.BASE))
    return secrets.scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *(number(kind).alias(f"n_{kind}") for kind in secrets.BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


@query()
def op2_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the long strings of earlier ones."""
    return spans.remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


QUALITY_RULES_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (
  SELECT doc_id, text, w, l, CAST(len(w) AS BIGINT) AS n,
         list_transform(range(1, len(w) - 6), lambda i: list_slice(w, i, i + 7)) AS win
  FROM t),
k AS (SELECT doc_id, unnest(win) AS win, unnest(range(len(win))) AS i FROM p),
d AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM k) WHERE c > 1),
r AS (
  SELECT doc_id, sum(least(8, i - before)) AS n_repeat FROM (
    SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8) AS before
    FROM d) GROUP BY doc_id),
c AS (
  SELECT doc_id, n AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(list_filter(w, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words,
         CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_capitals
  FROM p LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND word_chars / n_words BETWEEN 2.0 AND 14.0
       AND n_symbols / n_words <= 0.3
       AND n_stop_words / n_words >= 0.02
       AND n_capitals / word_chars <= 0.4
       AND n_dup_lines / n_lines <= 0.5 AS kept
FROM b
""".replace(
    "{stop}",
    ", ".join(f"'{w}'" for w in sorted({w for r in quality_rules.STOP_WORDS for w in r.split()})),
)


@query(QUALITY_RULES_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdict of every document."""
    return quality_rules.apply_rules(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query()
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth one."""
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@query()
def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and group of every document."""
    return simhash.groups(read(spark, sf_dir, "documents")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "n_links",
    )


@query()
def op6_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return ranking.rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (CAST([5, 2, 1] AS DOUBLE[]))[
           1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, CAST(3 AS DOUBLE) * source_size AS cap,
         row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS j
  FROM s),
l AS (
  SELECT j, cap, w,
         (CAST(sum(source_size) OVER () AS DOUBLE)
          - coalesce(sum(cap) OVER (
              ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM o),
x AS (SELECT level FROM l WHERE cap > w * level ORDER BY j LIMIT 1),
t AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM (SELECT o.*, least(cap, w * coalesce((SELECT level FROM x), 0)) AS target FROM o)),
r AS (
  SELECT d.*, source_size, target, rate, rate - floor(rate) AS fraction
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT source, source_size, target, rate, k,
         sum(CASE WHEN chance < fraction THEN size ELSE 0 END) AS extra
  FROM (
    SELECT r.*, k, CAST(CAST('0x' || substr(md5(k || ':' || doc_id), 1, 12) AS UBIGINT) AS DOUBLE)
                   / 281474976710656 AS chance
    FROM r, range(64) AS seeds(k))
  GROUP BY ALL),
p AS (
  SELECT source, k FROM e
  QUALIFY row_number() OVER (
    PARTITION BY source
    ORDER BY abs(extra - (target - floor(rate) * source_size)), k) = 1)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN
         CAST(CAST('0x' || substr(md5(k || ':' || doc_id), 1, 12) AS UBIGINT) AS DOUBLE)
         / 281474976710656 < fraction THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source
"""


@query(MIXING_SQL)
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with the checksum of its ids."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path()).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


URL_SQL = r"""
WITH RECURSIVE
h AS (
  SELECT url, html FROM pages WHERE url IS NOT NULL),
k AS (
  SELECT url, regexp_extract(regexp_extract(html,
           '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
           '(?is)\bhref\s*=\s*["'']?\s*([^\s"''>]+)', 1) AS raw FROM h
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(html,
           '(?is)<meta\b[^>]*http-equiv\s*=\s*["'']?refresh\b[^>]*>'),
           '(?is)\burl\s*=\s*["'']?\s*([^\s"''>]+)', 1) FROM h),
a AS (
  SELECT url, CASE
           WHEN raw LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || raw
           WHEN raw LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || raw
           ELSE raw END AS target FROM k),
b AS (
  SELECT url AS f, target AS t FROM a WHERE contains(target, '://') AND url <> target
  UNION SELECT target, url FROM a WHERE contains(target, '://') AND url <> target),
reach AS (
  SELECT f, t FROM b
  UNION SELECT reach.f, b.t FROM reach JOIN b ON reach.t = b.f),
u AS (SELECT url FROM h UNION SELECT f FROM b),
n AS (
  SELECT url,
         translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM u),
o AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM n),
v AS (
  SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
                 WHEN rule IS NOT NULL THEN 'block' END AS own FROM o),
c AS (
  SELECT reach.f AS url, bool_or(v.own = 'block') AND NOT coalesce(bool_or(v.own = 'allow'), false)
           AS blocked
  FROM reach JOIN v ON v.url = reach.t GROUP BY reach.f)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(own, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM pages LEFT JOIN v USING (url) LEFT JOIN c USING (url)
"""


@query(URL_SQL)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return url_rules.judge(read(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return toxicity.rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coordinates of every vector along the first components."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


EXACT_DEDUP_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS own
  FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(own) AS text_sha256
FROM t WINDOW same AS (PARTITION BY own)
"""


@query(EXACT_DEDUP_SQL)
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which copy of every document stays.

    The files of the table come in four batches (a single file in one), so later ones meet
    the state that earlier ones left.
    """
    path = f"{sf_dir}/documents.parquet"
    files = len(spark.read.parquet(path).inputFiles())
    store = shared_folder(spark, "exact-dedup")
    return exact_dedup.deduplicate(spark, path, store, files_per_batch=max(1, -(-files // 4)))


TRIE_SQL = """
WITH
raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
seq AS (
  SELECT conv_id, list(struct_pack(id := md5(len(role) || ':' || role || text),
                                   n := CAST(strlen(text) AS BIGINT))
                       ORDER BY turn NULLS FIRST, role, text) AS s
  FROM raw GROUP BY conv_id),
crc AS (
  SELECT conv_id,
    xor(list_reduce(list_prepend(4294967295::UBIGINT,
        list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ord(ch)::UBIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
        lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))), 4294967295::UBIGINT) AS crc
  FROM seq),
reb AS (
  SELECT q.conv_id, list_concat(coalesce(list_slice(b.s, 1, CAST(crc % 9 AS BIGINT)), []),
                                list_slice(q.s, CAST(crc % 9 AS BIGINT) + 1, len(q.s))) AS r
  FROM seq q JOIN crc USING (conv_id) LEFT JOIN seq b ON b.conv_id = q.conv_id - q.conv_id % 5),
ids AS (SELECT conv_id, r, list_transform(r, lambda t: t.id) AS i FROM reb),
mem AS (
  SELECT conv_id, d AS depth, md5(array_to_string(list_slice(i, 1, d), ',')) AS k,
    CASE WHEN d > 0 THEN md5(array_to_string(list_slice(i, 1, d - 1), ',')) END AS up,
    CASE WHEN d > 0 THEN r[d].n ELSE 0 END AS n, d = len(r) AS ends
  FROM ids, unnest(range(CAST(len(r) AS BIGINT) + 1)) AS x(d)),
node AS (
  SELECT depth, k, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * min(n) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                    FILTER (WHERE ends), '')) AS ends_sha256
  FROM mem GROUP BY depth, k),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
own AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (depth, k)),
sums AS (
  SELECT m.depth, m.k, sum(v.saved) AS saved, count(*) FILTER (WHERE v.n_children = 0) AS leaves
  FROM own v JOIN mem m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.depth, m.k)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children,
  leaves AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own o JOIN sums USING (depth, k) LEFT JOIN own p ON p.depth = o.depth - 1 AND p.k = o.up
"""


@query(TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversation prefixes."""
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))
