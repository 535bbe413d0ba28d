"""The registered queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import lexical, merkle, mixing, packing, pii, pseudo, quality, repeats, sharding, simhash, topk, toxicity, urls
from wardline.llm.shared import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(build):
    QUERIES[build.__name__] = build
    return build


@_query
def op1_remove_repeats(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = repeats.remove_repeats(read(spark, folder, "documents"), window=50)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op2_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard(read(spark, folder, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def _day(number):
    return F.date_add(F.lit("2024-01-01").cast("date"), number.cast("int"))


def _captures(pages: DataFrame) -> DataFrame:
    """The pages as captures: the table has no dates, so the id gives one."""
    return pages.select("page_id", "url", _day(F.col("page_id") * 7919 % 366).alias("fetched"))


def _entries(pages: DataFrame) -> DataFrame:
    """Dated lists over the pages' own hosts and domains: every host is blocked, later freed, and every third blocked
    again; every domain is allowed or blocked from some day on, and the other way round half a year later."""
    hosts = pages.select("page_id", urls.host_of(F.col("url")).alias("host")).where("host IS NOT NULL")
    domains = hosts.select("page_id", F.try_element_at(urls.covering(F.col("host")), F.lit(-2)).alias("domain"))
    host = hosts.groupBy(F.col("host").alias("pattern")).agg(F.min("page_id").alias("n"))
    domain = domains.groupBy(F.col("domain").alias("pattern")).agg(F.min("page_id").alias("n"))

    def log(of, name, action, day):
        return of.select(F.lit(name).alias("list"), "pattern", F.lit(action).alias("action"), _day(day).alias("day"))

    n = F.col("n")
    return (
        log(host, "hosts", "block", n * 31 % 300)
        .union(log(host, "hosts", "remove", n * 31 % 300 + 20 + n % 60))
        .union(log(host.where("n % 3 = 0"), "hosts", "block", n * 31 % 300 + 120))
        .union(log(domain.where("n % 2 = 0"), "domains", "allow", n % 100))
        .union(log(domain.where("n % 2 = 0"), "domains", "block", n % 100 + 180))
        .union(log(domain.where("n % 2 = 1"), "domains", "block", n % 100))
        .union(log(domain.where("n % 2 = 1"), "domains", "allow", n % 100 + 180))
    )


@_query
def op3_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    found = urls.evaluate(_captures(pages), _entries(pages))
    return found.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "verdict", "list", "pattern",
                        F.col("since").cast("string").alias("since"))


SQL["op3_url_verdicts"] = r"""
WITH named AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INTEGER) AS fetched,
         regexp_replace(regexp_extract(lower(trim(url)),
           '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)', 1), '\.+$', '') AS h
  FROM pages),
c AS (SELECT page_id, fetched, CASE WHEN length(h) > 0 THEN h END AS host FROM named),
cov AS (
  SELECT DISTINCT host, CASE WHEN regexp_matches(host, '^(\[.*|[0-9.]+)$') THEN [host]
    ELSE list_transform(range(1, len(string_split(host, '.')) + 1),
                        lambda i: array_to_string(string_split(host, '.')[i:], '.')) END AS above
  FROM c WHERE host IS NOT NULL),
n AS (
  SELECT 'hosts' AS list, host AS pattern, min(page_id) AS n FROM c WHERE host IS NOT NULL GROUP BY host
  UNION ALL
  SELECT 'domains', above[-2], min(page_id) FROM c JOIN cov USING (host) WHERE len(above) > 1 GROUP BY above[-2]),
log AS (
  SELECT list, pattern, 'block' AS action, n * 31 % 300 AS d FROM n WHERE list = 'hosts'
  UNION ALL SELECT list, pattern, 'remove', n * 31 % 300 + 20 + n % 60 FROM n WHERE list = 'hosts'
  UNION ALL SELECT list, pattern, 'block', n * 31 % 300 + 120 FROM n WHERE list = 'hosts' AND n % 3 = 0
  UNION ALL SELECT list, pattern, CASE n % 2 WHEN 0 THEN 'allow' ELSE 'block' END, n % 100 FROM n WHERE list = 'domains'
  UNION ALL SELECT list, pattern, CASE n % 2 WHEN 0 THEN 'block' ELSE 'allow' END, n % 100 + 180 FROM n WHERE list = 'domains'),
v AS (
  SELECT list, pattern, action, DATE '2024-01-01' + CAST(d AS INTEGER) AS since,
         DATE '2024-01-01' + CAST(lead(d) OVER (PARTITION BY list, pattern ORDER BY d) AS INTEGER) AS until
  FROM log),
m AS (
  SELECT c.page_id, c.host, c.fetched, v.*,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.pattern) DESC, v.action = 'allow', v.list) AS nth
  FROM c JOIN cov USING (host) JOIN v ON list_contains(cov.above, v.pattern)
   AND v.since <= c.fetched AND (v.until IS NULL OR c.fetched < v.until)
  WHERE v.action <> 'remove')
SELECT c.page_id, c.host, CAST(c.fetched AS VARCHAR) AS fetched, coalesce(m.action, 'none') AS verdict, m.list, m.pattern,
       CAST(m.since AS VARCHAR) AS since
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.nth = 1"""


@_query
def op4_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.scaled(read(spark, folder, "embeddings"), factor=256.0)
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


SQL["op4_top_k"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         max(CAST(coalesce(list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: z[1] * z[2])), 0) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)
  WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5"""


@_query
def op5_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(read(spark, folder, "documents"), tokenizer, capacity=4096, end_id=1).drop("row")


@_query
def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(read(spark, folder, "documents"))

    def shown(spans):
        """kind:start:end of the spans, which come by kind and start."""
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = map(number, pii.KINDS[:4])
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


@_query
def op7_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    found = pseudo.score(read(spark, folder, "documents"))
    return found.select("doc_id", "n_words", F.round("log_probability", 4).alias("log_probability"),
                        F.round("mean_log_probability", 6).alias("mean_log_probability"))


@_query
def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.copies(read(spark, folder, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return taken.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


@_query
def op9_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.judged(read(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        "kept", F.round("p_good", 6).alias("p_good"))


@_query
def op10_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.components(read(spark, folder, "documents"), shingle=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


# The level at which the sources fill up is found by trying each source's own.
SQL["op8_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS weight,
         2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS budget
  FROM s),
levels AS (
  SELECT DISTINCT a.cap / a.weight AS low,
         (SELECT sum(CASE WHEN b.cap / b.weight <= a.cap / a.weight THEN b.cap ELSE 0 END) FROM w b) AS full_caps,
         (SELECT sum(CASE WHEN b.cap / b.weight <= a.cap / a.weight THEN 0 ELSE b.weight END) FROM w b) AS open_weight,
         (SELECT sum(least(b.cap, b.weight * a.cap / a.weight)) FROM w b) AS given, a.budget
  FROM w a
  UNION ALL SELECT 0, 0, sum(weight), 0, any_value(budget) FROM w),
level AS (
  SELECT arg_max((budget - full_caps) / open_weight, low) AS level FROM levels WHERE given <= budget AND open_weight > 0),
t AS (SELECT source, source_size, CAST(least(cap, weight * level) AS DOUBLE) AS target FROM w, level),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST('0x' || substring(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
           / CAST(4294967296 AS DOUBLE) AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r"""


@_query
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"), k=20)


SQL["op11_lexical_search"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
q AS (
  SELECT item_id, row_number() OVER () AS q, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark),
asked AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(terms) AS term FROM q) GROUP BY q, term),
facts AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
held AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), facts),
scores AS (
  SELECT a.q, h.r, CAST(sum(a.times * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 12 * (75 + (25 * len(d.terms) * n_docs) // total)))) AS BIGINT) AS score
  FROM asked a JOIN held h USING (term) JOIN weights w USING (term) JOIN d ON d.r = h.r, facts GROUP BY a.q, h.r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT q.item_id, d.doc_id, s.score, row_number() OVER (PARTITION BY s.q ORDER BY s.score DESC, d.doc_id NULLS LAST) AS rank
      FROM scores s JOIN d USING (r) JOIN q ON q.q = s.q WHERE s.score > 0)
WHERE rank <= 20"""


@_query
def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return found.withColumn("score", F.round("score", 6))


@_query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every second document, by a checksum of its id, is shown without its line feeds, which its proof must tell."""
    docs = read(spark, folder, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = F.when(altered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", merkle.leaf(*map(F.col, columns)).alias("leaf"),
                         merkle.leaf(*map(F.col, columns[:4]), shown).alias("seen"))
    found = merkle.manifest(leaves, keep=("seen",))
    found = merkle.folded(found.withColumn("proof_sha256", F.sha2(merkle.siblings(F.col("proof")), 256)), "seen", "proof")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


# Trees grow level by level; a document's siblings are looked up at the levels below its subroot, then above it.
SQL["op13_merkle_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
         || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
         list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) & 1 AS crc_bit
  FROM documents),
l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         -- The checksum is the register's complement: it is even where the register is odd.
         sha256(head || coalesce(CASE WHEN crc_bit = 1 THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')
                                      ELSE strlen(text) || ':' || text END, '-')) AS seen
  FROM d),
p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER () AS id
  FROM l),
low AS (
  SELECT 0 AS level, tree, spot, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM p
  UNION ALL
  SELECT level + 1, tree, spot // 3, sha256(string_agg(h, '' ORDER BY spot)), any_value((n + 2) // 3)
  FROM low WHERE n > 1 GROUP BY level, tree, spot // 3),
subs AS (SELECT tree, h FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, tree AS spot, h, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT level + 1, spot // 3, sha256(string_agg(h, '' ORDER BY spot)), any_value((n + 2) // 3)
  FROM high WHERE n > 1 GROUP BY level, spot // 3),
steps AS (
  SELECT p.id, low.level, string_agg(low.h, '' ORDER BY low.spot) FILTER (low.spot < p.spot // CAST(pow(3, low.level) AS BIGINT)) AS l,
         string_agg(low.h, '' ORDER BY low.spot) FILTER (low.spot > p.spot // CAST(pow(3, low.level) AS BIGINT)) AS r
  FROM p JOIN low ON low.tree = p.tree AND low.n > 1 AND low.spot // 3 = p.spot // CAST(pow(3, low.level + 1) AS BIGINT)
  GROUP BY p.id, low.level
  UNION ALL
  SELECT p.id, 1000 + high.level, string_agg(high.h, '' ORDER BY high.spot) FILTER (high.spot < p.tree // CAST(pow(3, high.level) AS BIGINT)),
         string_agg(high.h, '' ORDER BY high.spot) FILTER (high.spot > p.tree // CAST(pow(3, high.level) AS BIGINT))
  FROM p JOIN high ON high.n > 1 AND high.spot // 3 = p.tree // CAST(pow(3, high.level + 1) AS BIGINT)
  GROUP BY p.id, high.level),
proofs AS (
  SELECT id, string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY level) AS proof,
         list({'l': coalesce(l, ''), 'r': coalesce(r, '')} ORDER BY level) AS way
  FROM steps GROUP BY id),
folds AS (
  SELECT p.id, coalesce(way, []) AS way, seen AS h, 1 AS step FROM p LEFT JOIN proofs USING (id)
  UNION ALL
  SELECT id, way, sha256(way[step].l || h || way[step].r), step + 1 FROM folds WHERE step <= len(way))
SELECT p.doc_id, p.leaf, subs.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root,
       sha256(coalesce(proofs.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = (SELECT h FROM high WHERE n = 1) AS verified
FROM p JOIN subs USING (tree) LEFT JOIN proofs USING (id) JOIN folds f ON f.id = p.id AND f.step = len(f.way) + 1"""
