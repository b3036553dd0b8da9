"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitbars.llm import annscan, dartminhash, hostrep, langid, maskrank, mixing, packing, pii, rpforest, sharding, spelling
from pitbars.llm import warc, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _utf8(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def op1_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rpforest.near_vectors(
        _table(spark, sf_dir, "embeddings"), row_id=F.col("vec_id"), embedding=F.col("embedding")
    )
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = packing.pack(_table(spark, sf_dir, "documents"), vocabulary=packing.vocabulary_path(spark))
    return packing.read_segments(manifest).drop("path", "path_row")


def op3_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    terms = F.array_join(
        F.transform("terms", lambda t: F.concat_ws(":", F.lit(pii.TERM), t["start"].cast("string"), t["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id", *[F.get("counts", F.lit(i)).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)],
        F.sha2("base", 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(terms, F.lit(""))).alias("spans"),
        F.size("terms").cast("bigint").alias("n_term"),
    )


def op4_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(
        _table(spark, sf_dir, "documents"),
        F.col("doc_id"),
        F.md5(_utf8("text")),
        F.octet_length(_utf8("text")) + 1,
        shards=8,
        text_crc32=F.crc32(_utf8("text")),
    )
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def taught(docs: DataFrame) -> DataFrame:
    """The documents that a language model may learn from."""
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def op6_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(taught(docs), F.col("text"), F.col("lang"), F.col("doc_id"))
    told = langid.predict(docs, F.col("doc_id"), F.col("text"), model, held_out=_held_out())
    return told.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score", "rejected")


def op7_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mix(
        _table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("source"), mixing.word_count(F.col("text"))
    )
    return made.docs.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a number takes the outcome that ``labels`` has for that number."""
    labels = _table(spark, sf_dir, "labels")
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    bad = F.when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), bad)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    judged = hostrep.judge(_table(spark, sf_dir, "pages"), outcomes, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def contaminated() -> Column:
    """Whether hits cover at least a twentieth of a document's words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op10_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    page = r"^<urn:page:(-?[0-9]+)>$"

    def number(name: str) -> Column:
        return F.nullif(F.regexp_extract(name, page, 1), F.lit("")).cast("bigint")

    return read.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), number("refers_to").alias("refers_to"),
    )


def op11_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(_table(spark, sf_dir, "documents"), doc_id=F.col("doc_id"), text=F.col("text"))
    return spelling.group_spellings(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annscan.nearest(
        _table(spark, sf_dir, "embeddings"), row_id=F.col("vec_id"), embedding=F.col("embedding"),
        is_query=F.col("vec_id") % 20 == 0, k=20,
    )
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_presence_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maskrank.rank(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"),
        doc_id=F.col("doc_id"), text=F.col("text"), item_id=F.col("item_id"), item_text=F.col("text"), k=10,
    )


QUERIES = {
    "op1_projection_forest": op1_projection_forest,
    "op2_packing": op2_packing,
    "op3_disclosure": op3_disclosure,
    "op4_dartminhash": op4_dartminhash,
    "op5_sampled_splitters": op5_sampled_splitters,
    "op6_compression_langid": op6_compression_langid,
    "op7_source_schedule": op7_source_schedule,
    "op8_host_reputation": op8_host_reputation,
    "op9_winnowing": op9_winnowing,
    "op10_warc_normaliser": op10_warc_normaliser,
    "op11_partenum": op11_partenum,
    "op12_adaptive_scan": op12_adaptive_scan,
    "op13_presence_masks": op13_presence_masks,
}

_OP7 = """
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM documents
), named AS (
  SELECT source, sum(size)::BIGINT AS source_size, min(source IS NULL) AS nothing FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY nothing, encode(source)) - 1) % 3 + 1]::DOUBLE AS w,
         row_number() OVER (ORDER BY nothing, encode(source)) AS i,
         2.0 * source_size AS cap
  FROM named
), ordered AS (
  SELECT *, sum(w) OVER later AS w_left,
         1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0) AS left_over
  FROM weighed
  WINDOW later AS (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         earlier AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(left_over / w_left, w_left * -1) AS per_weight, min(cap / w) AS first_ratio
  FROM ordered WHERE cap * w_left > w * left_over
), aimed AS (
  SELECT source, source_size,
         CASE WHEN cap * w_left > w * left_over THEN w * per_weight ELSE cap END AS target
  FROM ordered, level
), laid AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, floor(a.target) AS quota,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(s.doc_id || ':0'), s.doc_id) - s.size AS first,
         a.source_size
           + sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(s.doc_id || ':1'), s.doc_id) - s.size AS second
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (greatest(0, least(size, quota - first)) + greatest(0, least(size, quota - second)))::BIGINT AS taken
FROM laid
"""

_OP8 = """
WITH parsed AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), pages_in AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parsed
), outcomes AS (
  SELECT doc_id AS page_id, max((coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0)::INT) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY doc_id
), hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
         regexp_replace(host, ':[0-9]*$', '') AS bare
  FROM pages_in LEFT JOIN outcomes USING (page_id) GROUP BY host
), placed AS (
  SELECT *, CASE WHEN regexp_matches(bare, '^[0-9.]+$|^\\[') OR len(string_split(bare, '.')) < 3 THEN bare
                 ELSE array_to_string(string_split(bare, '.')[-2:], '.') END AS domain
  FROM hosts
), named AS (
  SELECT *, CASE WHEN regexp_matches(domain, '^[0-9.]+$|^\\[') THEN '' ELSE string_split(domain, '.')[-1] END AS suffix
  FROM placed
), domains AS (
  SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM named WHERE host <> '' GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix
), stacked AS (
  SELECT 1 AS level, n, bad FROM suffixes UNION ALL SELECT 2, n, bad FROM domains
  UNION ALL SELECT 3, n, bad FROM named WHERE host <> ''
), sums AS (
  SELECT level, count(*) AS g, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(n * n)::DOUBLE AS nn,
         sum(bad * bad / n::DOUBLE) AS bb
  FROM stacked WHERE n > 0 GROUP BY level
), spread AS (
  SELECT level, g, n, (bb - bad * bad / n) / nullif(g - 1, 0) AS between_g,
         (bad - bb) / nullif(n - g, 0) AS within_g, (n - nn / n) / nullif(g - 1, 0) AS typical
  FROM sums
), rho AS (
  SELECT level, CASE WHEN g >= 2 AND n > g AND between_g + (typical - 1) * within_g > 0
                     THEN (between_g - within_g) / (between_g + (typical - 1) * within_g) ELSE 0 END AS rho
  FROM spread
), weights AS (
  SELECT level, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1.0), 1000.0) ELSE 1000.0 END AS w FROM rho
), w AS (
  SELECT coalesce(max(w) FILTER (level = 1), 1000.0) AS w1, coalesce(max(w) FILTER (level = 2), 1000.0) AS w2,
         coalesce(max(w) FILTER (level = 3), 1000.0) AS w3
  FROM weights
), base AS (
  SELECT (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS base FROM suffixes
), suffix_rate AS (
  SELECT suffix, (bad + w1 * base) / (n + w1) AS prior FROM suffixes, w, base
), domain_rate AS (
  SELECT d.suffix, d.domain, (d.bad + w2 * s.prior) / (d.n + w2) AS prior
  FROM domains d JOIN suffix_rate s USING (suffix), w
), posterior AS (
  SELECT h.host, h.bad + w3 * p.prior AS a, h.n - h.bad + w3 * (1 - p.prior) AS b
  FROM (
    SELECT h.host, h.n, h.bad, CASE WHEN h.host = '' THEN base ELSE coalesce(d.prior, base) END AS prior
    FROM named h LEFT JOIN domain_rate d ON h.suffix = d.suffix AND h.domain = d.domain, base
  ) p JOIN named h USING (host), w
), judged AS (
  SELECT host, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM posterior
), rules AS (
  SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                        ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(act, rhost, rpath)
), ruled AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, len(rhost || rpath)) AS rule,
         arg_max(act, len(rhost || rpath)) AS act
  FROM pages_in LEFT JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule,
       coalesce(act, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN judged USING (host)
"""

_OP9 = """
WITH worded AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT k FROM windows
), places AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS words
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, lengths WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, k, i, item_id FROM places JOIN windows USING (k, words)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM worded LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_OP10 = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha
  FROM pages
), topped AS (
  SELECT *, max(page_id) OVER (PARTITION BY sha, payload_bytes) AS top FROM hashed
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(sha, (j // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (j % 4))) & 31)::BIGINT + 1, 1)), '')
         AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM topped
"""

_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of strings. ``crc_table`` is the byte table by its rule; ``crc({})`` is spelt as below.
_CRC_TABLE = """
crc_step0 AS (SELECT i, i::BIGINT AS c FROM range(256) t(i)),
crc_table AS (
  SELECT list(list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM crc_step0
)"""


def _crc(text: str, table: str = "t") -> str:
    """CRC-32 of a non-empty SQL string, over its UTF-8 bytes; ``table`` is ``crc_table.t``."""
    hexed = f"hex(encode({text}))"
    byte = f"('0x' || substr({hexed}, 2 * k + 1, 2))::BIGINT"
    bytes_ = f"list_transform(range(length({hexed}) // 2), lambda k: {byte})"
    step = f"xor(c >> 8, {table}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda c, b: {step}), 4294967295)"


_OP5 = f"""
WITH {_CRC_TABLE}, keyed AS (
  SELECT doc_id, coalesce(text, '') AS body, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents
), placed AS (
  SELECT doc_id, body, size,
         sum(size) OVER (ORDER BY md5(body), doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT AS reach,
         row_number() OVER (ORDER BY md5(body), doc_id NULLS FIRST) AS place, sum(size) OVER ()::BIGINT AS total
  FROM keyed
), cut AS (
  SELECT *, least(7, floor((2 * reach - size) * 8 / (2 * total)))::INT AS shard FROM placed
), crcs AS (
  SELECT body, {_crc("body")} AS c FROM (SELECT DISTINCT body FROM keyed WHERE body <> ''), crc_table
)
SELECT doc_id, size::BIGINT AS size, coalesce(c, 0)::BIGINT AS text_crc32, 'bytes' AS law, shard,
       place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard
FROM cut LEFT JOIN crcs USING (body)
"""

_OP11 = f"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, {_LOWERED.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+'))")} AS r FROM documents
), hashed AS (
  SELECT r, {_crc("doc_id || ':' || r")} AS h, length(r) AS len FROM runs, crc_table WHERE length(r) >= 7
), words AS (
  SELECT word, count(*) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, (h % len)::BIGINT) || substr(r, (h % len)::BIGINT + 2) ELSE r END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 10 * w.n THEN b.top END AS form_n,
         CASE WHEN b.top >= 10 * w.n
              THEN (SELECT decode(min(encode(x.other))) FROM near x WHERE x.word = w.word AND x.other_n = b.top) END AS form
  FROM words w LEFT JOIN best b USING (word)
), walk AS (
  SELECT word, word AS reached, 0 AS step FROM forms
  UNION ALL
  SELECT k.word, f.form, k.step + 1 FROM walk k JOIN forms f ON k.reached = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(reached, step) AS root FROM walk GROUP BY word
)
SELECT word, form, root, n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN roots USING (word)
"""

#: The exact search. A table this small is one list, whose scan keeps all neighbours here.
_OP12 = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_OP13 = f"""
WITH placed AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWERED.format("coalesce(text, '')")},
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents
), counts AS (
  SELECT doc_id, term, count(*) AS tf FROM placed GROUP BY ALL
), sizes AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id
), whole AS (
  SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sizes
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED.format("coalesce(text, '')")},
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, whole GROUP BY term
), scored AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), whole
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op5_sampled_splitters": _OP5,
    "op7_source_schedule": _OP7,
    "op8_host_reputation": _OP8,
    "op9_winnowing": _OP9,
    "op10_warc_normaliser": _OP10,
    "op11_partenum": _OP11,
    "op12_adaptive_scan": _OP12,
    "op13_presence_masks": _OP13,
}
