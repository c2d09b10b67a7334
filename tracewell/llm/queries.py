"""The registered query of each operator of this subpackage, over whole tables, and its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import alignment, chat, langid, media, mixing, near_dup, packing, quality, sharding, substring_dup, token_counts, url_filter, vector_codes
from tracewell.llm.shared import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
s AS (SELECT doc_id, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.g) + len(y.g) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS low FROM g UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.doc_id WHERE r.low < e.b)
SELECT g.doc_id, len(any_value(g.g)) AS n_shingles, min(r.low) AS component_id, min(r.low) = g.doc_id AS kept
FROM g JOIN r USING (doc_id) GROUP BY g.doc_id
"""


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = media.store_texts(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    pages = media.tiff_pages(files, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    return pages.select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "page", "compression", "error",
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = langid.with_holdout(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = langid.learn(docs.where("NOT held_out"))
    return langid.predict(docs, model, "doc_id", "held_out")


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(read(spark, sf_dir, "documents"))


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, text AS raw FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS bare,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1), range(0, 3) k(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(bare) AS word_chars, length(regexp_replace(bare, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w),
l AS (SELECT doc_id, host, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
h AS (SELECT host, count(DISTINCT doc_id) AS docs FROM d WHERE raw IS NOT NULL GROUP BY host),
f AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT doc_id) AS n FROM l GROUP BY ALL) JOIN h USING (host) WHERE n > {quality.LEAST_DOCS} AND n * n > {quality.SPREAD} * docs),
g AS (SELECT doc_id, sum(words)::BIGINT AS n FROM l JOIN f USING (host, line) GROUP BY doc_id),
b AS (SELECT m.*, coalesce(r.n, 0) AS n_repeat_words, coalesce(g.n, 0) AS n_removed_words, n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed FROM m LEFT JOIN r USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT *, NOT base_failed AND 100 * (n_words - n_removed_words) >= {quality.KEPT_PERCENT} * n_words AS kept FROM b
"""


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.formatted(turns.union(more)))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given labels are of documents; a page has the outcome of the document with its number, toxic or of low quality."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return url_filter.judged(read(spark, sf_dir, "pages").select("page_id", "url"), labels).select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, keys: str, source: str) -> str:
    """SQL of one level's shrinkage; ``source`` has n, bad and m."""
    return f"""{name}_in AS MATERIALIZED ({source}),
{name}_rho AS (SELECT CASE WHEN sum(n) > count(*) THEN least(greatest((coalesce(sum(pow(bad - n * m, 2) / n / greatest(m * (1 - m), 1e-9)), 0) - count(*)) / (sum(n) - count(*)), 1e-4), 0.99) ELSE 1e-4 END AS rho FROM {name}_in WHERE n > 0),
{name} AS MATERIALIZED (SELECT {keys}, s * m + bad AS a, s * (1 - m) + n - bad AS b FROM (SELECT *, 1 / (rho / (1 - rho) + 1 / k) AS s FROM {name}_in, {name}_rho))"""


_ADDRESS = url_filter.ADDRESS
_TWO = ", ".join(f"'{x}'" for x in url_filter.SUFFIXES)
_RULES = ", ".join(str(x) for x in url_filter.RULES)
OP6_SQL = rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
o AS (SELECT doc_id AS page_id, CAST(toxic = 1 OR quality = 0 AS BIGINT) AS bad FROM labels WHERE (toxic = 1 OR quality = 0) IS NOT NULL),
st AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') AS site FROM u),
hh AS (SELECT site AS host, count(o.page_id) AS n, coalesce(sum(bad), 0) AS bad FROM st LEFT JOIN o USING (page_id) GROUP BY site),
h2 AS (SELECT *, string_split(host, '.') AS p FROM hh),
h3 AS (SELECT host, n, bad, array_to_string(p[-2:], '.') AS two, array_to_string(p[-3:], '.') AS three, p[-1] AS one FROM h2),
h AS (SELECT host, n, bad, CASE WHEN regexp_matches(host, '{_ADDRESS}') THEN host WHEN two IN ({_TWO}) THEN two ELSE one END AS suffix, CASE WHEN regexp_matches(host, '{_ADDRESS}') THEN host WHEN two IN ({_TWO}) THEN three ELSE two END AS domain FROM h3),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
t AS (SELECT (coalesce(sum(bad), 0) + {url_filter.PRIOR} * 0.5) / (coalesce(sum(n), 0) + {url_filter.PRIOR}) AS m, coalesce(sum(n), 0) + {url_filter.PRIOR} AS k FROM d),
{_level("ls", "suffix", "SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m, any_value(k) AS k FROM d, t GROUP BY suffix")},
{_level("ld", "domain", "SELECT domain, n, bad, a / (a + b) AS m, a + b AS k FROM d JOIN ls USING (suffix)")},
{_level("lh", "host", "SELECT host, n, bad, a / (a + b) AS m, a + b AS k FROM h JOIN ld USING (domain)")},
v AS (SELECT host, a / (a + b) - {url_filter.Z} * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) > {url_filter.LIMIT} AS worse FROM lh),
x(rh, rp, verdict) AS (VALUES {_RULES}),
f AS (SELECT page_id, rh || rp AS rule, verdict FROM u JOIN x ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, rh || rp DESC) = 1)
SELECT u.page_id, u.host, path, f.rule, coalesce(f.verdict, CASE WHEN worse THEN 'block' ELSE 'allow' END) AS verdict FROM st u JOIN v ON v.host = site LEFT JOIN f USING (page_id)
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.calibrated(read(spark, sf_dir, "documents"))
    return out.withColumn("probability", F.round("probability", 9))


def _raking_sql(sweeps: int = 24) -> str:
    """Goals by filling the smallest values first, then as many sweeps as any of the given tables needs to settle."""
    steps, now = [], "c0"
    for d, power in mixing.TEMPER.items():
        steps.append(f"""h_{d} AS (SELECT {d}, sum(tokens)::DOUBLE AS has, pow(sum(tokens)::DOUBLE, {power}) AS t FROM cells GROUP BY {d}),
k_{d} AS (SELECT *, ({mixing.KEEP} * sum(has) OVER () - (sum(has) OVER (ORDER BY has, {d}) - has)) / nullif(sum(t) OVER (ORDER BY has DESC, {d} DESC), 0) AS scale FROM h_{d}),
g_{d} AS MATERIALIZED (SELECT {d}, least(has, t * (SELECT min_by(scale, has) FROM k_{d} WHERE scale * t < has)) AS goal_{d} FROM k_{d})""")
    joins = " ".join(f"JOIN g_{d} USING ({d})" for d in mixing.TEMPER)
    steps.append(f"c0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS weight FROM cells {joins})")
    for i in range(sweeps):
        for d in mixing.TEMPER:
            then = f"c{i}_{d}"
            steps.append(f"{then} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN held > 0 THEN least(1.0, weight * goal_{d} / held) ELSE weight END AS weight) FROM (SELECT * EXCLUDE (held), sum(tokens * weight) OVER (PARTITION BY {d}) AS held FROM (SELECT *, 0 AS held FROM (SELECT source, lang, topic, tokens, goal_source, goal_lang, goal_topic, weight FROM {now}))))")
            now = then
    steps.append(f"rates AS (SELECT source, lang, topic, weight AS probability FROM {now})")
    return ",\n".join(steps)


OP7_SQL = rf"""
WITH r AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n_tokens,
    CASE WHEN contains(text, '@') THEN 'contact' WHEN regexp_matches(text, '(?i)licen[sc]e|rights reserved') THEN 'legal' WHEN length(text) >= 4000 THEN 'long' WHEN length(text) >= 800 THEN 'medium' ELSE 'short' END AS topic
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM r GROUP BY ALL),
{_raking_sql()}
SELECT doc_id, source, lang, topic, n_tokens, round(probability, 9) AS probability,
  ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13))::BIGINT / {float(2**52)} < probability AS kept
FROM r JOIN rates USING (source, lang, topic)
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-counts")
    return token_counts.limits(scratch.table(token_counts.length_histogram(token_counts.encoded_lengths(read(spark, sf_dir, "documents")))))


def op9_substring_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
d AS (SELECT DISTINCT doc_id, i + k AS at FROM h JOIN f USING (h), range(0, 50) t(k) WHERE doc_id > first),
k AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.at) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM w) x ANTI JOIN d ON d.doc_id = x.doc_id AND d.at = x.at GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(read(spark, sf_dir, "documents"))
    return packing.pack(Scratch(spark, "packing").table(packing.digests(pieces)))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleaved(sharding.digests(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


_CRC32 = """crc_steps AS (SELECT i, 0 AS k, i AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8)"""
_CRC32_OF_TEXT = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
_FRACTION = "('0x' || substr({0}, 1, 13))::BIGINT / " + str(float(2**52))
OP11_SQL = f"""
WITH RECURSIVE {_CRC32},
d AS (SELECT doc_id, source, text, octet_length(encode(text)) + 1 AS size, md5('{sharding.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(text)) AS key FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id, size) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n, {_FRACTION.format(f"md5('{sharding.SEED}:' || coalesce('=' || source, ''))")} AS u FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (rank + u) / n, source NULLS FIRST, rank) - 1 AS place, count(*) OVER () AS total FROM r),
s AS (SELECT *, place * {sharding.SHARDS} // total AS shard FROM p)
SELECT doc_id, size, {_CRC32_OF_TEXT} AS text_crc32, 'rows' AS law, shard::INT AS shard, place - (shard * total + {sharding.SHARDS - 1}) // {sharding.SHARDS} AS slot, NULL::INT AS grown_shard, source FROM s, crc
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = vector_codes.compressed(read(spark, sf_dir, "embeddings"))
    out = vector_codes.with_label_error(codes).withColumnRenamed("id", "vec_id")
    return out.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(codebooks)).alias("codebooks_sha256"))


def _lloyd_sql() -> str:
    def assigned(name: str, book: str) -> str:
        distance = "list_sum(list_transform(list_zip(c.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        return f"{name} AS MATERIALIZED (SELECT vec_id, part, any_value(label) AS label, any_value(v) AS v, min(struct_pack(d, entry)) AS best FROM (SELECT c.vec_id, c.part, c.label, c.v, e.entry, {distance} AS d FROM cut c JOIN {book} e USING (part)) GROUP BY vec_id, part)"

    steps = []
    for i in range(vector_codes.ROUNDS):
        steps.append(assigned(f"a{i}", f"b{i}"))
        steps.append(f"m{i} AS (SELECT part, entry, list(x ORDER BY k) AS v FROM (SELECT part, best.entry AS entry, k, CAST(floor(sum(v[k]) / count(*)::DOUBLE) AS BIGINT) AS x FROM a{i}, range(1, {1 + 64 // vector_codes.PARTS}) t(k) GROUP BY ALL) GROUP BY ALL)")
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m USING (part, entry))")
    return ",\n".join([*steps, assigned("final", f"b{vector_codes.ROUNDS}")])


OP12_SQL = f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT max(len(v)) // {vector_codes.PARTS} AS w FROM k),
cut AS MATERIALIZED (SELECT vec_id, label, part, v[part * w + 1:(part + 1) * w] AS v FROM k, w, range({vector_codes.PARTS}) t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM cut QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {vector_codes.ENTRIES}),
{_lloyd_sql()},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{vector_codes.ROUNDS}),
e AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM final GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e, h
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_aligned(read(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_near_dup, op2_tiff, op3_language_id, op4_line_quality, op5_chat, op6_url_filter, op7_mixing, op8_token_counts, op9_substring_dup, op10_packing, op11_sharding, op12_vector_codes, op13_alignment)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dup": OP1_SQL, "op4_line_quality": OP4_SQL, "op6_url_filter": OP6_SQL, "op7_mixing": OP7_SQL, "op9_substring_dup": OP9_SQL, "op11_sharding": OP11_SQL, "op12_vector_codes": OP12_SQL}
