"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import attention_mil, bpe, cdc_dedup, chat_events, collision_lsh, first_seen, interpolation, langid_cnn, perplexity, setsketch, soft_mixing, vector_codes, warc_revisit

#: Wanted shares of tokens of the domains that the labels table tells apart.
WEIGHTS = {"clean": 0.90, "junk": 0.08, "toxic": 0.02}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def domains(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").alias("domain"))


def vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(table(spark, sf_dir, "documents"))


def op2_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    net = attention_mil.train(docs.select("doc_id", "text").where(~held_out()), labels)
    out = attention_mil.score(docs, net)
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_langid_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid_cnn.predict(docs, langid_cnn.train(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


SAID = "</s>[INST] ok [/INST]"


def op4_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAID).alias("text"))
    return chat_events.read_back(chat_events.render(chat_events.fold(chat_events.events_of(rows.unionByName(extra)))))


SQL_OP4 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, 0, 'user', '{SAID}' UNION ALL SELECT -1, 1, 'assistant', '{SAID}'),
marked AS (
  SELECT *, regexp_replace(text, '([<\\[])(\\\\*)(s>|/s>|INST\\]|/INST\\]|<SYS>>|</SYS>>)', '\\1\\\\\\2\\3', 'g') AS safe,
         regexp_replace(role, '([<\\[])(\\\\*)(s>|/s>|INST\\]|/INST\\]|<SYS>>|</SYS>>)', '\\1\\\\\\2\\3', 'g') AS safe_role FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(3 + length(safe_role) + CASE WHEN role = 'assistant' THEN 7 + 4 ELSE 6 + 7 END + length(safe)) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def records(pages: DataFrame) -> DataFrame:
    """Capture records of ``pages``: a response for each page, and a later revisit under a variant of its URL.

    Every fifth revisit carries another page version's ETag; every seventh carries none but a digest.
    """
    header = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    p = p.withColumn("etag", F.concat(F.lit('"'), F.left("digest", F.lit(16)), F.lit('"')))
    response = p.select(
        (F.col("page_id") * 2).alias("record_id"), (F.col("page_id") * 60).alias("ts"), "url", F.lit("response").alias("kind"), "etag", F.lit(None).cast("string").alias("last_modified"), "digest",
        F.array(header("Content-Type", F.lit("text/html")), header("ETag", F.col("etag")), header("Date", F.col("page_id") * 60), header("Cache-Control", F.lit("max-age=60"))).alias("headers"), F.col("html").alias("payload"),
    )
    ts = F.col("page_id") * 60 + 30 + (F.col("page_id") % 7) * 40_000
    tag = F.when(F.col("page_id") % 7 == 3, F.lit(None)).when(F.col("page_id") % 5 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), F.col("etag")))
    revisit = p.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), ts.alias("ts"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"), F.lit("revisit").alias("kind"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.when(F.col("page_id") % 7 == 3, F.col("digest")).alias("digest"),
        F.array(header("date", ts), header("Server", F.lit("x"))).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


def op6_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_revisit.resolve_revisits(records(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return out.select("record_id", "ts", "url_key", "kind", "ref_record_id", "state", lines.alias("headers"), F.sha2("payload", 256).alias("payload_sha256"), F.length("payload").cast("long").alias("payload_chars"))


SQL_OP6 = r"""
WITH p AS (SELECT page_id, url, html, sha256(coalesce(html, '')) AS digest, '"' || left(sha256(coalesce(html, '')), 16) || '"' AS etag FROM pages),
r AS (
  SELECT page_id * 2 AS record_id, page_id * 60 AS ts, url, 'response' AS kind, etag, digest, html AS payload,
    'Content-Type: text/html' || chr(10) || 'ETag: ' || etag || chr(10) || 'Date: ' || (page_id * 60) || chr(10) || 'Cache-Control: max-age=60' AS headers FROM p
  UNION ALL
  SELECT page_id * 2 + 1, page_id * 60 + 30 + (page_id % 7) * 40000, regexp_replace(url, '#.*$', '') || '#again', 'revisit',
    CASE WHEN page_id % 7 = 3 THEN NULL WHEN page_id % 5 = 0 THEN '"stale"' ELSE etag END,
    CASE WHEN page_id % 7 = 3 THEN digest END, NULL, 'date: ' || (page_id * 60 + 30 + (page_id % 7) * 40000) || chr(10) || 'Server: x' FROM p),
u AS (SELECT *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['host', 'path', 'query']) AS m FROM r),
c AS (SELECT *, regexp_replace(regexp_replace(lower(m.host), '^www\.', ''), ':(80|443)$', '') || CASE WHEN m.path = '' THEN '/' ELSE m.path END
  || CASE WHEN coalesce(m.query, '') = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(m.query, '&')), '&') END AS url_key FROM u),
s AS (SELECT * FROM c WHERE kind = 'response'),
j AS (SELECT v.*, s.record_id AS ref, s.etag AS s_etag, s.digest AS s_digest, s.headers AS s_headers, s.payload AS s_payload, s.ts AS s_ts
  FROM (SELECT * FROM c WHERE kind = 'revisit') v ASOF LEFT JOIN s ON v.url_key = s.url_key AND v.ts > s.ts),
k AS (SELECT *, CASE WHEN ref IS NULL THEN 'no_response' WHEN coalesce(etag <> s_etag, false) OR coalesce(digest <> s_digest, false) THEN 'validator_mismatch' ELSE 'resolved' END AS state FROM j)
SELECT record_id, ts, url_key, kind, NULL::BIGINT AS ref_record_id, 'full' AS state, headers, sha256(payload) AS payload_sha256, length(payload) AS payload_chars FROM s
UNION ALL
SELECT record_id, ts, url_key, kind, ref, state,
  CASE WHEN state = 'resolved' THEN regexp_replace(s_headers, '\nDate: [0-9]+', '') || chr(10) || 'date: ' || ts ELSE headers END,
  CASE WHEN state = 'resolved' THEN sha256(s_payload) END, CASE WHEN state = 'resolved' THEN length(s_payload) END FROM k
"""


def _digests(codec: bpe.Codec, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    coded = codec.encode(texts)
    cols = [pa.array([len(x) for x in coded], pa.int64()), pa.array([sha(codec.decimal(x)) for x in coded]), pa.array([sha(codec.decode(x)) for x in coded])]
    return pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def tokenized(docs: DataFrame) -> DataFrame:
    return bpe.map_texts(docs, vocabulary(), _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))


#: Groups of reachable ids by a walk along the links; for small tables.
SQL_REACH = """r(id, c) AS (SELECT id, id FROM ids UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a), g AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)"""
SQL_OP8 = (
    r"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)), ids AS (SELECT doc_id AS id FROM documents), """
    + SQL_REACH
    + " SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept FROM documents d JOIN g ON g.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"
)


def op8_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


SQL_OP9 = (
    """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND n > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a), ids AS (SELECT vec_id AS id FROM embeddings), """
    + SQL_REACH
    + " SELECT v.vec_id, coalesce(d.n_links, 0) AS n_links, g.component_id, v.vec_id = g.component_id AS kept FROM v JOIN g ON g.id = v.vec_id LEFT JOIN d ON d.a = v.vec_id"
)


def op9_collision_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_lsh.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft_mixing.mix(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), WEIGHTS)


def remainder(of: int) -> F.Column:
    """The remainder of a document's checksum; null without a doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of))


BATCHES = 12


def op11_first_seen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = F.floor(remainder(64) * BATCHES / 64)
    docs, lines = first_seen.strip_seen_lines(table(spark, sf_dir, "documents"), batch, BATCHES)
    a = docs.select(F.lit("doc").alias("row_kind"), F.col("doc_id").cast("string").alias("row_id"), "batch", "n_all", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
    return a.union(lines.select(F.lit("line"), "key_sha256", "batch", "n_docs", "n_removed", F.lit(None).cast("string")))


SQL_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({x}) + 1), lambda i: ascii({x}[i])::BIGINT)),
    lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)), lambda t, j: xor(t >> 1, CASE WHEN t & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT)"""
SQL_OP11 = f"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, CAST(floor(12 * (coalesce({SQL_CRC32.format(x="CAST(doc_id AS VARCHAR)")}, 0) % 64) / 64) AS INTEGER) AS batch FROM documents),
s AS (SELECT *, string_split(text, chr(10)) AS ls FROM b),
l AS (SELECT r, batch, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM s),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, batch, count(DISTINCT r) AS n FROM k WHERE key <> '' GROUP BY ALL),
e AS (SELECT key, batch, sum(n) OVER (PARTITION BY key ORDER BY batch) - n AS earlier, sum(n) OVER (PARTITION BY key) AS total FROM d),
m AS (SELECT k.*, coalesce(e.earlier >= 3, false) AS gone, e.total FROM k LEFT JOIN e ON e.key = k.key AND e.batch = k.batch),
t AS (SELECT r, count(*) AS n_all, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept FROM m GROUP BY r)
SELECT 'doc' AS row_kind, CAST(b.doc_id AS VARCHAR) AS row_id, b.batch, t.n_all, t.n_removed, t.kept AS kept_sha256 FROM b JOIN t USING (r)
UNION ALL SELECT 'line', sha256(key), min(batch), CAST(max(total) AS BIGINT), count(*), NULL FROM m WHERE gone GROUP BY key
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def _sql_nearest(book: str) -> str:
    return f"""SELECT p.vec_id, p.part, p.v, min({{'d': list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'i': c.i}}) AS m FROM p JOIN {book} c ON c.part = p.part GROUP BY ALL"""


def _sql_means(book: str, nearest: str) -> str:
    return f"""SELECT c.part, c.i, coalesce(m.v, c.v) AS v FROM {book} c LEFT JOIN (
    SELECT part, i, list(((s - ((s % n) + n) % n) // n) ORDER BY pos) AS v FROM (
      SELECT part, m.i AS i, pos, CAST(sum(v[pos]) AS BIGINT) AS s, count(*) AS n FROM {nearest}, range(1, 5) t(pos) GROUP BY ALL) GROUP BY part, i) m ON m.part = c.part AND m.i = c.i"""


#: For vectors of 64 components, as the given tables hold.
SQL_OP12 = f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, list_slice(e, part * 4 + 1, part * 4 + 4) AS v FROM k, range(16) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS i, v FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
a0 AS MATERIALIZED ({_sql_nearest("c0")}), c1 AS MATERIALIZED ({_sql_means("c0", "a0")}),
a1 AS MATERIALIZED ({_sql_nearest("c1")}), c2 AS MATERIALIZED ({_sql_means("c1", "a1")}),
a2 AS MATERIALIZED ({_sql_nearest("c2")}),
r AS (SELECT vec_id, string_agg(format('{{:02x}}', m.i), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(v[pos] AS VARCHAR), ',' ORDER BY part, i, pos)) AS h FROM c2, range(1, 5) t(pos))
SELECT k.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.h AS codebooks_sha256 FROM k JOIN r ON r.vec_id = k.vec_id, h
"""


def op13_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interpolation.score(table(spark, sf_dir, "documents"), remainder(7) != 2)
    return out.select("doc_id", F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict:
    found = [op1_perplexity, op2_attention_mil, op3_langid_cnn, op4_chat_events, op5_substring_dedup, op6_warc_revisit, op7_byte_bpe, op8_setsketch, op9_collision_lsh, op10_soft_mixing, op11_first_seen_lines, op12_vector_codes, op13_deleted_interpolation]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_events": SQL_OP4, "op6_warc_revisit": SQL_OP6, "op8_setsketch": SQL_OP8, "op9_collision_lsh": SQL_OP9, "op11_first_seen_lines": SQL_OP11, "op12_vector_codes": SQL_OP12}
