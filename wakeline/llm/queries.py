"""Queries of these operators over whole tables, and what DuckDB can say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, jaccard, langid, licenses, packing, pii, quality, sharding, warc

#: Key of the registered query alone, so that its results can be compared; the pipeline takes the session's key or a random one.
DEMO_KEY = "wakeline demonstration key"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each conversation become a record in the layout usual for its shape; the operator brings all to one."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    convs = rows.unionByName(extra).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    text = lambda i: F.get("t", i)["content"]
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when((roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))), F.to_json(F.struct(text(1).alias("instruction"), text(2).alias("output"), text(0).alias("system"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))))
    )
    formatted = chat.format_turns(chat.to_turns(convs.select("conv_id", record.alias("record"))))
    read = formatted.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    flat = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("back").cast("bigint").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)
    net = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), net)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality.score(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 8)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10).drop("matches")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenise(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_language, op3_jaccard_join, op4_pseudonyms, op5_warc, op6_quality, op7_shards, op8_decontaminate, op9_pack, op10_licenses, pipeline)}

_CONTROL = r"<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<\|role\|>|<\|text\|>|<\|end\|>"
_ESCAPED = rf"(length({{0}}) + length({{0}}) - length(replace({{0}}, '\', '')) + len(regexp_extract_all({{0}}, '{_CONTROL}')))"

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"
_SPACED, _ALNUM = _WORDS.format(r"[^\x20\x09-\x0D]+"), _WORDS.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

ORACLE_SQL = {
    "op3_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2)) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id, CAST(coalesce(l.l, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(c) AS c FROM r GROUP BY a) c USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS l FROM e GROUP BY a) l USING (doc_id)""",
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ALNUM} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda j: list_slice(w, j, j + 9))) AS g FROM b WHERE len(w) > 0),
x AS (SELECT doc_id, k.n, unnest(range(1, len(w) - k.n + 2)) AS j, w FROM d, (SELECT DISTINCT len(g) AS n FROM i) k WHERE len(w) >= k.n),
o AS (SELECT x.doc_id, x.j, x.n, i.item_id FROM (SELECT doc_id, n, j, list_slice(w, j, j + n - 1) AS g FROM x) x JOIN i USING (g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op1_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST(-7 AS BIGINT), 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT CAST(-7 AS BIGINT), 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_ESCAPED.format('text')} + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
    ELSE 27 + {_ESCAPED.format('role')} END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
n AS (SELECT p.page_id, p.b, p.h, d.last, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(('0x' || substr(p.h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4)) & 31 AS INT), 1), '' ORDER BY i) AS digest
  FROM p JOIN d ON p.h = d.h, range(32) r(i) GROUP BY p.page_id, p.b, p.h, d.last)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM n""",
}
