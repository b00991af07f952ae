"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, embedding_dedup, fill_middle, hard_negatives, language_id, license_scan, line_dedup, minhash_dedup, quality_classifier, sentencepiece_bpe, shards, url_filter
from .spark_tools import shared_dir

#: Place of the vocabulary files; the same on all machines of a cluster.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"), least=0.93)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def _held_out(column: str, parts: int, which: int) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == which, F.lit(False))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").where(~_held_out("doc_id", 3, 1))
    model = quality_classifier.fit(docs, labels)
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", _held_out("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


#: The rules that the contract of op4 gives.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry the document whose id ends their path; its quality label marks the path."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    path = url_filter.path_of(F.col("url"))
    doc = F.expr("try_cast(doc as long)")
    marked = pages.select(url_filter.host_of(F.col("url")).alias("host"), path.alias("path"), F.regexp_extract(path, r"/(\d+)(?:\.\w+)?/?$", 1).alias("doc")).distinct().withColumn("doc_id", doc)
    labels = _read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)).alias("bad"))
    labelled = marked.join(labels, "doc_id").select("host", "path", "bad")
    out = url_filter.filter_urls(pages, url_filter.rule_table(spark, URL_RULES), labelled)
    return out.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", F.round("coverage", 4).alias("coverage"), F.round("slot_consistency", 4).alias("slot_consistency"), "verbatim")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in eight runs, are compacted, and each row tells the shard that holds it."""
    docs = _read(spark, sf_dir, "documents").withColumn("__arrival", F.pmod(F.xxhash64("doc_id"), F.lit(8)).cast("int"))
    store = shards.ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    store.append_arrivals(docs, "__arrival")
    store.compact()
    store.vacuum(0)  # the store is this run's own
    return shards.placements(store, "doc_id").select("doc_id", "shard", "tier", "version")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    learned = language_id.prototypes(docs.where(~_held_out("doc_id", 4, 2)))
    found = language_id.identify(docs, learned)
    return found.select("doc_id", _held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's directory is its source, then its language."""
    docs = _read(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return license_scan.scan_licenses(docs.select("doc_id", "text", "path"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    both = byte_bpe.encode(docs, TOKENIZER, PATTERN, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines, how many went, and the hash of the text that stays."""
    kept = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars_kept"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    hashes = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = sentencepiece_bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), PIECES, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in steps of 1/256; the label of every seventh is made a wrong one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.when(F.abs(256 * x.cast("double")) < float("inf"), F.floor(256 * x.cast("double")).cast("double")))
    quantised = _read(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), whole.alias("embedding"))
    return hard_negatives.mine(quantised, F.col("id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_minhash_dedup, op3_quality_classifier, op4_url_filter, op5_decontaminate, op6_sharding, op7_language_id, op8_license_scan, op9_byte_bpe, op10_line_dedup, op11_fill_middle, op12_sentencepiece, op13_hard_negatives)}

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_REACH = "reach AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)"

#: The other operators' models, shards, tokens and templates are no SQL.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": f"""
WITH RECURSIVE nodes AS (SELECT DISTINCT vec_id AS id FROM embeddings WHERE vec_id IS NOT NULL),
good AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
sized AS (SELECT *, sqrt(list_inner_product(e, e)) AS size FROM good),
links AS (SELECT x.id AS a, y.id AS b FROM sized x JOIN sized y ON x.label = y.label AND x.id <> y.id WHERE x.size > 0 AND y.size > 0 AND list_inner_product(x.e, y.e) / (x.size * y.size) >= 0.93),
{_REACH}, degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a), least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM least LEFT JOIN degree USING (id)""",
    "op2_minhash_dedup": f"""
WITH RECURSIVE nodes AS (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL),
worded AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
sets AS (SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(list_slice(w, i, i + 4), ' ') for i in range(1, len(w) - 3)] END) AS s FROM worded),
sized AS (SELECT id, len(s) AS n FROM sets), items AS (SELECT id, unnest(s) AS item FROM sets),
shared_items AS (SELECT x.id AS a, y.id AS b, count(*) AS same FROM items x JOIN items y ON x.item = y.item AND x.id <> y.id GROUP BY ALL),
links AS (SELECT a, b FROM shared_items JOIN sized p ON p.id = a JOIN sized q ON q.id = b WHERE 100 * same >= 85 * (p.n + q.n - same)),
{_REACH}, least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT id AS doc_id, n::BIGINT AS n_shingles, component_id, id = component_id AS kept FROM least JOIN sized USING (id)""",
    "op11_fill_middle": """
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT *, len(t) AS n, [('0x' || substr(h, 1 + 8 * i, 8))::BIGINT for i in range(4)] AS r FROM cut),
ranked AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:n], '') AS s FROM ranked)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts""",
    "op13_hard_negatives": """
WITH rows AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0),
scored AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM rows a JOIN rows b ON a.id % 50 = 0 AND a.id <> b.id),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
met AS (SELECT p.anchor, p.id AS positive_id, p.score AS positive_score, s.id, s.score, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor AS anchor_id, positive_id, rank::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score FROM met WHERE rank <= 3""",
}
