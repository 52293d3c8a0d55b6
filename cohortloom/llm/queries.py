"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, lexical, ngramjoin, oracle, packing, pieces, pii, quality, repeats, secrets, simhash, warc
from .common import fresh_path, table


def _digest(findings: str, kinds: tuple[str, ...]):
    """Derived columns of a findings array: counts, base digest, all spans."""
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    found = F.col(findings)
    of = lambda k: F.size(F.filter(found, lambda x: x["kind"] == k))
    counts = [of(k).cast("bigint").alias(f"n_{k}") for k in kinds]
    base = F.array_join(F.transform(F.filter(found, lambda x: x["base"]), name), ",")
    return [*counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform(found, name), ",").alias("spans")]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_with_ledger(table(spark, sf_dir, "documents"), fresh_path(spark, "ledger"))
    return found.select("doc_id", *_digest("findings", secrets.BASE_KINDS))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    top = F.array_max(F.transform("findings", lambda x: x["score"])).alias("top_score")
    return found.select("doc_id", *_digest("findings", pii.BASE_KINDS), top)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), sequence=2048, end_id=1)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.apply(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.apply(documents, langid.fit(documents))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"), width=4)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeat_words")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), sha(ids).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_warc_round_trip, op3_pii, op4_decontaminate, op5_pack, op6_simhash, op7_quality, op8_language, op9_ngram_join, op10_repeats, op11_lexical_search, op12_pieces)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
