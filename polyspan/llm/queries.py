"""The corpus operators as registered queries over the given tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    from .bpe import read_ranks

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids again; digests of both."""
    from . import bpe

    ranks, pattern = vocabulary()
    tokens = bpe.encode(_table(spark, sf_dir, "documents"), ranks, pattern, decoded=True)
    return tokens.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    from . import simhash

    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a window of a benchmark item."""
    from . import decontam

    found = decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    items = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; `source` stands for the owner, `source` and `lang` for the repository."""
    from . import secrets

    found = secrets.scan(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = secrets.listed(F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE)))
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"), live.alias("n_live"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_owners"])), F.lit(0)).alias("most_owners"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_repositories"])), F.lit(0)).alias("most_repositories"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    from . import warc

    folder = common.new_shared_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    found = warc.read(spark, folder)
    return found.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    from . import license_scan

    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    starts = F.transform("phrases", lambda p: p["start"].cast("long"))
    base = F.array_distinct(F.transform("phrases", lambda p: p["label"]))
    more = F.array_distinct(F.transform("matches", lambda m: m["label"]))
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.array_union(base, more)).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document, learnt from the rated ones."""
    from . import quality

    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier documents hold."""
    from . import substring

    found = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as audio and read back, with features."""
    from . import media

    folder = common.new_shared_path(spark, "tensors")
    found = media.with_tensors(media.features(media.store(_table(spark, sf_dir, "documents")), folder), folder, digest_only=True)
    bands = F.array_join(F.transform("mel_mean", lambda v: F.format_number(v, 2)), " ")
    active = F.aggregate("spans", F.lit(0.0), lambda n, s: n + s["end"] - s["start"])
    feature = F.concat_ws("|", "n_frames", F.size("spans"), F.format_number(active, 2), bands, "n_tensors", "tensors_sha256")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of held-out rows are not learnt."""
    from . import toxicity

    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    from . import spelling

    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document by the hierarchical Pitman-Yor model, and by counts of words."""
    from . import pitman_yor

    found = pitman_yor.score(_table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two public tokenizers, of every document."""
    import public_tokenizers

    from . import align

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = align.align(_table(spark, sf_dir, "documents"), *paths, public_tokenizers.PATTERN, digest_only=True)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_substrings": op5_substrings,
    "op6_audio": op6_audio,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_warc": op9_warc,
    "op10_licenses": op10_licenses,
    "op11_spelling": op11_spelling,
    "op12_language_model": op12_language_model,
    "op13_alignment": op13_alignment,
}
