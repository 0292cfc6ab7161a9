"""The registered queries of this package and the DuckDB SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import anisotropic_ann, dart_minhash, exponion, language_id, license_scan, line_dedup, lz_fingerprint, mixing, ngram_join, packing, secret_scan, token_counts, whitening
from .common import cut, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select("doc_id", *map(of, secret_scan.BASE_KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def two_versions(docs: DataFrame) -> DataFrame:
    """(path, text): every document, and a later version of the English ones with a line more."""
    later = F.concat("text", F.lit("\ntoken = "), F.substring(F.md5("text"), 1, 20))
    path = lambda n: F.struct("doc_id", F.lit(n).alias("version")).alias("path")
    return docs.select(path(1), "text").unionByName(docs.where("lang = 'en'").select(path(2), later.alias("text")))


def secret_ledger_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules scan the documents; then all rules scan all versions, of which only unseen blobs and rules are read."""
    versions = two_versions(table(spark, sf_dir, "documents"))
    base = tuple(r for r in secret_scan.RULES if r.kind in secret_scan.BASE_KINDS)
    known = cut(secret_scan.scan_new(versions.where("path.version = 1"), rules=base))
    ledger = cut(secret_scan.merge_ledger(known, cut(secret_scan.scan_new(versions, known))))
    found = secret_scan.findings(versions, ledger, key="path")
    return found.select("path.doc_id", F.col("path.version").cast("long").alias("version"), F.size("spans").cast("long").alias("n_spans"), _joined(F.col("spans")).alias("spans"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op8_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    # a licence is named before a mere reservation of rights, however near the latter
    best = F.array_max(F.transform("matches", lambda m: F.struct((m["license"] != "proprietary").alias("named"), m["dice"].alias("dice"), (-m["line"]).alias("line"), m["license"].alias("license"))))
    return found.select(
        "doc_id", best["license"].alias("license"), best["dice"].alias("dice"), F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.cluster(table(spark, sf_dir, "embeddings")).drop("scans")


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op13_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # null where a deviation exceeds a long; the operator gives all its digits
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_dart_minhash": op1_dart_minhash,
    "op2_pack_windows": op2_pack_windows,
    "op3_secret_scan": op3_secret_scan,
    "secret_ledger_rescan": secret_ledger_rescan,
    "op4_mix_sources": op4_mix_sources,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_anisotropic_ann": op7_anisotropic_ann,
    "op8_lz_fingerprint": op8_lz_fingerprint,
    "op9_license_scan": op9_license_scan,
    "op10_language_id": op10_language_id,
    "op11_exponion_clusters": op11_exponion_clusters,
    "op12_ngram_join": op12_ngram_join,
    "op13_exact_whitening": op13_exact_whitening,
}

ORACLES: dict[str, str] = {
    "op4_mix_sources": mixing.ORACLE_SQL,
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op11_exponion_clusters": exponion.oracle_sql(),
    "op12_ngram_join": ngram_join.ORACLE_SQL,
}
