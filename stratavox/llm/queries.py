"""Queries opN_<name> of the twelve operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm import bpe, decontaminate, forest, langid, licenses, packing, quality, runs, simhash, substring, toxicity, urlfilter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), use=quality.learnable())
    found = quality.classify(docs, model)
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), use=toxicity.learnable())
    found = toxicity.tag(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "toxic_tokens", "spans")


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "removed")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, use=langid.learnable())
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 with a table of redirects, as the given pages hold no link: every url redirects to a page of its host."""
    pages = table(spark, sf_dir, "pages")
    host = urlfilter.host_of(F.col("url"))
    moved = pages.where(host != "").select(F.col("url").alias("src"), F.concat(F.lit("https://www."), host, F.lit("/de/")).alias("dst"))
    return urlfilter.judge(pages, redirects=moved)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(runs.plant_runs(table(spark, sf_dir, "documents")))
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("")
    milli = F.expr("1000 * top.length div top.period")
    digests = [F.sha2(c, 256).alias(n) for c, n in ((lines, "runs_sha256"), (F.col("collapsed"), "collapsed_sha256"))]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", milli.alias("exponent_milli"), *digests)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded, and decoded again from the ids alone."""
    done = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), packed=True))
    return done.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_vectors": op3_vectors,
    "op4_simhash": op4_simhash,
    "op5_substring": op5_substring,
    "op6_licenses": op6_licenses,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_bpe": op12_bpe,
    "url_aliases": url_aliases,
}

ORACLE_SQL: dict[str, str] = {
    "op3_vectors": forest.oracle_sql(),
    "op9_url_filter": urlfilter.oracle_sql(),
    "url_aliases": urlfilter.oracle_sql(redirects=f"SELECT url, 'https://www.' || {urlfilter.host_sql('url')} || '/de/' FROM pages WHERE {urlfilter.host_sql('url')} <> ''"),
}
