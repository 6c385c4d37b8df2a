"""The corpus pipeline: language ID, quality rules, near duplicates, personal data, packing, one operator per stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
An empty table gives no rows at every stage, texts of any length are read whole, and columns other than those of
``documents`` are dropped whatever their names. Nulls in lang, source and n_chars pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import language, ngram_join, packing, pii, quality_rules
from folium.llm.common import cut, scratch, table

#: A document stays if its language is told with at least this share of the languages' likelihoods.
LEAST_SHARE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``decided (doc_id)``, columns as they were."""
    return docs.join(decided.select("doc_id").distinct(), "doc_id", "left_semi").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go, so null and empty texts do; repeated rows share their fate."""
    found = language.identify(docs, language.fit(language.sample(docs)), keep=COLUMNS)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go, null and empty texts among them; repeated rows share their fate."""
    return quality_rules.quality_rules(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that with the least id. Of rows with one id and one set of
    n-grams one stays; different texts under one id are told apart by their sets. Texts without words, and rows without
    an id, link with nothing and stay, equal ones once.

    Texts are shuffled once, by id; only rows whose id is there twice are looked at again.
    """
    classes = cut(ngram_join.ngram_join(docs, keys=True).where(F.col("doc_id") == F.col("class_id")).select("doc_id", "set_key"))
    times = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id"))
    docs = docs.select(*COLUMNS)
    single = _with(docs, classes.join(times, "doc_id", "left_anti"))
    shared = ngram_join.set_keys(docs.join(times, "doc_id", "left_semi").select(*COLUMNS))
    stay = shared.where("set_key IS NOT NULL").join(classes, ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"])
    rest = shared.where("set_key IS NULL").select(*COLUMNS).unionByName(docs.where(F.col("doc_id").isNull())).dropDuplicates(["doc_id", "text"])
    return single.unionByName(stay.select(*COLUMNS)).unionByName(rest)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are taken out of the texts; n_chars follows. Every row stays; null
    and empty texts stay as they are, and repeated rows stay equal."""
    clean = pii.sanitise(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces in sequences of at most 4096 tokens; null and empty texts are the end id alone, and every row,
    repeated ones too, is a document of its own."""
    return packing.packed(docs)


STAGES = [
    ("language ID", language_stage),
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Language ID, sanitisation and packing have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None
