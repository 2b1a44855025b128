"""A corpus from raw documents to packed sequences: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import decontam, langid, ngram_join, packing, secrets
from tessella.llm.common import discard, id_filter, picked, staged, table

#: Documents that score under this share of the median of their language's labelled documents are rejected, as are those without a letter. Labelled documents score 0.45 or more where their median is
#: 0.7 (sf0.01); random letters and languages that were not learned score 0.25 or less.
LEAST_LANGUAGE_SHARE = 0.5
SHINGLE, SIMILARITY = 5, (80, 100)
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def medians(scores: DataFrame) -> dict[str, float]:
    """The exact median (of two, the lower) of the scores of each language. Equal scores are counted first, so what is sorted depends on how many different ones there are."""
    counts = scores.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    of_lang = Window.partitionBy("lang")
    places = counts.select("lang", "score", F.sum("n").over(of_lang.orderBy("score")).alias("upto"), F.sum("n").over(of_lang).alias("all"))
    return {r["lang"]: r["median"] for r in places.where(2 * F.col("upto") >= F.col("all")).groupBy("lang").agg(F.min("score").alias("median")).collect()}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; profiles and least scores are learned from all documents that have a language. Labelled documents are scored twice, as staged scores would be another copy of the corpus."""
    rows = langid.labelled(docs).select("lang", "text")
    profiles = langid.learn(rows, train_rows=None)
    own = langid.identify(rows, profiles).where(F.col("lang_pred") == F.col("lang"))
    least = {lang: LEAST_LANGUAGE_SHARE * median for lang, median in medians(own.select("lang", "score")).items()}
    fits = F.lit(False)
    for lang in profiles:
        # A language whose labelled documents all look like another one's is held to the strictest score.
        fits = fits | ((F.col("lang_pred") == lang) & (F.col("score") >= least.get(lang, max(least.values(), default=1.0))))
    return langid.identify(docs, profiles).where(fits).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (by doc_id; those without one come last) of each group of similar ones. Documents are known by doc_id and text, so unrelated texts that share a doc_id both stay; of equal rows one does.
    Only texts of documents in question are shuffled."""
    key = F.xxhash64("doc_id", "text")
    groups = ngram_join.link_classes(docs.select(key.alias("id"), "text"), SHINGLE, SIMILARITY).groupBy("id").agg(F.min("component").alias("component"))
    named = docs.groupBy(key.alias("id")).agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("doc_id"))
    state = staged(named.join(groups, "id"), "pipeline-groups")
    first = state.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id"))["id"].alias("id")).select("id", F.lit(True).alias("first"))
    known = state.join(first, "id", "left").select("id", "rows", F.col("first").isNotNull().alias("stays"))
    doubtful = staged(known.where(~F.col("stays") | (F.col("rows") > 1)), "pipeline-doubtful")
    discard(state)
    marks = id_filter(doubtful.select("id"))
    keyed = docs.withColumn("__key", key)
    asked = picked(keyed, "__key", marks).join(doubtful.withColumnRenamed("id", "__key"), "__key", "left")
    plain = [F.col(f"`{n}`") for n, t in docs.dtypes if "map<" not in t]
    once = asked.where(F.col("stays")).groupBy("__key", F.hash("text").alias("__text")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("__row")).select("__row.*")
    return picked(keyed, "__key", marks, inside=False).select(docs.columns).unionByName(asked.where(F.col("rows").isNull()).select(docs.columns)).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark: 13 words in a row of an item, or a shorter item as a whole."""
    judged = decontam.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    dirty = staged(judged.where("n_hit > 0").select(F.col("doc_id").alias("__id")).distinct(), "pipeline-contaminated")
    marks = id_filter(dirty)
    kept = picked(docs, "doc_id", marks).join(dirty, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
    return picked(docs, "doc_id", marks, inside=False).unionByName(kept)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets blotted out; n_chars follows the text where it was the text's length."""
    out = secrets.redact(docs.withColumn("__size", F.char_length("text")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("n_chars") == F.col("__size"), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES = [("language_id", language_id), ("ngram_join", near_duplicates), ("decontamination", decontamination), ("secret_scans", secret_scan), ("packing", packed)]

#: Language ID, the sketches behind the join and packing have no SQL form; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
