"""The corpus pipeline: five stages from raw documents to token ids, each on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, mixing, ngram_join, sentencepiece_scan, suffix_dedup
from tessera.llm.common import documents, fewer, text_key, written

#: A document is rejected if it has no letter, or if no language has more than this share of the probability.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; lang is the predicted one. Those without a letter, null and empty texts among them, go; repeated rows are judged alike."""
    judged = language_id.identify_rows(docs, language_id.learn(docs))
    kept = judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return fewer(kept.select(*[F.col(f"row.`{c}`") if c != "lang" else F.col("lang_pred").alias("lang") for c in docs.columns]), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of texts with alike sets of five-word shingles; all without words.

    Of rows with the same doc_id and text one stays, that of the least hash of all its columns, which stay whatever their names and types.
    """
    found = ngram_join.jaccard_components(docs, 5, 4, 5)
    ident = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("tk"))
    kinds = found.groupBy("doc_id", "tk").agg(F.count("*").alias("n"), F.first("class").alias("class"), F.max("n_shingles").alias("n_shingles"))
    groups = kinds.filter("n_shingles > 0").groupBy("class").agg(F.min_by(F.struct("doc_id", "tk", "n"), ident).alias("first")).select("first.*")
    kept = groups.unionByName(kinds.filter("n_shingles = 0").select("doc_id", "tk", F.lit(1).cast("long").alias("n")))
    kept = written(kept.select(F.col("doc_id").alias("id"), "tk", (F.col("n") > 1).alias("several")), "kept")
    rows = docs.select(F.struct("*").alias("row"), text_key().alias("tk"))
    of = lambda k: rows.join(k.select("id", F.col("tk").alias("key")), (F.col("tk") == F.col("key")) & F.col("row.doc_id").eqNullSafe(F.col("id")))
    repeated = of(kept.filter("several")).groupBy("id", "key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return fewer(of(kept.filter("not several")).select("row.*").unionByName(repeated.select("row.*")), docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of suffix_dedup.LENGTH bytes or more that repeat; documents of which nothing but spaces is left go, those without text before stay."""
    cut = suffix_dedup.cut_rows(docs).filter("not emptied")
    new = {"text": F.col("cut").alias("text"), "n_chars": F.length("cut").cast("long").alias("n_chars")}
    return fewer(cut.select(*[new.get(c, F.col(f"row.`{c}`")) for c in docs.columns]), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample whose tokens have the target shares of sources, languages and topics; a document that is too scarce for its share is repeated. Null sources and languages are values of their own."""
    chosen = mixing.mix_sources(docs).filter("chosen")
    return fewer(chosen.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*"), docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, source, ids, n_tokens; the text is what the ids decode to, null for a null text."""
    done = sentencepiece_scan.encode(docs)
    return fewer(done.select("row.doc_id", F.col("decoded").alias("text"), "row.lang", "row.source", "ids", "n_tokens"), docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", remove_repeats),
    ("mixing", mix),
    ("sentencepiece", tokenise),
]

#: Languages are identified by a model that is trained on the way, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
