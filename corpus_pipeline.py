"""The corpus pipeline: language, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last adds a document's shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import decontam, jaccard, langid, mixing, sharding
from lacuna.llm.common import meet, settle, table

#: Below this posterior probability a text's language counts as not identified.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language: null or empty texts, texts without letters, and texts that no language clearly claims."""
    judged = langid.predict(docs.withColumns({f"__{c}": F.col(c) for c in ("lang_pred", "score") if c in docs.columns}), langid.fit(docs))
    kept = judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return kept.select(*[F.col(f"`__{c}`").alias(c) if c in ("lang_pred", "score") else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of documents that hang together by Jaccard similarities of 0.8 or more of their sets of five-word shingles: the one of the
    smallest doc_id (a null one last), and of texts and rows of the same doc_id any one. Documents without words are in no group and stay. A row goes for its own
    text, never for its doc_id, which may be null or stand in other rows."""
    found = settle(jaccard.link(docs, width=5, num=80, den=100).filter("cluster is not null").select("key", "th", "cluster"), "groups")
    place = F.struct(F.col("key").isNull().alias("none"), "key", "th")
    first = found.groupBy("cluster").agg(F.min(place).alias("first"), F.count("*").alias("k")).filter("k > 1").select("cluster", "first")
    many = settle(meet(found, first, "cluster").groupBy("key", "th").agg(F.first(place == F.col("first")).alias("stays"), F.count("*").alias("k")), "copies")
    drop = settle(many.filter("not stays or k > 1").select(F.col("key").alias("__key"), F.col("th").alias("__th"), F.col("stays").alias("__stays")), "dropped")
    few = F.broadcast if drop.count() <= jaccard.BROADCAST_ROWS else (lambda x: x)
    same = F.col("doc_id").eqNullSafe(F.col("__key")) & (F.xxhash64("text") == F.col("__th"))
    repeated = drop.filter("__stays")
    if not repeated.take(1):
        return docs.join(few(drop), same, "left_anti")
    once = docs.join(few(repeated), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(few(drop), same, "left_anti").unionByName(once)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to the sources' target weights: documents repeated, cut to the words taken, or left out."""
    return mixing.mixed(docs, length="n_chars" if "n_chars" in docs.columns else None)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its shard."""
    return sharding.shard(docs)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("mixing", mix), ("sharding", shards)]
#: The mix draws at random, which SQL cannot repeat; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
