"""The corpus pipeline: five stages from ``documents`` to packed sequences.

Each stage is an operator of tessera.llm on all rows that its predecessor kept; between stages the rows are a Parquet table.

Defined results: a null text counts as empty; a null doc_id is kept by the filtering stages; rows that repeat a doc_id and its
text are copies, of which one stays; an empty table passes through as an empty table; other columns, whatever
their names, are carried along."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, ngram_join, packing, pii, quality
from tessera.llm.common import hidden, shown, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Only the measures are stored for the fit; to store them beside the texts would cost a copy of the corpus on disk."""
    model = quality.fit(written(quality.measured(docs.select("doc_id", "text")).drop("text"), "measures"), table(spark, sf_dir, "labels"))
    rows = quality.scored(quality.measured(hidden(docs).withColumn("text", F.col("doc__text"))), model)
    return shown(rows.where(F.col("score") >= quality.CUT), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the least doc_id stays."""
    found = ngram_join.joined(docs.select("doc_id", "text"))
    first = found.where("doc_id = class_id").groupBy("node").agg(F.min(F.struct("doc_id", "x")).alias("k")).select("k.doc_id", F.col("k.x").alias("x"))
    rows = hidden(docs).withColumn("hash", F.xxhash64(F.coalesce("doc__text", F.lit(""))))
    once = rows.join(first, (F.col("doc__doc_id") == F.col("doc_id")) & (F.col("hash") == F.col("x")), "left_semi").dropDuplicates(["doc__doc_id", "hash"])
    return shown(once.unionByName(rows.where("doc__doc_id is null")), docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind in brackets. Texts are searched twice, to train and to redact, since candidates beside the texts would cost a copy of the corpus on disk."""
    weights = pii.trained(pii.candidates(docs.select("text")))
    found = pii.candidates(hidden(docs).withColumn("text", F.col("doc__text")))
    out = found.withColumn("spans", F.concat("base", pii.accepted(F.col("more"), weights)))
    out = out.withColumn("new", F.when(F.col("text").isNotNull(), pii.redacted(F.col("text"), F.col("spans"))))
    return shown(out, docs, text=F.col("new"), n_chars=F.length("new"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shards of the mix, block by block: a row is what a document has in a block, so a doc_id comes once for each of its fragments and
    once more for each repeat; documents of which the mix takes nothing go. A null text has no words and goes."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as pieces in sequences of at most 2048 ids, each closed by the closing id; an empty text is that id alone."""
    return packing.packed(docs.select("doc_id", "text"), packing.default_tokenizer())


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the stages (fits, pseudorandom permutations, a greedy plan); tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
