"""A corpus pipeline of five stages over the operators in nearspark.llm.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; each works on all that
its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearspark.llm import common, dedup, jaccard, mixing, pieces, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels of the given documents, doesn't reject.

    Null and empty texts get the bias's score, repeated rows one decision each and the same; without labels all stay.
    """
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    # the operator's columns get out of the way of the documents' own
    plain = docs.toDF(*[f"doc_{c}" for c in docs.columns])
    kept = toxicity.score(plain, model, text_col="doc_text").where("predicted = 0")
    return kept.select(*[F.col(f"`doc_{c}`").alias(c) for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (null: empty), the longest, then of smallest id; of rows repeated with one id and text one stays."""
    return dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each component of near copies; texts without words and rows with a null id stay."""
    return jaccard.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as the mix takes them: some left out, some twice. Texts without words (size 0) cost nothing and are taken as their source's budget has it."""
    return mixing.Plan(docs).mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids (ids) and how many they are (n_ids); null and empty texts have none, repeated rows are coded each.

    Columns of these two names that the documents bring along are replaced.
    """
    import public_tokenizers

    coded = pieces.encode(docs.drop("ids", "n_ids"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.withColumn("n_ids", F.size("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The first and last stage can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stage(docs, f"pipeline-{name}")
    return docs
