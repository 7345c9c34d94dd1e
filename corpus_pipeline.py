"""A corpus pipeline over ``documents``: each stage calls one operator of lotlens.llm.

In every stage: a null text counts as an empty one; rows with a null doc_id are no duplicates' rivals and stay unless their text
is an exact copy; rows that repeat a doc_id are judged each by its own text, and near-duplicates drop an identifier with all its rows;
whole texts of any length are read; columns other than those of ``documents`` are dropped, so no name clashes; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.llm import queries
from lotlens.llm.common import discard, materialise, table
from lotlens.llm.exact_dedup import tree_exact_dedup
from lotlens.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Empty texts have no evidence against them and stay; repeated rows fare alike."""
    return queries.toxicity(spark, docs, sf_dir).where(F.col("score") < queries.TOXIC_AT).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null and empty ones are equal), the row with the largest doc_id stays, once; null identifiers only among themselves."""
    return tree_exact_dedup(docs, keep="max").where("kept").select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word shingles, the smallest doc_id stays.

    Texts without words are alike. Rows with a null doc_id are not compared and stay.
    """
    dropped = near_duplicates(docs).where("doc_id != component_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mix of as many tokens, whose source, language and topic shares are evened out; a document has a row for each of its copies.

    Null sources and languages are categories; an empty text weighs one token; rows of one doc_id are drawn together.
    """
    return queries.mixed(docs).where("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: number and digest of its ids, digest of what they decode to, and how often it occurs.

    Empty texts have no tokens; rows that agree in identifier and tokens are counted together.
    """
    rows = queries.bpe_digests(docs.select("doc_id", "text"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing", mixing),
    ("byte-level BPE", bpe),
]

#: A trained classifier and fingerprints are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, "stage")
            discard(before)
    return docs
