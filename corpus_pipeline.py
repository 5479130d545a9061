"""The corpus pipeline: toxic documents go, one of each group of near copies stays, secrets are masked, sources are mixed, the rest is packed.

Every stage works on all that the one before it kept. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from senseloom.llm import mixing, nearcopies, packing, secrets, toxicity
from senseloom.llm.common import materialize, table
from senseloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity classifier rejects; it learns from the labels of the documents at hand.

    Null and empty texts get the score of a text without words; a document's verdict hangs on its text alone, so repeated rows share it and ties do not occur. Without labels of both classes the prior
    decides. An empty table gives an empty one. Columns travel under numbers, so any names may occur beside doc_id and text.
    """
    model = toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    numbered = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))
    return toxicity.score(numbered, model).where("predicted = 0").select(*numbered.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest doc_id of each group of near copies: texts whose five-word shingles are alike to 0.8 or more.

    A null id comes last; of one id's texts the smallest hash decides, and of rows alike in id and text one stays. Texts without words, null among them, are copies of each other. Very long
    texts are compared whole. An empty table gives an empty one; the row travels as a struct, so any names may occur.
    """
    return nearcopies.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets and linked credentials in the texts; all documents stay.

    Null and empty texts stay as they are, repeated rows are masked alike, overlapping finds become one mask; ``n_chars`` is counted anew where a text has changed. All other columns are passed
    through by place, whatever their names; an empty table gives an empty one.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and thin out documents to the sources' target weights.

    A null source is one of its own and comes last; texts without words weigh nothing and are repeated like their source; rows alike in id and text share one draw. A source's targets are met
    within half a document, however long. An empty table gives an empty one; the row travels as a struct, so any names may occur.
    """
    return mixing.mix(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack into sequences: one row per piece, with its token ids.

    A null or empty text is the end id alone; long texts are cut into full windows; repeated rows and copies are packed each on its own; pieces of one length are told apart by id, start and ids, and
    what is equal in all of these may change places. An empty table gives an empty one; columns other than doc_id and text end here.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack_tokens)]

#: SQL cannot express the classifier, the hashes and the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
