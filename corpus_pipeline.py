"""A training corpus from raw documents.

Five stages, each over all that its predecessor kept, each written as Parquet
and read again by the next: toxic documents go; of each group of near copies
one document stays; personal data is masked; sources are mixed to their target
weights (whole documents, repeated by epochs); texts are encoded and checked
by decoding. All but the last return the columns of ``documents``. Very long
texts, repeated rows and empty tables pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, order_minhash, pii, toxicity
from tessera.llm.common import read, staged
from tessera.llm.queries import TOKENIZER
from tessera.session import apply_defaults


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3, from which op3 calls them
    toxic; a document without text has no hit and stays."""
    apply_defaults(spark)
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels"), "toxic", folds=4, held_out=2)
    return toxicity.without_toxic(docs, lexicon, 0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near copies; documents
    without a text all stay, as does an empty table."""
    apply_defaults(spark)
    return order_minhash.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; a null text
    stays null. Terms need two documents to prove that they disclose."""
    apply_defaults(spark)
    return pii.sanitize(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its target, in whole copies; texts
    without a word are never taken, ties go by key, size and text digest."""
    apply_defaults(spark)
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (packed) and whether they decode to
    the text; a null text is the empty text.

    Encoded rows are staged: in one job, each task would have a Python worker
    to encode and another to decode, and the executors keep both for all that
    follows."""
    apply_defaults(spark)
    encoded = staged(bpe.encode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER), "encoded")
    decoded = bpe.decode(encoded, TOKENIZER)
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


# No stage but the mixing is expressible in SQL; tests compare with plain Python.
ORACLE_SQL = None
