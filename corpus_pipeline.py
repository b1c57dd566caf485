"""From documents to training sequences: toxicity, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents. run() writes
what a stage keeps as Parquet and gives it to the next. Decisions are made for rows, not for ids: a row is known by its
doc_id (null counts as a value) and a hash of its text, so texts that share an id, or have none, go each for itself, and
of rows equal in both one stays where copies go. Null and empty texts are copies of each other for stage 2, and otherwise
clean, unlike all others and packed as one end id. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, exact_dedup, minhash, packing, toxicity
from docloom.llm.common import stash, table

HASH, OWN = "__text_hash", "__own_id"


def _known(docs: DataFrame) -> DataFrame:
    return docs.withColumn(HASH, F.xxhash64("text"))


def _chosen(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Rows of docs (with HASH) that are, or are not, in rows (doc_id, HASH); the texts are shuffled once, at every size."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63))
    keys = rows.select(own.alias(OWN), HASH).distinct()
    return docs.withColumn(OWN, own).hint("merge").join(keys, [OWN, HASH], how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the model scores as toxic go; rows with a null doc_id or text are scored like any other."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one row of each group of equal texts stays, also where ids or whole rows repeat."""
    known = _known(docs)
    kept = exact_dedup.exact_dedup(known, also=(HASH,)).where("kept")
    return _chosen(known, kept, "left_semi").dropDuplicates([OWN, HASH]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the row with the smallest id of each near-duplicate class stays; texts without words stay, one of rows that are equal in id and text."""
    known = _known(docs)
    kept = minhash.near_duplicates(known, also=(HASH,)).where("kept")
    return _chosen(known, kept, "left_semi").dropDuplicates([OWN, HASH]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents of which a twentieth is benchmark text go, each row by its own text."""
    known = _known(docs)
    found = decontaminate.decontaminate(known, table(spark, sf_dir, "benchmark"), also=(HASH,))
    return _chosen(known, found.where("contaminated"), "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of the documents, packed into sequences of 4096 tokens; rows that repeat an id are packed each for itself."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: Trained models, signatures and a genetic algorithm have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
