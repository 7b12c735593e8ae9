"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents; each result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.llm import linedup, mixing, neardup, packing, toxicity
from caseloom.llm.common import WORD, shared_path, staged, without

#: Documents with this similarity in five-word shingles are copies as wholes: that of the stage that removes them.
SPARE = 0.8


def _columns(docs) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def toxic_documents(spark, docs, sf_dir):
    """Documents whose toxicity is at least one half go. The model is fitted on a bounded sample of the labelled documents.

    Null and empty texts have no sentence and stay; so do rows without doc_id, if their text is clean. Repeated rows are scored each. An empty
    table gives an empty result; columns of other names stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.labelled_documents(docs, labels))
    scored = toxicity.score(spark, docs, model, keep=True, names=("__toxicity", "__spans"))
    return scored.where("__toxicity < 0.5").select(*_columns(docs))


def line_duplicates(spark, docs, sf_dir):
    """Blocks of lines that an earlier document has too are deleted; a document of which nothing is left goes. n_chars follows the text.

    Documents that are near copies as wholes, by their full sets of five-word shingles, are left to the next stage. Null, empty and blank texts and
    rows without doc_id stay as they are; a row that repeats a doc_id is aligned with documents of smaller doc_id. An empty table gives an empty result.
    """
    out = linedup.delete_repeated(docs, spare=SPARE, counts=("__lines", "__deleted"))
    out = out.where((F.col("__deleted") == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*_columns(docs))


def near_duplicates(spark, docs, sf_dir):
    """Of documents linked by a similarity of 0.8 in five-word shingles, the smallest doc_id stays.

    Texts that are null or without words are linked with nothing and stay, as do rows without doc_id. Rows that repeat a doc_id are one document:
    they stay or go together. An empty table gives an empty result.
    """
    gone = staged(neardup.near_groups(docs, k=5).where("NOT kept").select("doc_id").distinct(), "near-gone")
    return without(docs, gone, "doc_id").select(*_columns(docs))


def mixed_sources(spark, docs, sf_dir):
    """Each document as often as the mix takes it.

    Texts without words are in no mix and are taken zero times; a null source is a source of its own. An empty table gives an empty result.
    """
    return mixing.repeated(docs)


def packed_sequences(spark, docs, sf_dir):
    """All documents, as pieces of sequences; a null text holds the end id alone. An empty table gives an empty result."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_documents),
    ("line_dedup", line_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: SQL can express neither the classifier nor the alignment; the operators' own tests hold them against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {}
