"""From raw documents to token ids: five stages, each one operator of ``watchloom.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and reads all that its predecessor kept, from the table
that ``run`` writes in between. All stages but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm import bpe, lines, quality, simhash, winnow
from watchloom.session import load, read_like, scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality.keep_good(docs)


def line_frequency(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; ``n_chars`` follows the text."""
    out = lines.drop_boilerplate(docs, counts=False)
    if "n_chars" in docs.columns:
        # Spelled by the text: a row whose lines all stay keeps the number it came with.
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(lines.CUT), length).otherwise(F.col("n_chars")))
    return out.drop(lines.CUT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (fingerprints of four-word runs at 4 bits) its first document stays."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return winnow.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each remaining document, with the digests of the ids and of their decoded bytes."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line frequency", line_frequency),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("token ids", token_ids),
]

#: Fingerprints and byte-pair merges have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = read_like(spark, [path], out.schema)
    return docs
