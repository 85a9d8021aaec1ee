"""Documents to training mix: language, exact copies, near copies, benchmark passages, source weights.

Each stage works on all rows that the one before kept, written as Parquet in the shared folder and read again. Rows with a
null or empty text go at the first stage, as texts without letters do; of repeated rows one stays; a null id is an id like
others; further columns travel along, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.common import stage
from ledgerlens.llm.decontaminate import decontaminate
from ledgerlens.llm.exact_dedup import exact_dedup
from ledgerlens.llm.langid import keep_identified
from ledgerlens.llm.mixing import mix_documents
from ledgerlens.llm.ngram_join import dedup_ngrams


#: Languages that stay, of those learned from the labels; None: all of them.
LANGUAGES: tuple[str, ...] | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are in none of LANGUAGES: no letters, predicted as another one, or too far from every profile."""
    return keep_identified(docs, languages=LANGUAGES)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_ngrams(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


STAGES = [("language ID", identify_language), ("exact dedup", drop_exact_copies), ("n-gram Jaccard join", drop_near_copies),
          ("benchmark decontamination", drop_contaminated), ("mixing sources", mix)]

#: Language ID and the similarity join cannot be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
