"""The corpus pipeline: stages of training-data preparation, each on the rows that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, but the last, which returns the packing.
Further columns are kept whatever their names, rows that a stage keeps keep their order of columns and types, and an empty
table gives an empty result in every stage.  Null and repeated doc_ids, null, empty and very long texts are rows like others;
what each stage does with them is said there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairspark.llm._spark import fresh, materialise, table
from fairspark.llm.jaccard_join import jaccard_join
from fairspark.llm.mixing import domain_of_source, mix
from fairspark.llm.packing import best_fit_packing
from fairspark.llm.pii import sanitise
from fairspark.llm.quality_gam import keep_good
from fairspark.llm.queries import MIX_WEIGHTS, tokenizer_path

#: Words of a shingle and the similarity of near duplicates; the share of all tokens that the mixture has.
SHINGLE, SIMILAR_PERCENT, MIX_SHARE = 5, 80, 0.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labels, accepts: those that score 0.3 or more.

    A null or empty text is scored by features of 0; rows of a repeated doc_id are scored each by their own text, and learned
    from each where it has a label; a doc_id without a label, or null, is scored too.  Without labels all documents stay.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return keep_good(docs, labels, threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of smallest doc_id; rows without doc_id come after all others.

    Texts without words are nobody's duplicates and stay.  Rows are linked by their own texts, also rows that share a doc_id: of
    rows equal in doc_id and text one stays, of those with one doc_id and unlike texts all; ties go to the smaller text.
    """
    (key,) = fresh(docs, "_row_key")
    named = F.col("doc_id").cast("long")
    rows, distinct, most = docs.agg(F.count(F.lit(1)), F.count_distinct(named), F.max(named)).first()
    if rows == distinct:
        keyed = docs.withColumn(key, named)
    else:
        # Further rows of a doc_id, and rows without, are numbered after all; written down, as the numbers depend on the run.
        after = F.lit(min(max(most or 0, 0), 1 << 62) + 1) + F.monotonically_increasing_id()
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) == 1
        keyed = docs.where("doc_id IS NOT NULL").withColumn(key, F.when(first, named)).union(docs.where("doc_id IS NULL").withColumn(key, F.lit(None).cast("long")))
        keyed = materialise(keyed.withColumn(key, F.coalesce(key, after)), "pipeline-keyed")
    found = jaccard_join(keyed.select(F.col(key).alias("doc_id"), "text"), n=SHINGLE, percent=SIMILAR_PERCENT)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    # A sort-merge join at every size: what goes grows with the corpus.
    return keyed.join(gone.hint("merge"), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what discloses it replaced in text.

    A null text stays null; equal texts are rewritten alike; n_chars, where there is one, follows the text.
    """
    return sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's prefix of one seeded epoch, so that no document comes twice.

    A null lang or source is a leaf of its own; rows of a repeated doc_id have one place in the epoch and are taken or
    left together; documents without words weigh nothing, and go with a leaf that has no tokens at all.
    """
    return mix(docs, domain_of_source(5), budget_share=MIX_SHARE, epochs=1, seed="7", weights=MIX_WEIGHTS, figures=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 4096; a null text is empty and packed as its end id; repeated rows are packed each."""
    return best_fit_packing(docs, tokenizer_path(), size=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]

#: SQL can't express the trained classifier, the disclosing terms or the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
