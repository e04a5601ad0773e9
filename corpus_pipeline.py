"""A corpus pipeline: language, near-duplicates, decontamination, personal data, packing.

Nulls and repeats: rows are judged one by one.  Where doc_ids are null or repeat, each row gets a key of its
own in order of (doc_id, text), nulls last, for the stages that compare rows.  Null and empty texts have no
language and go in the first stage.  Columns beside those of ``documents`` are carried through unchanged,
whatever their names; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import decontaminate, language, ngram_join, packing, pii
from tidewright.llm.store import materialize
from tidewright.operators.names import unused


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that names each row: doc_id where it does, else a number in the order of rows."""
    odd = docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty()
    key = unused("row_key", docs.columns)
    if odd:
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(sorted_rows.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts."""
    names = tuple(unused(n, docs.columns) for n in ("lang_pred", "lang_score", "lang_accepted"))
    return language.predict(docs, language.fit(docs), names).filter(F.col(names[2])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group, by doc_id and then text; of equal rows one stays."""
    rows, key = _keyed(docs)
    found = ngram_join.jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"))
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias(key))
    return rows.join(first, key, "left_semi").select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows, key = _keyed(docs)
    found = decontaminate.contaminated(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind and n_chars by the new length."""
    return pii.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a packed sequence."""
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

# No SQL form: the classifier, the tagger and the tokenizer are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
