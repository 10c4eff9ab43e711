"""A corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes each stage's rows as Parquet
in the shared folder and gives them, read again, to the next one. All stages but the last keep the columns of
``documents``; the last returns the pieces of the packed sequences.

Every stage takes nulls in any column, repeated ids, extra columns of any name (they are kept as they are), and empty
tables, which give no rows. A very long text is held whole in the task that reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from boutlog.llm import decontam, line_dedup, near_dedup, packing, quality_rules
from boutlog.llm.queries import tokenizer_path
from boutlog.session import discard, prepare, stored


#: Least similarity, in hundredths, of near duplicates on word shingles; only op5_near_dedup takes 85.
NEAR_PERCENT = 80
ROW = "_boutlog_row"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their group's thresholds; the others go, null and empty texts among them."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text", "lang", "source")
    measured = stored(quality_rules.measure(own).drop("text"))  # measured once: both the thresholds and the verdicts read it
    judged = quality_rules.judge(measured, quality_rules.thresholds(measured))
    return judged.where("kept").select("_doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later runs of lines; n_chars follows the text. Null texts stay null, with n_chars as it was."""
    others = [c for c in docs.columns if c != "text"]
    own = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("_doc"))
    out = line_dedup.dedup_lines(own)
    chars = F.coalesce(F.length("text").cast("long"), F.col("_doc.n_chars"))
    named = {"text": F.col("text"), "n_chars": chars.alias("n_chars")}
    return out.select(*[named.get(c, F.col(f"_doc.`{c}`").alias(c)) for c in docs.columns])


def keyed(docs: DataFrame) -> DataFrame:
    """docs with ROW, a hash of the whole row: rows of one key are equal, whatever their ids; null differs from any value."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn(ROW, F.xxhash64(*names, *[c.isNull() for c in names]))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least doc_id, null last) of each group of near duplicates; equal rows count once."""
    rows = keyed(docs)
    label = near_dedup.near_duplicates(rows, ROW, percent=NEAR_PERCENT).select(ROW, "component_id").distinct()
    named = rows.select(ROW, "doc_id").distinct().join(label, ROW)
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", ROW)).alias("least")).select(f"least.{ROW}")
    return rows.join(kept, ROW, "left_semi").dropDuplicates([ROW]).drop(ROW)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none and stay."""
    rows = keyed(docs)
    found = decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ROW).select(ROW).distinct()
    return rows.join(found, ROW, "left_anti").drop(ROW)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; a null or empty text is the end token alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: No stage list of SQL: sketches, shingle components, alignments and token ids are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep of documents; each stage's rows are removed once the next has written its own."""
    docs, before = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before:
            discard(before)
        before = docs
    return docs
