"""Corpus pipeline over `documents`: toxicity, near copies, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm import common as C
from factlens.llm import jaccard, packing, substrings, templates, toxicity


# Stages keep all columns of documents, of any name: beside doc_id and text they travel in one struct, so an operator's own
# columns (score, contaminated, ...) replace none of them.


def _boxed(docs: DataFrame) -> DataFrame:
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(F.lit(0).alias("none"), *others).alias("row"), "doc_id", "text")


def _unboxed(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    return df.select(*[changed[c].alias(c) if c in changed else F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the threshold; the model is learned from the labels that are not held out.

    A null or empty text scores as one without hits, so it stays; repeated rows fare alike; an empty table, or one without labels
    of both kinds, loses nothing.
    """
    model = toxicity.learn(spark, docs, C.table(spark, sf_dir, "labels"))
    return _unboxed(toxicity.score_toxicity(_boxed(docs), model).filter(F.col("score") < toxicity.THRESHOLD), docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: that of the smallest id.

    A document without an id stays only in a group without ids, and of several texts of that id, or without one, the one of
    the least hash stays. Rows of equal id and text are one document, of which one row stays, those with a null or empty text
    too; such texts are copies of nothing else. An empty table stays empty.
    """
    found = jaccard.components_of(spark, docs, k=5, percent=80).select(F.col("doc_id").isNull().alias("none"), C.id_key().alias("idk"), "tkey", "root")
    least = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("none", "idk", "tkey")).alias("kept")).select("kept.*")
    kept = least.unionByName(found.filter("root IS NULL").select("none", "idk", "tkey").distinct())
    keyed = _boxed(docs).select("*", F.col("doc_id").isNull().alias("none"), C.id_key().alias("idk"), F.xxhash64("text").alias("tkey"))
    return _unboxed(keyed.join(kept, ["none", "idk", "tkey"], "left_semi").dropDuplicates(["none", "idk", "tkey"]), docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their words in windows of 20 that start earlier in the corpus; emptied documents go.

    A document that loses nothing keeps its text as it is, a null or empty one too. n_chars, where there is such a column, counts the
    text that is left. Repeated rows lose the same; an empty table stays empty.
    """
    kept = substrings.dedup_substrings(spark, _boxed(docs), size=20).filter("n_removed = 0 OR n_removed < n_words")
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    return _unboxed(kept, docs.columns, **changed)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, nor one with other numbers, names or units; null and empty texts hold none."""
    found = templates.decontaminate(_boxed(docs), C.table(spark, sf_dir, "benchmark"))
    return _unboxed(found.filter("NOT contaminated"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in near-equal windows of at most 2048 ids; a null or empty text is its end id alone."""
    return packing.pack(spark, docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", one_of_near_copies),
    ("substrings", without_repeated_passages),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: Learned scores and tokenizer ids cannot be expressed in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again by the next.

    A stage's table is removed when the next is written. The last one's, and the operators' own, stay until
    factlens.llm.common.clear_scratch is called, once the result is written.
    """
    scratch, last = C.Scratch(spark, "pipeline"), None
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
