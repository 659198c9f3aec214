"""Documents to training sequences: language, quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, and any further columns untouched, whatever their names. Nulls, empty and very
long texts, ties, repeated rows and empty tables are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, packing, quality, secrets, simhash
from corpusloom.llm.common import drop_staged, read, stage_table, staged_so_far

#: Near-duplicates: words in a shingle, and the Jaccard similarity that links two texts.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns under names that no operator makes, and the new name of each."""
    at = {c: f"c_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()]), at


def restored(rows: DataFrame, at: dict[str, str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns under their own names and in their own order, with the changed ones in place."""
    return rows.select(*[(changed or {}).get(c, F.col(n)).alias(c) for c, n in at.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the model knows; those that are far from all go. The model learns from the labelled rows outside the held-out fold."""
    model = langid.train(docs.filter(~langid.held_out("doc_id")), "doc_id", "text", "lang")
    rows, at = renamed(docs)
    found = langid.identify(rows, model, at["text"])
    return restored(found.filter(~F.col("rejected") & (F.col("lang_pred") != langid.UNKNOWN)), at)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules on words, repeated windows and lines. Null and empty texts go, texts are judged whole, repeated rows alike."""
    rows, at = renamed(docs)
    return restored(quality.judge(rows, at["text"]).filter("kept"), at)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, linked by 5-word shingles with a Jaccard similarity of 0.8 or more, the document with the smallest id; of rows that share that id, one. Documents without an id come after all others and stay if their group has no other."""
    rows, at = renamed(docs)
    # far above any id, and the same for equal texts
    stand_in = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce(at["text"], F.lit(""))), F.lit(1 << 61))
    keyed = rows.withColumn("row_key", F.coalesce(at["doc_id"], stand_in))
    found = simhash.near_duplicates(keyed, "row_key", at["text"], width=SHINGLE_WORDS, similarity=SIMILARITY)
    first = stage_table(found.filter(F.col("row_key") == F.col("component")).select("row_key").distinct(), "firsts")
    kept = keyed.join(first, "row_key")
    # rows of one id are rare; of those the first in the order of their columns stays
    one = kept.groupBy("row_key").agg(F.min(F.struct(*at.values())).alias("first_row"))
    return restored(one.select("first_row.*"), at)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; credentials that look live and belong to few owners are replaced in their texts, copied examples stay. Null texts stay null."""
    rows, at = renamed(docs)
    found = secrets.scan(rows, at["text"], at["source"], at["source"]).withColumn("live", F.filter("secrets", lambda s: s["live"]))
    found = found.withColumn("clean", secrets.redact(F.col(at["text"]), F.col("live")))
    n_chars = F.when(F.size("live") > 0, F.length("clean")).otherwise(F.col(at["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return restored(found, at, {"text": F.col("clean"), "n_chars": n_chars})


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens. Null and empty texts are their separator alone; longer texts are cut; other columns than id and text are ignored."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scans),
    ("packing", pack),
]

#: Language models, fingerprints and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage and the one before have written is deleted once its own result stands."""
    docs, used = read(spark, sf_dir, "documents"), staged_so_far()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage_table(docs, f"pipeline-{name}")
            drop_staged(spark, used, staged_so_far() - 1)
            used = staged_so_far() - 1
    return docs
