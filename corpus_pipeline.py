"""Documents to training sequences, in five stages that each keep what passes.

Every stage gets the rows that the one before it wrote. Texts go to Python in
small batches: the stages set that for the session, as their rows go there when
the caller writes them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passim.llm import decontaminate, jaccard, language, packing, secrets
from passim.llm.queries import tokenizer
from passim.session import broadcast_within, keep_batches_small, new_folder


# A text of so many words shows its language; where none gets this share, it goes.
SHOWING_WORDS, LEAST_SHARE = language.EVIDENCE_WORDS, 0.5
# What the number of a dropped row takes in a broadcast table.
NUMBER_BYTES = 64


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without letters, and texts whose language stays unsure.

    A text of 20 words or more is unsure if the model gives no language half of
    the probability; shorter ones stay. Without labelled rows only the first
    two rules hold.
    """
    keep_batches_small(spark)
    model = language.train_languages(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = docs.select(F.struct("*").alias("_row"), "text")
    found = language.identify_languages(named, model)
    words = F.size(F.filter(F.split("text", r"[^\p{L}\p{M}]+"), lambda w: w != ""))
    unsure = (F.col("score") < LEAST_SHARE) & (words >= SHOWING_WORDS)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & ~unsure).select("_row.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id stays; of equal ids the first stored.

    A null id comes after all others. Rows of one id that are not alike are
    rows of their own. Texts without words are no group: all such rows stay.
    """
    keep_batches_small(spark)
    path = new_folder(spark, "numbered")
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.monotonically_increasing_id().alias("number"))
    docs.select(F.struct("*").alias("row"), key.alias("key")).write.parquet(path)
    numbered = spark.read.parquet(path)
    groups = jaccard.near_duplicates(numbered.select("key", F.col("row.text").alias("text")), doc_id="key")
    kept = F.expr("n_shingles = 0 or doc_id.number = component_id.number")
    gone = new_folder(spark, "dropped")
    groups.where(~F.coalesce(kept, F.lit(False))).select("doc_id.number").write.parquet(gone)
    dropped = spark.read.parquet(gone)
    # The numbers of dropped rows are sent out if they are few, so that the texts stay where they lie.
    dropped = broadcast_within(dropped, dropped.count(), NUMBER_BYTES)
    return numbered.select("row", "key.number").join(dropped, "number", "left_anti").select("row.*")


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    keep_batches_small(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text, and counts its characters again where that was done."""
    rows = docs.select(F.struct("*").alias("_row"), "text")
    found = secrets.find_secrets(rows, secrets.train_secrets(docs))
    changed = {"text": secrets.redacted(F.col("text"), F.col("_spans")).alias("text")}
    if "n_chars" in docs.columns:
        counted = F.length(changed["text"]).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.size("_spans") > 0, counted).otherwise(F.col("_row.n_chars")).alias("n_chars")
    return found.select(*(changed.get(c, F.col(f"_row.`{c}`")) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_benchmark_texts),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

# Trained models and sequences that the packing chooses are beyond SQL; tests
# compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
