"""From documents to training ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._store import SMALL_IDS, saved, scratch, shared_dir, without
from quarry.llm.decontaminate import drop_contaminated
from quarry.llm.language_id import identify, learn
from quarry.llm.line_dedup import dedup_lines
from quarry.llm.nbest import encode
from quarry.llm.ngram_join import ngram_join
from quarry.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows that go to Python at once at most: texts are long, and five stages' workers share an executor's memory. The pipeline sets the session's limit where that is larger.
BATCH_ROWS = 1000
#: Posterior probability under which a document's language counts as unknown.
LEAST_SCORE = 0.5


def _bound_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language, which replaces ``lang``; what has no letter or no clear language goes."""
    _bound_batches(spark)
    model = tokenizer("piece_bpe_32k.model")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    fitted = learn(docs, model, allowed=~F.coalesce(held_out, F.lit(False)))
    rows = identify(docs.select(*COLUMNS), model, fitted, pred="_lang", score="_score")
    return rows.filter((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SCORE)).select("doc_id", "text", F.col("_lang").alias("lang"), "source", "n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; one that consisted of nothing else goes."""
    rows = dedup_lines(docs.select(*COLUMNS), removed="_removed", lines="_lines")
    rows = rows.filter((F.col("_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def _row_key():
    """What tells rows apart where ids repeat: a hash of the id and the text."""
    return F.xxhash64("doc_id", "text")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, of equal ids that with the smallest row key. Rows without an id stay; of rows equal in id and text one does."""
    _bound_batches(spark)
    docs = docs.select(*COLUMNS)
    twice = saved(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
    if not (n := twice.count()):
        groups = saved(ngram_join(docs).components(), "groups")
        return without(docs, groups.filter("component_id < doc_id").select("doc_id").distinct(), "doc_id")
    # ids repeat: the join and what it drops go by row
    some = docs.join(F.broadcast(twice) if n <= SMALL_IDS else twice, "doc_id", "left_semi")
    some = some.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r")).select("doc_id", "text", "r.*")
    rows = without(docs, twice, "doc_id").unionByName(some).withColumn("_row", F.when(F.col("doc_id").isNotNull(), _row_key()))
    rows = saved(rows, "rows")
    groups = saved(ngram_join(rows, key="_row").components().filter("component_id IS NOT NULL").select(F.col("doc_id").alias("_row"), "component_id"), "groups")
    ids = rows.filter("_row IS NOT NULL").select("_row", "doc_id")
    first = groups.join(ids, "_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("first"))
    drop = groups.join(first, "component_id").filter("_row != first").select("_row").distinct()
    return without(rows, drop, "_row").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; rows go one by one, whatever ids they share."""
    _bound_batches(spark)
    keyed = docs.select(*COLUMNS).withColumn("_row", _row_key())
    return drop_contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_words=1, key="_row").select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids and scores of each document's four best segmentations, and whether decoding the best gives the text back."""
    _bound_batches(spark)
    docs = docs.select(*COLUMNS)
    rows = encode(docs.withColumn("_row", F.struct("doc_id", "lang", "source", F.col("text").alias("raw"))), tokenizer("piece_bpe_32k.model"), n=4, key="_row", all_ids=True)
    return rows.select("_row.doc_id", "_row.lang", "_row.source", "ids", "scores", "n_best", F.size("ids").cast("long").alias("n_pieces"), F.col("decoded").eqNullSafe(F.col("_row.raw")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: Language models and segmentations are no SQL; tests hold each stage and the whole against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        with scratch(spark):  # what a stage wrote on its way goes once its rows are written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
