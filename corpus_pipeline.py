"""A corpus pipeline: quality, near duplicates, mixing by source, token ids.

Each stage takes (spark, docs, sf_dir), with docs as the stage before left them, and all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.byte_bpe import encode_documents
from lattica.llm.common import stash, table
from lattica.llm.jaccard_join import jaccard_components
from lattica.llm.mixing import mix, word_sizes
from lattica.llm.quality_crf import learn_and_score
from lattica.sources.shipping import ship

#: Documents below this chance of being good are rejected: in doubt, a document stays.
QUALITY = 0.5
#: Words of a shingle, and hundredths of Jaccard similarity.
SHINGLE, SIMILAR = 5, 80

#: The stages can't be written in SQL: a trained field, a knapsack and merges of bytes.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field doesn't reject; those without text have the base rate of good ones."""
    ship(spark)
    return learn_and_score(docs, table(spark, sf_dir, "labels"), QUALITY).where("predicted = 1").select(*docs.columns)


def named(docs: DataFrame) -> DataFrame:
    """docs with own and more: 128 bits of hash that rows alike in all columns share."""
    # Hashes pass over nulls, so which columns are null is hashed too.
    nulls = [F.col(c).isNull() for c in docs.columns]
    return docs.select("*", F.xxhash64(*nulls, *docs.columns).alias("own"), F.xxhash64(*docs.columns, *nulls).alias("more"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows, the one with the smallest id; null ids come last, ties are settled by a hash.

    Rows are told apart by all their columns, not by their ids: a row whose text is unlike all others stays, whether
    or not its id is null or repeats. Rows alike in all columns are one. Rows without words link with nothing.
    """
    ship(spark)
    keyed = named(docs)
    found = jaccard_components(keyed.select(F.col("own").alias("doc_id"), "text"), SHINGLE, SIMILAR)
    groups = found.select(F.col("doc_id").alias("own"), F.col("component_id").alias("near")).distinct()
    ids = keyed.select("own", "doc_id").distinct()
    kept = stash(groups.join(ids, "own").groupBy("near").agg(F.min_by("own", F.struct(F.col("doc_id").isNull(), "doc_id", "own")).alias("own")).select("own"), "kept")
    # One shuffle of texts, by own, serves the join and the dropping of alike rows.
    rows = keyed.select("own", "more", F.struct(*docs.columns).alias("row")).join(kept.hint("merge"), "own", "left_semi")
    return rows.groupBy("own", "more").agg(F.first("row").alias("row")).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of the sources takes it; rows alike in all columns count each for itself."""
    ship(spark)
    keyed = named(docs)
    sized = stash(word_sizes(keyed.withColumn("row_key", F.struct("own", "more")), key="row_key"), "sizes")
    times = mix(sized).where("times > 0").groupBy("doc_id.own", "doc_id.more").agg(F.sum("times").cast("int").alias("times"))
    times = stash(times, "times")
    rows = keyed.select("own", "more", F.struct(*docs.columns).alias("row")).join(times.hint("merge"), ["own", "more"])
    alike = rows.groupBy("own", "more").agg(F.first("row").alias("row"), F.first("times").alias("times"))
    return alike.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of its text, their number and the digest of the text decoded from them, for each row.

    Rows are answered by themselves, whether ids are null or repeat; a null text counts as empty. An empty table
    gives no rows.
    """
    import public_tokenizers

    ship(spark)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("ids", "n_tokens", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again.

    What becomes of nulls, repeated rows, odd texts and empty tables is said with each stage; none of them ends a run.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
