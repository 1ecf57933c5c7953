"""Corpus pipeline: the stages that turn raw documents into training tokens.

Each stage takes (spark, docs, sf_dir), calls one operator of ``strata.llm``
and returns a DataFrame; it is written as Parquet and reread as the next
stage's docs.  All but the last return the columns of ``documents``.  Parquet
promises no order, so the last stage works out the mixture's positions again
(a function of sources and keys) and sorts by them; ``run`` returns its rows
in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rule or the learned decision list rejects."""
    from strata.llm.quality import keep_good

    return keep_good(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    from strata.llm.jaccard import one_of_each

    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found in a text are replaced by a mark; n_chars follows."""
    from strata.llm.secrets import redact

    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of an equal-weight mixture of their sources."""
    from strata.llm.mixing import mix

    return mix(docs)


def placed_tokens(docs: DataFrame) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes that they decode to, and its position in the mixture.

    The ids stay packed (``packing.pack``: used byte planes, zstd): the join, the written rows and the sort carry them so.
    """
    import public_tokenizers
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from strata.llm import bpe, mixing
    from strata.llm.queries import RANKS
    from strata.llm.shared import written

    # rows are told apart by their place in the files, which every reading of them gives alike
    rows = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row"))
    places = mixing.places(rows.select("doc_id", "source", "row")).select(F.col("row").alias("at"), "position")
    places = written(places, "places")
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    out = bpe.encode_packed(rows.select(F.struct("doc_id", "row").alias("doc_id"), "text"), bpe.TiktokenWords(ranks, public_tokenizers.PATTERN),
                            public_tokenizers.PATTERN,
                            also={"decoded": (T.BinaryType(), bpe.decoder(ranks)), "packed": (T.BinaryType(), bpe.packed)})
    out = out.select("doc_id.*", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                     F.sha2("decoded", 256).alias("decoded_sha256"), F.col("packed").alias("ids"))
    lost = F.raise_error(F.lit("a row has no place: write the input to files first")).cast("long")
    return out.join(places, F.col("row") == F.col("at"), "left").select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", F.coalesce("position", lost).alias("position"))


def in_order(placed: DataFrame) -> DataFrame:
    """Rows sorted by their position in the mixture; ids, packed until then, as lists."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from strata.llm import bpe

    def unpacked(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([bpe.unpacked(b.column(i)) if c == "ids" else b.column(i)
                                              for i, c in enumerate(b.schema.names)], b.schema.names)

    rows = placed.orderBy("position").drop("position")
    return rows.mapInArrow(unpacked, T.StructType([
        T.StructField("ids", T.ArrayType(T.IntegerType())) if f.name == "ids" else f for f in rows.schema.fields]))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``placed_tokens`` in mixture order."""
    return in_order(placed_tokens(docs))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets),
          ("mixing sources to target weights", mixture), ("byte-level BPE encoding and decoding", tokens)]

#: A learned list, exact near-duplicate groups and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, in mixture order; every stage's rows are written to the shared folder and reread."""
    from strata.llm.shared import written

    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return in_order(written(placed_tokens(docs), "pipeline"))
