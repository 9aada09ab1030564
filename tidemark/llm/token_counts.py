"""Operator 1. Token counts by an exact histogram of encoded lengths.

Documents are encoded once, each task adds up how many have which length, and Spark sums those
counts by length. The histogram is all that later questions need: suffix sums over it give, for
any context limit, how many documents and tokens are longer, what remains after truncation, and
every quantile.

Nulls and empty texts have length 0. Ties and repeated rows just count. An empty table gives an
empty histogram. Columns besides the text are not read. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._common import checkpointed, documents, slices

#: Lengths per block of the two-level suffix sums.
BLOCK = 1024


@cache
def _encoder(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(ranks_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def length_histogram(df: DataFrame, text: str = "text", ranks_path: str | None = None) -> DataFrame:
    """(length, n_docs): how many texts are encoded in how many tokens."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = _encoder(path).encode_ordinary, Counter()
        for part in slices(batches, "t", keeps=(_encoder,)):
            seen.update(len(encode(t)) if t else 0 for t in part.column("t").to_pylist())
        yield pa.RecordBatch.from_pydict({"length": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    partial = df.select(F.col(text).alias("t")).mapInArrow(count, "length long, n long")
    return partial.groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds to each length: n_tokens, docs_ge and tokens_ge (of that length or longer), truncated_tokens
    (left when every text is cut to that length), share_le (of documents up to that length).

    Two levels keep each window small: sums by block of lengths, then sums within a block. The histogram
    is used several times, so it is checkpointed first and no text is encoded again for it.
    """
    h = checkpointed(histogram).select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    above = blocks.select("block", F.coalesce(F.sum("d").over(later), zero).alias("d_above"), F.coalesce(F.sum("t").over(later), zero).alias("t_above"))
    totals = blocks.agg(F.sum("d").alias("all_docs"), F.sum("t").alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    summed = h.join(above, "block").crossJoin(F.broadcast(totals)).select(
        "length", "n_docs", "n_tokens", "all_docs", "all_tokens",
        (F.sum("n_docs").over(inside) + F.col("d_above")).alias("docs_ge"),
        (F.sum("n_tokens").over(inside) + F.col("t_above")).alias("tokens_ge"),
    )
    return summed.select(
        "length", "n_docs", "n_tokens", "docs_ge", "tokens_ge",
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_docs")).alias("share_le"),
    )


def truncated_total(sums: DataFrame, limit: int) -> Column | DataFrame:
    """One row: the tokens left when each text is cut to ``limit`` tokens, and how many texts are cut."""
    over = F.col("length") > limit
    return sums.agg(
        F.coalesce(F.sum(F.when(over, F.col("n_docs") * limit).otherwise(F.col("n_tokens"))), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): for each share, the least length that so many of the documents do not exceed."""
    return sums.agg(*[F.min(F.when(F.col("share_le") >= s, F.col("length"))).alias(f"q{i}") for i, s in enumerate(shares)]).select(
        F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("length")) for i, s in enumerate(shares)])).alias("x")
    ).select("x.*")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(length_histogram(documents(spark, sf_dir)))
