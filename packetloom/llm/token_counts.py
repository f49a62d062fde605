"""Token counts from an exact length histogram.

Documents are aggregated by encoded length; everything else is read off the histogram. For a context
limit L the tokens kept when every document is truncated to L are the tokens of the shorter
documents and L for each document of length L or more, so suffix sums over the lengths answer
totals, quantiles and truncated totals for every limit: those that occur as lengths, and any others
that are asked for, which join the histogram as lengths without documents.

The suffix sums run in two levels, within blocks of neighbouring lengths and over the blocks' totals,
so no task gets all lengths: the top level has one row per block of ``block`` lengths.

Cases: a null or empty text has length 0; ties are one row; repeated rows count each time; an empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.bpe import spec_of
from packetloom.llm.io import written

#: Context limits that are answered beside the lengths that occur.
LIMITS = tuple(1 << b for b in range(7, 21))

#: Fixed value: the public pattern that cuts texts into pieces for byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(1)
def encoding(ranks: str, pattern: str):
    """An encoding from the text of a file of base64 tokens and ranks; special tokens are ordinary text."""
    from tiktoken import Encoding

    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return Encoding("counted", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def lengths(docs: DataFrame, path: str, text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """Encoded lengths, with the count of equal lengths in a batch: (n_tokens, n_docs)."""
    ranks = docs.sparkSession.sparkContext.broadcast(spec_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks.value, pattern).encode_ordinary
        for batch in batches:
            counts: dict[int, int] = {}
            for at in range(0, batch.num_rows, 500):
                for t in batch.column(0).slice(at, 500).to_pylist():
                    n = len(encode(t)) if t else 0
                    counts[n] = counts.get(n, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.int64()), pa.array([*counts.values()], pa.int64())], names=["n_tokens", "n_docs"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "n_tokens long, n_docs long")


def histogram(counted: DataFrame) -> DataFrame:
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def by_limit(hist: DataFrame, limits: Sequence[int] = (), block: int = 1024) -> DataFrame:
    """For each length that occurs and each given limit, taken as context limit: counts, totals and truncated totals.

    ``docs_at_least``/``tokens_at_least`` count documents of that length or more; ``kept_tokens`` is the
    corpus truncated to it, ``lost_tokens`` the rest; ``quantile`` is the share of documents not longer.
    A limit that no document has as its length is a row without documents (``n_docs`` 0).
    """
    if limits:
        given = hist.sparkSession.createDataFrame([(int(n), 0) for n in limits], "n_tokens long, n_docs long")
        some = hist.agg(F.count("*").alias("lengths")).filter("lengths > 0")  # an empty table stays empty
        hist = histogram(hist.select("n_tokens", "n_docs").union(given.join(some).select("n_tokens", "n_docs")))
    block_of = F.floor(F.col("n_tokens") / block).alias("block")
    h = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), block_of)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        *(F.coalesce(F.sum(f"b_{k}").over(after), F.lit(0)).alias(f"later_{k}") for k in ("docs", "tokens")),
        *(F.sum(f"b_{k}").over(every).alias(f"all_{k}") for k in ("docs", "tokens")),
    )
    here = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    s = h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        *((F.sum(c).over(here) + F.col(f"later_{k}")).alias(f"{k}_at_least") for c, k in (("n_docs", "docs"), ("tokens", "tokens"))),
        "all_docs",
        "all_tokens",
    )
    kept = F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return s.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        kept.alias("kept_tokens"),
        (F.col("all_tokens") - kept).alias("lost_tokens"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
        F.col("all_tokens").alias("total_tokens"),
    )


def count_tokens(docs: DataFrame, path: str, text: str = "text", limits: Sequence[int] = LIMITS) -> DataFrame:
    """Every context limit's figures; the texts are encoded once, for the histogram that is written."""
    return by_limit(written(histogram(lengths(docs, path, text)), "lengths"), limits)


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents don't exceed."""
    return limits.filter(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
