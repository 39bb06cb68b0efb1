"""Token counts: the exact histogram of encoded lengths, and what its suffix sums tell.

Documents are counted by the number of tokens of their text.  Suffix sums over the lengths - within blocks of
lengths, and over the blocks - give for every context limit how many documents reach it and how many tokens are
left when each document is cut to it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.packing import encoder
from lumenfold.llm.shared import shared_dir, stash

#: Lengths in a block; blocks are few, lengths may be many.
BLOCK = 1024


def histogram(docs: DataFrame, *, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): documents by exact encoded length.  Null and empty texts have length 0; repeated rows count
    each; an empty table gives no rows; other columns aren't read."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def count(batches):
        encode, seen = encoder(path), np.zeros(0, np.int64)
        for pdf in batches:
            lengths, n = np.unique([len(encode(t)) if isinstance(t, str) else 0 for t in pdf["text"]], return_counts=True)
            if len(lengths):
                seen = np.pad(seen, (0, max(0, int(lengths[-1]) + 1 - len(seen)))) if lengths[-1] < 1 << 20 else seen
                low = lengths < len(seen)
                seen[lengths[low]] += n[low]
                if not low.all():
                    yield pd.DataFrame({"n_tokens": lengths[~low], "n_docs": n[~low]})
        full = np.flatnonzero(seen)
        yield pd.DataFrame({"n_tokens": full, "n_docs": seen[full]})

    counts = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "n_tokens long, n_docs long")
    return counts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """hist is written to the shared folder first, as it is read twice and its texts should be tokenized once.

    Returns hist plus docs_at_least, tokens_at_least (documents of this length or more, and their tokens), docs_below,
    tokens_below, and truncated_total: all tokens that are left if every document is cut to n_tokens."""
    hist = stash(hist, shared_dir(hist.sparkSession), "histogram")
    rows = hist.withColumn("block", F.expr(f"n_tokens div {BLOCK}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("tokens_after"), F.sum("block_docs").over(everything).alias("all_docs"), F.sum("block_tokens").over(everything).alias("all_tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(blocks, "block").select("n_tokens", "n_docs", (F.sum("n_docs").over(within) + F.col("docs_after")).alias("docs_at_least"), (F.sum("tokens").over(within) + F.col("tokens_after")).alias("tokens_at_least"), "all_docs", "all_tokens")
    out = out.withColumn("docs_below", F.col("all_docs") - F.col("docs_at_least")).withColumn("tokens_below", F.col("all_tokens") - F.col("tokens_at_least"))
    return out.withColumn("truncated_total", F.col("tokens_below") + F.col("n_tokens") * F.col("docs_at_least")).drop("all_docs", "all_tokens")


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_total) for any limits, whether a document has that length or not."""
    rows = sums.select("*", F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context_limit"))
    over = F.col("n_tokens") > F.col("context_limit")
    return rows.groupBy("context_limit").agg(F.coalesce(F.max(F.when(over, F.col("docs_at_least"))), F.lit(0)).alias("docs_over"), F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents don't exceed."""
    rows = sums.select("n_tokens", ((F.col("docs_below") + F.col("n_docs")) / (F.col("docs_below") + F.col("docs_at_least"))).alias("reached"), F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return rows.where(F.col("reached") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op4(spark, sf_dir: str) -> DataFrame:
    """op4_token_counts: one row per encoded length that documents have."""
    return suffix_sums(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")))
