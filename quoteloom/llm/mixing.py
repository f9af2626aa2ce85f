"""Sources mixed to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash, pass after pass where it may be repeated; a document's virtual
finish time is the tokens of its source up to and with it, divided by the source's weight. In the order of
finish times every prefix holds the sources in their shares, so the mixture is the prefix that fits the budget.
Running sums are taken in two steps, over hash ranges and within them, so that no source meets one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.session import checkpointed

#: The vocabulary files' folder is a parameter; this is where the public ones are installed.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE of this kind first cuts a text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Documents that one task sums up in order; the hash ranges are as many as that takes, 256 at least.
RANGE_DOCUMENTS = 200_000


def token_counts(documents: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) by a public byte-level BPE; null texts have none."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        coder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(coder.encode_ordinary(t)) if isinstance(t, str) else 0 for t in pdf["text"]]})

    kinds = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, source string, tokens long"
    return documents.select("doc_id", "source", "text").mapInPandas(count, kinds)


def weights(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, weight, target_share, max_repeats, held, budget, passes), a row a target.

    Sources that hold nothing, or whose share or repeats are not above zero, get a null weight; the others'
    shares are scaled to one. The budget is the largest at which each of them reaches its share within its
    repeats, or ``total_tokens`` if that is given and smaller. Null shares count as zero, null repeats as one.
    """
    held = sizes.where("source is not null and tokens > 0").groupBy("source").agg(F.sum("tokens").alias("held"))
    t = targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("long").alias("max_repeats"))
    t = t.join(held, "source", "left").withColumn("usable", F.col("held").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    every = Window.partitionBy(F.lit(0))  # a row a target: a dozen
    share = F.when(F.col("usable"), F.col("target_share"))
    t = t.withColumn("weight", share / F.sum(share).over(every))
    room = F.min(F.col("held") * F.col("max_repeats") / F.col("weight")).over(every)
    budget = room if total_tokens is None else F.least(room, F.lit(float(total_tokens)))
    t = t.withColumn("budget", budget)
    return t.withColumn("passes", F.least(F.ceil(F.col("weight") * F.col("budget") / F.col("held")), F.col("max_repeats")).cast("int")).drop("usable")


def mixture(sizes: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, copy_no, tokens, finish), the weights): the documents of the mixture, in order of finish.

    ``copy_no`` counts a document's uses from 1; a source is never gone through more than its max_repeats times.
    Documents of no source, of a source without a target, or without tokens are left out. Equal finish times go
    by doc_id and copy. Repeated rows are documents of their own. Empty tables give an empty mixture.
    """
    w = checkpointed(weights(sizes, targets, total_tokens))
    bits = max(8, math.ceil(math.log2(1 + sizes.count() / RANGE_DOCUMENTS)))
    plan = F.broadcast(w.where("weight is not null").select("source", "weight", "passes", "budget"))  # a row a target
    copies = sizes.where("tokens > 0").select("doc_id", "source", "tokens").join(plan, "source").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    hashed = copies.withColumn("h", F.xxhash64("doc_id", "copy_no", F.lit(seed))).withColumn("range_no", F.shiftrightunsigned(F.col("h"), 64 - bits))
    place = ["source", "copy_no", "range_no"]
    sums = hashed.groupBy(*place).agg(F.sum("tokens").alias("in_range"))
    before = sums.withColumn("before", F.sum("in_range").over(Window.partitionBy("source").orderBy("copy_no", "range_no").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_range")).drop("in_range")
    inner = Window.partitionBy(*place).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    timed = hashed.join(before, place).withColumn("finish", (F.col("before") + F.sum("tokens").over(inner)) / F.col("weight"))
    # before virtual time b, each source has sent at most weight * b tokens, all together at most b: the prefix that fits
    kept = timed.where(F.col("finish") <= F.col("budget") * (1 + 1e-12)).select("doc_id", "source", "copy_no", "tokens", "finish")
    return kept, w


def reached_shares(kept: DataFrame, w: DataFrame) -> DataFrame:
    """A row a target: what was asked, what was reached, and how often the source's documents were used."""
    got = kept.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_documents"), F.max("copy_no").alias("repeats"))
    out = w.select("source", "target_share", "max_repeats", "held").join(got, "source", "left").na.fill(0, ["tokens", "n_documents", "repeats", "held"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("reached_share", F.when(total > 0, F.col("tokens") / total))
