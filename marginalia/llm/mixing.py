"""Mixing sources so that each has a target share of the tokens.

The texts of a source, in a pseudorandom order, form one stream of tokens that is cut into
blocks of a fixed length. The mixed output is made of shards of equally many slots; how many
slots of a shard go to which source is drawn from a multinomial with the target weights. The
j-th slot that a source gets, over all shards, is mapped to its block by a pseudorandom
permutation of the source's blocks, a new one for each pass through the source; blocks are
then joined by their index.

Size. The output is as large as the scarcest source allows at its target share, with a margin
for the draws (`spare` standard deviations). A source never gets more slots than max_repeats
times its blocks: what a draw would exceed goes to the sources that have room, by their
weights, so no text is used more often than allowed and the reached shares tell the rest.

Defined results
  * equal texts are one text (that of the smallest doc_id, in a weighted source), however often
    and in however many sources they occur, so repeats are bounded for texts, not rows;
  * null and empty texts and texts of sources without a weight, or without a source, are not
    selected; they are reported with share 0;
  * weighted sources without texts cannot be reached: the other weights are scaled to sum to 1
    (effective_weight), and the source is reported with share 0;
  * a weight that is null or not above 0 counts as no weight, max_repeats below 1 or null as 1;
    a source listed twice has its weights added and the smaller of its max_repeats;
  * the last block of a source may be shorter; the same seed gives the same mix;
  * empty tables give an empty mix; other columns than those named are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, spread
from .encoding import TOKENIZERS, token_count


#: Tokens of an output shard, at most on average, where the number of shards is not given.
SHARD_TOKENS = 1 << 30
#: Slots that are listed at once.
STRETCH = 8192


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Place of each index under a pseudorandom permutation of 0..size-1 named by key.

    A Feistel network over the next even power of two, walked until inside.
    """
    index, size, key = (np.asarray(x, dtype=np.uint64) for x in (index, size, key))
    half = np.array([max(1, (max(int(s) - 1, 1).bit_length() + 1) // 2) for s in np.unique(size)], dtype=np.uint64)
    half = half[np.searchsorted(np.unique(size), size)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.copy()
    todo = np.ones(len(out), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = out[todo] >> half[todo], out[todo] & mask[todo]
            for r in range(rounds):
                x = (right ^ key[todo]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(29)
                x *= np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(32)
                left, right = right, (left ^ x) & mask[todo]
            out[todo] = (left << half[todo]) | right
            todo = out >= size
    return out.astype(np.int64)


def draw_counts(weights: np.ndarray, room: np.ndarray, slots: int, shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard (shards x sources), never more than room in all."""
    rng = np.random.default_rng(seed)
    left = room.astype(np.int64).copy()
    counts = np.zeros((shards, len(weights)), dtype=np.int64)
    for k in range(shards):
        want = slots // shards + (k < slots % shards)
        open_ = np.where(left > 0, weights, 0.0)
        while want > 0 and open_.sum() > 0:
            drawn = np.minimum(rng.multinomial(want, open_ / open_.sum()), left)
            counts[k] += drawn
            left -= drawn
            want -= int(drawn.sum())
            open_ = np.where(left > 0, weights, 0.0)
    return counts


def slots_that_fit(weights: np.ndarray, room: np.ndarray, spare: float) -> int:
    """Most slots of which every source can be expected to fill its share."""
    most = math.inf
    for w, r in zip(weights, room):
        # largest t with t w + spare sqrt(t w (1 - w)) <= r
        b = spare * math.sqrt(w * (1 - w))
        root = (-b + math.sqrt(b * b + 4 * w * r)) / (2 * w)
        most = min(most, root * root)
    return int(most) if math.isfinite(most) else 0


class Mix:
    """A mix of docs(doc_id, text, source) by weights(source, target_weight, max_repeats)."""

    def __init__(
        self,
        docs: DataFrame,
        weights: DataFrame,
        block: int = 64,
        shards: int | None = None,
        seed: int = 7,
        spare: float = 3.0,
        slots: int | None = None,
        order_rows: int = 50_000,
        tokenizer: str = "byte_bpe_50k",
        folder: str = TOKENIZERS,
    ):
        docs = docs.select("doc_id", "text", "source")
        self.docs, self.block, self.seed = docs, block, seed
        self.spark = docs.sparkSession
        self.weights = (
            weights.where(F.col("source").isNotNull())
            .groupBy("source")
            .agg(
                F.sum(F.when(F.col("target_weight") > 0, F.col("target_weight"))).alias("target_weight"),
                F.greatest(F.min(F.coalesce("max_repeats", F.lit(1))), F.lit(1)).alias("max_repeats"),
            )
        )
        weighted = self.weights.where("target_weight > 0").select("source")
        texts = (
            docs.where(F.length("text") > 0)
            .join(weighted, "source", "left_semi")
            .withColumn("h", F.sha2("text", 256))
            .groupBy("h")
            .agg(F.min_by(F.struct("doc_id", "source", "text"), F.struct("doc_id", "source")).alias("d"))
            .select("d.*")
        )
        self.sized = cut_lineage(
            spread(texts, "doc_id").select("doc_id", "source", token_count("text", tokenizer, folder).alias("tokens"))  # at least one each
        )
        self._lay_out(order_rows)
        self._draw(spare, slots, shards)

    def _lay_out(self, order_rows: int) -> None:
        """Place of every text in its source's stream: a prefix sum in two levels."""
        buckets = max(1, math.ceil(self.sized.count() / order_rows))
        mixed = F.xxhash64("doc_id", F.lit(self.seed))
        placed = self.sized.withColumn("o", mixed).withColumn("bucket", F.pmod(F.shiftright("o", 7), F.lit(buckets)))
        by_bucket = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = by_bucket.select("source", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
        inside = Window.partitionBy("source", "bucket").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        self.stream = placed.join(starts, ["source", "bucket"]).select(
            "source", "doc_id", "tokens", (F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("start")
        )

    def _draw(self, spare: float, slots: int | None, shards: int | None) -> None:
        """What every source holds and gets. One row for each weighted source, on the driver."""
        held = self.sized.groupBy("source").agg(F.sum("tokens").alias("tokens"))
        rows = self.weights.where("target_weight > 0").join(held, "source").orderBy("source").collect()
        self.sources = [r["source"] for r in rows]
        w = np.array([r["target_weight"] for r in rows], dtype=float)
        self.effective = w / w.sum() if len(w) else w
        self.blocks = np.array([math.ceil(r["tokens"] / self.block) for r in rows], dtype=np.int64)
        room = self.blocks * np.array([r["max_repeats"] for r in rows], dtype=np.int64)
        self.slots = slots_that_fit(self.effective, room, spare) if slots is None else slots
        self.shards = shards or max(64, math.ceil(self.slots * self.block / SHARD_TOKENS))
        self.counts = draw_counts(self.effective, room, self.slots, self.shards, self.seed)

    def slot_blocks(self) -> DataFrame:
        """(shard, source, slot, pass, block): the block of every slot."""
        before = np.cumsum(self.counts, axis=0) - self.counts
        plan = [
            (k, s, i, int(before[k, i]), int(self.counts[k, i]), int(self.blocks[i]))
            for k in range(self.shards)
            for i, s in enumerate(self.sources)
            if self.counts[k, i]
        ]
        seed = self.seed

        @F.pandas_udf("long")
        def place(slot: pd.Series, size: pd.Series, at: pd.Series) -> pd.Series:
            n = size.to_numpy()
            passes = slot.to_numpy() // n
            key = passes * 1_000_003 + at.to_numpy() * 7919 + seed
            return pd.Series(permuted(slot.to_numpy() % n, n, key))

        rows = self.spark.createDataFrame(plan, "shard int, source string, at int, first long, n long, size long")
        last = F.col("first") + F.col("n") - 1
        stretches = rows.select("shard", "source", "at", "size", last.alias("last"), F.explode(F.sequence("first", last, F.lit(STRETCH))).alias("begin"))
        slot = stretches.repartition("shard", "source", "begin").select(
            "shard", "source", "at", "size", F.explode(F.sequence("begin", F.least("last", F.col("begin") + (STRETCH - 1)))).alias("slot")
        )
        return slot.select(
            "shard", "source", "slot", F.floor(F.col("slot") / F.col("size")).cast("int").alias("pass"), place("slot", "size", "at").alias("block")
        )

    def block_pieces(self) -> DataFrame:
        """(source, block, doc_id, first, last): the tokens first..last-1 of texts in each block."""
        b = F.lit(self.block)
        end = F.col("start") + F.col("tokens")
        number = F.col("block") * b
        return self.stream.select(
            "source", "doc_id", "start", "tokens", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))).alias("block")
        ).select(
            "source",
            "block",
            "doc_id",
            F.greatest(number - F.col("start"), F.lit(0)).cast("int").alias("first"),
            F.least(number + b - F.col("start"), F.col("tokens")).cast("int").alias("last"),
        )

    def pieces(self) -> DataFrame:
        """(shard, source, slot, pass, block, doc_id, first, last) of the whole mix."""
        return self.slot_blocks().join(self.block_pieces(), ["source", "block"]).select(
            "shard", "source", "slot", "pass", "block", "doc_id", "first", "last"
        )

    def shares(self) -> DataFrame:
        """Target, effective and reached share of every source, with tokens held and selected."""
        used = (
            self.pieces()
            .groupBy("source", "doc_id", "first")
            .agg(F.sum(F.col("last") - F.col("first")).alias("n"), F.count("*").alias("uses"))
            .groupBy("source")
            .agg(F.sum("n").alias("tokens_selected"), F.max("uses").alias("most_uses"))
        )
        held = self.sized.groupBy("source").agg(F.sum("tokens").alias("tokens_held"))
        effective = self.spark.createDataFrame(
            [(s, float(x)) for s, x in zip(self.sources, self.effective)], "source string, effective_weight double"
        )
        every = self.docs.select("source").union(self.weights.select("source")).where("source is not null").distinct()
        total = Window.partitionBy()

        def n(c: str) -> Column:
            return F.coalesce(c, F.lit(0)).cast("long").alias(c)

        return (
            every.join(self.weights, "source", "left")
            .join(effective, "source", "left")
            .join(held, "source", "left")
            .join(used, "source", "left")
            .select("source", "target_weight", "effective_weight", "max_repeats", n("tokens_held"), n("tokens_selected"), n("most_uses"))
            .withColumn("share", F.col("tokens_selected") / F.greatest(F.sum("tokens_selected").over(total), F.lit(1)))
        )
