"""Filling fixed-capacity containers with items (problem 7): sum-of-squares online packing.

Items arrive one after the other. With N[h] partially filled containers at fill level h, an item of size s goes to the
level (0 opens a container) that minimises the sum of N[h]^2 afterwards; the counts are a level array. An item larger
than the capacity, and only such a one, is divided: full containers and a rest, which is packed like any item.

Items are spread over lanes, each packed on its own; a lane gets about ``LANE_ITEMS`` items whatever the data, so a task's
work and memory are bounded and the space lost to the last partial containers of a lane is a small share of it.

The packing is the same on every run and partitioning: copies of an item are numbered, lanes are taken from a hash of
(item, size, copy), and a lane is packed in the order of that hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.tokens import token_count
from tesserae.plans.scale import cut, lookup_join

#: Items a lane packs, about.
LANE_ITEMS = 20_000


class SumOfSquares:
    """The online packer of one capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)  # count[h]: open containers at level h; 0 and capacity unused
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.containers = 0

    def place(self, size: int) -> int:
        """The number of the container that takes an item of 1..capacity tokens."""
        c, n = self.capacity, self.count
        room = c - size
        level, least = 0, (2 * n[size] + 1 if size < c else 0)
        if room >= 1:
            here = n[1 : room + 1]
            # moving a container from h to h + size changes the sum by 2 (N[h+size] - N[h]) + 2, or 1 - 2 N[h] if that fills it
            change = 2 * (n[1 + size : c + 1] - here) + 2
            change[-1] = 1 - 2 * here[-1]
            change = np.where(here > 0, change, np.iinfo(np.int64).max)
            k = int(change[::-1].argmin())  # of equal changes the fullest level
            if change[room - 1 - k] <= least:
                level = room - k
        if level:
            where = self.open[level].pop()
            n[level] -= 1
        else:
            where = self.containers
            self.containers += 1
        if level + size < c:
            n[level + size] += 1
            self.open[level + size].append(where)
        return where


def _lane(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["_order", "_item", "_tokens", "_copy"], kind="stable")
    packer = SumOfSquares(int(pdf["_capacity"].iloc[0]))
    bins = [packer.place(int(s)) for s in pdf["_size"]]
    return pdf[["_spec", "_capacity", "_item", "_copy", "_piece", "_size", "_lane"]].assign(_bin=bins)


def pack(docs: DataFrame, specs: DataFrame, doc: str = "doc_id", text: str = "text", spec: str = "spec_id", capacity: str = "capacity_tokens", tokenizer: str | None = None) -> DataFrame:
    """Every piece of every item in its container, for each container size: (spec, doc, ``piece``, ``pieces``,
    ``from_token``, ``tokens``, ``container``).

    A text of 0 tokens (also a null one) has one piece of 0 tokens and no container (null). Repeated rows are items of
    their own, and so are rows that share an id. Sizes that are null or below 1 are no containers; a spec with several
    sizes has containers of each, and repeated rows of one size are one. Null ids are kept."""
    sizes = docs.select(F.col(doc).alias("_item"), token_count(F.col(text), tokenizer).alias("_tokens"))
    # rows of one id and size are interchangeable: they are counted (map-side first) and numbered, not ordered
    counted = cut(sizes.groupBy("_item", "_tokens").agg(F.count(F.lit(1)).alias("_copies")))
    kinds = specs.where(F.col(capacity) >= 1).select(F.col(spec).alias("_spec"), F.col(capacity).cast("bigint").alias("_capacity")).distinct().collect()  # the sizes: a stated handful
    items = counted.agg(F.sum("_copies")).first()[0] or 0
    lanes = max(1, -(-items // LANE_ITEMS))
    copies = counted.select("_item", "_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)).alias("_copy"))
    each = F.explode(F.array(*[F.struct(F.lit(k["_spec"]).alias("_spec"), F.lit(k["_capacity"]).alias("_capacity")) for k in kinds]))
    spread = copies.withColumn("_k", each).select("_item", "_tokens", "_copy", "_k.*") if kinds else copies.limit(0).selectExpr("*", "cast(null as bigint) _spec", "1L _capacity")
    full, rest = F.floor(F.col("_tokens") / F.col("_capacity")), F.col("_tokens") % F.col("_capacity")
    spread = spread.withColumns({"_full": full, "_rest": rest}).withColumn("_pieces", F.greatest(F.col("_full") + F.when(F.col("_rest") > 0, 1).otherwise(0), F.lit(1)))
    kind = F.concat_ws("x", "_spec", "_capacity")
    # whole containers need no search: pieces 0.._full-1, expanded where they are
    whole = spread.where("_full > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_full") - 1)).alias("piece"))
    name = F.concat_ws("-", kind, F.lit("w"), F.coalesce(F.col("_item").cast("string"), F.lit("null")), "_tokens", "_copy", "piece")
    whole = whole.select("_spec", "_item", "piece", "_pieces", (F.col("piece") * F.col("_capacity")).alias("from_token"), F.col("_capacity").alias("tokens"), name.alias("container"))
    zero = F.lit(0).cast("bigint")
    none = spread.where("_tokens = 0").select("_spec", "_item", zero.alias("piece"), "_pieces", zero.alias("from_token"), zero.alias("tokens"), F.lit(None).cast("string").alias("container"))
    order = F.xxhash64("_item", "_tokens", "_copy")
    parts = spread.where("_rest > 0").select("_spec", "_capacity", "_item", "_tokens", "_copy", F.col("_full").alias("_piece"), F.col("_rest").alias("_size"), order.alias("_order"), F.pmod(order, F.lit(lanes)).alias("_lane"))
    item, number = docs.schema[doc].dataType.simpleString(), specs.schema[spec].dataType.simpleString()
    placed = parts.groupBy("_spec", "_capacity", "_lane").applyInPandas(_lane, f"_spec {number}, _capacity bigint, _item {item}, _copy bigint, _piece bigint, _size bigint, _lane bigint, _bin bigint")
    placed = placed.select("_spec", "_item", F.col("_piece").alias("piece"), (F.col("_piece") + 1).alias("_pieces"), (F.col("_piece") * F.col("_capacity")).alias("from_token"), F.col("_size").alias("tokens"), F.concat_ws("-", kind, "_lane", "_bin").alias("container"))
    return whole.unionByName(none).unionByName(placed).withColumnsRenamed({"_spec": spec, "_item": doc, "_pieces": "pieces"})


def fill(packed: DataFrame, specs: DataFrame, spec: str = "spec_id", capacity: str = "capacity_tokens") -> DataFrame:
    """Of a packing, a row a container size: (spec, ``items`` with tokens, ``tokens``, ``containers``, ``fullest`` in
    tokens, ``least`` containers that could do: tokens over capacity rounded up, ``used`` share of the space).

    A spec with several sizes is measured against the largest."""
    each = packed.where(F.col("container").isNotNull()).groupBy(spec, "container").agg(F.sum("tokens").alias("_t"), F.sum(F.when(F.col("piece") == 0, 1).otherwise(0)).alias("_i"))
    sums = each.groupBy(spec).agg(F.sum("_i").alias("items"), F.sum("_t").alias("tokens"), F.count(F.lit(1)).alias("containers"), F.max("_t").alias("fullest"))
    sizes = cut(specs.where(F.col(capacity) >= 1).groupBy(spec).agg(F.max(F.col(capacity).cast("bigint")).alias("_c")))
    out = lookup_join(sums, sizes, [spec], "inner")
    return out.select(spec, "items", "tokens", "containers", "fullest", F.ceil(F.col("tokens") / F.col("_c")).alias("least"), (F.col("tokens") / (F.col("containers") * F.col("_c"))).alias("used"))
