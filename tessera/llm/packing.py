"""Problem 7: passages of varying length into containers of fixed capacity, by sum-of-squares packing.

Each passage goes where it makes the sum, over all gaps, of the squared number of open
containers with that gap smallest; for integer sizes this wastes only a vanishing share. A
passage larger than the capacity, and no other, is split: into pieces as large as a container
and a rest, which is packed like the others.

Passages are cut into blocks by a hash of their id and row, so a hot source or
work, or rows repeated under one id, never meet in one task, and each block is packed by itself: only sizes and ids travel,
``block_items`` of them a block, and a block's open containers are the only loss against one
packing of everything. Blocks of a fixed size keep time and memory per task the same at any
scale.

Defined results: NULL and empty texts have no tokens and are put nowhere; a NULL id can't be
placed and is left out; repeated rows are passages of their own; equal choices go to the
smallest gap; capacities below 1 or NULL make no containers; an empty table has none.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import TOKENIZERS, VOCABULARY, n_tokens
from tessera.session import cut

#: Passages of one block; the loss is at most about one container's worth of open gaps per block.
BLOCK_ITEMS = 50_000

PLACED = "spec_id int, block int, container int, place int, doc_id long, piece int, start int, n_tokens int, capacity int"


def sum_of_squares(sizes: Iterable[int], capacity: int) -> list[tuple[int, int]]:
    """(container, place in it) for each size, in the order given; all sizes are in 1..capacity."""
    import numpy as np

    count = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap; full ones (gap 0) don't count
    open_at: dict[int, list[int]] = defaultdict(list)
    filled: list[int] = []
    out = []
    for size in sizes:
        # into gap g: 2 (n[g-size] - n[g] + 1), less 1 without the new gap 0; a new container: 2 n[capacity-size] + 1
        cost = 2 * (count[: capacity + 1 - size] - count[size:] + 1)
        cost[0] = 1 - 2 * count[size]
        cost[count[size:] == 0] = np.iinfo(np.int64).max
        cost[-1] = 2 * count[capacity - size] + 1 if size < capacity else 0
        gap = int(cost.argmin()) + size
        if gap == capacity:
            container = len(filled)
            filled.append(0)
        else:
            container = open_at[gap].pop()
            count[gap] -= 1
        out.append((container, filled[container]))
        filled[container] += 1
        if gap > size:
            open_at[gap - size].append(container)
            count[gap - size] += 1
    return out


def _pack_block(table):
    """One block of one specification, as Arrow table in and out."""
    import numpy as np
    import pyarrow as pa

    spec, block, capacity = table["spec_id"][0].as_py(), table["block"][0].as_py(), table["capacity"][0].as_py()
    order = np.lexsort((table["doc_id"].to_numpy(), table["mixed"].to_numpy()))
    docs, sizes = table["doc_id"].to_numpy()[order].tolist(), table["n_tokens"].to_numpy()[order].tolist()
    rows = []  # doc, piece, start, size
    for doc, size in zip(docs, sizes):
        for piece, start in enumerate(range(0, size, capacity)):
            rows.append((doc, piece, start, min(capacity, size - start)))
    placed = sum_of_squares([r[3] for r in rows], capacity)
    n = len(rows)
    doc, piece, start, size = zip(*rows)
    container, place = zip(*placed)
    int32 = lambda x: pa.array(x, pa.int32())
    return pa.table({
        "spec_id": int32([spec] * n), "block": int32([block] * n), "container": int32(container), "place": int32(place),
        "doc_id": pa.array(doc, pa.int64()), "piece": int32(piece), "start": int32(start), "n_tokens": int32(size), "capacity": int32([capacity] * n),
    })


def passage_sizes(documents: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text, tgt_text, both, row): sizes in tokens of the sides of each document; ``row`` tells repeated ids apart once the table is written."""
    sized = documents.where("doc_id IS NOT NULL").select("doc_id", n_tokens("text", vocabulary, folder).alias("text"), n_tokens("tgt_text", vocabulary, folder).alias("tgt_text"))
    return sized.select("*", (F.col("text") + F.col("tgt_text")).alias("both"), F.monotonically_increasing_id().alias("row"))


def pack(documents: DataFrame, specs: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The container and the place in it of each piece, for each specification (spec_id, side, capacity).

    ``start`` is the first token of the piece in its passage. A container is named by
    (spec_id, block, container).
    """
    sizes = cut(passage_sizes(documents, vocabulary, folder), "sizes")  # counted once for all specifications
    blocks = max(1, -(-sizes.count() // block_items))
    wanted = specs.where("capacity > 0").select("spec_id", "side", "capacity")
    wanted = F.broadcast(wanted) if wanted.limit(1001).count() <= 1000 else wanted  # three small columns of a thousand rows at most
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("n_tokens")) for s in ("text", "tgt_text", "both")])
    items = (
        sizes.select("doc_id", "row", F.inline(sides)).where("n_tokens > 0").join(wanted, "side")
        .select("spec_id", "capacity", "doc_id", "n_tokens", F.xxhash64("doc_id", "row").alias("mixed"))
        .withColumn("block", F.pmod("mixed", F.lit(blocks)).cast("int"))
    )
    return items.groupBy("spec_id", "block").applyInArrow(_pack_block, PLACED)


def containers(packed: DataFrame) -> DataFrame:
    """Each container with its pieces and tokens."""
    return packed.groupBy("spec_id", "block", "container", "capacity").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n_tokens"))


def fill(packed: DataFrame) -> DataFrame:
    """Per specification: containers, tokens and the share of the space that is used."""
    per = containers(packed).groupBy("spec_id", "capacity").agg(F.count("*").alias("containers"), F.sum("n_tokens").alias("n_tokens"))
    return per.select("*", (F.col("n_tokens") / (F.col("containers") * F.col("capacity"))).alias("used_share"))
