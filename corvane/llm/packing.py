"""Texts put into containers of fixed capacity: best fit over vectors of residual capacities.

A container has capacities of tokens, of documents and of attention cost (squared lengths in tiles of TILE tokens, as a
block-diagonal kernel computes them: a short piece costs a whole tile). Pieces are placed longest first; of the open containers
that can take a piece under every constraint, the one with the smallest weighted norm of what would remain is chosen. Blocks of pieces, drawn by a hash, are packed apart from each other, each by one task; a
block leaves at most a few containers with room, so the loss is about one container in a block of thousands.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import TOKENIZER, with_tokens
from corvane.session import written

BLOCK_PIECES = 8192
#: Tokens of a tile of attention.
TILE = 16
WEIGHTS = (1.0, 0.05, 0.05)


def attention(tokens: np.ndarray | int) -> np.ndarray:
    """Cost of a piece: its length in whole tiles, squared."""
    return (np.ceil(np.asarray(tokens) / TILE) * TILE) ** 2.0


def best_fit(tokens: np.ndarray, capacity: int, max_docs: int, max_cost: float, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Container number of each piece; pieces must not exceed a capacity by themselves."""
    caps = np.array([capacity, max_docs, max_cost], dtype=np.float64)
    need = np.stack([tokens, np.ones(len(tokens)), attention(tokens)], axis=1)
    w = np.asarray(weights) / caps**2
    out = np.empty(len(tokens), dtype=np.int64)
    room, numbers, made = np.empty((0, 3)), np.empty(0, dtype=np.int64), 0
    grown, used = np.empty((64, 3)), 0
    ids = np.empty(64, dtype=np.int64)
    least = np.minimum.accumulate(tokens[np.argsort(-tokens, kind="stable")][::-1])[::-1]
    for turn, i in enumerate(np.argsort(-tokens, kind="stable")):
        room, numbers = grown[:used], ids[:used]
        after = room - need[i]
        score = np.where((after >= -1e-9).all(1), (after * after) @ w, np.inf)
        at = int(score.argmin()) if used else -1
        if at < 0 or not np.isfinite(score[at]):
            if used == len(grown):
                grown, ids = np.concatenate([grown, np.empty_like(grown)]), np.concatenate([ids, np.empty_like(ids)])
            grown[used], ids[used], at = caps, made, used
            made, used = made + 1, used + 1
        out[i] = ids[at]
        grown[at] -= need[i]
        if grown[at, 0] < least[turn] or grown[at, 1] < 1:  # nothing fits any more
            used -= 1
            grown[at], ids[at] = grown[used], ids[used]
    return out


def _packed(capacity: int, max_docs: int, max_cost: float):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc", "piece"], kind="stable")
        f["slot"] = best_fit(f["tokens"].to_numpy(dtype=np.int64), capacity, max_docs, max_cost)
        return f[["block", "slot", "doc", "piece", "first_token", "tokens"]]

    return run


def pack(
    df: DataFrame, capacity: int, doc_id: str = "doc_id", text: str = "text", max_docs: int | None = None, max_cost: float | None = None, tokenizer: str = TOKENIZER,
) -> DataFrame:
    """(container, doc, piece, first_token, tokens): where every text goes; a text beyond ``capacity`` is cut into pieces of it.

    No container exceeds ``capacity`` tokens, ``max_docs`` pieces (one a token if None) or
    ``max_cost`` of attention (that of a text of full capacity if None; less than that cuts texts into pieces that keep it).
    Only texts that exceed a capacity by themselves are cut. Blank texts have 0 tokens and are placed, in containers of their
    own where the others have all their pieces; null ids and texts are left out; rows repeated under one id are one text, the longest by
    tokens. An empty table gives an empty result. Other columns play no part. Containers are named block-slot.
    """
    docs = capacity if max_docs is None else max_docs
    cost = float(attention(capacity)) if max_cost is None else max(float(max_cost), float(TILE**2))
    most = max(1, min(capacity, int(cost**0.5) // TILE * TILE))
    sizes = with_tokens(df, doc_id, text, tokenizer).groupBy("doc").agg(F.max("tokens").alias("tokens"))
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.col("tokens") - 1, F.lit(0)), F.lit(most)))
    pieces = sizes.select("doc", "tokens", start.alias("first_token"))
    pieces = pieces.select("doc", (F.col("first_token") / most).cast("int").alias("piece"), "first_token", F.least(F.lit(most), F.col("tokens") - F.col("first_token")).alias("tokens"))
    pieces = written(pieces)
    blocks = max(1, -(-pieces.count() // BLOCK_PIECES))
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("doc", "piece"), F.lit(blocks)).cast("int"))
    kind = dict(pieces.dtypes)["doc"]
    packed = blocked.repartition(blocks, "block").groupBy("block").applyInPandas(_packed(capacity, docs, cost), f"block int, slot long, doc {kind}, piece int, first_token int, tokens int")
    return packed.select(F.concat_ws("-", "block", "slot").alias("container"), "doc", "piece", "first_token", "tokens")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, share of the capacity used, emptiest container."""
    each = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return each.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count(F.lit(1)) * F.lit(capacity))).alias("fill"), F.min("t").alias("least"), F.max("n").alias("most_pieces"),
    )
