"""Ordered patterns of events that many sequences share, gaps allowed: prefix-projected pattern growth.

1. Sequences are shortened without loss: an event is left out where no pattern of at most ``max_len`` steps needs it (Simon's
   congruence), first in blocks of a sequence, then over the joined blocks. So a sequence of any length ends up small.
2. Equal sequences become one with a weight. Each is projected onto every frequent first step: (step, suffix, weight).
3. Prefixes grow level by level. A worker holds a share of one first step's suffixes and the frequent prefixes of that step,
   keeps one pointer per prefix and suffix, and counts each suffix once per extension. Infrequent extensions are pruned
   after each level by their summed counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.runs import sequence_events, sequence_order
from corvane.operators.ordering import BLOCK, in_block, ordered_blocks
from corvane.session import written

#: Item numbers in the packed sequences.
CODE = "<u4"
#: Events of a sequence that are shortened at a time, and suffixes that one task extends at a time.
PIECE, SHARE = 8192, 50_000


def shorten(items: list[int] | np.ndarray, k: int) -> list[int]:
    """The sequence without events that no subsequence of at most ``k`` steps needs; same subsequences up to that length.

    x of an event: steps of the shortest subsequence of the part before and with it that first ends there; y likewise from
    the end. Where x + y > k + 1 every subsequence through this event has an equal one that avoids it.
    """
    x: list[int] = []
    least: dict[int, int] = {}
    for a in items:
        at = least.get(a, 1)
        x.append(at)
        for b, v in least.items():
            if v > at + 1:
                least[b] = at + 1
        least[a] = at + 1
        # A letter not seen yet keeps 1: its first event always begins a subsequence.
    kept: list[int] = []
    least = {}
    for a, at in zip(reversed(items), reversed(x), strict=True):
        y = least.get(a, 1)
        if at + y > k + 1:
            continue
        kept.append(a)
        for b, v in least.items():
            if v > y + 1:
                least[b] = y + 1
        least[a] = y + 1
    return kept[::-1]


def _shortened(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["items"] = [bytes_of(shorten(ints_of(b), k)) for b in f["items"]]
            yield f

    return run


def bytes_of(items: list[int]) -> bytes:
    return np.asarray(items, dtype=CODE).tobytes()


def ints_of(b: bytes) -> list[int]:
    return np.frombuffer(bytes(b), dtype=CODE).tolist()


def _packed(k: int):
    """Rows of (s, part, ids as array) to (s, part, items)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["items"] = [bytes_of(shorten(list(map(int, a)), k)) for a in f.pop("list")]
            yield f[["s", "part", "items"]]

    return run


def _joined(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["items"] = [bytes_of(shorten(ints_of(b"".join(map(bytes, a))), k)) for a in f.pop("list")]
            yield f[["s", "part", "items"]]

    return run


def _chunks(lengths: np.ndarray, alphabet: int) -> Iterator[slice]:
    """Slices of sorted lengths whose pointer tables take about 32 MB."""
    i = 0
    while i < len(lengths):
        j, most = i + 1, 0
        while j <= len(lengths):
            most = (int(lengths[min(j, len(lengths)) - 1]) + 1) * alphabet * 4 * (j - i)
            if most > 32_000_000 and j > i + 1:
                break
            j += 1
        j = max(i + 1, j - 1)
        yield slice(i, j)
        i = j


def extension_counts(suffixes: list[list[int]], weights: np.ndarray, prefixes: list[tuple[int, ...]]) -> dict[tuple[int, ...], int]:
    """Weight of the suffixes that contain each prefix followed by each item, every suffix counting once.

    ``prefixes`` are without the step that the suffixes were projected on.
    """
    order = np.argsort([len(x) for x in suffixes], kind="stable")
    lengths = np.array([len(suffixes[i]) for i in order])
    items = sorted({a for x in suffixes for a in x})
    code = {a: i for i, a in enumerate(items)}
    totals: dict[tuple[int, ...], int] = {}
    prefixes = sorted(p for p in prefixes if all(a in code for a in p))
    for part in _chunks(lengths, max(1, len(items))):
        own = [suffixes[i] for i in order[part]]
        w = weights[order[part]]
        n, most = len(own), int(lengths[part].max(initial=0))
        none = most + 1
        nxt = np.full((n, none + 1, len(items)), none, dtype=np.int32)  # from pointer p: where the item comes next, plus one
        seq = np.full((n, most), -1)
        for i, x in enumerate(own):
            seq[i, : len(x)] = [code[a] for a in x]
        for p in range(most - 1, -1, -1):
            nxt[:, p] = nxt[:, p + 1]
            rows = np.nonzero(seq[:, p] >= 0)[0]
            nxt[rows, p, seq[rows, p]] = p + 1
        every = np.arange(n)
        stack: list[tuple[int, np.ndarray]] = []
        for prefix in prefixes:
            depth = 0
            while depth < len(stack) and depth < len(prefix) and stack[depth][0] == prefix[depth]:
                depth += 1
            del stack[depth:]
            for a in prefix[depth:]:
                at = stack[-1][1] if stack else np.zeros(n, dtype=np.int32)
                stack.append((a, nxt[every, at, code[a]]))
            at = stack[-1][1] if stack else np.zeros(n, dtype=np.int32)
            counts = w @ (nxt[every, at] < none)
            for i in np.nonzero(counts)[0]:
                key = (*prefix, items[i])
                totals[key] = totals.get(key, 0) + int(counts[i])
    return totals


def _grown(key: tuple, suffixes: pd.DataFrame, prefixes: pd.DataFrame) -> pd.DataFrame:
    lists = [ints_of(b) for b in suffixes["items"]]
    found = extension_counts(lists, suffixes["weight"].to_numpy(dtype=np.int64), [tuple(ints_of(b)) for b in prefixes["prefix"]])
    return pd.DataFrame({"first": key[0], "prefix": [bytes_of(p) for p in found], "support": list(found.values())}).astype({"first": "int32", "support": "int64"})


def sequences(events: DataFrame, items: DataFrame, max_len: int) -> DataFrame:
    """(s, items): each sequence of frequent items, shortened. Sequences are cut into pieces first and joined level by level."""
    coded = events.join(F.broadcast(items), "name").select("s", "pos", "id", "item")
    blocks = ordered_blocks(coded, "s", sequence_order())
    rn = F.row_number().over(in_block("s", sequence_order()))
    pieces = blocks.select("s", "pos", "id", "item", BLOCK, F.floor((rn - 1) / PIECE).cast("int").alias("cut"))
    # Nulls sort first in structs, as in sequence_order.
    listed = pieces.groupBy("s", BLOCK, "cut").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "item")), nulls_first), lambda x: x["item"]).alias("list"))
    parts = listed.select("s", F.struct(BLOCK, "cut").alias("part"), "list").mapInPandas(_packed(max_len), "s string, part struct<_cv_block int, cut int>, items binary")
    ranked = parts.select("s", (F.row_number().over(Window.partitionBy("s").orderBy("part")) - 1).alias("part"), "items")
    level = written(ranked)
    while True:
        most = level.groupBy("s").agg(F.sum(F.length("items")).alias("n"), F.count(F.lit(1)).alias("parts")).agg(F.max("n"), F.max("parts")).first()
        if not most[1] or most[1] == 1:
            return level.select("s", "items")
        by = F.lit(0) if most[0] <= 32 * PIECE else F.floor(F.col("part") / 16).cast("int")
        single = F.struct("part", "items")
        lists = level.groupBy("s", by.alias("up")).agg(F.transform(F.array_sort(F.collect_list(single)), lambda x: x["items"]).alias("list"))
        level = written(lists.select("s", F.col("up").alias("part"), "list").mapInPandas(_joined(max_len), "s string, part int, items binary"))


def nulls_first(a, b):
    """Order of (pos, id) structs with null positions before all others."""
    def cmp(x, y):
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)

    return (
        F.when(a["pos"].isNull() & b["pos"].isNotNull(), -1).when(a["pos"].isNotNull() & b["pos"].isNull(), 1)
        .when(a["pos"].isNull() | (a["pos"] == b["pos"]), cmp(a["id"], b["id"])).otherwise(cmp(a["pos"], b["pos"]))
    )


def frequent_subsequences(
    df: DataFrame, session: str = "session_id", event_id: str = "id", name: str = "tool_name", position: str = "execution_order",
    time: str = "timestamp", ingested: str | None = "ingested_at", min_share: float = 0.05, min_len: int = 3, max_len: int = 5,
) -> DataFrame:
    """(pattern, length, support): sequences of ``min_len`` to ``max_len`` names that at least ``min_share`` of the sessions contain.

    A session counts once per pattern; repeats within a pattern are allowed. Order is (position, id), null positions first.
    Every non-null session counts in the denominator, also one without any name. Rows without a name match nothing;
    repeated ids count once. No session, or no frequent pattern, gives an empty result. Other columns play no part.
    """
    spark = df.sparkSession
    events = written(sequence_events(df, session, event_id, name, position, time, ingested).select("s", "id", "pos", "name"))
    n = df.where(F.col(session).isNotNull()).select(session).distinct().count()
    need = max(1, int(np.ceil(min_share * n - 1e-9)))
    per_item = events.where("name is not null").select("s", "name").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= need)
    # Bounded: the distinct names of an average session, divided by min_share.
    names = [r["name"] for r in per_item.select("name").orderBy("name").collect()]
    items = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, item int")
    lists = sequences(events, items, max_len).groupBy("items").agg(F.count(F.lit(1)).alias("weight"))

    def projected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for b, w in zip(f["items"], f["weight"], strict=True):
                x = ints_of(b)
                out += [(a, bytes_of(x[x.index(a) + 1 :]), w) for a in sorted(set(x))]
            yield pd.DataFrame(out, columns=["first", "items", "weight"]).astype({"first": "int32", "weight": "int64"})

    suffixes = lists.mapInPandas(projected, "first int, items binary, weight long").groupBy("first", "items").agg(F.sum("weight").alias("weight"))
    suffixes = written(suffixes)
    shares = max(1, -(-suffixes.count() // (SHARE * max(1, len(names)))))
    # A first step may hold most suffixes, so the number of shares follows its own count.
    sizes = suffixes.groupBy("first").agg(F.greatest(F.lit(shares), F.ceil(F.count(F.lit(1)) / SHARE)).cast("int").alias("shares"))
    shared = suffixes.join(F.broadcast(sizes), "first").select("first", "items", "weight", F.pmod(F.xxhash64("items"), F.col("shares")).cast("int").alias("share"))
    level = written(sizes.select("first", F.lit(b"").alias("prefix"), F.lit(0).cast("long").alias("support")))
    found = None
    for length in range(2, max_len + 1):
        spread = level.join(F.broadcast(sizes), "first").select("first", "prefix", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        counts = shared.groupBy("first", "share").cogroup(spread.groupBy("first", "share")).applyInPandas(_grown, "first int, prefix binary, support long")
        level = written(counts.groupBy("first", "prefix").agg(F.sum("support").alias("support")).where(F.col("support") >= need))
        if length >= min_len:
            found = level if found is None else found.unionByName(level)
    dictionary = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    # Item numbers are little-endian: the four bytes in reverse.
    byte = lambda i, n: F.hex(F.substring("prefix", 4 * i + n, F.lit(1)))
    steps = F.transform(F.sequence(F.lit(0), F.col("length") - 2), lambda i: F.conv(F.concat(*[byte(i, n) for n in (4, 3, 2, 1)]), 16, 10).cast("int"))
    if found is None:
        return spark.createDataFrame([], "pattern string, length int, support long")
    rows = found.select("first", "prefix", "support", (F.length("prefix") / 4 + 1).cast("int").alias("length"))
    codes = F.concat(F.array("first"), steps)
    return rows.select(F.array_join(F.transform(codes, lambda i: F.element_at(dictionary, i + 1)), ">").alias("pattern"), "length", "support")
