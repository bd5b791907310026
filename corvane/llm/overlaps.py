"""Records of evaluation splits that stand, as they are or slightly changed, in the training split.

Fingerprint: every letter count of a record, modulo 4 in Gray code, gives two bits. One letter inserted or left out flips one
bit, one letter replaced two, two swapped none; so records that ask the same lie within a Hamming radius of 2. The 64 bits
are cut into four segments of which two at least agree within that radius: each pair of segments is a block code, and
records of the two sides that share a block code are compared. A random-hyperplane fingerprint of so short texts has no such
radius, which is why the bits are counted, not drawn.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import written

#: Words that carry no question.
STOP_WORDS = "please the a an where is are of in for how does do find show me all to we what which".split()
SEGMENTS = 4
#: Letters in turns over the segments, the frequent ones first, so that every segment tells about as much.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
PAIRS = list(combinations(range(SEGMENTS), 2))


def question_words(text: Column) -> Column:
    """Sorted words of a record: runs of letters, split where a capital follows a small letter, lower-cased, without STOP_WORDS."""
    apart = F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})", " ")
    words = F.split(F.lower(F.regexp_replace(apart, r"[^\p{L}]+", " ")), " ")
    return F.array_sort(F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS)))


def numbered(words: Column) -> Column:
    """Words, each with its turn among its equals, so that set operations count repeats. ``words`` must be a plain column.

    Each different word is counted once; where no word is repeated nothing is counted.
    """
    kinds = F.array_distinct(words)
    turns = lambda w: F.sequence(F.lit(1), F.size(F.filter(words, lambda x: x == w)))
    repeated = F.flatten(F.transform(kinds, lambda w: F.transform(turns(w), lambda n: F.concat(w, F.lit(" "), n.cast("string")))))
    return F.when(F.size(kinds) == F.size(words), F.transform(words, lambda w: F.concat(w, F.lit(" 1")))).otherwise(repeated)


def segment_codes(text: Column) -> list[Column]:
    """SEGMENTS codes of the letter counts of ``text``; letters outside a-z share one counter in the first segment."""
    def bits(count: Column) -> Column:
        return F.element_at(F.array(F.lit(0), F.lit(1), F.lit(3), F.lit(2)), (count % 4 + 1).cast("int"))

    def count(letter: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))

    other = F.length(F.regexp_replace(text, "[a-z ]", ""))
    codes = []
    for s in range(SEGMENTS):
        code = F.lit(0)
        for letter in LETTERS[s::SEGMENTS]:
            code = code * 4 + bits(count(letter))
        codes.append((code * 4 + bits(other)) if s == 0 else code)
    return [c.cast("int") for c in codes]


def one_edit(a: Column, b: Column) -> Column:
    """One letter inserted, left out or replaced, or two neighbouring letters swapped."""
    def swapped(i: Column) -> Column:
        return (F.substring(a, i, F.lit(1)) == F.substring(b, i + 1, F.lit(1))) & (F.substring(a, i + 1, F.lit(1)) == F.substring(b, i, F.lit(1))) & (
            F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 2, F.length(a))) == F.concat(F.substring(b, F.lit(1), i - 1), F.substring(b, i + 2, F.length(b)))
        )

    edits = F.levenshtein(a, b)
    turns = (edits == 2) & (F.length(a) == F.length(b)) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), swapped)
    return (edits == 1) | turns


def records(df: DataFrame, record_id: str, text: str, split: str, source: str, train: str, evaluation: list[str]) -> DataFrame:
    """One row per record id: rid, split, source, key (its sorted words). Records without id, text or known split are in no split.

    Rows repeated under one id count once; if they differ, the smallest (split, source, text) stands.
    """
    rows = df.where(F.col(record_id).isNotNull() & F.col(text).isNotNull() & F.col(split).isin(train, *evaluation))
    one = rows.groupBy(F.col(record_id).alias("rid")).agg(F.min(F.struct(F.col(split).alias("split"), F.col(source).alias("source"), F.col(text).alias("text"))).alias("r"))
    return written(one.select("rid", "r.split", "r.source", F.array_join(question_words(F.col("r.text")), " ").alias("key")))


def class_links(rows: DataFrame, train: str) -> DataFrame:
    """(key_t, key_e): classes of equal word lists in train and in evaluation that ask the same; equal keys included.

    Copies are one class each, so that a group of copies adds one row here, whatever its size.
    """
    sides = rows.groupBy("key").agg(F.max(F.col("split") == train).alias("t"), F.max(F.col("split") != train).alias("e"))
    same = sides.where("t and e").select(F.col("key").alias("key_t"), F.col("key").alias("key_e"))
    words = F.split("key", " ")
    coded = sides.where("key != ''").select("*", words.alias("words")).select("key", "t", "e", numbered(F.col("words")).alias("w"), *[c.alias(f"c{i}") for i, c in enumerate(segment_codes(F.col("key")))])
    blocks = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y")) for n, (i, j) in enumerate(PAIRS)]))
    keyed = coded.select("*", F.size("w").alias("size"), blocks.alias("b")).select("key", "t", "e", "w", "size", "b.*", *[f"c{i}" for i in range(SEGMENTS)])
    left = keyed.where("t").select(*[F.col(c).alias(f"l_{c}") for c in keyed.columns])
    right = keyed.where("e").select(*[F.col(c).alias(f"r_{c}") for c in keyed.columns])
    agree = [F.col(f"l_c{i}") == F.col(f"r_c{i}") for i in range(SEGMENTS)]
    distance = sum((F.bit_count(F.col(f"l_c{i}").bitwiseXOR(F.col(f"r_c{i}"))) for i in range(SEGMENTS)), F.lit(0))
    first = F.lit(len(PAIRS))
    for n in reversed(range(len(PAIRS))):  # a pair is taken under the first block code it shares
        first = F.when(agree[PAIRS[n][0]] & agree[PAIRS[n][1]], F.lit(n)).otherwise(first)
    near = left.join(right, (F.col("l_n") == F.col("r_n")) & (F.col("l_x") == F.col("r_x")) & (F.col("l_y") == F.col("r_y")) & (F.col("l_size") == F.col("r_size")))
    near = near.where((F.col("l_key") != F.col("r_key")) & (first == F.col("l_n")) & (distance <= 2))
    near = near.select("l_key", "r_key", F.array_except("l_w", "r_w").alias("a"), F.array_except("r_w", "l_w").alias("b")).where((F.size("a") == 1) & (F.size("b") == 1))
    word = lambda c: F.substring_index(F.get(c, F.lit(0)), " ", 1)
    near = near.where(one_edit(word("a"), word("b"))).select(F.col("l_key").alias("key_t"), F.col("r_key").alias("key_e"))
    return same.unionByName(near)


def split_overlaps(
    df: DataFrame, record_id: str = "query_id", text: str = "query", split: str = "split_name", source: str = "source",
    train: str = "train", evaluation: tuple[str, ...] = ("validation", "test"),
) -> DataFrame:
    """(train_id, eval_id, eval_split, eval_source, train_source, exact): every pair of a train and an evaluation record that ask the same.

    Two records ask the same if they have the same words as often, or all but one word of each, and these two are ``one_edit``
    apart. Records without any word are the same as each other only. Null ids, texts or splits take no part; a null source
    is kept as null. Repeated rows count once, empty tables give an empty result, other columns play no part.
    """
    rows = records(df, record_id, text, split, source, train, list(evaluation))
    links = class_links(rows, train)
    t = rows.where(F.col("split") == train).select(F.col("key").alias("key_t"), F.col("rid").alias("train_id"), F.col("source").alias("train_source"))
    e = rows.where(F.col("split") != train).select(F.col("key").alias("key_e"), F.col("rid").alias("eval_id"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    return links.join(t, "key_t").join(e, "key_e").select("train_id", "eval_id", "eval_split", "eval_source", "train_source", (F.col("key_t") == F.col("key_e")).alias("exact"))


def overlap_report(
    df: DataFrame, record_id: str = "query_id", text: str = "query", split: str = "split_name", source: str = "source",
    train: str = "train", evaluation: tuple[str, ...] = ("validation", "test"),
) -> DataFrame:
    """Per evaluation split and source: records, overlapping records, pairs. Counted by class; no pairs are made for it."""
    rows = records(df, record_id, text, split, source, train, list(evaluation))
    links = class_links(rows, train)
    n_train = rows.where(F.col("split") == train).groupBy(F.col("key").alias("key_t")).agg(F.count(F.lit(1)).alias("n_t"))
    hits = links.join(n_train, "key_t").groupBy(F.col("key_e").alias("key")).agg(F.sum("n_t").alias("partners"), F.max((F.col("key_t") == F.col("key_e")).cast("int")).alias("exact"))
    groups = rows.where(F.col("split") != train).groupBy("key", "split", "source").agg(F.count(F.lit(1)).alias("n"))
    both = groups.join(hits, "key", "left")
    found = F.col("partners").isNotNull()
    return both.groupBy(F.col("split").alias("eval_split"), F.col("source").alias("eval_source")).agg(
        F.sum("n").alias("records"), F.coalesce(F.sum(F.when(found, F.col("n"))), F.lit(0)).alias("overlapping"),
        F.coalesce(F.sum(F.when(F.col("exact") == 1, F.col("n"))), F.lit(0)).alias("exact_overlapping"),
        F.coalesce(F.sum(F.col("n") * F.col("partners")), F.lit(0)).alias("pairs"),
    )
