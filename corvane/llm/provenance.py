"""Source files that were not written by hand: generated, minified, copied in, or data saved as code.

Identifier character n-gram models are trained per language over all chunks. Each file is then measured as a whole:
- mangled names: mean cross-entropy of its identifiers under the model of its language, with their length;
- template-like names: how few of its words are names at all, and how few different ones, against its literals;
- foreign naming: how far the naming style (camel, snake, Pascal, upper) differs from that of its repository and language;
- what it says of itself in the comment at its head, and where it lies.
All measures are sums over chunks, so that no file is ever put together.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.splitting import family
from corvane.session import written

IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
LITERAL = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|\b(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\b")
COMMENT = re.compile(r"\s*(?:/\*[*!]*|\*/?|//[/!]*|#+!?|--+|;+|<!--|\"\"\"|'''|%+)\s?")
# What generators write at the head of their output, and what copies of other people's work carry there.
GENERATED = re.compile(
    r"@generated\b|<auto-?generated\b|^\W*(?:this (?:file|code) (?:is|was) )?(?:auto(?:matically)?[- ]?generated)\b(?!\s+(?:stubs|files|code|tables)\b.*\b(?:stay|are|in step|skipped))|"
    r"\bcode generated by\b|^\W*generated (?:on|by|from|with|at|automatically|using|code|file)\b|\bdo not (?:edit|modify)\b(?!\s+\S+\.\w+\s+by hand)(?=\W*$|.*\bgenerated\b)|"
    r"(?:^\W*(?:this (?:file|code|module|source) (?:is|was|has been) )?|\b(?:is|was|been) )(?:machine|tool|script|computer|auto(?:matically)?)[- ]?(?:written|made|created|produced|emitted)\b(?=\W*$|\W*(?:from|by|with|via|using|on|at)\b|[.,;:!(])|"
    r"\b(?:manual|hand|local) (?:edits|changes) (?:are|will be) (?:over-?written|lost)|\bchanges will be (?:lost|overwritten)\b|\boutput of \S+\W+(?:regenerate|do not)|\bregenerate instead of\b|\bproduced (?:by|with) \S+ v?\d",
    re.I,
)
COPIED = re.compile(
    r"@license\b|@preserve\b|\bunmodified copy of\b|\bvendored (?:copy|from)\b|\bcopied (?:verbatim )?from\b|\breleased under the\b.*\blicen[cs]e\b|"
    r"\b(?:imported|taken|mirrored|pulled|synced|fetched|forked|downloaded|extracted) (?:\w+ ){0,3}from\b.*https?://\S+(?=.*(?:\b(?:tag|commit|rev|revision|release|version)\b|\bv?\d+\.\d+))|"
    r"\bv?\d+\.\d+(?:\.\d+)?\s*[|(,-]\s*\(?(?:MIT|BSD|ISC|Apache|GPL|LGPL|MPL|Unlicense|Zlib)\b|\b(?:MIT|BSD-\d-Clause|ISC|Apache-2\.0|MPL-2\.0)\b.*https?://\S*licen[cs]e|\bthird[- ]party (?:code|copy|library)\b.*\bdo not\b",
    re.I,
)
GENERATED_PATH = re.compile(r"(?:\.generated\.\w+|\.gen\.\w+|_gen\.\w+|_generated\.\w+|_pb2(?:_grpc)?\.pyi?|\.pb\.\w+|_pb\.\w+|\.g\.(?:dart|cs|ts)|\.designer\.cs|_string\.go|zz_generated[^/]*|\.freezed\.dart)$", re.I)
COPIED_PATH = re.compile(r"(?:^|/)(?:vendor|node_modules|third[_-]party|bower_components|site-packages|Godeps|Pods)/|(?:^|/)(?:external|deps|thirdparty|extern|contrib)/[^/]*[.@-][^/]*/", re.I)
MINIFIED_PATH = re.compile(r"[.-]min\.\w+$", re.I)
STYLES = ("camel", "snake", "pascal", "upper", "short", "flat")
#: Cross-entropy in bits a sign above which a name is mangled; measured means over hand-written files lie near 3.
MANGLED_BITS, MANGLED_SHARE = 4.2, 0.45
DATA_SHARE, FOREIGN = 0.6, 0.8


@lru_cache(maxsize=200_000)
def style(name: str) -> str:
    core = name.strip("_$")
    if len(core) <= 2:
        return "short"
    if "_" in core:
        return "upper" if core.isupper() else "snake"
    if core.isupper():
        return "upper"
    if core[0].isupper():
        return "pascal"
    return "camel" if any(c.isupper() for c in core) else "flat"


def grams(name: str) -> list[tuple[str, str]]:
    """(two signs before, sign) along a name; digits are one sign."""
    s = "^^" + re.sub(r"\d", "0", name) + "$"
    return [(s[i - 2 : i], s[i]) for i in range(2, len(s))]


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n-grams of the identifiers of each language; each name counts once per chunk."""
    total: dict[str, Counter] = {}
    for f in frames:
        for path, language, text in zip(f["path"], f["language"], f["content"], strict=True):
            own = total.setdefault(family(path, language) or "other", Counter())
            own.update(set(IDENTIFIER.findall(LITERAL.sub(" ", text))))
    rows: Counter = Counter()
    for language, names in total.items():
        for name, n in names.items():
            for before, sign in grams(name):
                rows[language, before, sign] += n
    yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["language", "before", "sign", "n"])


class NameModel:
    """Interpolated trigrams of signs; bits a sign of a name."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.pair: dict[str, int] = Counter()
        self.tri: dict[tuple[str, str], int] = Counter()
        self.one: dict[tuple[str, str], int] = Counter()
        self.last: dict[str, int] = Counter()
        self.signs: dict[str, int] = Counter()
        for before, sign, n in rows:
            self.tri[before, sign] += n
            self.pair[before] += n
            self.one[before[1], sign] += n
            self.last[before[1]] += n
            self.signs[sign] += n
        self.total = sum(self.signs.values()) or 1
        self.cache: dict[str, float] = {}

    def bits(self, name: str) -> float:
        if (b := self.cache.get(name)) is None:
            b, own = 0.0, grams(name)
            for before, sign in own:
                p = (self.signs.get(sign, 0) + 0.5) / (self.total + 50)
                p = (self.one.get((before[1], sign), 0) + 5 * p) / (self.last.get(before[1], 0) + 5)
                p = (self.tri.get((before, sign), 0) + 5 * p) / (self.pair.get(before, 0) + 5)
                b -= math.log2(p)
            b /= len(own)
            if len(self.cache) < 500_000:
                self.cache[name] = b
        return b


#: A comment over several lines, by its opening: what ends it.
BLOCKS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
PRELUDE = re.compile(r"\s*(?:package|import|using|use|namespace|library|from\s+\S+\s+import|#\s*(?:include|pragma))\b|\s*[\"']use strict[\"']|\s*<\?php")
#: The marks that count behind package and import lines as well.
MARK = re.compile(r"^\W*(?:code generated\b.*\bdo not edit\b|@generated\b|<auto-?generated\b)", re.I)


def head_says(text: str) -> tuple[bool, bool, bool]:
    """(generated, copied, open): what the comments before the first line of code say, and that no code follows them here.

    Behind package or import lines only MARK counts.
    """
    made = copied = code = False
    closing = ""
    for line in text.replace("\r", "").split("\n"):
        if not line.strip():
            continue
        rest = ""
        if closing:
            said, end, rest = line.partition(closing)
            closing = "" if end else closing
            said = re.sub(r"^\s*\*?\s?", "", said)
        else:
            m = COMMENT.match(line)
            if not m:
                if not PRELUDE.match(line):
                    return made, copied, False
                code = True
                continue
            said = line[m.end() :]
            for opening, end in BLOCKS.items():
                if m.group().lstrip().startswith(opening):
                    said, shut, rest = said.partition(end)
                    closing = "" if shut else end
        said = said.rstrip()
        made = made or bool((MARK if code else GENERATED).search(said))
        copied = copied or (not code and bool(COPIED.search(said)))
        if rest.strip():
            return made, copied, False
    return made, copied, True


FEATURES = ["chars", "names", "kinds", "bits", "mangled", "short", "literal_chars", "lines", "long_chars", "data_lines", *[f"s_{s}" for s in STYLES]]
#: Names are template-like where so few of them, piece by piece, are different ones, or a sign of so many belongs to a name.
DIVERSITY, NAMES_A_SIGN = 0.35, 0.01
DATA_LINE = re.compile(r"\s*[\[\]{}(\"'\-+\d.][^=;]*[;\s]*$")


def measures(text: str, model: NameModel | None) -> list[float]:
    rest, literals = LITERAL.subn(" ", text)
    literal = len(text) - len(rest) + literals
    names = IDENTIFIER.findall(rest)
    kinds = Counter(names)
    bits = mangled = 0.0
    for name, n in kinds.items():
        if len(name) <= 2:
            mangled += n
        elif model:
            b = model.bits(name)
            bits += b * n
            mangled += n * (b > MANGLED_BITS)
    lines = text.split("\n")
    by = Counter()
    for name in kinds:
        by[style(name)] += 1
    data = 0
    if 2 * literal > len(text):  # lines of data are mostly literals
        data = sum(len(x) for x in lines if x.strip() and DATA_LINE.match(x) and not IDENTIFIER.search(LITERAL.sub("", x)))
    long_chars = sum(len(x) for x in lines if len(x) > 400 and not re.search(r"[\"'][^\"'\s]{300,}[\"']", x))
    return [float(len(text)), len(names), len(kinds), bits, mangled, sum(n for x, n in kinds.items() if len(x) <= 2), literal, len(lines), long_chars, data, *[by[s] for s in STYLES]]


def _measured(models: Broadcast):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = {k: NameModel(v) for k, v in models.value.items()}
        for f in frames:
            rows = []
            for path, language, text, start in zip(f["path"], f["language"], f["content"], f["start"], strict=True):
                kind = family(path, language) or "other"
                mark = hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
                rows.append((path, kind, start, *head_says(text), mark, *measures(text, by.get(kind))))
            yield pd.DataFrame(rows, columns=["path", "kind", "start", "made", "copied", "open", "mark", *FEATURES])

    return run


def name_counts(rows: DataFrame) -> dict[str, list[tuple[str, str, int]]]:
    """Counts of three signs by family of languages, over every identifier of every row. Bounded: by the signs of an alphabet, cubed."""
    counts = rows.mapInPandas(_counted, "language string, before string, sign string, n long").groupBy("language", "before", "sign").agg(F.sum("n").alias("n"))
    by: dict[str, list] = {}
    for r in counts.collect():
        by.setdefault(r[0], []).append((r[1], r[2], r[3]))
    return by


def file_measures(df: DataFrame, path: str = "file_path", content: str = "content", language: str = "language", start: str = "start_line") -> DataFrame:
    """One row per file: its measures, what its head says, and the distance of its naming style from its repository's and language's."""
    rows = df.where(F.col(path).isNotNull() & F.col(content).isNotNull())
    rows = rows.select(F.col(path).alias("path"), F.col(content).alias("content"), F.col(language).alias("language"), F.coalesce(F.col(start), F.lit(0)).cast("int").alias("start"))
    models = df.sparkSession.sparkContext.broadcast(name_counts(rows))
    schema = "path string, kind string, start int, made boolean, copied boolean, open boolean, mark string, " + ", ".join(f"{c} double" for c in FEATURES)
    # A piece written twice counts once.
    measured = rows.mapInPandas(_measured(models), schema).dropDuplicates(["path", "start", "mark"])
    sums = [F.sum(c).alias(c) for c in FEATURES]
    # The head of a file goes on through the pieces that hold nothing but comments.
    at = lambda c: F.min(F.when(c, F.col("start")))
    code = F.coalesce(at(~F.col("open")), F.lit(2**31 - 1))
    says = [(F.coalesce(at(F.col(c)), F.lit(2**31 - 1)) <= code).alias(c) for c in ("made", "copied")]
    any_mark = [F.max(c).alias(f"any_{c}") for c in ("made", "copied")]
    files = written(measured.groupBy("path").agg(F.min("kind").alias("kind"), *says, *any_mark, *sums))
    files = files.withColumn("repo", F.substring_index("path", "/", 1))
    shown = [s for s in STYLES if s not in ("short", "flat")]

    def shares(prefix: str, by: list[str]) -> DataFrame:
        total = sum((F.sum(f"s_{s}") for s in shown), F.lit(0.0))
        return files.groupBy(*by).agg(*[(F.sum(f"s_{s}") / F.greatest(total, F.lit(1.0))).alias(f"{prefix}_{s}") for s in shown])

    own = sum((F.col(f"s_{s}") for s in shown), F.lit(0.0))
    joined = files.join(shares("l", ["kind"]), "kind").join(shares("r", ["repo", "kind"]), ["repo", "kind"])
    far = lambda p: sum((F.abs(F.col(f"s_{s}") / F.greatest(own, F.lit(1.0)) - F.col(f"{p}_{s}")) for s in shown), F.lit(0.0)) / 2
    return joined.select("path", "kind", (F.col("made") & F.col("any_made")).alias("made"), (F.col("copied") & F.col("any_copied")).alias("copied"), *FEATURES, far("l").alias("from_language"), far("r").alias("from_repo"), own.alias("styled"))


def provenance(df: DataFrame, path: str = "file_path", content: str = "content", language: str = "language", start: str = "start_line") -> DataFrame:
    """(path, reason, rule): the files not written by hand; reason is generated, minified, vendored or data.

    rule: what told it: names (cross-entropy), diversity (few different names among literals), style (foreign naming), marker
    (the comments at the head) or path. A file is all rows of one path; its head are the pieces from the smallest start line
    (null counts as 0) to the first line of code. Null paths and contents are left out; an empty file is hand-written; rows
    written twice count once, but for the weights of the models. A hand-written file may speak of generated, minified or
    vendored code: only what a generator or licence would say at the head counts. An empty table gives an empty result.
    Other columns play no part.
    """
    f = file_measures(df, path, content, language, start)
    code = ~F.col("kind").isin("markdown", "yaml", "ini")
    named = F.greatest(F.col("names"), F.lit(1.0))
    size = F.greatest(F.col("chars"), F.lit(1.0))
    rules = {
        "names": ("minified", code & (F.col("mangled") / named >= MANGLED_SHARE) & (F.col("long_chars") / size >= 0.5)),
        "diversity": ("data", code & (F.col("chars") >= 200) & ((F.col("data_lines") / size >= DATA_SHARE) | ((F.col("literal_chars") / size >= DATA_SHARE) & ((F.col("kinds") / named <= DIVERSITY) | (F.col("names") / size <= NAMES_A_SIGN))))),
        "style": ("vendored", code & (F.col("from_repo") >= FOREIGN) & (F.col("from_language") >= FOREIGN) & (F.col("styled") >= 20)),
        "marker": ("generated", F.col("made")), "path": ("generated", F.col("path").rlike("(?i)" + GENERATED_PATH.pattern)),
        "marker of a copy": ("vendored", F.col("copied")), "path of a copy": ("vendored", F.col("path").rlike("(?i)" + COPIED_PATH.pattern)),
        "path of a bundle": ("minified", code & F.col("path").rlike("(?i)" + MINIFIED_PATH.pattern)),
    }
    found = F.coalesce(*[F.when(told, F.struct(F.lit(reason).alias("reason"), F.lit(rule).alias("rule"))) for rule, (reason, told) in rules.items()])
    return f.select("path", found.alias("found")).where("found is not null").select("path", "found.reason", "found.rule")
