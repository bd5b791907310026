"""Column expressions on text, paths and identifiers. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out when queries are compared.
QUERY_STOP_WORDS = "a an the is are was were be been being have has had do does did will would could should may might must can of in to for with on at by from as into and or but not no if then else when where what which who how why this that these those it its".split()

# Directories that are never walked.
EXCLUDED_DIRS = "node_modules .git .svn .hg dist build out .next .nuxt coverage __pycache__ venv .venv target vendor .idea .vscode .cache .turbo .expo".split()


def token_estimate(text: Column) -> Column:
    """Four characters to a token, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def content_id(*parts: Column, size: int = 64) -> Column:
    """Hex digits of sha256 over the parts, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, size)


def ascii_words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def normalised_query(query: Column) -> Column:
    """Lower case, split at white space, without one-letter and stop words, sorted, joined by blanks."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(QUERY_STOP_WORDS))
    return F.array_join(F.array_sort(words), " ")


def query_hash(query: Column) -> Column:
    return F.substring(F.sha2(normalised_query(query), 256), 1, 16)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words; 1 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def error_words(message: Column) -> Column:
    """Distinct words of more than two signs, without punctuation."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(message), r"[^a-z0-9_\s]", " "), r"\s+"), lambda w: F.length(w) > 2))


def glob_pattern(glob: str, single: str = "[^/]*") -> str:
    """A glob as a regular expression over a whole path: ** crosses directories, * doesn't, ? is one sign."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        c = glob[i]
        out.append(single if c == "*" else "." if c == "?" else "\\" + c if c in r".+()[]{}^$|\\" else c)
        i += 1
    return "^" + "".join(out) + "$"


def glob_match(path: Column, glob: str) -> Column:
    return path.rlike("(?i)" + glob_pattern(glob))


def is_excluded(path: Column, dirs: list[str] | None = None) -> Column:
    """Any directory of the path is an excluded one."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in dirs or EXCLUDED_DIRS]))


# By language the names of test files, the directories of tests and the names of test symbols.
TEST_FILES = {
    "typescript": r"[._](test|spec)\.[tj]sx?$", "javascript": r"[._](test|spec)\.jsx?$", "python": r"(^|/)test_[^/]*\.py$|_test\.py$|(^|[^a-z])test\.py$", "go": r"_test\.go$", "rust": r"_test\.rs$|(^|[^a-z])tests\.rs$",
    "java": r"(Test|Tests|TestCase|IT)\.java$", "c": r"_tests?\.c$|test_[^/]*\.c$", "cpp": r"_test\.(cpp|cc|cxx)$|test_[^/]*\.cpp$|Test\.cpp$",
}
TEST_DIRS = {
    "typescript": r"(^|/)(__tests__|test|tests|testing)/", "javascript": r"(^|/)(__tests__|test|tests|testing)/", "python": r"(^|/)(tests?|testing)/", "go": r"(^|/)testdata/", "rust": r"(^|/)tests/",
    "java": r"(^|/)tests?/", "c": r"(^|/)tests?/", "cpp": r"(^|/)(tests?|gtest)/",
}
TEST_SYMBOLS = {
    "typescript": r"(?i)^test_|^(it|describe|beforeEach|afterEach|beforeAll|afterAll)$", "javascript": r"(?i)^test_|^(it|describe)$", "python": r"^test_|^Test[A-Z]", "go": r"^(Test|Benchmark|Example)[A-Z]", "rust": r"^test_",
    "java": r"^(test|should)[A-Z]", "c": r"^[tT]est_", "cpp": r"^TEST(_F)?$|(?i)^test_",
}
LANGUAGE_OF_TESTS = {"ts": "typescript", "tsx": "typescript", "mts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp"}


def _by_language(language: Column, subject: Column, patterns: dict[str, str]) -> Column:
    hits = [(language == name) & subject.rlike(p) for name, p in patterns.items()]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def test_language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGE_OF_TESTS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.substring_index(path, ".", -1)))


def is_test_path(path: Column) -> Column:
    """A test file by the rules of its language, which its ending tells: by its name or a directory. Other files are none."""
    language = test_language(path)
    return _by_language(language, path, TEST_FILES) | _by_language(language, path, TEST_DIRS)


def is_test_symbol(name: Column, language: Column) -> Column:
    """A test by the name of the symbol, by the rules of its language."""
    return _by_language(language, name, TEST_SYMBOLS)


def language_of(path: Column) -> Column:
    """Language by file ending; null if unknown."""
    by = {
        "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "go": "go", "rs": "rust", "sh": "shell", "bash": "shell",
        "sql": "sql", "yaml": "yaml", "yml": "yaml", "md": "markdown", "ini": "ini", "cfg": "ini", "env": "ini", "java": "java", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "php": "php",
    }
    pairs = [F.lit(x) for kv in by.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.substring_index(path, ".", -1)))


# Intent rules in the order in which they are tried: (intent, confidence, patterns).
INTENT_RULES = [
    ("symbol_lookup", 0.85, [r"^[A-Z][a-zA-Z0-9]*$", r"^[a-z][a-zA-Z0-9]*$", r"(?i)\b(function|class|type|interface|enum)\s+\w+", r"\bdef\s+\w+", r"\bfunc\s+\w+"]),
    ("structural", 0.80, [r"(?i)\b(calls?|invokes?|uses|imports?|extends?|implements?|inherits?|depends?)\b", r"(?i)\b(callers?|callees?|dependencies|dependents)\b", r"(?i)\b(methods|properties|fields)\s+(in|of|on)\b", r"(?i)(what|who)\s+(calls|uses|imports)\b"]),
    ("location", 0.75, [r"(?i)\b(in|under|inside)\s+(the\s+)?(\w+/|\w+\s+folder|\w+\s+directory)", r"(?i)\b(tests?|specs?)\s+for\b", r"(?i)\b(files?|modules?)\s+(in|under)\b", r"\.(ts|js|py|go|rs|java)$"]),
    ("similarity", 0.70, [r"(?i)\b(similar|like|same\s+as|pattern)\b", r"(?i)\bexample\s+of\b", r"(?i)\bcode\s+(like|similar)\b"]),
]


def intent(query: Column) -> Column:
    """struct(intent, confidence) by the first rule that matches; semantic at 0.5 otherwise."""
    q = F.trim(query)
    out = F.struct(F.lit("semantic").alias("intent"), F.lit(0.5).alias("confidence"))
    for name, confidence, patterns in reversed(INTENT_RULES):
        hit = reduce(lambda a, b: a | b, [q.rlike(p) for p in patterns])
        out = F.when(hit, F.struct(F.lit(name).alias("intent"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def entities(query: Column) -> Column:
    """Distinct dotted, Pascal, camel and snake names and file paths, in this order."""
    patterns = [r"\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)\b", r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b", r"\b([a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+)\b", r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b", r"([\w-]+(?:/[\w.-]+)+)"]
    return F.array_distinct(F.concat(*[F.regexp_extract_all(query, F.lit(p), F.lit(1)) for p in patterns]))


def error_category(message: Column) -> Column:
    low = F.lower(message)
    rules = [
        ("timeout", r"time(d )?-?out|deadline"), ("permission", r"permission|denied|forbidden|unauthori[sz]ed|eacces"), ("not_found", r"not found|no such|enoent|missing|404"),
        ("syntax", r"syntax|parse|unexpected token"), ("type", r"type ?error|not assignable|cannot convert"), ("network", r"network|econn|socket|dns|unreachable"), ("validation", r"invalid|validation|required|schema"),
    ]
    out = F.lit("unknown")
    for name, pattern in reversed(rules):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def duration_band(ms: Column) -> Column:
    return F.when(ms.isNull(), "unknown").when(ms < 100, "instant").when(ms < 1000, "fast").when(ms < 10000, "medium").when(ms < 60000, "slow").otherwise("very_slow")


def fuzzy_match(a: Column, b: Column) -> Column:
    """Equal or contained either way, over lower-case letters and digits; or equal file names without ending."""
    x, y = F.regexp_replace(F.lower(a), "[^a-z0-9]", ""), F.regexp_replace(F.lower(b), "[^a-z0-9]", "")
    stem = lambda c: F.regexp_replace(F.substring_index(F.lower(c), "/", -1), r"\.[^.]*$", "")
    return (x == y) | ((x != "") & y.contains(x)) | ((y != "") & x.contains(y)) | (stem(a) == stem(b))


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def version_parts(version: Column) -> Column:
    """struct(operator, major, minor, patch) of a version or range; absent numbers are null."""
    def number(group: int) -> Column:
        return F.nullif(F.regexp_extract(version, r"^\s*([\^~<>=!]*)\s*v?(\d+)(?:\.(\d+))?(?:\.(\d+))?", group), F.lit("")).try_cast("int")

    return F.struct(
        F.regexp_extract(version, r"^\s*([\^~<>=!]*)", 1).alias("operator"), number(2).alias("major"), number(3).alias("minor"), number(4).alias("patch"),
    )


def document_class(text: Column) -> Column:
    """api_reference with three marks of an interface or more, best_practice with two of advice, else framework_doc."""
    api = [r"\bfunction\b|\bdef \w", r"\breturns?\b", r"\bparam(eter)?s?\b", r"\bmethod\b", r"\bclass \w", r"=>|->", r"\w+\([^)]*\)"]
    advice = [r"\bbest practice", r"\brecommend", r"\bshould\b", r"\bavoid\b", r"\bprefer\b", r"\bpattern\b", r"\bmust\b"]
    low = F.lower(text)
    count = lambda ps: reduce(lambda a, b: a + b, [low.rlike(p).cast("int") for p in ps])
    return F.when(count(api) >= 3, "api_reference").when(count(advice) >= 2, "best_practice").otherwise("framework_doc")


def rolling_hash_bucket(text: Column, buckets: int = 100) -> Column:
    """abs(h) modulo ``buckets`` with h = 31 h + code point in 32 bits: assignment to experiment groups."""
    wrap = lambda x: F.pmod(x + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: wrap(acc * 31 + F.ascii(c)))
    return (F.abs(h) % buckets).cast("int")


def token_overlap(made: Column, original: Column) -> Column:
    """Share of the original's distinct words that were made."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9_]+"), lambda w: w != ""))
    a, b = words(made), words(original)
    return F.when(F.size(b) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(b))
