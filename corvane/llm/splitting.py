"""Oversized texts cut into pieces under a size limit, at the starts of units where possible, with repeated lines.

Where units begin is told by a small lexer per family of languages that knows strings, comments, heredocs and fences. Sizes
are prefix sums over lines; boundaries are a sorted array, in which the last one under the limit is found by binary search.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# File endings and spellings of languages, by family.
FAMILIES = {
    "python": "python py python3 pyi pyx", "js": "javascript typescript js ts jsx tsx mjs cjs mts cts ecmascript node", "go": "go golang", "rust": "rust rs",
    "shell": "shell bash sh zsh ksh", "sql": "sql plsql psql ddl", "yaml": "yaml yml", "ini": "ini env dotenv cfg conf properties toml editorconfig", "markdown": "markdown md mdx",
    "c": "java c cc cpp cxx h hpp cs csharp kotlin kt swift scala php",
}
FAMILY = {word: family for family, words in FAMILIES.items() for word in words.split()}

_OPEN = {
    "python": re.compile(r"#|[rbuf]{0,2}(\"\"\"|'''|\"|')", re.I),
    "js": re.compile(r"//|/\*|`|\"|'"),
    "go": re.compile(r"//|/\*|`|\"|'(?:\\.|[^'\\])+'"),
    "rust": re.compile(r"//|/\*|b?r(#*)\"|\"|'(?:\\.[^']*|[^'\\])'"),
    "c": re.compile(r"//|/\*|\"|'(?:\\.|[^'\\])+'"),
    "shell": re.compile(r"(?:(?<=\s)|^)#|<<<|<<-?[ \t]*(?:\\?([A-Za-z_]\w*)|'([^'\n]+)'|\"([^\"\n]+)\")|\\.|'|\"", re.M),
    "sql": re.compile(r"--|/\*|'|\"|\$(\w*)\$|;"),
}
_COMMENT = {"python": "#", "js": "//", "go": "//", "rust": "//", "c": "//", "shell": "#", "sql": "--", "yaml": "#", "ini": "#;"}

_JS_LEAD = r"(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?"
_UNIT = {
    "python": re.compile(r"(?:async[ \t]+)?def[ \t]+\w|class[ \t]+\w|\w+[ \t]*(?::[^=\n]+)?=[ \t]*lambda\b"),
    "js": re.compile(
        _JS_LEAD + r"(?:async[ \t]+)?function\b|" + _JS_LEAD + r"(?:abstract[ \t]+)?class\b|" + _JS_LEAD + r"interface[ \t]+\w|"
        r"(?:export[ \t]+)?(?:default[ \t]+|(?:const|let|var)[ \t]+[\w$]+[ \t]*(?::[^=\n]+(?:=>[^=\n]+)?)?=[ \t]*|(?:module\.)?exports(?:\.[\w$]+)?[ \t]*=[ \t]*)"
        r"(?:async[ \t]*)?(?:function\b|class\b|(?:<[^>\n]*>)?\([^\n]*?\)[ \t]*(?::[^\n]+?)?=>|\([^)\n]*$|[\w$]+[ \t]*=>)"
    ),
    "go": re.compile(r"func\b|type[ \t]+\w+(?:\[[^\]\n]*\])?[ \t]+(?:struct|interface)\b|var[ \t]+\w+[ \t]*=[ \t]*func\b"),
    "rust": re.compile(r"(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:default[ \t]+)?(?:const[ \t]+)?(?:async[ \t]+)?(?:unsafe[ \t]+)?(?:extern[ \t]+\"[^\"]*\"[ \t]+)?(?:fn|struct|enum|trait|union)[ \t]+\w|(?:unsafe[ \t]+)?impl\b"),
    "c": re.compile(r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|data|export|partial|inline|extern|unsafe|virtual|override|async)[ \t]+)*(?:class|interface|struct|enum|record|object|trait|fun|func|function)[ \t]+\w|(?!return\b|else\b|typedef\b)[A-Za-z_][\w:<>,*&\[\] \t]*[ \t*&]\w+[ \t]*\([^;\n]*(?:\{|$)"),
    "shell": re.compile(r"function[ \t]+[\w:.-]+|[\w:.-]+[ \t]*\([ \t]*\)"),
    "yaml": re.compile(r"(?:[^\s#'\"\-\[\]{}&*!|>%@`,?:][^#\n]*?|\"[^\"\n]*\"|'[^'\n]*')[ \t]*:(?:[ \t]|$)"),
    "ini": re.compile(r"\[[^\]\n]+\]"),
    "markdown": re.compile(r" {0,3}#{1,6}(?:[ \t]|$)"),
}
_DECORATION = re.compile(r"@|#!?\[")


def family(path: str | None, language: str | None) -> str:
    """By the file's ending, else by the language column; '' if neither is known."""
    end = (path or "").rsplit("/", 1)[-1].lower()
    end = end.rsplit(".", 1)[-1] if "." in end else ""
    return FAMILY.get(end) or FAMILY.get((language or "").strip().lower(), "")


def _skip(text: str, kind: str, m: re.Match) -> tuple[int, bool]:
    """(end of the string or comment that opens at m, whether it is a comment)."""
    token, at, n = m.group(), m.end(), len(text)

    def until(mark: str, escapes: bool) -> int:
        i = at
        while (i := text.find(mark, i)) >= 0:
            back = 0
            while escapes and text[i - 1 - back] == "\\" and i - 1 - back >= at:
                back += 1
            if back % 2 == 0:
                return i + len(mark)
            i += 1
        return n

    line = text.find("\n", at)
    line = n if line < 0 else line
    if token in ("#", "//", "--"):
        return line, True
    if token == "/*":
        if kind != "rust":
            return until("*/", False), True
        depth, i = 1, at
        while depth and (x := re.compile(r"/\*|\*/").search(text, i)):
            depth, i = depth + (1 if x.group() == "/*" else -1), x.end()
        return (i if not depth else n), True
    if kind == "python":
        q = m.group(1)
        return (until(q, True) if len(q) == 3 else min(until(q, True), line)), False
    if token == "`":
        return until("`", kind == "js"), False
    if kind == "rust" and m.group(1) is not None:
        return until('"' + m.group(1), False), False
    if kind == "shell":
        tag = m.group(1) or m.group(2) or m.group(3)
        if tag:
            end = re.compile(r"^\t*" + re.escape(tag) + r"[ \t]*\r?$", re.M).search(text, line)
            return (end.end() if end else n), False
        if token in ("'", '"'):
            return until(token, token == '"'), False
        return at, False
    if kind == "sql":
        if token in ("'", '"'):
            return until(token, False), False
        return (until(token, False) if token != ";" else at), False
    if token == '"':
        end = until('"', True)
        return (end if kind in ("rust", "shell") else min(end, line)), False
    if token == "'":
        return min(until("'", True), line), False
    return at, False


def _lexed(text: str, kind: str, starts: list[int]) -> tuple[list[bool], list[bool], list[int]]:
    """Per line: does it begin inside a string or comment; is it nothing but a comment; offsets of statement ends (SQL)."""
    inside, comment, ends = [False] * len(starts), [False] * len(starts), []
    at, opener = 0, _OPEN[kind]
    while m := opener.search(text, at):
        if m.group() == ";":
            ends.append(m.start())
            at = m.end()
            continue
        end, is_comment = _skip(text, kind, m)
        first, last = bisect_right(starts, m.start()) - 1, bisect_right(starts, max(m.start(), end - 1)) - 1
        for i in range(first + 1, last + 1):
            inside[i] = True
        if is_comment and m.start() == starts[first]:
            tail = text[end : text.find("\n", end) if text.find("\n", end) >= 0 else len(text)]
            for i in range(first, last + 1 if not tail.strip() else last):
                comment[i] = True
        at = max(end, m.end())
    return inside, comment, ends


def unit_lines(text: str, path: str | None = None, language: str | None = None) -> list[int]:
    """Line numbers (from 0) where units begin: functions, classes, statements, keys, sections, headings.

    Comment, attribute and decorator lines right above a unit belong to it. Text in strings, heredocs, comments and fences
    begins none. A language that is not known has no units.
    """
    kind = family(path, language)
    if not kind or not text:
        return []
    text = text.replace("\r\n", " \n")  # keeps offsets
    lines = text.split("\n")
    starts = [0, *accumulate(len(x) + 1 for x in lines[:-1])]
    found: list[int] = []
    if kind == "markdown":
        fence, comment, inside = "", [False] * len(lines), []
        for i, line in enumerate(lines):
            if m := re.match(r" {0,3}(`{3,}|~{3,})", line):
                if not fence:
                    fence = m.group(1)
                elif m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not line.strip(" `~"):
                    fence = ""
                continue
            if not fence:
                if _UNIT[kind].match(line):
                    found.append(i)
                comment[i] = bool(re.match(r"<!--.*-->\s*$", line))
    elif kind in ("yaml", "ini"):
        comment = [x[:1] in tuple(_COMMENT[kind]) for x in lines]
        quote = ""
        for i, line in enumerate(lines):
            if kind == "yaml":  # a quoted scalar over several lines
                body = line if quote else re.sub(r"\"(?:\\.|[^\"\\])*\"|(?<![\w])'(?:''|[^'])*'|(?:^|\s)#.*", "", line)
                if quote:
                    quote = "" if quote in line else quote
                    continue
                if m := re.search(r":[ \t]+([\"'])", body):
                    quote = m.group(1)
            if _UNIT[kind].match(line):
                found.append(i)
    else:
        inside, comment, ends = _lexed(text, kind, starts)
        if kind == "sql":
            fresh, e = True, 0
            for i, line in enumerate(lines):
                if fresh and line.strip() and not inside[i] and not comment[i] and not line.lstrip().startswith(("--", "/*")):
                    found.append(i)
                    fresh = False
                stop = starts[i] + len(line)
                while e < len(ends) and ends[e] < stop:
                    fresh, e = True, e + 1
                    rest = re.sub(r"--.*|/\*.*", "", text[ends[e - 1] + 1 : stop]).strip(" ;\r")
                    if rest and not (e < len(ends) and ends[e] < stop):
                        fresh = False
        else:
            unit = _UNIT[kind]
            found = [i for i, line in enumerate(lines) if line and not inside[i] and unit.match(line)]
    out = []
    for i in found:
        low = out[-1] + 1 if out else 0
        while i > low and (comment[i - 1] or kind in ("python", "rust", "js", "c") and _DECORATION.match(lines[i - 1]) and not inside[i - 1]):
            i -= 1
        if kind == "shell" and i == 0 and lines[0].startswith("#!") and found[0] != 0 and not out:
            pass
        out.append(i)
    return out


def pieces(text: str, limit: int, overlap: int, boundaries: list[int]) -> list[tuple[int, int, int, int, str]]:
    """(first line, last line, begin, end, cut) of each piece: lines from 0, offsets in the text; cut: unit, line, hard or end.

    No piece is longer than ``limit``. A piece ends before the last unit that still fits, else before the last line that
    fits; a line that is longer than the limit by itself is cut hard. Each piece begins with the last ``overlap`` lines of
    the one before, with fewer where they would leave no room for a further line, and with none after a hard cut.
    """
    lines = text.split("\n")
    sums = [0, *accumulate(len(x) + 1 for x in lines)]  # offset of each line; of the end, plus one
    n, marks, out = len(lines), sorted(boundaries), []
    start = done = 0  # first line of the piece, first line not in a piece yet
    while done < n:
        room = bisect_right(sums, sums[start] + limit + 1) - 1  # lines before this one fit
        if room >= n:
            out.append((start, n - 1, sums[start], sums[n] - 1, "end"))
            break
        if room <= done:
            if start < done:
                start += 1
                continue
            at, stop = sums[done], sums[done + 1] - 1
            while at < stop:
                out.append((done, done, at, min(at + limit, stop), "hard"))
                at += limit
            start = done = done + 1
            continue
        b = bisect_right(marks, room) - 1
        cut, kind = (marks[b], "unit") if b >= 0 and marks[b] > done else (room, "line")
        out.append((start, cut - 1, sums[start], sums[cut] - 1, kind))
        start, done = max(start, cut - overlap), cut
    return out


def _unit_rows(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nos = [], []
            for i, text, path, language, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = unit_lines(text, path, language)[1:]
                ids += [i] * len(own)
                nos += [(start or 0) + x for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(nos, pa.int32())], ["id", "line_no"])

    return run


def _piece_rows(limit: int, overlap: int):
    schema = pa.schema([("id", pa.string()), ("piece_no", pa.int32()), ("file_path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string()), ("cut", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text, path, language, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for no, (first, last, a, e, cut) in enumerate(pieces(text, limit, overlap, unit_lines(text, path, language))):
                    rows.append((i, no, path, (start or 0) + first, (start or 0) + last, text[a:e], cut))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)

    return run


def _oversized(df: DataFrame, limit: int, row_id: str, content: str, path: str, language: str, start: str) -> DataFrame:
    rows = df.where(F.col(row_id).isNotNull() & (F.length(content) > limit))
    return rows.select(F.col(row_id).cast("string").alias("id"), F.col(content).alias("content"), F.col(path).alias("path"), F.col(language).alias("language"), F.col(start).cast("int").alias("start"))


def unit_starts(df: DataFrame, limit: int, row_id: str = "id", content: str = "content", path: str = "file_path", language: str = "language", start: str = "start_line") -> DataFrame:
    """(id, line_no): file lines where a unit begins in the texts longer than ``limit`` characters, without each text's first unit.

    Null ids and contents are left out; a null start line counts as 0; the family of a language comes from the file's ending,
    else from the language. Rows repeated under one id count once. Empty tables give an empty result.
    """
    return _oversized(df, limit, row_id, content, path, language, start).mapInArrow(_unit_rows(limit), "id string, line_no int").distinct()


def split_oversized(
    df: DataFrame, limit: int, overlap: int, row_id: str = "id", content: str = "content", path: str = "file_path", language: str = "language", start: str = "start_line",
) -> DataFrame:
    """(id, piece_no, file_path, start_line, end_line, content, cut): the pieces of every text longer than ``limit`` characters.

    See ``pieces`` for the cuts. end_line is counted from the text, so that a null or wrong one does no harm. Nulls and
    repeats as in ``unit_starts``; other columns play no part.
    """
    schema = "id string, piece_no int, file_path string, start_line int, end_line int, content string, cut string"
    return _oversized(df, limit, row_id, content, path, language, start).mapInArrow(_piece_rows(limit, overlap), schema).dropDuplicates(["id", "piece_no"])
