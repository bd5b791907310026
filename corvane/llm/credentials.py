"""Credentials in source code and configuration: found by line, and blanked without touching anything else.

One Aho-Corasick automaton holds the openings of all grammars: token formats, key armor, connection strings, headers,
command flags and names of secrets. It runs over the text once, in overlapping windows. Token formats and key armor are read on
from the place of the hit, to whatever length; what needs a name or a command before it is read on its line. Spans are taken at
absolute offsets, and those that overlap become one. Every step is linear in the text, also where that is a single line.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = "REDACTED"
WINDOW, OVERLAP = 1 << 20, 1 << 12

# Public token formats (opening, whole token).
FORMATS = {
    "akia": r"A(?:KI|SI)A[0-9A-Z]{16}", "asia": r"A(?:KI|SI)A[0-9A-Z]{16}", "ghp_": r"gh[pousr]_[A-Za-z0-9]{30,}", "gho_": r"gh[pousr]_[A-Za-z0-9]{30,}",
    "ghu_": r"gh[pousr]_[A-Za-z0-9]{30,}", "ghs_": r"gh[pousr]_[A-Za-z0-9]{30,}", "ghr_": r"gh[pousr]_[A-Za-z0-9]{30,}", "github_pat_": r"github_pat_\w{22,}",
    "glpat-": r"glpat-[\w-]{16,}", "xox": r"xox[abeoprs]-[\w-]{10,}", "sk_live_": r"[sr]k_live_\w{12,}", "rk_live_": r"[sr]k_live_\w{12,}", "sk_test_": r"sk_test_\w{12,}",
    "sk-": r"sk-(?:proj-|ant-)?[\w-]{20,}", "pypi-": r"pypi-[\w-]{16,}", "npm_": r"npm_[A-Za-z0-9]{20,}", "aiza": r"AIza[\w-]{30,}", "hf_": r"hf_[A-Za-z0-9]{20,}",
    "sg.": r"SG\.[\w-]{16,}\.[\w-]{16,}", "eyj": r"eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{8,}", "dop_v1_": r"dop_v1_[0-9a-f]{32,}", "shpat_": r"shpat_[0-9a-fA-F]{32}",
    "whsec_": r"whsec_[A-Za-z0-9+/=]{16,}", "ya29.": r"ya29\.[\w-]{20,}", "hvs.": r"hvs\.[\w-]{20,}", "dckr_pat_": r"dckr_pat_[\w-]{20,}", "age-secret-key-": r"AGE-SECRET-KEY-1[0-9A-Z]{40,}",
}
# Words of names of secrets, and words that stand in the place of one.
STRONG = "password passwd passphrase pwd pass secret token cred creds credential credentials apikey accesskey secretkey authtoken idtoken passcode jwt".split()
BEFORE_KEY = "api access secret private signing sign encryption auth account service master client app license shared session admin webhook deploy storage consumer crypto hmac jwt ssh".split()
STAND_INS = "changeme change_me placeholder example dummy redacted todo fixme none null nil true false undefined empty optional required string secret password hidden masked removed here foo bar test".split()
FIELD_WORDS = set(STRONG) | {"api", "key", "access", "auth", "x", "user", "name", "header", "field", "id", "login", "db", "new", "old", "my", "client", "the", "authorization", "bearer", "basic", "admin", "username", "reset", "confirm", "private", "public", "signing", "current"}

ARMOR = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY( BLOCK)?-----")
ARMOR_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
KEY_LINES = re.compile(r"(?:[ \t\"'+\\n]*+[A-Za-z0-9+/=:,. -]{0,80}+[\"'+\\n; \t]*+\r?(?:\n|$))*+")
BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
URL = re.compile(r"(?<=[a-z0-9])://[^\s/:@'\"`<>]*:([^\s'\"`<>/@]+|[^\s'\"`<>@]+)@[\w\[]", re.I)
QUERY = re.compile(r"[?&;](?:[\w-]*(?:token|secret|password|passwd|signature|sig|key|auth|pwd))=([^\s&'\"`<>#)\]]+)", re.I)
SCHEME = re.compile(r"\b(bearer|basic|token)[ \t]+([\w+/.~=-]{8,})", re.I)
FLAG_P = re.compile(r"(?:mysql\w*|mariadb\w*|sshpass|psql|mysqldump)\b[^\n|;&]*?[ \t]-p[ \t]?(?:'([^']+)'|\"([^\"]+)\"|(\S+))")
FLAG_U = re.compile(r"(?:curl|wget|http|https)\b[^\n|;]*?[ \t](?:-u|--user)[ =]?['\"]?[^\s:'\"]+:([^\s'\"]+)")
LOGIN = re.compile(r"\blog-?in\b[^\n:=]{0,20}?(?:was|is|are|:|=|with)[ \t]+[^\s/]+[ \t]*(?:/|with password|password)[ \t]*([^\s'\"`]+)", re.I)
NAME = re.compile(r"[A-Za-z][\w.-]*")
QUOTED = re.compile(r"(?:[rbuf]{0,2})(\"\"\"|'''|\"|'|`)((?:\\.|(?!\1)[^\\\n])*)\1?", re.I)
#: What may stand between a name and its value: the end of the name's quotes or brackets, then a separator.
LINK = re.compile(r"(?:[\"'`\]]{0,3}[ \t]*(?::=|=>|->|==?|:)[ \t]*|[\"'`]?[ \t]*,[ \t]*(?:value[ \t]*[:=][ \t]*)?|\([ \t]*|[\"'`]?\)?[ \t]+(?:is|as|to)?[ \t]*(?::[ \t]*)?)")
TYPED = re.compile(r"[ \t]*:[ \t]*&?(?:'static[ \t]+)?(?:str|String|string|Option<\w+>|any|const char ?\*)[ \t]*=[ \t]*")
BARE = re.compile(r"[^\s'\"`,;)\]}>]+")


def words_of(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


@lru_cache(maxsize=65536)
def names_secret(name: str) -> str:
    """'' or the kind of secret that an identifier holds: its last words say so."""
    w = words_of(name.rsplit(".", 1)[-1] if not name.endswith(".") else name)
    while w and (w[-1].isdigit() or w[-1] in ("value", "val", "str", "literal", "plain", "b", "64", "hex")):
        w = w[:-1]
    if not w:
        return ""
    if w[-1] in ("password", "passwd", "passphrase", "pwd", "pw", "pass", "passcode") or "".join(w[-2:]) in ("passwd", "password"):
        return "password"
    if w[-1].endswith(("password", "passwd", "passphrase", "pwd")):
        return "password"
    if w[-1] in STRONG or "".join(w) in STRONG or w[-1].endswith(("apikey", "accesskey", "secretkey", "authtoken", "idtoken", "accesstoken")):
        return "secret"
    if w[-1] == "key" and len(w) > 1 and w[-2] in BEFORE_KEY:
        return "secret"
    return ""


#: Runs and words that stand in the place of a value.
STAND_IN = re.compile(r"x{4,}|\*{3,}|\.{3}|-{4,}|_{4,}|0{8,}|1234567(?:89)?0?|abcdef|your|example|changeme|change-me|placeholder|dummy|redacted|insert|replace|todo|vault|environ|getenv|secretstore|\bfake|sample_", re.I)


def varied(value: str) -> bool:
    """Goes back and forth between small letters, capitals and digits, as drawn values do and words don't."""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in value if c.isalnum()]
    return len(kinds) >= 6 and "d" in kinds and sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) >= 5


@lru_cache(maxsize=65536)
def stands_for_nothing(value: str) -> bool:
    """Placeholders, variables, references to a store, names of fields."""
    v = value.strip()
    low = v.lower()
    if len(v) < 5 or re.match(r"\$\w+$|\$[({]|%\w+%$|%[sd(]|<|\{\{?|#\{|@\w+$|[&*]\w+$", v) or "${" in v or "{{" in v or "$(" in v or "%(" in v or re.search(r"<[A-Za-z][\w .-]*>", v):
        return True
    if "://" in v and "@" not in v or low.startswith(("vault:", "env:", "env.", "ssm:", "aws:", "arn:", "secretsmanager:", "op://", "file:", "keyring:", "sops:", "ref+", "kms:", "gcp:", "process.", "os.", "data:", "sha256:", "sha1:", "md5:")) or re.fullmatch(r"(?:~|\.{1,2})?/(?:[\w.@-]+/)*[\w.@-]*", v) and not (v.count("/") == 1 and strong(v) and len(v) >= 24):
        return True
    if STAND_IN.search(low) and not varied(STAND_IN.sub("", v)):
        return True
    parts = words_of(v)
    if low in STAND_INS or parts and all(p in FIELD_WORDS or p in STAND_INS for p in parts):
        return True
    return len(set(v)) < 4


def strong(value: str) -> bool:
    """Looks drawn at random: long, with digits and letters mixed."""
    return len(value) >= 16 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and " " not in value and len(set(value)) > 7


def literal(value: str, kind: str) -> bool:
    """Is a literal of this kind of secret, as against a word, a name or a number."""
    if stands_for_nothing(value):
        return False
    letters, digits = any(c.isalpha() for c in value), any(c.isdigit() for c in value)
    odd = any(not c.isalnum() and c not in "_-./: " for c in value)
    if " " in value.strip() and not odd:
        return False
    if re.fullmatch(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+(?:\(.*)?|\w+\(.*", value):  # code, not text
        return False
    if kind == "password":
        mixed = re.search(r"[a-z]", value) and re.search(r"[A-Z]", value[1:])
        return len(value) >= 6 and letters and bool(digits or odd or (mixed and len(value) >= 8)) and not value.isdigit() and not re.fullmatch(r"[a-z]+(?:[_-][a-z0-9]+)*_?\d{0,4}", value)
    return len(value) >= 10 and letters and bool(digits or (re.search(r"[a-z]", value) and re.search(r"[A-Z]", value[1:]) and len(value) >= 16)) and not re.fullmatch(r"[a-z]+(?:[_-][a-z]+)*[_-]?\d{0,4}|[A-Z]+(?:_[A-Z]+)*_?\d{0,4}", value)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    kinds: dict[str, str] = {}
    for opening in FORMATS:
        kinds[opening] = "format"
    for word in ("password", "passwd", "passphrase", "passcode", "pwd", "pw", "pass", "secret", "token", "cred", "jwt", "key"):
        kinds[word] = "name"
    kinds |= {"-----begin ": "armor", "-----end ": "tail", "://": "url", "bearer": "scheme", "basic": "scheme", " -p": "flag_p", " -u": "flag_u", " --user": "flag_u", "login": "login"}
    for opening, kind in kinds.items():
        a.add_word(opening, (kind, len(opening), opening))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    return _automaton()


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_FORMAT = {k: re.compile(v) for k, v in FORMATS.items()}


def _value_after(line: str, at: int, kind: str, code: bool) -> tuple[int, int] | None:
    """Span of the literal that a name ending at ``at`` is given."""
    if kind == "field" or not (m := TYPED.match(line, at) or LINK.match(line, at)) or m.end() == at:
        return None
    link, at = m.group(), m.end()
    spaced = not re.search(r"[=:,(>]", link)
    if m := re.compile(r"(?:\$?\(|Some\(|String::from\(|str\(|\[\]byte\()?").match(line, at):
        at = m.end()
    if m := re.compile(r"(?i)(?:bearer|basic|token)[ \t]+").match(line, at):
        at = m.end()
    if (q := QUOTED.match(line, at)) and q.group(2):
        a, b = q.span(2)
        if m := re.compile(r"(?i)(?:bearer|basic|token)[ \t]+").match(line, a, b):
            a = m.end()
        value = line[a:b]
        return (a, b) if literal(value, kind) and not (spaced and not any(c.isdigit() for c in value)) else None
    if link.strip() in (",", "(") or not (b := BARE.match(line, at)):
        return None
    value = b.group().rstrip(".:\\")
    if re.match(r"[(\[.]", line[b.end() :]) or code and not (strong(value) and re.fullmatch(r"[\w+/=.-]+", value)):
        return None
    if spaced and not (strong(value) and not re.fullmatch(r"[0-9a-f]{40}", value)):
        return None
    return (at, at + len(value)) if literal(value, kind) else None


def _is_code(line: str, path: str) -> bool:
    """Bare words after a name are code here, not text."""
    return bool(re.search(r"\.(?:py|[cm]?[jt]sx?|go|rs|sql|java|rb|c|cc|cpp|h|cs|kt|swift|php)$", path, re.I)) and not re.match(r"\s*(?://|#|--|\*|/\*|;)", line)


def line_spans(line: str, kinds: set[tuple[str, str]], path: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the values on one line."""
    out: list[tuple[int, int, str]] = []
    for kind, opening in kinds:
        if kind == "format":
            for m in _FORMAT[opening].finditer(line):
                before = line[m.start() - 1] if m.start() else " "
                if not (before.isalnum() or before == "_") and not stands_for_nothing(m.group()) and (opening in ("akia", "asia") or any(c.isdigit() for c in m.group())) and "data:" not in line[max(0, m.start() - 40) : m.start()]:
                    out.append((*m.span(), opening.strip("_-.")))
    names = {k for k, _ in kinds}
    if "url" in names:
        out += [(*m.span(1), "url_password") for m in URL.finditer(line) if not stands_for_nothing(m.group(1)) or re.fullmatch(r"[^${<*x]{1,4}", m.group(1))]
        out += [(*m.span(1), "url_parameter") for m in QUERY.finditer(line) if literal(m.group(1), "secret")]
    if "scheme" in names or "name" in names:
        for m in SCHEME.finditer(line):
            v = m.group(2)
            if not stands_for_nothing(v) and (strong(v) if m.group(1).lower() != "basic" else len(v) >= 12 and len(v) % 4 == 0 and not v.islower() and bool(re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", v))):
                if m.group(1).lower() != "token" or re.search(r"(?i)authorization|header", line[: m.start()]):
                    out.append((*m.span(2), m.group(1).lower()))
    if "flag_p" in names:
        for m in FLAG_P.finditer(line):
            g = next(i for i in (1, 2, 3) if m.group(i))
            if literal(m.group(g), "password"):
                out.append((*m.span(g), "password"))
    if "flag_u" in names:
        out += [(*m.span(1), "password") for m in FLAG_U.finditer(line) if literal(m.group(1), "password")]
    if "login" in names:
        out += [(*m.span(1), "password") for m in LOGIN.finditer(line) if literal(m.group(1), "password")]
    if "name" in names:
        code = _is_code(line, path)
        for m in NAME.finditer(line):
            name = m.group().rstrip(".-")
            if kind := names_secret(name[-256:]):  # the last words decide
                if (m.start() and line[m.start() - 1] in "$%{") and not re.match(r"\s*=", line[m.end() :]):
                    continue
                if span := _value_after(line, m.start() + len(name), kind, code):
                    out.append((*span, kind))
    return out


def _merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for a, b, k in sorted(set(spans), key=lambda s: (s[0], -s[1], s[2])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, k))
    return out


def _armor(text: str, at: int) -> tuple[int, int, str] | None:
    """The body after a BEGIN mark of a private key, up to its END mark or the last line that looks like key material."""
    m = ARMOR.match(text, at)
    if not m:
        return None
    other = text.find("-----BEGIN", m.end())
    upto = other if other >= 0 else len(text)
    end = ARMOR_END.search(text, m.end(), upto)
    body = text[m.end() : end.start()] if end else text[m.end() : KEY_LINES.match(text, m.end(), upto).end()]
    if not BODY.search(body) or re.search(r"x{8}|\.\.\.|your|<", body, re.I):
        return None
    return m.end(), m.end() + len(body.rstrip()), "private_key"


def _parts(line: str) -> Iterator[tuple[int, int]]:
    """Windows over a long line. Each ends with a token, however long, and the next begins OVERLAP before that."""
    at = 0
    while True:
        end = min(len(line), at + 8192)
        end = TOKEN.match(line, end).end()
        yield at, end
        if end >= len(line):
            return
        at = end - OVERLAP


def _hits(text: str) -> Iterator[tuple[int, str, str]]:
    """(offset, kind, opening) of every opening; those in the overlap of two windows come twice."""
    for base in range(0, max(1, len(text) - OVERLAP if len(text) > WINDOW else 1), WINDOW - OVERLAP):
        window = text[base : base + WINDOW]
        low = window.lower()
        if len(low) != len(window):
            low = window.translate(_LOWER)
        for end, (kind, size, opening) in automaton().iter(low):
            yield base + end - size + 1, kind, opening


def _token(text: str, at: int, opening: str) -> tuple[int, int, str] | None:
    """The token that begins at ``at``, read as far as its format goes."""
    if at and (text[at - 1].isalnum() or text[at - 1] == "_") or not (m := _FORMAT[opening].match(text, at)):
        return None
    whole = m.group()
    if stands_for_nothing(whole) or not (opening in ("akia", "asia") or any(c.isdigit() for c in whole)) or "data:" in text[max(0, at - 40) : at].rsplit("\n", 1)[-1]:
        return None
    return (*m.span(), opening.strip("_-."))


def _tail(text: str, at: int) -> tuple[int, int, str] | None:
    """Lines of key material right before an END mark."""
    start = at
    while start > 0 and KEY_LINE.fullmatch(text, before := text.rfind("\n", 0, start - 1) + 1, start):
        start = before
    return (start, at, "private_key_tail") if start < at else None


def spans(text: str, path: str = "") -> list[tuple[int, int, str]]:
    """(begin, end, kind) of every credential value; those of private keys begin behind the BEGIN mark."""
    found: list[tuple[int, int, str]] = []
    ends = [m.start() for m in re.finditer("\n", text)]
    first_key = text.find("-----BEGIN")
    lines: dict[int, list[tuple[int, str, str]]] = {}
    for at, kind, opening in _hits(text):
        if kind == "armor":
            found += [span] if (span := _armor(text, at)) else []
        elif kind == "tail":
            if ARMOR_END.match(text, at) and not 0 <= first_key < at:
                found += [span] if (span := _tail(text, at)) else []
        else:
            if kind == "format":
                found += [span] if (span := _token(text, at, opening)) else []
            lines.setdefault(bisect_left(ends, at), []).append((at, kind, opening))
    for number, hits in lines.items():
        start, end = ends[number - 1] + 1 if number else 0, ends[number] if number < len(ends) else len(text)
        line = text[start:end]
        hits.sort()
        goes_on = (m := GOES_ON.search(line)) and (q := NEXT.match(text, end))
        for o, e in _parts(line):
            inside = hits[bisect_left(hits, (start + o,)) : bisect_left(hits, (start + e,))]
            own = {(kind, opening) for _, kind, opening in inside}
            if e == len(line) and goes_on and own:
                # A literal that goes on in the next line is judged whole, and taken up to the end of this line's part.
                joined = line[o : m.start()] + q.group(1) + m.group(1)
                found += [(start + o + a, start + o + min(b, m.start() - o), k) for a, b, k in line_spans(joined, own, path) if a < m.start() - o]
            elif own := {h for h in own if h[0] != "format"}:
                found += [(start + o + a, start + o + b, k) for a, b, k in line_spans(line[o:e], own, path)]
    return _merged(found)


KEY_LINE = re.compile(r"[ \t]*[A-Za-z0-9+/=]{16,}[ \t]*\r?\n")
TOKEN = re.compile(r"[^\s\"'`,;]*")
GOES_ON = re.compile(r"(?<=[\w+/=!-])([\"'`])[ \t]*[+.\\]?[ \t]*\\?\r?$")
NEXT = re.compile(r"\n[ \t]*[+.]?[ \t]*[\"'`]([^\s\"'`]+)[\"'`]")
#: A literal that goes on in the next line's literal.
REST = re.compile(r"[\"'`][ \t]*[+.\\]?[ \t]*\\?\r?\n[ \t]*[+.]?[ \t]*[\"'`]([^\s\"'`]+)(?=[\"'`])")


def with_rests(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans and those of the literals that go on with a value; these have the kind 'rest'."""
    out = []
    for a, b, kind in found:
        out.append((a, b, kind))
        while m := REST.match(text, b):
            b = m.end(1)
            out.append((*m.span(1), "rest"))
    return _merged(out)


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with every value replaced by PLACEHOLDER; the lines of a key are blanked one by one, so that lines keep their numbers."""
    out, at = [], 0
    for a, b, kind in found:
        value = text[a:b]
        out += [text[at:a], re.sub(r"[A-Za-z0-9+/=]{4,}", PLACEHOLDER, value) if kind.startswith("private_key") else PLACEHOLDER]
        at = b
    return "".join([*out, text[at:]])


def _scan(with_content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, text, path, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = spans(text, path or "")
                if not found:
                    continue
                if with_content:
                    rows.append((i, len(found), redact(text, with_rests(text, found))))
                else:
                    at, line = 0, start or 0
                    for a, e, k in found:
                        at, line = a, line + text.count("\n", at, a)
                        rows += [(i, line, k, a, e)] if k != "private_key_tail" else []
            names = ["id", "spans", "content"] if with_content else ["id", "line_no", "kind", "begin", "end"]
            kinds = [pa.string(), pa.int32(), pa.string()] if with_content else [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names)

    return run


def _columns(df: DataFrame, row_id: str, content: str, path: str, start: str | None) -> DataFrame:
    rows = df.where(F.col(row_id).isNotNull() & F.col(content).isNotNull())
    return rows.select(F.col(row_id).cast("string").alias("id"), F.col(content).alias("content"), F.col(path).alias("path"), (F.col(start) if start else F.lit(1)).cast("int").alias("start"))


def find_credentials(df: DataFrame, row_id: str = "id", content: str = "content", path: str = "file_path", start: str | None = "start_line") -> DataFrame:
    """(id, line_no, kind, begin, end): one row per credential; begin and end are offsets in the content.

    line_no is the line of the file on which the value begins, or the BEGIN mark of a key; a null start line counts as 0.
    Null ids and contents are left out, an empty text has no credential, a text of any length is scanned whole. Rows
    repeated under one id count once. An empty table gives an empty result. Other columns play no part.
    """
    return _columns(df, row_id, content, path, start).mapInArrow(_scan(False), "id string, line_no int, kind string, begin long, end long").distinct()


def redacted(df: DataFrame, row_id: str = "id", content: str = "content", path: str = "file_path") -> DataFrame:
    """(id, spans, content): every row that holds credentials, with their values blanked. Nulls and repeats as in find_credentials."""
    rows = _columns(df, row_id, content, path, None).mapInArrow(_scan(True), "id string, spans int, content string")
    return rows.groupBy("id").agg(F.min("spans").alias("spans"), F.min("content").alias("content"))
