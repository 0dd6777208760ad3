"""Secret scan: fixed patterns, and an assignment-aware lexer for source and configuration text.

The lexer reads ``name = value`` in its usual spellings (``=``, ``:=``, ``:``,
``=>``, quoted keys, type annotations, ``<name>value</name>``). A value is a
list of literals and of names assigned before, so a literal that reaches a
sensitive name through other constants is found where it stands. It may stand
in triple quotes, in a YAML block, or on a line after its name. What a PEM block
holds is a literal that the block's title names. A literal is reported when the
words of the name it reaches and its own look add up.

Spans are code point ranges, end exclusive. Defined cases: a null or empty text
has no spans. Of several assignments to one name the last before its use
counts. Values, chains and joins of constants are followed without limit on
length. Texts are scanned whole. On a line of its own, a literal without quotes
counts if it stands deeper than its name, and after a bare ``name:`` one in
quotes if it has no blanks. Repeated rows are judged one by one.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.llm.text import small_batches
from logvane.session import free_name

# ---- fixed values: the base patterns, their least lengths and their order
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is a maximal run that passes
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ["assign", "access", "hex", "literal"]
ASSIGN_STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# ---- the lexer
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passwort": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "credential": 0.9,
    "credentials": 0.9, "token": 0.8, "apikey": 1.0, "bearer": 0.7, "auth": 0.5, "authorization": 0.6, "private": 0.5,
    "api": 0.4, "access": 0.4, "signing": 0.4, "encryption": 0.4, "master": 0.3, "client": 0.2, "key": 0.45, "pass": 0.7,
    "salt": 0.5, "jwt": 0.6, "session": 0.3, "cookie": 0.4, "dsn": 0.5,
}
HARMLESS_WORDS = {
    "public", "path", "file", "url", "uri", "name", "id", "count", "size", "length", "len", "type", "field", "column", "header",
    "label", "hint", "policy", "expires", "expiry", "ttl", "min", "max", "index", "foreign", "primary", "sort", "keyboard",
}
PLACEHOLDER = re.compile(
    r"(?i)^(x{3,}|\*{3,}|\.{3,}|changeme|change_me|example.*|your[_-].*|placeholder|none|null|nil|true|false|undefined|todo|test|"
    r"password|secret|token|dummy|sample|default|redacted|\$\{.*|\{\{.*|<.*|%\(.*|os\.environ.*|process\.env.*|getenv.*)$"
)
THRESHOLD = 1.0
LEAST_LITERAL = 8
#: smaller weights add up, so any of the words may stand in a sensitive name
_STEMS = tuple(NAME_WEIGHTS)
_SPLIT_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_TARGET = re.compile(
    r"""(?P<quote>["']?)(?P<name>[A-Za-z_][A-Za-z0-9_.-]{0,99})(?P=quote)(?:\x20*:\x20*[A-Za-z_][\w.\[\]]{0,40}(?=\x20*=))?"""
    r"""[\x20\t]*(?P<op>:=|=>|=(?![=~])|:(?!:))[\x20\t]*"""
)
# long strings run to their quotes or to the end of the text, so reading them never steps back
_TERM = re.compile(
    r'''(?P<long>"""(?:[^"\\]+|\\.|"(?!""))*(?:"""|\\?\Z)|\'\'\'(?:[^'\\]+|\\.|'(?!''))*(?:\'\'\'|\\?\Z))'''
    r'''|(?P<string>"(?:[^"\\\n]|\\[^\n])*"|'(?:[^'\\\n]|\\[^\n])*'|`[^`\n]*`)|(?P<bare>[A-Za-z0-9_+/=.~-]+)''', re.DOTALL
)
_JOIN = re.compile(
    r"""[\x20\t]*(?:(?:\+|\.\.?|&|\|\|)[\x20\t]*(?:\\?\r?\n[\x20\t]*(?=["'`]))?|\\\r?\n[\x20\t]*(?=["'`]))?"""
)
#: what may stand between an assignment and its value besides blanks: an open parenthesis, ends of lines
_BEFORE = re.compile(r"\([\x20\t]*(?:\r?\n\s*)?|\\?\r?\n\s*")
_NEXT_STRING = re.compile(r"""\s*?\n\s*(?=["'`])""")
_LINE_END = re.compile(r"[\x20\t]*(?:\r?\n|\Z)")
_BLOCK = re.compile(r"[|>][0-9+-]{0,2}[\x20\t]*(?:\#[^\n]*)?\r?\n")
_BLOCK_LINE = re.compile(r"([\x20\t]*)([^\n]*)(?:\n|\Z)")
_LONE_NAME = re.compile(r"""[\x20\t]*(?P<quote>["']?)(?P<name>[A-Za-z_][A-Za-z0-9_.-]{0,99})(?P=quote)[\x20\t]*\r?$""")
_LONE_OP = re.compile(r"[\x20\t]*(?P<op>:=|=>|=(?![=~])|:(?!:))[\x20\t]*")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]{0,99})>([^<>]+)</\1>")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9][A-Z0-9 ]{0,99})-----")
_LINE_BREAK = re.compile(r"\s*\n\s*")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind."""
    found = []
    low = text.lower()
    if any(stem in low for stem in ASSIGN_STEMS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=_by_place)


def _by_place(span: tuple) -> tuple:
    return span[1], KINDS.index(span[0]), span[2]


def name_weight(name: str) -> float:
    """How much a target name speaks for a secret, by its words."""
    words = [w.lower() for w in _SPLIT_NAME.findall(name)]
    weight = sum(sorted((NAME_WEIGHTS.get(w, 0.0) for w in dict.fromkeys(words)), reverse=True)[:3])
    return weight - 0.6 * sum(w in HARMLESS_WORDS for w in words)


def literal_weight(value: str) -> float:
    """How much a literal looks like a secret: length, kinds of characters, entropy."""
    if len(value) < LEAST_LITERAL or PLACEHOLDER.match(value) or "://" in value and "@" not in value:
        return -1.0
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9\s]"))
    counts = [value.count(c) for c in set(value)]
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts)
    spaces = value.count(" ") / len(value)
    return 0.15 * (kinds - 1) + 0.1 * max(0.0, min(entropy, 5.0) - 2) - 2 * spaces - (0.3 if value.isalpha() else 0.0)


def _stripped(text: str, a: int, b: int) -> tuple[int, int]:
    """The place without blanks at its ends."""
    inner = text[a:b]
    return a + len(inner) - len(inner.lstrip()), b - len(inner) + len(inner.rstrip())


def _value(text: str, at: int, column: int, bare_key: bool, known: dict[str, list]) -> list[tuple[int, int]]:
    """Literal places that a right-hand side is made of: its own, and those of the names it uses."""
    if block := _BLOCK.match(text, at):
        return _block(text, block.end(), column)
    places, inside = [], text.startswith("(", at)
    if before := _BEFORE.match(text, at):
        at = before.end()
        term = _TERM.match(text, at)
        if not term:
            return []
        if term["bare"] is not None:
            deeper = at - text.rfind("\n", 0, at) - 1 > column
            if inside or not deeper or not _LINE_END.match(text, term.end()):
                return []
        elif bare_key and not inside and re.search(r"\s", term[0].strip("\"'`").strip()):
            return []
    while term := _TERM.match(text, at):
        if term["long"] is not None:
            quoted = term["long"]
            end = term.end() - 3 if len(quoted) >= 6 and quoted.endswith(quoted[:3]) else term.end()
            places.append(_stripped(text, term.start() + 3, end))
        elif term["string"] is not None:
            places.append((term.start() + 1, term.end() - 1))
        elif term["bare"] in known:
            places += known[term["bare"]]
        else:
            places.append(term.span())
        joint = _JOIN.match(text, term.end())
        if inside and (line := _NEXT_STRING.match(text, term.end())):
            joint = line
        if joint.end() == term.end() or not joint[0].strip() and text[joint.end() : joint.end() + 1] not in ("'", '"'):
            break
        at = joint.end()
    return places


def _block(text: str, at: int, column: int) -> list[tuple[int, int]]:
    """The lines of a YAML block, which stand deeper than their name."""
    start, end = at, at
    while at < len(text):
        line = _BLOCK_LINE.match(text, at)
        if line[2].strip():
            if len(line[1]) <= column:
                break
            end = line.end(2)
        at = line.end()
    a, b = _stripped(text, start, end)
    return [(a, b)] if a < b else []


def _targets(text: str) -> Iterator[tuple[str, str, str, int, int]]:
    """Name, its quote, operator, column of the name and the place behind the operator, of every assignment in order."""
    start, last = 0, None
    for line in text.split("\n"):
        if "=" in line or ":" in line:
            op = _LONE_OP.match(line)
            if op and last:
                yield last["name"], last["quote"], op["op"], last.start("name"), start + op.end()
            for target in _TARGET.finditer(line):
                yield target["name"], target["quote"], target["op"], target.start(), start + target.end()
            last = None
        else:
            last = _LONE_NAME.match(line)
        start += len(line) + 1


def assignments(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Every ``name, literal places`` pair, constants already followed."""
    known: dict[str, list] = {}
    if "=" in text or ":" in text:
        for name, quote, op, column, at in _targets(text):
            places = list(dict.fromkeys(_value(text, at, column, op == ":" and not quote, known)))
            if places:
                yield name, places
                if op != ":" or quote:
                    known[name] = places
    if "</" in text:
        for element in _ELEMENT.finditer(text):
            yield element[1], [_stripped(text, *element.span(2))]
    open_ended = set()
    for block in _PEM.finditer(text) if "-----BEGIN " in text else ():
        end = text.find(f"-----END {block[1]}-----", block.end()) if block[1] not in open_ended else -1
        if end < 0:
            open_ended.add(block[1])
        else:
            yield block[1], [_stripped(text, block.end(), end)]


def all_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans and literals that reach a sensitive name, outside base spans, by start, then kind."""
    if not text:
        return []
    spans = base_spans(text)
    low = text.lower()
    if any(stem in low for stem in _STEMS) and ("=" in text or ":" in text or "</" in text or "-----BEGIN " in text):
        taken = _merged(spans)
        added = set()
        for name, places in assignments(text):
            weight = name_weight(name)
            if weight < 0.4:
                continue
            for a, b in places:
                if (a, b) not in added and not _meets(taken, a, b) and weight + literal_weight(_LINE_BREAK.sub(" ", text[a:b])) >= THRESHOLD:
                    added.add((a, b))
        spans = sorted([*spans, *(("literal", a, b) for a, b in added)], key=_by_place)
    return spans


def _merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint ranges that spans sorted by start cover."""
    starts, ends = [], []
    for _, a, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _meets(ranges: tuple[list[int], list[int]], a: int, b: int) -> bool:
    i = bisect_right(ranges[1], a)
    return i < len(ranges[0]) and ranges[0][i] < b


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, a, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < b:
            i += 1
            b = max(b, spans[i][2])
        out += [text[at:a], f"[{kind}]"]
        at, i = b, i + 1
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _span_batches(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        yield pa.array([[dict(zip(("kind", "start", "end"), s)) for s in all_spans(t)] for t in part.to_pylist()], _SPANS)


def _redact_batches(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        yield pa.array([redacted(t, all_spans(t)) for t in part.to_pylist()], pa.string())


def _digest_batches(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        rows = []
        for text in part.to_pylist():
            spans = all_spans(text)
            kinds = [s[0] for s in spans]
            base = joined([s for s in spans if s[0] != "literal"])
            rows.append({
                **{f"n_{kind}": kinds.count(kind) for kind in KINDS},
                "base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": joined(spans),
            })
        yield pa.array(rows, _DIGEST)


_DIGEST = pa.struct([
    *((f"n_{kind}", pa.int64()) for kind in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()),
])
DIGEST = [f.name for f in _DIGEST]


def find_secrets(df: DataFrame, text: str = "text", result: str = "secret_spans") -> DataFrame:
    """The input with an array of spans."""
    small_batches(df.sparkSession)
    run = F.arrow_udf(_span_batches, "array<struct<kind:string,start:bigint,end:bigint>>")
    return df.withColumn(result, run(F.col(f"`{text}`")))


def digests(df: DataFrame, text: str = "text") -> DataFrame:
    """The input without its text, with counts by kind, the digest of the base spans and all spans as a string."""
    small_batches(df.sparkSession)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (*DIGEST, text)]
    run = F.arrow_udf(_digest_batches, "n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string")
    return df.select(*kept, run(F.col(f"`{text}`")).alias("_digest")).select(
        *kept, *[F.col(f"_digest.{c}") for c in DIGEST]
    )


def redact(df: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The input with every span of its texts replaced by the span's kind in brackets.

    The length column, if there is one, follows where a text changed. Null
    texts stay null.
    """
    small_batches(df.sparkSession)
    name = free_name(df, "redacted_text")
    new, old = F.col(name), F.col(f"`{text}`")
    found = df.select("*", F.arrow_udf(_redact_batches, "string")(old).alias(name))
    changed = {text: new, length: F.when(new != old, F.length(new).cast("long")).otherwise(F.col(f"`{length}`"))}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in df.columns])
