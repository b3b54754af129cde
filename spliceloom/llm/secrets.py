"""Secret scan: fixed patterns plus assignment-aware lexing with constant propagation.

Method. A lexer reads source and configuration syntax (``name = literal``,
``"name": "literal"``, ``name := a + b"c"``, ``<name>literal</name>``, ``--name
literal``, ``set_name("literal")``, ...) into name-literal pairs. Names
that stand for constants are replaced by the literals they were given last before
in the text, or else first after. A literal is reported if the name it reaches is sensitive and the
literal looks like a secret, at the place where it is written.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "lexed")

# The base patterns.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12

# Words of a name that make it sensitive, and how much.
SENSITIVE = {
    "password": 1.0,
    "passwd": 1.0,
    "passphrase": 1.0,
    "pwd": 0.9,
    "secret": 1.0,
    "token": 0.9,
    "apikey": 1.0,
    "accesskey": 0.9,
    "privatekey": 1.0,
    "credential": 0.9,
    "credentials": 0.9,
    "auth": 0.7,
}
# Literals that stand for a value to be filled in. Templates and masks count anywhere, words only as
# whole parts of a literal, variables and angle brackets only as the whole literal.
PLACEHOLDER = re.compile(
    r"\$\{[^{}]*\}|\{\{[^{}]*\}\}|\*{3}|(?<![a-z0-9])x{4,}(?![a-z0-9])"
    r"|^(?:<[^<>]*>|\{[\w.-]+\}|(?-i:\$[A-Z_]+|\$[a-z_]+)|(?:(?:none|null|true|false)[_.-]?)+"
    r"|(?:[a-z]+[_.-])*(?:example|changeme|placeholder|your)(?:[_.-][a-z]+)*)$",
    re.IGNORECASE,
)

# Strings with the prefixes and quotes of common languages; what is no string is a name, a number or a bare value.
STRING = (
    r"[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''"
    r"|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+')"
)
TERM = STRING + r"|[^\s,;+(){}\[\]\"'<>]++"
PAIR = re.compile(
    rf"(?<![\w.-])[\"']?([A-Za-z_][\w.-]*+)[\"']?\]?[ \t]*+(?::=|=>|=(?!=)|:(?!:))[ \t]*+((?:{TERM})(?:[ \t]*+\+[ \t]*+(?:{TERM}))*+)"
)
TERMS = re.compile(TERM)
QUOTED = re.compile(r"[rRbBuUfF]{0,2}(\"\"\"|'''|[\"'])")
# Other syntax that gives a name a literal: <name>literal</name>, --name literal, set_name("literal").
MARKUP = re.compile(r"<([A-Za-z_][\w.-]*+)(?:\s[^<>]*+)?>([^<>\s]++)</\1>")
FLAG = re.compile(rf"(?<![\w-])--?([A-Za-z][\w-]*+)(?:=|[ \t]++)((?:{STRING})|[^\s\"'<>=-][^\s\"'<>]*+)")
CALL = re.compile(rf"(?<![\w.-])(?:\w++\.)*+([A-Za-z_]\w*+)\(\s*+({STRING})\s*+[,)]")
# First words of functions that ask for a secret by its name.
ASKS = {"get", "getenv", "getpass", "read", "load", "fetch", "find", "has", "is", "check", "require", "lookup", "input", "prompt"}
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
GATE = tuple(w.encode() for w in SENSITIVE)
_FOLDED = bytes(range(256)).lower()
_BETWEEN = bytes(c for c in range(256) if not (chr(c).isascii() and chr(c).isalnum()))

Literal = tuple[int, int, str]


def name_weight(name: str) -> float:
    """Sensitivity of a name: its words, alone or two in a row, in any case and with any separators."""
    words = [w.lower() for w in WORDS.findall(name)]
    joined = words + [a + b for a, b in zip(words, words[1:])]
    return max((SENSITIVE.get(w, 0.0) for w in joined), default=0.0)


class Value:
    """What an assignment gives its name: literals written in it, and other values by reference, in order."""

    __slots__ = ("parts", "_counts", "_done")

    def __init__(self, parts: list[Literal | Value]) -> None:
        self.parts = parts
        self._counts: Counter | None = None
        self._done = False

    def counts(self) -> Counter:
        """How often each character occurs, repeated parts counted as often as they are joined; each value once."""
        stack = [self]
        while stack:
            value = stack[-1]
            if value._counts is None:
                value._counts = Counter()  # a value that refers to itself through others adds nothing there
                stack += [p for p in value.parts if isinstance(p, Value) and p._counts is None]
                continue
            stack.pop()
            if not value._done:
                value._done = True
                for p in value.parts:
                    value._counts.update(p._counts if isinstance(p, Value) else p[2])
        return self._counts

    def literals(self) -> list[Literal]:
        """All literals it is joined from, each written place once."""
        seen: set[int] = set()
        out: list[Literal] = []
        stack: list[Literal | Value] = [self]
        while stack:
            part = stack.pop()
            if not isinstance(part, Value):
                out.append(part)
            elif id(part) not in seen:
                seen.add(id(part))
                stack += reversed(part.parts)
        return out


def literal_weight(counts: Counter) -> float:
    """0 to 1: length, mixture of character kinds and entropy of a literal with these characters; 0 for prose."""
    n = sum(counts.values())
    if n < 8 or any(c.isspace() for c in counts):
        return 0.0
    letters = "".join(counts)
    kinds = sum(bool(re.search(p, letters)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    return min(1.0, kinds / 3) * min(1.0, entropy / 3)


def may_name_secrets(text: str) -> bool:
    """False only if no name in the text is sensitive: words of a name that follow each other touch once all but letters and digits is gone."""
    squeezed = text.encode("ascii", "ignore").translate(_FOLDED, _BETWEEN)
    return any(w in squeezed for w in GATE)


def unquoted(word: str, at: int) -> Literal | None:
    """What a string at ``at`` holds; null for other terms."""
    quote = QUOTED.match(word)
    if not quote or len(word) < quote.end() + len(quote[1]):
        return None
    end = len(word) - len(quote[1])
    return at + quote.end(), at + end, word[quote.end() : end]


def other_literals(text: str) -> Iterator[tuple[str, int, str]]:
    """Name, place and text of literals that are given to names without an assignment."""
    if "</" in text:
        yield from ((m[1], m.start(2), m[2]) for m in MARKUP.finditer(text))
    if "-" in text:
        yield from ((m[1], m.start(2), m[2]) for m in FLAG.finditer(text))
    for m in CALL.finditer(text):
        words = WORDS.findall(m[1])
        if words and words[0].lower() not in ASKS:
            yield m[1], m.start(2), m[2]


def lexed_secrets(text: str, least: float = 0.6) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name; each place once."""
    known: dict[str, Value] = {}
    first: dict[str, Value] = {}
    ahead: list[tuple[Value, int, str]] = []  # names that have no literal yet
    sensitive: list[tuple[float, Value]] = []
    for pair in PAIR.finditer(text):
        name, at = pair[1], pair.start(2)
        value = Value([])
        terms = list(TERMS.finditer(pair[2]))
        called = text[pair.end() : pair.end() + 1] in ("(", "[")
        for term in terms:
            word, literal = term[0], unquoted(term[0], at + term.start())
            if literal:
                value.parts.append(literal)
            elif word in known:
                value.parts.append(known[word])
            else:
                # A bare word may be a name that gets its literal later, and a literal itself only if it stands alone.
                ahead.append((value, len(value.parts), word))
                alone = len(terms) == 1 and not called
                value.parts.append((at + term.start(), at + term.end(), word) if alone else Value([]))
        known[name] = value
        first.setdefault(name, value)
        if weight := name_weight(name):
            sensitive.append((weight, value))
    for name, start, word in other_literals(text):
        if weight := name_weight(name):
            sensitive.append((weight, Value([unquoted(word, start) or (start, start + len(word), word)])))
    for value, k, word in ahead:
        if first.get(word, value) is not value:
            value.parts[k] = first[word]
    found: dict[tuple[int, int], None] = {}
    for weight, value in sensitive:
        if weight * literal_weight(value.counts()) >= least:
            literals = value.literals()
            if not PLACEHOLDER.search("".join(v for _, _, v in literals)):
                found |= dict.fromkeys((s, e) for s, e, v in literals if v)
    return list(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping in each kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: a lexed literal that lies in a base span is not reported again."""
    base = base_spans(text)
    if not may_name_secrets(text):
        return base, base
    starts = [b for b, _, _ in base]
    reach = list(accumulate((f for _, _, f in base), max))  # the furthest end of the spans that begin up to here
    held = lambda s, e: (k := bisect_right(starts, s)) > 0 and reach[k - 1] >= e
    return base, sorted(base + [(s, 3, e) for s, e in lexed_secrets(text) if not held(s, e)])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text.

    Returns one row per input row: the id column, n_assign, n_access, n_hex,
    n_lexed, base_spans, spans. Spans are kind:start:end in code points, end
    exclusive, by start and then kind, comma-joined.

    Null text counts as empty and has no spans; texts of any length are read
    whole. Repeated rows get equal results. No rows give no rows. Other columns
    are not read, whatever their names.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            base_text, all_text = [], []
            for text in batch.column(1):
                base, spans = scan_text(text.as_py() or "")
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in spans))
                base_text.append(joined(base))
                all_text.append(joined(spans))
            arrays = [pa.array(c, pa.int64()) for c in counts] + [pa.array(base_text, pa.string()), pa.array(all_text, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "n_assign", "n_access", "n_hex", "n_lexed", "base_spans", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, n_lexed long, base_spans string, spans string"
    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_col)

