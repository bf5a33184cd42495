"""Secrets in texts: fixed patterns, and assignments read from source and configuration syntax."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import LOWER_BYTES, bound_batches, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are taken whole, so the least length can stand in the pattern
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "literal")
#: Lower-case words without which ASSIGN cannot match.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: How telling a word in the name of an assignment's target is.
NAME_WEIGHTS = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3,
    "privatekey": 3, "accesskey": 3, "signingkey": 3, "encryptionkey": 3, "bearer": 2, "auth": 2, "authorization": 2, "salt": 1, "key": 1, "pin": 1, "cert": 1,
}
#: Names of which one stands in the letters and digits of every text with a target that can score. A name may be of two words with anything else between.
HINT_WORDS = tuple(w.encode() for w in NAME_WEIGHTS)
NOT_HINT = bytes(c for c in range(256) if not (c < 128 and chr(c).isalnum()))
#: Literals of at least this score (name and shape together) are secrets.
LEAST_SCORE = 5
#: A strong literal: so long, of both cases and digits, so much entropy, and so large a share of neighbours of different classes; no path or address.
STRONG_LENGTH, STRONG_ENTROPY, STRONG_CHANGES = 16, 3.5, 0.4
#: Characters up to which a value that is put together from names is kept as text; a longer one is kept as what its score needs (Made).
MOST_VALUE = 1024
#: Characters at the beginning of a longer value that are kept, more than any placeholder or kind of place is told by.
HEAD = 32
SCHEME = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
PLACE = re.compile(r"[./~]|[A-Za-z][A-Za-z0-9+.-]*:|.*://")
CLASSES = ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|0+|your[-_ ].*|change[-_]?me|example.*|placeholder|dummy|test|none|null|true|false|undefined|todo|redacted|\$\{.*|\{\{.*|<.*>|%\(.*|env\b.*|os\.environ.*)$")
SCAN = re.compile(
    r"""(?P<define>(?<!\S)\#[ \t]*define(?=[ \t]))
    |(?P<comment>(?<![^\s;{}(),\]])(?:\#|//|--(?![\w-]))[^\n]*)
    |(?P<element><(?P<tag>[A-Za-z_][\w.-]*)(?:\s[^<>]*)?>(?P<inner>[^<>\n]*)</(?P=tag)\s*>)
    |(?P<long>[rbufRBUF]{0,2}(?P<lq>\"\"\"|''')(?P<lines>(?:\\[\s\S]|(?!(?P=lq))[^\\])*+)(?P=lq))
    |(?P<string>[rbufRBUF]{0,2}(?P<q>\"\"\"|'''|["'`])(?P<body>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q))
    |(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z_$][A-Za-z0-9_$]*)*)
    |(?P<op>:=|=>|==+|!=|<=|>=|->|::|:|=|\+|\[|\]|\(|\)|\{|\}|,|;|\||&)
    |(?P<option>(?<!\S)--?(?=[A-Za-z]))
    |(?P<bare>[A-Za-z0-9+/_.=$%@!~^*-]+)
    |(?P<end>\\?\n)
    |(?P<gap>[^\S\n]+)
    |(?P<other>.)""",
    re.VERBOSE | re.ASCII,
)
#: A block of a configuration file: a sign behind the name, and indented lines below.
BLOCK = re.compile(r"[ \t]*[|>][0-9+-]*[ \t]*\n")
LINE = re.compile(r"([ \t]*)([^\n]*)\n?")
OPEN, SHUT = ("[", "{", "("), ("]", "}", ")")
DECLARE = {"export", "set", "let", "const", "var", "final", "static", "public", "private", "protected", "val", "def", "string", "str", "char", "auto", "local", "readonly", "env"}


def _words(name: str) -> list[str]:
    """The words of snake_case, kebab-case, dotted and camelCase names, and the last two joined."""
    parts = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    return parts + [a + b for a, b in zip(parts, parts[1:], strict=False)]


def name_score(name: str) -> int:
    return max((NAME_WEIGHTS.get(w, 0) for w in _words(name)), default=0)


def may_score(text: str) -> bool:
    """False only where no name in the text can score."""
    flat = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES, NOT_HINT)
    return any(w in flat for w in HINT_WORDS)


def _kind(c: str) -> int:
    return next(i for i, p in enumerate(CLASSES) if re.match(p, c))


class Made:
    """A value too long for text, as names double each other: exactly what its score needs, in the space of its alphabet."""

    def __init__(self, parts: list[str | Made]):
        self.length = self.changes = 0  # changes: neighbours of different classes
        self.counts: Counter[str] = Counter()
        self.head = self.tail = ""
        self.url, self.odd = False, None  # whether :// is in it, and its first character that no scheme has
        for part in parts:
            if part if isinstance(part, str) else part.length:
                self._add(part)

    def _add(self, part: str | Made) -> None:
        text = isinstance(part, str)
        head, tail = (part[:HEAD], part[-2:]) if text else (part.head, part.tail)
        self.changes += self.length > 0 and _kind(self.tail[-1]) != _kind(head[0])
        self.url = self.url or "://" in (part if text else head) or not text and part.url or "://" in self.tail + head[:2]
        if self.odd is None:
            self.odd = next((c for c in part if c not in SCHEME), None) if text else part.odd
        if text:
            kinds = [_kind(c) for c in part]
            self.changes += sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
        else:
            self.changes += part.changes
        self.length += len(part) if text else part.length
        self.counts.update(part if text else part.counts)
        self.head, self.tail = (self.head + head)[:HEAD], (self.tail + tail)[-2:]

    def shown(self) -> str:
        """A text that is a placeholder, has white space and has the classes of characters as the value does."""
        return self.head + "".join(self.counts) + self.tail

    def is_place(self) -> bool:
        return self.head[0] in "./~" or self.url or self.head[0].isascii() and self.head[0].isalpha() and self.odd == ":"


def literal_score(value: str | Made, quoted: bool) -> int:
    """0 to 3: length, mixed classes and entropy; 4 for a strong literal, which is a secret under any sensitive name; -9 for what is no secret by its shape."""
    text = isinstance(value, str)
    shown, counts, length = (value, Counter(value), len(value)) if text else (value.shown(), value.counts, value.length)
    if length < 6 or PLACEHOLDER.match(shown) or any(c.isspace() for c in shown):
        return -9
    present = [bool(re.search(p, shown)) for p in CLASSES]
    classes = sum(present)
    entropy = -sum(share * math.log2(share) for n in counts.values() if (share := n / length))
    if not quoted and (classes < 2 or not re.search("[0-9]", shown)):
        return -9
    score = (length >= 8) + (classes >= 2) + (entropy >= 2.5)
    if score == 3 and all(present[:3]) and length >= STRONG_LENGTH and entropy >= STRONG_ENTROPY and not (PLACE.match(value) if text else value.is_place()):
        if text:
            kinds = [_kind(c) for c in value]
            score += sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) >= STRONG_CHANGES * (length - 1)
        else:
            score += value.changes >= Fraction(str(STRONG_CHANGES)) * (length - 1)
    return score


def _literals(spans: list, told: dict[int, list]) -> Iterator[tuple[int, int]]:
    """The spans of a value and of the names it is made of; what a name holds is given once, and is noted in told."""
    todo = [spans]
    while todo:
        for span in todo.pop():
            if not isinstance(span, list):
                yield span
            elif id(span) not in told:
                told[id(span)] = span
                todo.append(span)


class _Lexed:
    """Statements `name op expression` of a text, read token by token."""

    def __init__(self, text: str):
        self.text = text
        inner = {"q": "string", "body": "string", "lq": "long", "lines": "long", "tag": "element", "inner": "element", "option": "gap"}
        self.tokens = [(inner.get(m.lastgroup, m.lastgroup), m) for m in SCAN.finditer(text)]
        self.seen = self.tried = 0  # tokens up to which lists have been read, and rows of names been tried as targets
        #: What a name holds: its value, and the spans of its literals; a list among them is what another name held.
        self.constants: dict[str, tuple[str | Made, list]] = {}

    def _next(self, i: int, newlines: bool = False) -> int:
        """The next token that means something, or one that ends the statement."""
        while i < len(self.tokens) and (self.tokens[i][0] in ("gap", "comment") or self.tokens[i][1][0] == "\\\n" or newlines and self.tokens[i][0] == "end"):
            i += 1
        return i

    def _op(self, i: int) -> str:
        return self.tokens[i][1][0] if i < len(self.tokens) and self.tokens[i][0] == "op" else ""

    def pairs(self) -> Iterator[tuple[str, str | Made, list, bool]]:
        """(target name, value, spans of the literals it is made of, quoted); see _literals() for the spans."""
        i = 0
        while i < len(self.tokens):
            kind, m = self.tokens[i]
            if kind == "element":
                yield m["tag"], m["inner"].strip(), self._strip(*m.span("inner")), True
                i += 1
                continue
            if kind == "define":
                i = yield from self._defined(i)
                continue
            if kind == "name" and i >= self.tried and self._op(self._next(i + 1)) == ",":
                end = yield from self._several(i)
                if end > i:
                    i = end
                    continue
            name = m[0] if kind == "name" else m["body"] if kind == "string" else None
            if not name or kind == "name" and name.lower() in DECLARE:
                i += 1
                continue
            j = self._next(i + 1)
            if self._op(j) == "]":  # settings["name"] = ...
                j = self._next(j + 1)
            if kind == "name" and self._op(j) == ":" and (k := self._next(j + 1)) < len(self.tokens) and self.tokens[k][0] == "name" and self._op(self._next(k + 1)) == "=":
                j = self._next(k + 1)  # name: type = ...
            if self._op(j) not in ("=", ":", ":=", "=>"):
                i += 1
                continue
            block = self._block(j, m.start()) if self._op(j) == ":" else None
            if block is not None:
                value, spans, end = block
                yield name, value, spans, True
                i = max(end, i + 1)
                continue
            first = self._next(j + 1)
            if self._op(first) in ("[", "{") and first >= self.seen and name_score(name):
                yield from self._listed(name, first)  # what stands inside is read again, for its own names
            value, spans, quoted, end = self._expression(first)
            if spans:
                if kind == "name" or self._op(j) != "=":
                    self.constants[name] = (value, spans) if quoted else ("", [])
                yield name, value, spans, quoted
            i = max(end, i + 1)

    def _strip(self, a: int, b: int) -> list[tuple[int, int]]:
        """The span without white space at its ends; none if nothing is left."""
        text = self.text[a:b]
        a, b = a + len(text) - len(text.lstrip()), b - len(text) + len(text.rstrip())
        return [(a, b)] if a < b else []

    def _defined(self, i: int):
        """#define name value; gives the place to go on at."""
        j = self._next(i + 1)
        if j >= len(self.tokens) or self.tokens[j][0] != "name" or j + 1 >= len(self.tokens) or self.tokens[j + 1][0] != "gap":
            return max(j, i + 1)
        value, spans, quoted, end = self._expression(self._next(j + 1))
        if spans:
            name = self.tokens[j][1][0]
            self.constants[name] = (value, spans) if quoted else ("", [])
            yield name, value, spans, quoted
        return max(end, j + 1)

    def _several(self, i: int):
        """a, b = x, y; gives the place to go on at, or i where the names are no targets."""
        names, j = [], i
        while j < len(self.tokens) and self.tokens[j][0] == "name":
            names.append(self.tokens[j][1][0])
            j = self._next(j + 1)
            if self._op(j) != ",":
                break
            j = self._next(j + 1)
        if self._op(j) != "=" or len(names) < 2:
            self.tried = max(self.tried, j)  # these names are not tried again
            return i
        for k, name in enumerate(names):
            if k and self._op(j) != ",":
                break
            value, spans, quoted, j = self._expression(self._next(j + 1))
            if spans:
                self.constants[name] = (value, spans) if quoted else ("", [])
                yield name, value, spans, quoted
        return j

    def _listed(self, name: str, i: int):
        """Each string of a list, and each string value of a mapping, that is assigned to a name; lists inside it are part of it."""
        depth = 0
        while i < len(self.tokens):
            kind, m = self.tokens[i]
            if kind == "op":
                depth += (m[0] in OPEN) - (m[0] in SHUT)
                if depth <= 0:
                    break
            elif kind == "string" and self._op(self._next(i + 1)) not in (":", "=>"):  # else a key
                yield name, m["body"], [m.span("body")], True
            i += 1
        self.seen = max(self.seen, i)

    def _block(self, j: int, start: int) -> tuple[str, list[tuple[int, int]], int] | None:
        """(value, spans, end) of indented lines behind `name: |` or `name: >`, those that are further in than the name's own line; None if there is no such block."""
        m = BLOCK.match(self.text, self.tokens[j][1].end())
        if m is None:
            return None
        line = self.text.rfind("\n", 0, start) + 1
        margin, at, spans = len(self.text[line:start]) - len(self.text[line:start].lstrip()), m.end(), []
        while at < len(self.text):
            row = LINE.match(self.text, at)
            if row[2].strip() and len(row[1]) <= margin:
                break
            spans += self._strip(*row.span(2))
            at = row.end()
        while j < len(self.tokens) and self.tokens[j][1].start() < at:
            j += 1
        return "".join(self.text[a:b] for a, b in spans), spans, j

    def _expression(self, i: int) -> tuple[str | Made, list, bool, int]:
        """Strings and constants joined by + or side by side, or one bare word: (value, spans, quoted, end).

        Names hold their values, so that one is as long as it is, however often the
        names double each other; a value that names make longer than MOST_VALUE is
        one of Made, and the spans of a name are shared, not copied. Each token is
        read once, and what a name adds is bounded by its alphabet.
        """
        values: list[str | Made] = []
        spans: list = []
        first, quoted, depth, length, named = i, False, 0, 0, False
        while i < len(self.tokens):
            kind, m = self.tokens[i]
            if kind == "op" and m[0] == "(":
                depth += 1
                i = self._next(i + 1, newlines=True)
            elif kind == "op" and m[0] == ")" and depth:
                depth -= 1
                i = self._next(i + 1, newlines=depth > 0)
            elif kind in ("string", "long"):
                quoted = True
                parts = [m.span("body")] if kind == "string" else self._strip(*m.span("lines"))
                spans += parts
                values += ["".join(x.strip() for x in self.text[a:b].split("\n")) if kind == "long" else m["body"] for a, b in parts]
                length += sum(b - a for a, b in parts)
                i = self._next(i + 1, newlines=depth > 0)
            elif kind == "name" and self.constants.get(m[0], ("", []))[1]:
                quoted = named = True
                value, parts = self.constants[m[0]]
                length += len(value) if isinstance(value, str) else value.length
                values.append(value)
                spans.append(parts)
                i = self._next(i + 1, newlines=depth > 0)
            elif kind == "op" and m[0] == "+" and spans:
                i = self._next(i + 1, newlines=True)
                continue
            else:
                break
            if self._op(i) not in ("+", ")") and not (i < len(self.tokens) and self.tokens[i][0] in ("string", "long")) and not (depth and i < len(self.tokens)):
                break
        if not spans and first < len(self.tokens) and self.tokens[first][0] in ("name", "bare"):
            a = b = self.tokens[first][1].start()
            i = first
            while i < len(self.tokens) and (self.tokens[i][0] in ("name", "bare") or self._op(i) in (":", "=", "+", "::", "&", "|") and i > first):
                b = self.tokens[i][1].end()
                i += 1
            if i < len(self.tokens) and self._op(i) == "(":
                return "", [], False, i  # a call, not a literal
            return self.text[a:b], [(a, b)], False, i
        return Made(values) if named and length > MOST_VALUE else "".join(values), spans, quoted, i


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind.

    The base spans are the matches of ASSIGN (group 2 of LEAST_ASSIGN characters),
    ACCESS and HEX. The lexer adds "literal": what is assigned to a sensitive name,
    directly, by concatenation or through names that hold constants, where its
    score reaches LEAST_SCORE and no base span has it already. Read are assignments
    and mappings, #define, options with a value, elements, several targets at once,
    lists and mappings of strings, strings over several lines and indented blocks.
    What begins a comment does so only behind white space or punctuation.
    """
    if not text:
        return []
    low = text.lower()
    spans = []
    if any(w in low for w in ASSIGN_WORDS):
        spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(c in text for c in "=:<#") and may_score(text):
        base, added = sorted((a, b) for _, a, b in spans), set()
        begins, reach = [a for a, _ in base], [0, *accumulate((b for _, b in base), max)]  # reach[k]: how far the first k base spans go
        told: dict[int, list] = {}
        for name, value, spans_, quoted in _Lexed(text).pairs():
            weight = name_score(name)
            if weight and weight + literal_score(value, quoted) >= LEAST_SCORE:
                added |= {("literal", a, b) for a, b in _literals(spans_, told) if b > a and reach[bisect_right(begins, a)] < b}
        spans += added
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            spans = find_secrets(text)
            counts = Counter(k for k, _, _ in spans)
            base = _joined([s for s in spans if s[0] != "literal"])
            rows.append((counts["assign"], counts["access"], counts["hex"], hashlib.sha256(base.encode()).hexdigest(), _joined(spans)))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans has all spans of find_secrets() as kind:start:end, comma-joined;
    base_sha256 is of those of the fixed patterns alone. Null and empty texts have
    none. A scan without a shuffle: rows, repeated ones and null ids included, are
    judged one by one. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
