r"""Secret scan by assignment-aware lexing.

Base kinds are regular expressions over whole texts: ``assign`` (name, separator, value of six or more characters), ``access``
(key ids of 20 or more characters) and ``hex`` (24 or more digits), leftmost non-overlapping per kind, spans in code points with
exclusive ends. The lexer adds ``named`` spans. It reads source and configuration syntax in the order of the text: a head (``name =``,
``name:``, ``name :=``, ``name =>``, ``name(`` or ``<name>literal</name>``; a name may stand in quotes) and then the tokens of its
value: quoted strings with escapes, triple-quoted and back-ticked ones, bare words, names, lists, parentheses, parts joined by ``+`` or side by
side. A value ends with its line unless a bracket is open, then with a blank line at the latest; keys inside it are heads of their own. Each value is a set of literals. A
name stands for what it was last given, so a name given to another hands its literals on, in any number of steps, and a value
scores by the most sensitive name it was given to. Each literal is scored by that, its length and its character mix; those of
``threshold`` or more are reported once. Comments are read like code, strings inside strings aren't joined, names aren't scoped.

Null texts are empty: no spans, the digest of the empty string. Very long texts are read whole, in time linear in their length. Rows are independent, so ties and repeated rows need no rule.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.shared import lean, with_field

KINDS = ("assign", "access", "hex", "named")
# Fixed values of the contract; the length limits are part of it.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_LEAST = 6
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Weight of the words that a name may hold.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3, "private": 2, "auth": 2, "bearer": 2, "signing": 1, "access": 1, "key": 1, "api": 1, "session": 1, "salt": 1}
# possessive runs without length limits: a name starts only where its run starts, so this is linear
_PAIR = re.compile(r"""(?<![\w.$-])([A-Za-z_$][\w$.-]*+)["'`]?+[ \t]*+(?:(:=|=>|(?<![=!<>])=(?!=)|:(?![:/]))|(\())|<([A-Za-z_][\w.-]*+)>([^<>\n]++)</""", re.ASCII)
# a string without its closing quote is the last of its line or text, so what it scans in vain is scanned once
_TOKEN = re.compile(
    r"""[ \t\r]++|"{3}(?P<long>.*?)"{3}|'{3}(?P<also>.*?)'{3}|"(?P<double>(?:[^"\\\n]|\\[^\n])*+)"|'(?P<single>(?:[^'\\\n]|\\[^\n])*+)'|`(?P<tick>[^`]*+)`"""
    r"""|(?P<bare>[^\s"'`,;(){}\[\]<>]++)|(?P<mark>[\[\](){},\n])""",
    re.ASCII | re.DOTALL,
)
_KEY = re.compile(r"[ \t]*+(?:=>|:(?![:/]))", re.ASCII)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", re.ASCII)
_NAME = re.compile(r"[A-Za-z_$][\w$.-]*\Z", re.ASCII)
_ANY = re.compile("|".join(sorted(SENSITIVE)), re.IGNORECASE)


def sensitivity(name: str) -> int:
    parts = [x.lower() for x in _PARTS.findall(name)]
    return sum(SENSITIVE.get(x, 0) for x in parts) + sum(SENSITIVE.get(x + y, 0) for x, y in zip(parts, parts[1:]))


def literal_score(text: str) -> int:
    """0 to 3: long enough, several character classes, high entropy."""
    if len(text) < 6 or "${" in text or "{{" in text:
        return 0
    counts = Counter(text)
    entropy = -sum(n / len(text) * math.log2(n / len(text)) for n in counts.values())
    classes = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return 1 + (classes >= 2) + (entropy >= 3)


class _Values:
    """Values of a text: the literals of each, the values it was made of, and the score of the most sensitive name it was given to."""

    def __init__(self):
        self.spans, self.made_of, self.score = [], [], []
        self.given: dict[str, int] = {}

    def add(self, name: str, spans: list[tuple[int, int]], made_of: list[int], score: int) -> None:
        if not spans and len(made_of) == 1:  # a constant under another name
            value = made_of[0]
            self.score[value] = max(self.score[value], score)
        else:
            value = len(self.spans)
            self.spans.append(spans)
            self.made_of.append(made_of)
            self.score.append(score)
        self.given[name] = value

    def scored(self):
        """(span, score) of all literals; what a value was made of is older than the value."""
        for value in range(len(self.spans) - 1, -1, -1):
            for part in self.made_of[value]:
                self.score[part] = max(self.score[part], self.score[value])
        return ((span, w) for spans, w in zip(self.spans, self.score, strict=True) if w >= 2 for span in spans)


def _value(text: str, at: int, is_call: bool, op: str | None, given: dict[str, int]) -> tuple[list[tuple[int, int]], list[int], int]:
    """(spans of the literals, values of the names, end) of the value that starts at `at`, in the parentheses of a call or by itself.

    Inside parentheses only quoted strings are literals, in lists bare words too.
    """
    open_, whole, spans, parts = ["("] * is_call, False, [], []
    while m := _TOKEN.match(text, at):
        kind = m.lastgroup
        if kind is None:  # blanks
            pass
        elif kind == "mark":
            mark = m.group()
            if mark in "[(":
                if whole and not open_:
                    break
                open_.append(mark)
            elif mark in "])":
                whole = True
                if not open_ or open_.pop() and not open_ and is_call:
                    break
            elif mark in "{}" or not open_ or text.startswith("\n\n", m.start()):
                break
        elif kind == "bare":
            word = m.group()
            if word == "+":
                whole = False
            elif whole and not open_:
                if op == ":" and word == "=":  # a name with its type: what is left is the value
                    spans, parts, whole, op = [], [], False, "="
                else:
                    break
            elif (head := _PAIR.match(text, at)) and (open_ or head.group(3)):
                break
            else:
                if _NAME.match(word) and word in given:
                    parts.append(given[word])
                elif not open_ or open_[-1] == "[":
                    spans.append(m.span(kind))
                whole = True
        else:
            if open_ and _KEY.match(text, m.end()):
                at += 1
                break
            spans.append(m.span(kind))
            whole = True
        at = m.end()
    return spans, parts, at


def named(text: str, threshold: int = 4) -> list[tuple[int, int]]:
    """Spans of literals whose names, direct or through constants, are sensitive enough."""
    if not _ANY.search(text):
        return []
    values, at, weights = _Values(), 0, {}
    while m := _PAIR.search(text, at):
        name = m.group(1) or m.group(4)
        if name not in weights:
            weights[name] = sensitivity(name)
        at = m.end()
        if m.group(4):
            if text.startswith(f"{name}>", at):
                values.add(name, [m.span(5)], [], weights[name])
            else:
                at = m.start(5)
        elif m.group(2) or weights[name]:  # of calls only those of sensitive names are read
            spans, parts, at = _value(text, at, m.group(2) is None, m.group(2), values.given)
            if spans or parts:
                values.add(name if m.group(2) else f"{name}(", spans, parts, weights[name])
    best: dict[tuple[int, int], int] = {}
    for span, w in values.scored():
        best[span] = max(best.get(span, 0), w)
    return [s for s, w in sorted(best.items()) if (v := literal_score(text[s[0] : s[1]])) and w + v >= threshold + 1]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, place of the kind, end), sorted: base spans; all spans."""
    base = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    return base, sorted(base + [(a, 3, b) for a, b in named(text)])


def shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def find(df: DataFrame, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """df with all spans of each text as array<struct<kind,start,end>>; a column of that name is replaced."""
    kept = [f"`{c}`" for c in df.columns if c.lower() != out.lower()]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            got = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(x or "")[1]] for x in table[text].to_pylist()]
            yield from table.append_column(out, pa.array(got, kind)).to_batches()

    base = df.select(*kept)
    return base.mapInArrow(run, with_field(base, out, "array<struct<kind:string,start:int,end:int>>"))


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, merged where they overlap, replaced by mark."""
    out, at = [], 0
    for a, _, b in scan(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redacted(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with secrets in the text replaced; null stays null, all other columns as they are."""
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            got = pa.array([None if x is None else redact(x, mark) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], got, *batch.columns[at + 1 :]], schema=batch.schema)

    return df.mapInArrow(lean(run), df.schema)


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_named."""

    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column(1):
                base, found = scan(x.as_py() or "")
                n = Counter(k for _, k, _ in found)
                rows.append((n[0], n[1], n[2], hashlib.sha256(shown(base).encode()).hexdigest(), shown(found), n[3]))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(cols[i], pa.int64()) for i in range(3)), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long")
