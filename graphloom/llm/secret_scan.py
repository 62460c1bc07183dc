"""Secret scan by assignment-aware lexing, beside fixed patterns.

A text is cut into tokens (strings with their escapes, names, bare values, signs, line starts with their indentation).
From those come name-literal pairs of source code and configuration: assignments with or without a type, keys of
mappings and of nested blocks, subscripts, arguments of calls, parts joined by a sign, elements and attributes of markup,
and name and value given side by side. A second pass carries constants on: a name that is assigned another name holds its literals, wherever that is
defined. Each literal is scored by the most sensitive name that it reaches, and by its length and mix of characters.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "lexed")

# All repeats are possessive or end at a character they exclude, so that a scan stays linear without bounds on length.
TOKEN = re.compile(
    r"""
    (?P<line>\n[\x20\t]*+(?:-[\x20\t]++)?+)
  | (?P<space>[\x20\t\r\f\v]++)
  | (?P<long>[A-Za-z]{0,2}(?:\"\"\"(?:[^"\\]|\\(?s:.)|"(?!\"\"))*+\"\"\"|\'\'\'(?:[^'\\]|\\(?s:.)|'(?!\'\'))*+\'\'\'))
  | (?P<string>(?<![A-Za-z0-9_])[A-Za-z]{0,2}(?:"(?:[^"\\\n]|\\[^\n])*+"|'(?:[^'\\\n]|\\[^\n])*+'|`(?:[^`\\]|\\(?s:.))*+`))
  | (?P<close></[A-Za-z_][\w.:-]*+\s*+>)
  | (?P<word>[A-Za-z_$@][\w$]*+(?:[.-][\w$]++)*+)
  | (?P<value>[0-9][\w.+-]*+)
  | (?P<sign>:=|=>|->|==|!=|<=|>=|\+=|::|&&|\|\||//|[=:,;+.&|?!<>()\[\]{}/*\\-])
  | (?P<other>[^\n])
    """,
    re.ASCII | re.VERBOSE,
)
#: The text of a value without quotes, from where a sign ends it; a name is such a value too.
BARE = re.compile(r"[A-Za-z0-9+/_.=$%!@~^-]++", re.ASCII)
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*", re.ASCII)
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)[^<>]*+>[\x20\t]*+([^<>\s][^<>\n]*+)</\1\s*+>", re.ASCII)
#: Keys whose value names what the next value is of.
TITLES = ("name", "key", "id", "title")
#: Parts of names that promise a secret, with their weights.
SENSITIVE = (("password", 1.0), ("passwd", 1.0), ("passphrase", 1.0), ("pwd", 0.8), ("secret", 1.0), ("token", 0.9), ("apikey", 1.0), ("privatekey", 1.0), ("accesskey", 1.0), ("credential", 0.8), ("auth", 0.6))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, in code points."""
    low = text.lower()
    out = []
    if any(w in low for w in WORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


@lru_cache(maxsize=4096)
def sensitivity(name: str) -> float:
    flat = name.lower().replace("_", "").replace("-", "").replace(".", "")
    return max((w for part, w in SENSITIVE if part in flat), default=0.0)


def sharper(a: str, b: str) -> str:
    """The name of the higher sensitivity, the first of equal ones; empty if neither is sensitive."""
    x, y = sensitivity(a), sensitivity(b)
    return (a if x >= y else b) if x or y else ""


def strength(literal: str) -> float:
    """0 to 1 from length and entropy: words and placeholders are weak, keys are strong."""
    bits = -sum(n / len(literal) * math.log2(n / len(literal)) for n in Counter(literal).values())
    return min(1.0, len(literal) / 16) * min(1.0, bits / 3.0) * (1.0 if re.search(r"\d", literal) else 0.6)


def literal_of(token: re.Match) -> tuple[str, int, int]:
    """The text inside a string's quotes, and where it starts and ends."""
    raw, start, end = token[0], token.start(), token.end()
    quote = min(i for i in (raw.find('"'), raw.find("'"), raw.find("`")) if i >= 0)
    width = 3 if token.lastgroup == "long" else 1
    return raw[quote + width : -width], start + quote + width, end - width


class Pairs:
    """The name-literal pairs of a text, and which name holds which."""

    def __init__(self, text: str):
        self.text = text
        self.literals: dict[str, list[tuple[str, int, int]]] = {}
        self.named: dict[str, list[str]] = {}
        self.tokens = [t for t in TOKEN.finditer(text) if t.lastgroup != "space"]
        self.read()
        for m in ELEMENT.finditer(text) if "</" in text else ():
            self.literals.setdefault(m[1], []).append((m[2].rstrip(), m.start(2), m.start(2) + len(m[2].rstrip())))

    def add(self, names: list[str], token: re.Match, bare_to: int) -> int:
        """Give a value that starts at ``token`` to ``names``; the place in the text up to which it was read."""
        if token.lastgroup in ("string", "long"):
            value = literal_of(token)
            end = token.end()
        else:
            m = BARE.match(self.text, token.start())
            if m is None:
                return token.end()
            value, end = (m[0], m.start(), m.end()), m.end()
            if NAME.fullmatch(m[0]):
                for name in names:
                    self.named.setdefault(name, []).append(m[0])
                # a word of its own is a literal as well, unless it turns out to be a name that holds something
                value = (m[0], m.start(), m.end())
        for name in names:
            self.literals.setdefault(name, []).append(value)
        return end

    def read(self) -> None:
        tokens, n = self.tokens, len(self.tokens)
        blocks: list[tuple[int, str]] = []  # keys above, by indentation, and the most sensitive of it and those above it
        stack: list[tuple[str, str, str]] = []  # open brackets, the name that each belongs to, and likewise
        indent, title, past, i = 0, "", -1, 0
        last = ""  # the name just before, with its subscripts
        while i < n:
            t = tokens[i]
            kind, raw = t.lastgroup, t[0]
            i += 1
            if kind == "line":
                indent, last = len(raw) - 1, ""
                while blocks and blocks[-1][0] >= indent and i < n and tokens[i].lastgroup != "line":
                    blocks.pop()
                continue
            if t.start() < past:  # inside a bare value
                continue
            if kind == "word":
                last = raw
                continue
            if kind in ("string", "long"):
                body, start, end = literal_of(t)
                nxt = tokens[i][0] if i < n else ""
                if stack and stack[-1][0] == "(" and stack[-1][1] and nxt in (",", ")", "+", "."):
                    self.literals.setdefault(stack[-1][1], []).append((body, start, end))
                elif stack and stack[-1][0] == "[" and stack[-1][1] and nxt in (",", "]", "\n") and not last:
                    self.literals.setdefault(stack[-1][1], []).append((body, start, end))
                last = "" if "\n" in body else body
                continue
            if kind != "sign":
                m = NAME.search(raw) if kind == "value" else None
                last = m[0] if m else ""
                continue
            if raw in ("(", "[", "{"):
                if raw == "[" and last:  # a subscript: its parts are parts of the name
                    j, parts = i, [last]
                    while j < n and tokens[j].lastgroup in ("string", "word", "value"):
                        parts.append(literal_of(tokens[j])[0] if tokens[j].lastgroup == "string" else tokens[j][0])
                        j += 1
                    if j > i and j < n and tokens[j][0] == "]":
                        last, i = ".".join(parts), j + 1
                        continue
                stack.append((raw, last, sharper(last, stack[-1][2] if stack else "")))
                last = ""
            elif raw in (")", "]", "}"):
                if stack:
                    stack.pop()
                last = ""
            elif raw in ("=", ":=", "=>", ":", "+=") and last:
                name, typed = last, ""
                if raw == ":" or raw == "=>":
                    j, depth = i, 0  # a type may stand between the name and its sign; it ends before the next colon
                    while j < n and tokens[j].lastgroup != "line":
                        x = tokens[j][0]
                        depth += x in ("[", "<", "(") and 1 or (x in ("]", ">", ")") and -1) or 0
                        if x == "=" and depth <= 0:
                            typed = "yes" if j > i else ""
                            break
                        if x in (";", "{", "}", ",") and depth <= 0 or tokens[j].lastgroup in ("string", "long") or x in (":", "=>"):
                            break
                        j += 1
                    if typed:
                        self.value([name], i, past)
                        i = j + 1
                names = [name]
                above = sharper(stack[-1][2] if stack else "", blocks[-1][1] if blocks else "")
                if above:
                    names.append(above)
                if title and name.lower() in ("value", "default", "val"):
                    names.append(title)
                if i < n and tokens[i].lastgroup in ("string", "long") and name.lower().rpartition(".")[2] in TITLES:
                    title = literal_of(tokens[i])[0]
                if i >= n or tokens[i].lastgroup == "line":
                    if raw == ":":
                        blocks.append((indent, sharper(name, blocks[-1][1] if blocks else "")))
                    last = ""
                    continue
                if name.lower() in TITLES and tokens[i].lastgroup == "word":
                    title = tokens[i][0]
                if tokens[i][0] in ("{", "[", "("):
                    stack.append((tokens[i][0], name, sharper(name, above)))
                    i += 1
                    last = ""
                    continue
                i, past = self.value(names, i, past)
                last = ""
            elif raw in ("?", "!", "]", "&", "|"):
                pass  # signs that may stand between a name and its sign
            else:
                last = ""

    def value(self, names: list[str], i: int, past: int) -> tuple[int, int]:
        """Read a value and what is joined to it, from token ``i``; the next token, and the place up to which it was read."""
        tokens, n = self.tokens, len(self.tokens)
        while i < n:
            t = tokens[i]
            if t.lastgroup == "word" and i + 1 < n and tokens[i + 1][0] in ("(", "["):
                return i, past  # a call or a subscript, read by itself
            if t.lastgroup in ("string", "long", "word", "value") or t.lastgroup in ("sign", "other") and BARE.match(t[0]) and t[0] not in ("=", "+", "."):
                past = max(past, self.add(names, t, past))
            else:
                return i, past
            while i < n and tokens[i].start() < past:
                i += 1
            if i < n and tokens[i].lastgroup in ("string", "long") and t.lastgroup in ("string", "long"):
                continue
            if i + 1 < n and tokens[i][0] in ("+", ".", "&", "\\") and tokens[i + 1].lastgroup in ("string", "long", "word", "line"):
                i += 1 + (tokens[i + 1].lastgroup == "line")
                continue
            return i, past
        return i, past

    def carried(self) -> dict[tuple[int, int], tuple[float, str]]:
        """The best weight of each literal's place, over all names that hold it directly or by way of others."""
        best: dict[tuple[int, int], tuple[float, str]] = {}
        met: set[str] = set()
        weights = {name: sensitivity(name) for name in self.literals.keys() | self.named.keys()}
        for name in sorted((n for n, weight in weights.items() if weight), key=weights.__getitem__, reverse=True):
            todo, weight = [name], weights[name]
            while todo:  # the heaviest come first, so that a name is followed once
                at = todo.pop()
                if at in met:
                    continue
                met.add(at)
                holds = self.named.get(at, ())
                for literal, start, end in self.literals.get(at, ()):
                    if literal in holds and self.held(literal):
                        continue  # it is a name
                    if weight > best.get((start, end), (0.0, ""))[0]:
                        best[start, end] = (weight, literal)
                for other in holds:
                    todo += (known for known in (other, other.rpartition(".")[2]) if known not in met and known in self.literals)
        return best

    def held(self, name: str) -> bool:
        return name in self.literals or name.rpartition(".")[2] in self.literals


def lexed_spans(text: str, least: float = 0.55) -> list[tuple[int, str, int]]:
    """Spans of the literals whose best name is sensitive enough, constants carried on whatever the order of the text."""
    flat = text.lower().replace("_", "").replace("-", "").replace(".", "")
    if not any(part in flat for part, _ in SENSITIVE):
        return []
    found = [(start, "lexed", end) for (start, end), (weight, literal) in Pairs(text).carried().items() if len(literal) >= 8 and weight * strength(literal) >= least]
    return sorted(found)


def joined(spans: list[tuple[int, str, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in ordered)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs`` (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start and then kind. base_sha256 is of the fixed
    patterns' spans alone. Null texts are empty: no spans, the digest of nothing. Whole texts are scanned. Repeated rows
    are scanned each; other columns are ignored.
    """

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            counts, digests, spans = [[], [], []], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                kinds = Counter(s[1] for s in base)
                for column, kind in zip(counts, KINDS, strict=False):
                    column.append(kinds[kind])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + lexed_spans(text or "")))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of all ``documents``."""
    return scan_secrets(table(spark, sf_dir, "documents"))
