"""Secrets in texts: fixed patterns, and literals assigned to names that promise a secret.

The lexer reads source code and configuration files as pairs of a name and an expression: assignments (``name = "x"``,
``"name": "x"``, ``name := x``, ``export NAME=x``), attributes, a key or name followed by its ``value``, elements, quotes of
one, three and back kind, lists (YAML's too), maps below a sensitive name, YAML blocks, passwords of URLs and PEM blocks. Constants are
propagated, so a literal is also judged by the names it reaches later (``k = "x"; db.password = k``); lists and YAML blocks are judged
where they are and not propagated. The words of a name and the shape of the literal give its score.

Constants are kept as a graph of literals, with the counts of characters of their whole text beside each name, so time
and memory follow the text however often a name is added to itself. Counts are kept in proportion beyond 10^12 characters; characters beyond
ASCII are counted in 128 classes.

Defined results: a null or empty text has no spans; rows are scanned one by one, so repeated rows
repeat their result; offsets count code points; an empty table gives no rows; other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesight.llm.batches import slices

KINDS = ("assign", "access", "hex", "literal")
BASE_KINDS = KINDS[:3]
MIN_SCORE = 0.4
MASK = "[SECRET]"

# The patterns of the base kinds.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# How much a word of a name promises a secret, and words that take it back: the name of a file, not its content.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 1.0,
             "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.6, "bearer": 0.8, "signature": 0.5, "salt": 0.5, "key": 0.4}
KEY_OWNERS = {"api", "access", "private", "secret", "encryption", "signing", "master", "account", "shared"}
HARMLESS = {"file", "path", "url", "uri", "name", "length", "policy", "hint", "field", "label", "type", "ttl", "expiry", "count", "public"}
PLACEHOLDERS = {"changeme", "password", "secret", "none", "null", "true", "false", "example", "undefined", "required", "default"}

INHERITED = 0.7  # a name within a map has this part of what the map's own name promises
LABELS, LABELLED = {"key", "name", "id"}, {"value", "content"}

_TOKEN = re.compile(r"(?<![=!<>:])(?::=|=>|=|:)(?![=:/])|[{}]")
_NAME_BEFORE = re.compile(r"[A-Za-z0-9_.$-]")
_QUOTED = re.compile(r"""[ \t]*(?:[bBrRuUfF@$]{1,2}(?=["'`]))?(?:(\"""|\'\'\'|`)|"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)')""")
_BARE = re.compile(r"[ \t]*(?:(?:Bearer|Basic)[ \t]+)?(?:\$\{|[$%])?([A-Za-z0-9_./+=$~^!@*-]+)[%}]?")
_PLUS = re.compile(r"[ \t]*\+")
_OPEN = re.compile(r"[ \t]*[\[(]")
_BETWEEN = re.compile(r"[ \t\r\n,\[\]()]*+")
_MEMBER = re.compile(r"\$?([A-Za-z0-9_.-]++)(?=[ \t\r\n]*+[,\])])")
_MAP = re.compile(r"[ \t\r\n]*\{")
_ITEM = re.compile(r"""[ \t]*\r?\n([ \t]*)-[ \t]+(?:"([^"\r\n]*+)"|'([^'\r\n]*+)'|([^\s"'#:]++))[ \t]*(?=\r?\n|$)""")
_BLOCK = re.compile(r"[ \t]*[|>][+-]?[ \t]*\r?\n")
_LINE = re.compile(r"([ \t]*)([^\r\n]*+)(\r?\n|$)")
_ELEMENT = re.compile(r"<([A-Za-z][\w.-]*+)>([^<>\n]++)</")
_URL_PASSWORD = re.compile(r"""://[^\s/:@"'`]*+:([^\s/@"'`]++)@""")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns, leftmost and non-overlapping per kind."""
    spans = []
    if ":" in text or "=" in text:
        lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        if any(word in lowered for word in _KEYWORDS):
            spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


@lru_cache(maxsize=4096)
def _judged(name: str) -> tuple[str, float]:
    words = [w.lower() for w in _NAME_WORDS.findall(name)]
    words = [w[:-1] if w[-1] == "s" and w[:-1] in SENSITIVE else w for w in words]
    score = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    if "key" in words and KEY_OWNERS & set(words):
        score = 1.0
    last = words[-1] if words else ""
    return last, score * (0.3 if last in HARMLESS or "public" in words else 1.0)


def judged(name: str) -> tuple[str, float]:
    """The last word of a name, and 0 to 1: how much the name promises a secret value."""
    return _judged(name) if len(name) <= 100 else _judged.__wrapped__(name)


class Shape(NamedTuple):
    """What the score of a literal depends on; shapes of joined literals are joined without their texts."""

    length: float
    counts: dict[int, float]
    kinds: int  # bits: lower, upper, digit, other, not a letter, blank, template
    word: str | None  # lower case, of short literals


LOWER, UPPER, DIGIT, OTHER, NO_LETTER, BLANK, TEMPLATE = (1 << k for k in range(7))
_SHORT, _LARGE = 16, 1e12


@lru_cache(maxsize=4096)
def _kind(c: str) -> tuple[int, int]:
    """The class that a character is counted in, and its bits."""
    return (ord(c) if c < "\x80" else 128 + ord(c) % 128,
            LOWER * c.islower() | UPPER * c.isupper() | DIGIT * c.isdigit() | OTHER * (not c.isalnum()) | NO_LETTER * (not c.isalpha()) | BLANK * (c == " "))


def shape_of(value: str) -> Shape:
    counts: dict[int, float] = {}
    kinds = TEMPLATE if "${" in value else 0
    for c, n in Counter(value).items():
        place, bits = _kind(c)
        counts[place] = counts.get(place, 0) + n
        kinds |= bits
    return Shape(len(value), counts, kinds, value.lower() if len(value) <= _SHORT else None)


def joined(shapes: list[Shape]) -> Shape:
    """The shape of a text made of literals of these shapes."""
    length, kinds, counts = sum(s.length for s in shapes), 0, {}
    for shape in shapes:
        kinds |= shape.kinds
        for c, n in shape.counts.items():
            counts[c] = counts.get(c, 0) + n
    if length > _LARGE:
        length, counts = length / _LARGE * 1e6, {c: n / _LARGE * 1e6 for c, n in counts.items()}
    short = length <= _SHORT and all(s.word is not None for s in shapes)
    return Shape(length, counts, kinds, "".join(s.word for s in shapes) if short else None)


def shape_score(shape: Shape) -> float:
    """0 to 1: how much a literal looks like a secret, by its length, characters and entropy."""
    length = shape.length
    if length < 6 or shape.word in PLACEHOLDERS or len(shape.counts) < 4 or shape.kinds & TEMPLATE:
        return 0.0
    entropy = -sum(n / length * math.log2(n / length) for n in shape.counts.values())
    one_case = not shape.kinds & NO_LETTER and (shape.kinds & (LOWER | UPPER)).bit_count() == 1
    return min(1.0, entropy / 4.0) * min(1.0, length / 10) * (0.5 if one_case else 1.0) * (0.5 if shape.kinds & BLANK else 1.0)


def literal_score(value: str) -> float:
    return shape_score(shape_of(value))


class Lexer:
    """Assigned names of one text, each with the terms ``(start, end, quoted)`` of its value, in the order of the text."""

    def __init__(self, text: str):
        self.text = text
        self.floor = 0  # what lies before is read
        self.unclosed: set[str] = set()

    def quoted(self, at: int) -> tuple[int, int, int] | None:
        """Start and end of a quoted literal at a place, and the place behind it."""
        found = _QUOTED.match(self.text, at)
        if not found:
            return None
        if found.group(1) is None:
            which = 2 if found.group(2) is not None else 3
            return found.start(which), found.end(which), found.end()
        mark = found.group(1)
        end = -1 if mark in self.unclosed else self.text.find(mark, found.end())
        if end < 0:
            self.unclosed.add(mark)  # there is none behind any later place either
            return None
        return found.end(), end, end + len(mark)

    def terms(self, at: int) -> list[tuple[int, int, bool]]:
        """Literals and names joined by plus signs."""
        out = []
        while True:
            if literal := self.quoted(at):
                start, end, at = literal
                out.append((start, end, True))
                # A literal of several lines may hold assignments itself.
                self.floor = at if self.text.find("\n", start, end) < 0 else max(self.floor, start)
            elif bare := _BARE.match(self.text, at):
                at = bare.end()
                out.append((bare.start(1), bare.end(1), False))
            else:
                return out
            plus = _PLUS.match(self.text, at)
            if not plus:
                return out
            at = plus.end()

    def elements(self, at: int) -> list[tuple[int, int, bool]]:
        """Literals and names of a list that opens at a place, nested lists included, up to its end or to what is neither."""
        out, depth = [], 0
        while True:
            between = _BETWEEN.match(self.text, at).group()
            depth += sum(between.count(c) for c in "[(") - sum(between.count(c) for c in "])")
            at += len(between)
            if depth <= 0:
                return out
            if literal := self.quoted(at):
                start, end, at = literal
                out.append((start, end, True))
                self.floor = max(self.floor, at)
            elif bare := _MEMBER.match(self.text, at):
                at = bare.end()
                out.append((bare.start(1), bare.end(1), False))
            else:
                return out

    def items(self, at: int) -> list[tuple[int, int, bool]]:
        """Items of a YAML list below a name, or its indented block as one literal."""
        out = []
        while item := _ITEM.match(self.text, at):
            which = next(k for k in (2, 3, 4) if item.group(k) is not None)
            out.append((item.start(which), item.end(which), True))
            at = self.floor = item.end()
        block = None if out else _BLOCK.match(self.text, at)
        if block:
            at, start, end, least = block.end(), -1, -1, None
            line_start = self.text.rfind("\n", 0, block.start()) + 1
            indent = len(_LINE.match(self.text, line_start).group(1))
            while at < len(self.text):
                line = _LINE.match(self.text, at)
                if line.group(2):
                    least = len(line.group(1)) if least is None else least
                    if len(line.group(1)) < least or least <= indent:
                        break
                    start, end = (line.start(2) if start < 0 else start), line.end(2)
                at = line.end()
            if start >= 0:
                self.floor = end
                out.append((start, end, True))
        return out

    def name_before(self, end: int) -> str:
        text, floor = self.text, self.floor
        while end > floor and text[end - 1] in " \t":
            end -= 1
        if end > floor and text[end - 1] in "\"'])":
            end -= 1
            if end > floor and text[end - 1] in "\"'":
                end -= 1
        start = end
        while start > floor and _NAME_BEFORE.match(text, start - 1):
            start -= 1
        return text[start:end]

    def assignments(self) -> Iterator[tuple[str, float, list[tuple[int, int, bool]], bool]]:
        """Name, how much it promises, terms, and whether they are one expression that the name is bound to, not a list."""
        text, label, depth = self.text, "", 0
        maps: list[tuple[int, float]] = []  # open maps of sensitive names: depth, promise
        opened = (-1, 0.0)
        for token in _TOKEN.finditer(text):
            if token.start() < self.floor:
                continue  # within the literal of the assignment before
            if token.group() == "{":
                depth += 1
                if opened[0] == token.start():
                    maps.append((depth, opened[1]))
                continue
            if token.group() == "}":
                if maps and maps[-1][0] == depth:
                    maps.pop()
                depth = max(0, depth - 1)
                continue
            name = self.name_before(token.start())
            if not any(c.isalpha() for c in name):
                continue
            last, promised = judged(name)
            if label and last in LABELLED:
                name, (last, promised) = label, judged(label)
            label = ""
            if maps and last not in HARMLESS:
                promised = max(promised, INHERITED * maps[-1][1])
            if promised:
                if brace := _MAP.match(text, token.end()):
                    opened = (brace.end() - 1, promised)
                    continue
                listed = self.elements(token.end()) if _OPEN.match(text, token.end()) else self.items(token.end())
                if listed:
                    yield name, promised, listed, False
                    continue
            terms = self.terms(token.end())
            if terms:
                if len(terms) == 1 and last in LABELS and terms[0][1] - terms[0][0] <= 200:
                    label = text[terms[0][0]:terms[0][1]]
                yield name, promised, terms, True


def marked(text: str) -> Iterator[tuple[int, int, str, float]]:
    """``(start, end, name, score)`` of secrets that their markup names: elements, passwords of URLs, PEM blocks."""
    for found in _ELEMENT.finditer(text) if "</" in text else ():
        if promised := judged(found.group(1))[1]:
            value = found.group(2)
            yield found.start(2) + len(value) - len(value.lstrip()), found.start(2) + len(value.rstrip()), found.group(1), promised * literal_score(value.strip())
    for found in _URL_PASSWORD.finditer(text) if "://" in text else ():
        yield found.start(1), found.end(1), "url password", literal_score(found.group(1))
    at = 0
    while block := _PEM.search(text, at):
        at = text.find("-----END", block.end())
        if at < 0:
            break
        body = text[block.end():at]
        yield block.end() + len(body) - len(body.lstrip()), block.end() + len(body.rstrip()), "private key", 1.0


def literal_spans(text: str, least: float = MIN_SCORE) -> list[tuple[int, int, str, str, float]]:
    """``(start, end, "literal", name, score)`` of literals that reach a sensitive name, with the best of their scores, in the order of the text.

    ``graph`` holds a literal's place, or the numbers of the joined ones. Names are followed from the best score down, so every
    part of the graph is visited once.
    """
    if ":" not in text and "=" not in text and "</" not in text and "PRIVATE KEY-----" not in text:
        return []
    graph: list[tuple[int, int] | list[int]] = []
    constants: dict[str, list] = {}  # name → [number in the graph, shape once it is needed]
    reached: list[tuple[float, str, int]] = []

    def value_of(start: int, end: int, quoted: bool) -> list:
        known = None if quoted else constants.get(text[start:end].lstrip("$"))
        if known is None:
            graph.append((start, end))
            known = [len(graph) - 1, None]
        return known

    def shape(value: list) -> Shape:
        if value[1] is None:
            value[1] = shape_of(text[slice(*graph[value[0]])])
        return value[1]

    for name, promised, terms, bound in Lexer(text).assignments():
        values = [value_of(*term) for term in terms]
        if bound and len(values) > 1:
            whole = joined([shape(v) for v in values])
            graph.append([v[0] for v in values])
            values = [[len(graph) - 1, whole]]
        if bound:
            constants[name] = values[0]
        else:
            constants.pop(name, None)
        if promised:
            reached += [(score, name, v[0]) for v in values if (score := promised * shape_score(shape(v))) >= least]

    best: dict[tuple[int, int], tuple[float, str]] = {}
    seen = bytearray(len(graph))
    for score, name, number in sorted(reached, reverse=True):
        waiting = [number]
        while waiting:
            at = waiting.pop()
            if seen[at]:
                continue
            seen[at] = 1
            if isinstance(graph[at], list):
                waiting += graph[at]
            else:
                best[graph[at]] = (score, name)
    for start, end, name, score in marked(text):
        if score >= least:
            best[start, end] = max(best.get((start, end), (0.0, "")), (score, name))
    return [(start, end, "literal", name, score) for (start, end), (score, name) in sorted(best.items()) if end > start]


def spans_of(text: str) -> list[tuple[int, int, str, str, float]]:
    """All spans of a text by start, then kind."""
    spans = [(start, end, kind, "", 1.0) for start, end, kind in base_spans(text)] + literal_spans(text)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans, base_sha256)``, one row per document; spans hold kind, start, end, name and score."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = [spans_of(text.as_py() or "") for text in batch.column(1)]
            digests = [hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k, *_ in row if k in BASE_KINDS).encode()).hexdigest() for row in rows]
            spans = [[{"kind": k, "start": s, "end": e, "name": n, "score": p} for s, e, k, n, p in row] for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN)), pa.array(digests, pa.string())],
                                             names=["id", "spans", "base_sha256"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = (f"id {chosen.schema['id'].dataType.simpleString()}, "
              "spans array<struct<kind:string,start:long,end:long,name:string,score:double>>, base_sha256 string")
    return chosen.mapInArrow(found, schema).withColumnRenamed("id", id_col)


def masked(text: str, mask: str = MASK) -> str:
    """The text with every span, overlaps merged, replaced by ``mask``."""
    out, at = [], 0
    for start, end, *_ in spans_of(text):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """The same rows and columns with secrets replaced; a null text stays null."""
    at = docs.columns.index(text_col)

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = pa.array([None if t.as_py() is None else masked(t.as_py(), mask) for t in batch.column(at)], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(replaced, docs.schema)
