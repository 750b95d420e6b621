"""Secret scans by assignment-aware lexing.

Base patterns find assignments to sensitive names, access keys and long hexadecimal runs. On top of them a lexer
reads every assignment of source or configuration syntax (``name = "literal"``, ``name: literal``, ``name := ...``,
``"name" => ...``) into a name and the terms of its value: string literals, bare configuration values, names of constants and
``${name}`` references, joined by ``+``, ``.`` or by standing side by side. Constants are propagated: the value of a name is
the concatenation of its terms, resolved through the document's other assignments, earlier ones first; bindings that lead
back to each other count as one value of all their literals. Each binding is resolved once, to the byte counts
and the two ends of its value, so neither its length, its literals nor the depth of constants has a limit. A value
is scored by how sensitive the words of its target name are, times how random the value looks; where the score
reaches ``least``, every literal that the value is made of is a span of kind ``lexed``. Private keys in PEM form count under every
sensitive name, quoted, bare or as a block; other values with white space only quoted and under names of sensitivity 1.

Spans are in code points of the whole text, end exclusive.

Edge cases: a null text has no spans and so has an empty one; equal spans of different kinds are all listed; ties of
start are listed in the order of KINDS; a name bound twice takes its latest binding before the use, or else its first;
repeated rows are scanned alike; further columns, whatever their names, are ignored, and kept by ``redact``; very long texts are scanned
whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.textcore import map_batches, texts
from lakeloom.plans.runtime import col

KINDS = ("assign", "access", "hex", "lexed")
LEAST_SCORE = 0.5
#: Bytes of both ends of a value that are kept: more than a placeholder and the marks of private keys have.
EDGE = 24
KEY_MARKS = (b"PRIVATE KEY-----", b"PRIVATE KEY BLOCK-----")
#: A private key is longer than its first and last line.
LEAST_KEY = 80
CLASSES = (frozenset(range(97, 123)), frozenset(range(65, 91)), frozenset(range(48, 58)), frozenset(range(256)) - frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
TEMPLATE, BLANK = frozenset(b"<>{}"), frozenset(b" \t\n\r\x0b\x0c")

#: Sensitivity of name words, and of two words that follow each other: fixed values.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "bearer": 0.9, "auth": 0.7, "authorization": 0.8, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "pin": 0.5, "cookie": 0.6, "signature": 0.6, "salt": 0.7, "pass": 0.7,
}
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("encryption", "key"): 1.0, ("signing", "key"): 1.0, ("account", "key"): 0.9, ("connection", "string"): 0.7}
#: Words that say a name holds something about a secret, not the secret.
HARMLESS = {"length", "len", "min", "max", "name", "file", "path", "url", "uri", "type", "id", "expiry", "expires", "ttl", "hint", "label", "field", "regex", "pattern", "format", "count", "policy", "prompt", "header", "endpoint"}
PLACEHOLDERS = {"changeme", "change_me", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false", "undefined", "todo", "xxxxxxxx", "your_password", "redacted"}

ASSIGN = re.compile(rb"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")

TARGET = re.compile(rb"([\"'`]?)(?<![A-Za-z0-9_])(?<![A-Za-z0-9_][.-])([A-Za-z_][A-Za-z0-9_]*+(?:[.-][A-Za-z_][A-Za-z0-9_]*+)*+)\1(?:[\x20\t]*\])?[\x20\t]*(?::[\x20\t]*[A-Za-z_][A-Za-z0-9_.]*(?:\[[A-Za-z0-9_., ]*\])?[\x20\t]*(?==))?(:=|=>|===?|!=|<=|>=|=|:)[\x20\t]*")
STRING = re.compile(rb"[rbfuRBFU]{0,2}(\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)", re.S)
REFERENCE = re.compile(rb"\$\{([A-Za-z_][A-Za-z0-9_.]*)\}|\$([A-Za-z_][A-Za-z0-9_]*)")
NAME = re.compile(rb"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*(?![A-Za-z0-9_+/=-])")
PEM = re.compile(rb"(?:[|>][+-]?[\x20\t]*\r?\n\s*+)?(-----BEGIN\x20(?:[A-Z0-9]+\x20)*?PRIVATE\x20KEY(?:\x20BLOCK)?-----(?:(?!-----)[\s\S])*+-----END\x20[A-Z0-9\x20]*+-----)")
BARE = re.compile(rb"[A-Za-z0-9+/_.=~!@%^&*?-]+")
JOINER = re.compile(rb"[\x20\t]*(?:[+.][\x20\t]*(?:\\?\n[\x20\t]*)?)?")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Term(NamedTuple):
    """A literal (with its place) or, without a place, the name of a constant."""

    value: bytes
    start: int = -1
    end: int = -1


def name_score(name: bytes) -> float:
    """Sensitivity of a target name, 0 to 1."""
    words = [w.lower() for w in WORD.findall(name.decode("ascii"))]
    if not words or words[-1] in HARMLESS:
        return 0.0
    found = [SENSITIVE.get(w, 0.0) for w in words] + [SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False)]
    return max(found)


class Value(NamedTuple):
    """What a score needs of a value of any length: bytes counted in units of 2 ** power, both ends, and whether a private key is in it."""

    counts: dict[int, float]
    power: int
    head: bytes
    tail: bytes
    key: bool


def literal(value: bytes) -> Value:
    return Value(Counter(value), 0, value[:EDGE], value[-EDGE:], any(x in value for x in KEY_MARKS))


def concatenated(values: list[Value]) -> Value:
    """The value of several values behind each other."""
    if len(values) == 1:
        return values[0]
    power = max((v.power for v in values), default=0)
    counts: dict[int, float] = {}
    head, tail, key = b"", b"", False
    for v in values:
        for byte, n in v.counts.items():
            counts[byte] = counts.get(byte, 0) + (n if v.power == power else math.ldexp(n, v.power - power))
        key = key or v.key or any(x in tail + v.head for x in KEY_MARKS)
        head = head if len(head) == EDGE else (head + v.head)[:EDGE]
        tail = v.tail if len(v.tail) == EDGE else (tail + v.tail)[-EDGE:]
    if sum(counts.values()) > 2**52:
        counts, power = {byte: math.ldexp(n, -50) for byte, n in counts.items()}, power + 50
    return Value(counts, power, head, tail, key)


def literal_score(value: bytes | Value, sensitive: float = 0.0) -> float:
    """How much the value of a name looks like a secret, 0 to 1: long, mixed, of high entropy and no placeholder."""
    v = literal(value) if isinstance(value, bytes) else value
    total = sum(v.counts.values())
    if v.key and (v.power or total >= LEAST_KEY):
        return 1.0
    if len(v.head) < 8 or len(v.counts) < 4 or (len(v.head) < EDGE and v.head.lower().decode("latin-1") in PLACEHOLDERS):
        return 0.0
    if not v.counts.keys().isdisjoint(TEMPLATE) or (sensitive < 1.0 and not v.counts.keys().isdisjoint(BLANK)):
        return 0.0
    entropy = -sum(n / total * math.log2(n / total) for n in v.counts.values() if n / total)
    classes = sum(not v.counts.keys().isdisjoint(x) for x in CLASSES)
    return min(1.0, 0.15 + 0.17 * entropy + 0.1 * (classes - 1)) if classes > 1 or entropy > 3.2 else 0.3


def assignments(data: bytes) -> Iterator[tuple[int, bytes, list[Term]]]:
    """(place, target name, terms of its value) of every assignment."""
    at = 0
    while (m := TARGET.search(data, at)) is not None:
        at = m.end()
        if m[3] in (b"==", b"===", b"!=", b"<=", b">="):
            continue
        terms, at = _terms(data, at)
        if terms:
            yield m.start(), m[2], terms


def _terms(data: bytes, at: int) -> tuple[list[Term], int]:
    terms: list[Term] = []
    while True:
        if (m := STRING.match(data, at)) is not None:
            quote = 3 if m[1][:3] in (b'"""', b"'''") else 1
            terms += _parts(data, m.start(1) + quote, m.end(1) - quote)
        elif (m := REFERENCE.match(data, at)) is not None:
            terms.append(Term(m[1] or m[2]))
        elif not terms and (m := PEM.match(data, at)) is not None:
            return [Term(m[1], m.start(1), m.end(1))], m.end()
        elif (m := NAME.match(data, at)) is not None and not terms and data[m.end() : m.end() + 1] not in (b"(", b"["):
            # A bare word is a constant if one is bound, else a configuration value.
            terms.append(Term(m[0], m.start(), m.end()))
        elif (m := NAME.match(data, at)) is not None and terms:
            terms.append(Term(m[0]))
        elif not terms and (m := BARE.match(data, at)) is not None and data[m.end() : m.end() + 1] not in (b"(", b"["):
            return [Term(m[0], m.start(), m.end())], m.end()
        else:
            return terms, at
        at = m.end()
        joined = JOINER.match(data, at)
        more = joined.end()
        if more == at or (joined[0].strip() == b"" and STRING.match(data, more) is None):
            return terms, at
        at = more


def _parts(data: bytes, start: int, end: int) -> list[Term]:
    """A string literal, cut at its ``${name}`` references."""
    terms, at = [], start
    for m in REFERENCE.finditer(data, start, end):
        if m[1]:
            terms += [Term(data[at : m.start()], at, m.start())] if m.start() > at else []
            terms.append(Term(m[1]))
            at = m.end()
    return terms + ([Term(data[at:end], at, end)] if end > at else [])


def lexed_spans(data: bytes, least: float = LEAST_SCORE) -> list[tuple[int, int]]:
    """Byte spans of the literals that reach sensitive names with a score of at least ``least``."""
    if b"=" not in data and b":" not in data:
        return []
    order = list(assignments(data))
    wanted = [i for i, (_, name, _) in enumerate(order) if name_score(name) >= least]
    if not wanted:
        return []
    bound: dict[bytes, list[tuple[int, int]]] = {}
    for i, (at, name, _) in enumerate(order):
        bound.setdefault(name, []).append((at, i))

    def parts(i: int) -> list[int | Term]:
        """The terms of a binding: literals, and other bindings."""
        at, _, terms = order[i]
        out: list[int | Term] = []
        for t in terms:
            known = bound.get(t.value) if t.start < 0 or (NAME.fullmatch(t.value) and data[t.start - 1 : t.start] not in (b'"', b"'", b"`")) else None
            j = known[max(0, bisect_left(known, at, key=lambda x: x[0]) - 1)][1] if known else i
            if j != i:
                out.append(j)
            elif t.start >= 0:
                out.append(t)
        return out

    values, groups = _resolved(wanted, parts)
    found: set[tuple[int, int]] = set()
    listed_groups: set[int] = set()
    for i in wanted:
        sensitive = name_score(order[i][1])
        if sensitive * literal_score(values[i], sensitive) < least:
            continue
        todo = [i]
        while todo:
            group = groups[todo.pop()]
            if id(group) not in listed_groups:
                listed_groups.add(id(group))
                for x in (x for _, terms in group for x in terms):
                    todo.append(x) if isinstance(x, int) else found.add((x.start, x.end))
    return sorted(found)


def _resolved(wanted: list[int], parts: Callable[[int], list[int | Term]]) -> tuple[dict[int, Value], dict[int, list[tuple[int, list[int | Term]]]]]:
    """The value of every binding that those wanted lead to, and the bindings with their parts that lead to each other and share it (Tarjan)."""
    values: dict[int, Value] = {}
    groups: dict[int, list[tuple[int, list[int | Term]]]] = {}
    seen: dict[int, int] = {}
    low: dict[int, int] = {}
    terms: dict[int, list[int | Term]] = {}
    waiting: list[int] = []
    for root in wanted:
        path: list[tuple[int, Iterator[int]]] = []
        following: int | None = None if root in seen else root
        while following is not None or path:
            if following is not None:
                i, following = following, None
                seen[i] = low[i] = len(seen)
                terms[i] = parts(i)
                waiting.append(i)
                path.append((i, iter([x for x in terms[i] if isinstance(x, int)])))
            i, left = path[-1]
            for j in left:
                if j not in seen:
                    following = j
                    break
                if j not in values:
                    low[i] = min(low[i], seen[j])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[i])
                if low[i] == seen[i]:
                    cut = len(waiting) - 1
                    while waiting[cut] != i:
                        cut -= 1
                    members = sorted(waiting[cut:])
                    del waiting[cut:]
                    value = concatenated([values[x] if isinstance(x, int) else literal(x.value) for m in members for x in terms[m] if not isinstance(x, int) or x in values])
                    group = [(m, terms[m]) for m in members]
                    for m in members:
                        values[m], groups[m] = value, group
    return values, groups


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the base patterns."""
    found = []
    low = data.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if len(m[2]) >= 8]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    return found


def spans(data: bytes | None, least: float = LEAST_SCORE) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, in code points, in order."""
    if not data:
        return []
    found = base_spans(data) + [(s, 3, e) for s, e in lexed_spans(data, least)]
    if not found:
        return []
    points, at, chars = {}, 0, 0
    for place in sorted({x for s, _, e in found for x in (s, e)}):
        chars += len(data[at:place].decode("utf-8", "ignore"))
        points[place], at = chars, place
    return sorted((points[s], k, points[e]) for s, k, e in found)


SPANS = "array<struct<start:bigint,kind:string,end:bigint>>"
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """doc_id and its spans as structs (start, kind, end), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans(x, least)] for x in texts(batch, text)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(doc_id)), pa.array(out, ARROW_SPANS)], ["doc_id", "spans"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T.StructType.fromDDL(f"spans {SPANS}").fields])
    return map_batches(docs.select(col(doc_id), col(text)), run, schema)


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame, **options: str) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, and all spans."""
    base = F.filter("spans", lambda x: x["kind"] != "lexed")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(docs, **options).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of the text replaced by ``mark``."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            out = [None if x is None else _without(x.decode("utf-8", "replace"), spans(x), mark) for x in texts(batch, text)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names)

    return map_batches(docs, run, schema)


def _without(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    at, parts = 0, []
    for s, _, e in found:
        if s >= at:
            parts += [text[at:s], mark]
        at = max(at, e)
    return "".join([*parts, text[at:]])
