"""Secret scans: three fixed patterns, and assignment-aware lexing of source and configuration.

The base patterns find ``assign`` (a telling name and its value), ``access`` (access key
ids) and ``hex`` (long hexadecimal runs), each leftmost and without overlaps; a match whose
value is too short is dropped but has used up its characters.

The lexer reads statements of the forms source and configuration files share: a name
(quoted or dotted or not, with or without a type), ``=``, ``:``, ``:=`` or ``=>``, and on the
right one or more literals or names joined by ``+``.  A name on the right stands for what was
assigned to it last before, or else first afterwards, so ``k = "..."`` and ``db_password = k``
lead back to the literal, through any number of names.  What is assigned is scored by how
sensitive the name is, times how much the value looks like a secret (length, mixture of
characters, entropy; placeholders score nothing).  From ``threshold`` on all of its literals
become spans of the kind ``lexed``, but for those that a base span already overlaps; base
spans always stay.

Statements refer to each other, so no list of literals is ever copied, and time and memory
grow with the text's length however its constants are chained.  A value that several literals
make up is judged by its length, its kinds of characters and an even sample of them.

A scan is one pass over the rows: no shuffle, and memory for one text at a time.  Null and
empty texts have no spans; null and repeated ids are rows like others; very long texts are
read whole.  An empty table has an empty result, and no extra column can clash, since only
the id and the text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.llm.cluster import batch_of, slices, texts_of

KINDS = ("assign", "access", "hex", "lexed")

# The base patterns, fixed by the contract.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more is what a filtered run is

#: Words of a name and how much they say about its value.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.9, "secret": 1.0, "token": 1.0, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "signingkey": 1.0, "bearer": 0.9, "auth": 0.7,
    "authorization": 0.8, "key": 0.6, "salt": 0.6, "cookie": 0.6, "session": 0.6, "dsn": 0.7, "webhook": 0.6,
}

NAME = r"(?>[A-Za-z_][A-Za-z0-9_]*(?:[.-][A-Za-z_][A-Za-z0-9_]*)*)"
QUOTED = r"\"(?>(?:[^\"\\\n]|\\.)*)\"|'(?>(?:[^'\\\n]|\\.)*)'|`[^`\\\n]*`"
TYPE = r"[\x20\t]*:[\x20\t]*(?>[A-Za-z_][A-Za-z0-9_.<>\[\]|?]*)(?=[\x20\t]*=)"
#: A name starts where no name goes on, so that a long dotted one is read once.
STATEMENT = re.compile(rf"""(?<![A-Za-z0-9_$])(?<![A-Za-z0-9_][.-])(?P<q>["']?)(?P<name>{NAME})(?P=q)(?:\[["'](?P<sub>{NAME})["']\])?(?:{TYPE})?[\x20\t]*(?::=|=>|(?<![=!<>])=(?!=)|:(?!:))[\x20\t]*(?P<right>(?:{QUOTED}|{NAME}|[A-Za-z0-9+/_=.-]{{8,}})(?:\x20*\+\x20*(?:{QUOTED}|{NAME}))*)""")
PART = re.compile(rf"(?P<quoted>{QUOTED})|(?P<bare>[A-Za-z0-9+/_=.-]+)")
PLACEHOLDER = re.compile(r"(?is)(?:[<$%{\[].*[>}%\]]|.*(?:x{4,}|\*{3,}|\.{3,}).*|(?:change.?me|example|placeholder|your[_-].*|dummy|redacted|none|null|true|false)[\W\d_]*)").fullmatch
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def name_score(name: str) -> float:
    """How sensitive a name is: the most telling of its words, or of two neighbours joined."""
    words = [w.lower() for w in CAMEL.findall(name)]
    return max((SENSITIVE.get(w, 0.0) for w in [*words, *map("".join, zip(words, words[1:], strict=False))]), default=0.0)


#: Characters that stand for a value of several literals.
SAMPLE = 64
CLASSES = [re.compile(p).search for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]


class Value:
    """What is known of a value: length, blanks, kinds of characters, and its text or an even sample of it."""

    __slots__ = ("blanks", "kinds", "length", "text")

    def __init__(self, text: str):
        self.text, self.length, self.blanks = text, len(text), text.count(" ")
        self.kinds = sum(1 << k for k, has in enumerate(CLASSES) if has(text))

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        out = cls("")
        for p in parts:
            out.length, out.blanks, out.kinds = min(out.length + p.length, 1 << 40), min(out.blanks + p.blanks, 1 << 40), out.kinds | p.kinds
        text = "".join(p.text for p in parts)
        step = 61 if len(text) % 61 else 59  # all over the text, whatever its period
        out.text = text if len(text) <= SAMPLE else "".join([text[k * step % len(text)] for k in range(SAMPLE)])
        return out

    def score(self) -> float:
        """How much it looks like a secret, from 0 to 1."""
        n = len(self.text)
        if self.length < 6 or self.blanks > 1 or (n == self.length and PLACEHOLDER(self.text)):
            return 0.0
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(self.text).values())
        return min(1.0, entropy / 3.0) * min(1.0, 0.4 + 0.1 * min(self.length, 24) / 4) * (0.55 if self.kinds.bit_count() < 2 else 1.0)


def literal_score(value: str) -> float:
    return Value(value).score()


def statements(text: str) -> list[tuple[str, str, list]]:
    """Each statement's name, the name that tells its meaning, and its parts: spans of literals, and names."""
    out = []
    for m in STATEMENT.finditer(text):
        at, parts = m.start("right"), []
        for p in PART.finditer(m["right"]):
            if p["quoted"]:
                parts.append((at + p.start() + 1, at + p.end() - 1))
            else:
                parts.append((p["bare"], at + p.start(), at + p.end()))
        out.append((m["name"], m["sub"] or m["name"], parts))
    return out


def lexed_spans(text: str, threshold: float) -> list[tuple[int, int]]:
    """Spans of literals that end up in sensitive names, with constants followed."""
    found = statements(text)
    places: dict[str, list[int]] = {}
    for k, (name, _, _) in enumerate(found):
        places.setdefault(name, []).append(k)
    refers: list[list] = []  # spans, and numbers of statements
    for k, (_, _, parts) in enumerate(found):
        own = []
        for p in parts:
            if len(p) == 2:
                own.append(p)
                continue
            where = places.get(p[0])
            if where:
                before = bisect_left(where, k) - 1
                target = where[max(0, before)]
                if target != k:
                    own.append(target)
            elif any(map(str.isdigit, p[0])):
                own.append(p[1:])
        refers.append(list(dict.fromkeys(own)))  # a constant added to itself stays as it is

    values: list[Value | None] = [None] * len(found)
    begun = bytearray(len(found))
    for k in range(len(found)):
        stack = [k]
        while stack:
            n = stack[-1]
            if values[n] is None:
                todo = [] if begun[n] else [r for r in refers[n] if isinstance(r, int) and values[r] is None and not begun[r]]
                begun[n] = 1
                if todo:
                    stack += todo
                    continue
                # a constant that leads back to itself adds nothing
                values[n] = Value.joined([Value(text[r[0] : r[1]]) if isinstance(r, tuple) else values[r] or Value("") for r in refers[n]] or [Value("")])
            stack.pop()

    reach = [k for k, (_, meaning, _) in enumerate(found) if (sensitive := name_score(meaning)) and sensitive * values[k].score() >= threshold]
    seen, spans = set(reach), {}
    while reach:
        for r in refers[reach.pop()]:
            if isinstance(r, tuple):
                spans[r] = None
            elif r not in seen:
                seen.add(r)
                reach.append(r)
    return [(a, b) for a, b in spans if a < b]


def scan(text: str, threshold: float = 0.5) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end), in code points, by start and then by kind."""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        starts, ends = [], []  # the base spans' union, in order
        for a, b in sorted((a, b) for _, a, b in spans):
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        for a, b in lexed_spans(text, threshold):
            k = bisect_left(starts, b) - 1  # the last that starts before this one ends
            if k < 0 or ends[k] <= a:
                spans.append(("lexed", a, b))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return spans


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, threshold: float = 0.5, mark: str = "[secret]") -> str:
    """The text with each secret (overlapping spans as one) replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in sorted(scan(text, threshold), key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: an array of (kind, start, end), in the order of the text."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def run(batches):
        for b in slices(batches):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t or "", threshold)] for t in b.column(1).to_pylist()]
            yield batch_of(schema, b.column(0), found)

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact_secrets(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with secrets in the text replaced (null texts stay null)."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact(t, threshold))

    return docs.withColumn(text_col, clean(docs[text_col]))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`find_secrets`, derived with built-in functions."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "lexed")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )
