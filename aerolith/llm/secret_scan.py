"""Secrets in texts: fixed patterns, and literals given to names that call for a secret.

The base patterns find assignments to a few names, access key ids and long hex numbers.  On top,
source and configuration syntax is lexed into pairs of a target name and its literals:

* ``name = "x"``, ``name := x``, ``name: x``, ``"name" => "x"``, ``name: type = "x"``, ``box["name"] = "x"``, ``put("name", "x")``,
  ``setName("x")``, ``--name x``, ``<name>x</name>``, ``key="name" value="x"``, and pairs inside a literal (connection strings);
* literals joined by ``+`` are one literal of several spans;
* constants are propagated: what is given to a name counts for all names that this name is
  given to, in any order and over any number of steps.

A literal is a secret if the score of its most sensitive target and its own (length, entropy,
digits among letters, no placeholder) reach ``least``.  A span holds the literal without its
quotes; one that meets a base span is not added, as that place is found already.

Null and empty texts have no spans.  Texts are lexed whole and once, in time linear in their
length.  Rows are judged one by one, so repeated rows get equal spans, and an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from aerolith.llm.common import pack, unpack
from aerolith.llm.registry import query
from aerolith.workload.registry import table

#: Fixed by the contract, with the least length of what each finds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken whole, so shorter ones need no match
KINDS = ["assign", "access", "hex", "literal"]
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: What the words of a target name add to its score.
_WORDS = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "passcode": 3, "pass": 2, "secret": 3, "secrets": 3, "token": 3,
    "apikey": 3, "credential": 3, "credentials": 3, "auth": 1, "bearer": 2, "pin": 1, "key": 1, "access": 1, "api": 1, "private": 2,
    "signing": 2, "encryption": 2, "master": 1, "account": 1, "salt": 1, "jwt": 2, "webhook": 1, "cookie": 1, "session": 1,
}
#: Words of names that hold something about a secret, or what everybody may see.
_HARMLESS = frozenset((
    "public pub length len size min max count limit id ids name names url uri path file dir field label prompt hint type policy "
    "expiry expires ttl timeout regex pattern error message placeholder column header prefix suffix url endpoint host user username "
    "primary foreign sort cache index tokenizer tokens text title description"
).split())
_PLACEHOLDER = re.compile(
    r"(?i)<.*|\$.*|\{\{.*|%.*|your.*|.*example.*|.*placeholder.*|change.?me.*|x{3,}.*|\*{3,}.*|\.{3,}.*|none|null|nil|true|false|"
    r"undefined|todo.*|dummy.*|.*redacted.*|process\.env.*|os\.environ.*|.*getenv.*|env[.:\[].*|https?:.*|/.*|\./.*")
#: Texts without such a word and a sign of a pair need no lexing.
_WORTH = re.compile(r"(?i)pass|pwd|secret|token|key|credential|auth|bearer|private|jwt|salt")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

_STRING = r'''"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`'''
_NAME = r"[A-Za-z_$][\w$]*+(?:[.-][A-Za-z_$][\w$]*+)*+"
_TOKEN = re.compile(
    r'(?P<long>"""(?:[^"\\]|\\.|"(?!""))*+""")'
    rf"|(?P<string>(?:(?<!\w)[rbfuRBFU]{{1,2}}+|(?<!\w))(?:{_STRING}))|(?P<name>{_NAME})"
    r"|(?P<op>:=|=>|->|[=!<>~]=|[=:])|(?P<mark>[()\[\]{},;+<>/\n])", re.S)
_VALUE = re.compile(rf'[ \t]*(?:[rbfuRBFU]{{0,2}}(?P<string>"""(?:[^"\\]|\\.|"(?!""))*+"""|{_STRING})|(?P<bare>[^\s"\'`,;#()\[\]{{}}<>=+]++=*+))', re.S)
_JOIN = re.compile(r"\s*\+\s*")
_MORE = re.compile(rf"[ \t]*(?:(?P<string>{_STRING})|(?P<bare>{_NAME}))")
_IS_NAME = re.compile(_NAME)

Span = tuple[int, int]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


# Scores -------------------------------------------------------------------------------------


def name_score(name: str) -> int:
    """How much a name calls for a secret: the last part of a dotted name decides, word by word."""
    words = [word.lower() for word in _CAMEL.findall(re.split(r"[.]", name)[-1])]
    if _HARMLESS & set(words):
        return 0
    score = sum(_WORDS.get(word, 0) for word in words)
    if "key" in words and score < 2:
        return 0  # a key of a table, a map or a lock
    return min(score, 4)


def literal_score(value: str) -> int:
    """How much a literal looks like a secret; negative if it cannot be one."""
    if len(value) < 6 or _PLACEHOLDER.fullmatch(value) or any(mark.isspace() for mark in value):
        return -9
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    digits, letters = any(map(str.isdigit, value)), any(map(str.isalpha, value))
    mixed = digits and letters or not value.isalnum() and letters and not _IS_NAME.fullmatch(value)
    return (entropy >= 2.25) + (entropy >= 3) + 2 * mixed + (len(value) >= 16) - (0 if digits or mixed else 2)


# Pairs --------------------------------------------------------------------------------------


class Pairs:
    """Names of a text, the literals given to them, and which name is given to which."""

    def __init__(self) -> None:
        self.literals: list[tuple[str, str, list[Span]]] = []  # target, joined value, spans
        self.given: dict[str, set[str]] = {}  # target: names given to it

    def read(self, text: str, offset: int = 0, depth: int = 0) -> None:
        """Lexes ``text``; ``offset`` is its place in the whole."""
        before: list[tuple[str, str, int]] = []  # the last tokens of a statement: kind, text, end
        keyed = ""  # the last value of an attribute named key or name
        for token in _TOKEN.finditer(text):
            kind, own = token.lastgroup, token[0]
            if kind in ("long", "string"):
                inner, start = self.unquoted(text, token)
                if depth < 2 and ("=" in inner or ":" in inner) and _WORTH.search(inner):
                    self.read(inner, offset + start, depth + 1)
                own = inner
            target, at = "", token.end()
            if kind == "op" and own in ("=", ":", ":=", "=>"):
                target = self.target(before, own)
            elif kind == "mark" and own == "," and [t[0] for t in before[-2:]] == ["mark", "string"] and before[-2][1] == "(":
                target = before[-1][1]
            elif kind == "mark" and own == "(" and before and before[-1][0] == "name" and re.search(r"(?:^|\.)(?:set|with|add|use)_?[A-Z_]?\w*$", before[-1][1]):
                target = before[-1][1]
            elif kind == "mark" and own == ">" and [t[0] for t in before[-2:]] == ["mark", "name"] and before[-2][1] == "<":
                target = before[-1][1]
            elif kind == "name" and text[max(token.start() - 2, 0):token.start()] == "--" and text[at:at + 1] == " ":
                target = own
            if target:
                value = self.take(text, at, offset, target)
                last = target.lower()
                if last in ("key", "name", "id"):
                    keyed = value
                elif last in ("value", "val", "content") and keyed:
                    self.take(text, at, offset, keyed)
                    keyed = ""
            if kind == "mark" and own in ";\n":
                before, keyed = [], keyed if own == "\n" else ""
            else:
                before = [*before[-3:], (kind, own, at)]

    @staticmethod
    def unquoted(text: str, found: re.Match, group: str | int = 0) -> tuple[str, int]:
        start, end = found.span(group)
        while text[start] not in "\"'`":
            start += 1
        quotes = 3 if end - start >= 6 and text.startswith('"""', start) else 1
        return text[start + quotes:end - quotes], start + quotes

    @staticmethod
    def target(before: list[tuple[str, str, int]], op: str) -> str:
        kinds = [(kind, own) for kind, own, _ in before]
        if not kinds:
            return ""
        if kinds[-1] == ("mark", "]") and len(kinds) > 1 and kinds[-2][0] == "string":
            return kinds[-2][1]
        if kinds[-1][0] == "string":
            return kinds[-1][1]
        if kinds[-1][0] != "name":
            return ""
        if op == "=" and len(kinds) > 2 and kinds[-2] == ("op", ":") and kinds[-3][0] == "name":
            return kinds[-3][1]  # between them stands a type
        return kinds[-1][1]

    def take(self, text: str, at: int, offset: int, target: str) -> str:
        """Reads the value that starts at ``at`` and notes it for the target."""
        found = _VALUE.match(text, at)
        parts: list[str] = []
        spans: list[Span] = []
        while found:
            if found["string"] is not None:
                value, start = self.unquoted(text, found, "string")
            else:
                value, start = found["bare"], found.start("bare")
                if _IS_NAME.fullmatch(value):
                    self.given.setdefault(target, set()).add(value)
            if found["string"] is not None or not parts:
                parts.append(value)
                spans.append((offset + start, offset + start + len(value)))
            join = _JOIN.match(text, found.end())
            found = _MORE.match(text, join.end()) if join else None
        if parts:
            self.literals.append((target, "".join(parts), spans))
        return "".join(parts)

    def scores(self) -> dict[str, int]:
        """The score of every name: its own, or that of the best name it is given to at any remove."""
        names = {target for target, _, _ in self.literals} | set(self.given)
        best: dict[str, int] = {}
        queue = [(-name_score(name), name) for name in names]
        heapq.heapify(queue)
        while queue:
            score, name = heapq.heappop(queue)
            if name in best:
                continue
            best[name] = -score
            for other in self.given.get(name, ()):
                if other not in best:
                    heapq.heappush(queue, (score, other))
        return best


def literal_spans(text: str, least: int = 5) -> list[Span]:
    """Literals whose target's score and their own reach ``least``."""
    if not _WORTH.search(text):
        return []
    pairs = Pairs()
    pairs.read(text)
    scores = pairs.scores()
    found = set()
    named = {target for target, _, _ in pairs.literals}
    for target, value, spans in pairs.literals:
        if scores[target] >= 2 and value not in named and scores[target] + literal_score(value) >= least:
            found.update(span for span in spans if span[0] < span[1])
    return sorted(found)


def secret_spans(text: str | None, least: int = 5) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)`` in code points, by start, then in the order of ``KINDS``."""
    if not text:
        return []
    base = base_spans(text)
    order = {kind: n for n, kind in enumerate(KINDS)}
    taken = sorted((start, end) for _, start, end in base)
    added, at, reach = [], 0, 0
    for start, end in literal_spans(text, least):
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= start:
            added.append(("literal", start, end))
    return sorted(base + added, key=lambda span: (span[1], order[span[0]], span[2]))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """The text with every run of spans that meet replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scanner(least: int):
    @F.pandas_udf(StringType())
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([",".join(f"{kind}:{start}:{end}" for kind, start, end in secret_spans(text, least)) for text in texts], dtype=object)

    return scan


def spans_of(text: Column, least: int = 5) -> Column:
    """The spans as an array of ``kind``, ``start`` and ``end``."""
    each = F.filter(F.split(_scanner(least)(text), ","), lambda span: span != "")

    def parsed(span: Column) -> Column:
        part = F.split(span, ":")
        return F.struct(part[0].alias("kind"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end"))

    return F.transform(each, parsed)


def find_secrets(docs: DataFrame, text: str = "text", least: int = 5) -> DataFrame:
    """``docs`` with ``spans``; an input column of that name gives way."""
    return unpack(pack(docs, found=spans_of(F.col(text), least)), spans=F.col("found"))


def redact(docs: DataFrame, text: str = "text", least: int = 5, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret of the text replaced by ``mark``."""

    @F.pandas_udf(StringType())
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if text is None else redacted(text, secret_spans(text, least), mark) for text in texts], dtype=object)

    at = next(name for name in docs.columns if name.lower() == text.lower())
    kept = pack(docs, new=clean(F.col(text)))
    return kept.select(*[F.col("new").alias(name) if name == at else F.col("row").getField(name).alias(name) for name in docs.columns])


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op12_secret_spans")
def op12_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", spans_of(F.col("text")).alias("spans"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(KINDS[:3]))
    return found.select(
        "doc_id", *[count(kind) for kind in KINDS[:3]], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"))
