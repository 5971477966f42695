"""Transcripts into turns: roles by a hidden Markov model, then canonical rendering.

A transcript is plain text whose speakers may be marked ("User:", "[assistant]", "Q:"), but
need not be.  Each line is described by a few discrete features: the kind of speaker marker
it starts with, its length, its last sign, whether a blank line comes before it, and how it
starts.  The model's states are the first line and the inner lines of a turn, for each role.
Its tables are counts over labelled lines, summed by Spark and smoothed by one; Viterbi's
best path then gives every line its role, and lines from one first line to the next are a
turn.  Rendering puts each turn between ``<|role|>`` and ``<|end|>``; markers at the start of a
turn are taken off, and ``<|`` inside a text is written ``< |``.

Null and empty transcripts have no turns and render as an empty text.  Blank lines belong
to the turn around them and are trimmed at its ends.  Labels other than the four roles
do not train.  Untrained, all states are alike but for the structure of turns.  Repeated
rows get equal results, and an empty table an empty result.

A conversation becomes one transcript, whatever its length, and is parsed in one piece: like any text it
has to fit into a worker.  Turns are put in the order of their number, those without a number
first, and equal ones in that of their text.  A turn without a conversation is a transcript of its
own, so that such rows never gather.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from aerolith.llm.common import fields, pack, unpack
from aerolith.llm.registry import query
from aerolith.sources.writers import settle
from aerolith.workload.registry import table

ROLES = ("system", "user", "assistant", "tool")
#: Words that mark a speaker.
SPEAKERS = {
    "system": "system instructions instruction context",
    "user": "user human customer q question prompt me",
    "assistant": "assistant ai bot a answer agent model response",
    "tool": "tool function output",
}
_ROLE_OF = {word: role for role, words in SPEAKERS.items() for word in words.split()}
_MARKER = re.compile(r"[\s#>*]*(?:<\|(\w+)\|>|\[(\w+)\]|\*{0,2}(\w+)\*{0,2}\s*[:：])\**\s*")
#: Features and the number of values each can have.
FEATURES = {"marker": len(ROLES) + 2, "length": 5, "last": 4, "after_blank": 2, "start": 3}
STATES = 2 * len(ROLES)  # first lines, then inner lines


def marker(line: str) -> tuple[int, int]:
    """Kind of the marker a line starts with (0: none, 1: a name that is no known word) and its length."""
    found = _MARKER.match(line)
    if not found:
        return 0, 0
    role = _ROLE_OF.get(next(group for group in found.groups() if group).lower())
    return (1, 0) if role is None else (2 + ROLES.index(role), found.end())


def describe(lines: list[str]) -> np.ndarray:
    """One row of feature values per line."""
    out = np.zeros((len(lines), len(FEATURES)), np.int64)
    blank = True
    for n, line in enumerate(lines):
        text = line.strip()
        size = len(text)
        length = 0 if not size else 1 if size < 40 else 2 if size < 120 else 3 if size < 400 else 4
        last = 0 if not size else 1 if text[-1] == "?" else 2 if text[-1] in ".!" else 3
        start = 0 if not size else 1 if text[0].isupper() else 2
        out[n] = marker(line)[0], length, last, blank, start
        blank = not size
    return out


def count_labelled(transcripts: Iterable[tuple[str | None, list[str | None]]]) -> Counter:
    """What the model's tables are made of: (table, a, b) with their counts; labels give a line its role, with ``+`` if it goes on a turn."""
    counts: Counter = Counter()
    for text, labels in transcripts:
        lines = split_lines(text)
        found = describe(lines)
        last = None
        for values, label in zip(found, labels if labels is not None else []):
            role = (label or "").rstrip("+")
            if role not in ROLES:
                last = None
                continue
            state = ROLES.index(role) + (len(ROLES) if label.endswith("+") else 0)
            if last is not None:
                counts["next", last, state] += 1
            for name, value in zip(FEATURES, values):
                counts[name, state, int(value)] += 1
            last = state
    return counts


def split_lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


class Model:
    """Log-probabilities from counts."""

    def __init__(self, counts: dict):
        moves = np.zeros((STATES, STATES))
        for (name, a, b), n in counts.items():
            if name == "next":
                moves[a, b] += n
        roles = len(ROLES)
        allowed = np.zeros((STATES, STATES), bool)
        allowed[:, :roles] = True  # a new turn may start anywhere
        for role in range(roles):
            allowed[[role, roles + role], roles + role] = True
        smoothed = np.where(allowed, moves + 1, 0)
        with np.errstate(divide="ignore"):
            self.next = np.log(smoothed / smoothed.sum(axis=1, keepdims=True))
        self.emit = []
        for name, values in FEATURES.items():
            found = np.ones((STATES, values))
            for (other, a, b), n in counts.items():
                if other == name:
                    found[a, b] += n
            self.emit.append(np.log(found / found.sum(axis=1, keepdims=True)))

    def best_path(self, found: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest states of the lines."""
        if not len(found):
            return np.zeros(0, np.int64)
        emitted = sum(table_[:, found[:, n]] for n, table_ in enumerate(self.emit)).T
        score = np.full(STATES, -np.inf)
        score[:len(ROLES)] = emitted[0, :len(ROLES)]
        back = np.zeros((len(found), STATES), np.int8)
        for n in range(1, len(found)):
            through = score[:, None] + self.next
            back[n] = through.argmax(axis=0)
            score = through.max(axis=0) + emitted[n]
        path = np.zeros(len(found), np.int64)
        path[-1] = score.argmax()
        for n in range(len(found) - 1, 0, -1):
            path[n - 1] = back[n, path[n]]
        return path

    def parse(self, text: str | None) -> tuple[list[str], list[tuple[str, str]]]:
        """The role of every line, and the turns as (role, text)."""
        lines = split_lines(text)
        path = self.best_path(describe(lines))
        turns: list[tuple[str, list[str]]] = []
        for line, state in zip(lines, path):
            if state < len(ROLES):
                turns.append((ROLES[state], [line[marker(line)[1]:]]))
            else:
                turns[-1][1].append(line)
        return [ROLES[state % len(ROLES)] for state in path], [(role, "\n".join(part).strip()) for role, part in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text.replace('<|', '< |')}\n<|end|>\n" for role, text in turns)


_COUNTS = fields(name=StringType(), a=LongType(), b=LongType(), n=LongType())


def train(labelled: DataFrame) -> Model:
    """From ``text`` and ``labels``, one label per line.

    Counts are summed per task and then by Spark; what comes to the driver has a row per
    cell of the model's tables, however many lines there are.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = count_labelled(zip(batch["text"], batch["labels"]))
            yield pd.DataFrame([(*key, n) for key, n in found.items()], columns=_COUNTS.names)

    cells = labelled.select("text", "labels").mapInPandas(count, _COUNTS).groupBy("name", "a", "b").agg(F.sum("n").alias("n"))
    return Model({(row.name, row.a, row.b): row.n for row in cells.collect()})


_TURN = StructType([StructField("role", StringType()), StructField("text", StringType())])
_PARSED = fields(line_roles=ArrayType(StringType()), turns=ArrayType(_TURN), rendered=StringType())


def parsed(text: Column, model: Model) -> Column:
    """A struct of ``line_roles``, ``turns`` and ``rendered``."""

    @F.pandas_udf(_PARSED)
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for one in texts:
            roles, turns = model.parse(one)
            rows.append((roles, [{"role": role, "text": said} for role, said in turns], render(turns)))
        return pd.DataFrame(rows, columns=_PARSED.names)

    return parse(text)


def format_transcripts(transcripts: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``transcripts`` with ``line_roles``, ``turns`` and ``rendered``, which replace columns of those names."""
    done = pack(transcripts, found=parsed(F.col(text), model))
    return unpack(done, **{name: F.col(f"found.{name}") for name in _PARSED.names})


#: How the query writes speakers down, by conversation; the last way has no markers, only blank lines.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: ", "tool": "Tool: "},
    {"system": "Instructions: ", "user": "Human: ", "assistant": "AI: ", "tool": "Output: "},
    {"system": "[system] ", "user": "[user] ", "assistant": "[assistant] ", "tool": "[tool] "},
    {"system": "Context: ", "user": "Q: ", "assistant": "A: ", "tool": "Function: "},
    {},
)


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """Turns written down as transcripts ``conv_id``, ``text`` with the true ``labels`` of the lines.

    The style follows from a hash of the conversation, and one turn in eight lacks its marker.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    spoken = F.coalesce("role", F.lit("-"))
    prefix = F.lit("")
    for n, words in enumerate(STYLES):
        for role, mark in words.items():
            prefix = F.when((style == n) & (spoken == role), mark).otherwise(prefix)
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    said = F.concat(F.when(bare, "").otherwise(prefix), F.array_join(lines, "\n"), F.when(style == len(STYLES) - 1, "\n").otherwise(""))
    labels = F.concat(
        F.array(spoken), F.array_repeat(F.concat(spoken, F.lit("+")), F.size(lines) - F.when(style == len(STYLES) - 1, 0).otherwise(1)))
    turns = conversations.select(
        "conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(F.col("turn"), said.alias("said"), labels.alias("labels")).alias("t"))
    whole = turns.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", F.array_join("t.said", "\n").alias("text"), F.flatten("t.labels").alias("labels"))


@query("op3_chat_format")
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcripts = settle(as_transcripts(table(spark, sf_dir, "conversations")), "transcripts")
    done = format_transcripts(transcripts, train(transcripts))
    right = F.size(F.filter(F.arrays_zip("labels", "line_roles"), lambda x: F.rtrim(x["labels"], F.lit("+")) == x["line_roles"]))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"),
        F.size("line_roles").cast("long").alias("n_lines"), right.cast("long").alias("n_right"), "rendered")
