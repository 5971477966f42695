import itertools

import numpy as np
from pyspark.sql import functions as F

from aerolith.llm import chat

TALK = [("User: Why?\nAssistant: It is so.\nAs I said.\n\nUser: And?\nAI: Yes.", ["user", "assistant", "assistant+", "assistant+", "user", "assistant"])] * 20


def model():
    return chat.Model(chat.count_labelled(TALK))


def test_markers():
    assert chat.marker("**Human**: hi")[0] == chat.marker("user: hi")[0] == chat.marker("### Question: x")[0] == 2 + chat.ROLES.index("user")
    assert chat.marker("<|assistant|> x")[0] == chat.marker("[bot] x")[0] == 2 + chat.ROLES.index("assistant")
    assert chat.marker("Note: x")[0] == 1 and chat.marker("so it is")[0] == 0


def test_best_path_by_trying_all_paths():
    fitted = model()
    found = chat.describe(["User: Why?", "It is so.", "", "AI: yes"])
    emitted = sum(t[:, found[:, n]] for n, t in enumerate(fitted.emit)).T

    def score(path):
        return sum(emitted[n, s] for n, s in enumerate(path)) + sum(fitted.next[a, b] for a, b in zip(path, path[1:]))

    paths = [p for p in itertools.product(range(chat.STATES), repeat=len(found)) if p[0] < len(chat.ROLES)]
    assert np.isclose(score(fitted.best_path(found)), max(map(score, paths)))


def test_turns_and_rendering():
    roles, turns = model().parse("User: Why <|x|>?\nAssistant: It is so.\nAs I said.")
    assert roles == ["user", "assistant", "assistant"]
    assert turns == [("user", "Why <|x|>?"), ("assistant", "It is so.\nAs I said.")]
    assert chat.render(turns) == "<|user|>\nWhy < |x|>?\n<|end|>\n<|assistant|>\nIt is so.\nAs I said.\n<|end|>\n"


def test_odd_transcripts(spark):
    given = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "\n\n", "c"), (4, "Q: x\n" * 3000, "d"), (4, "Q: x\n" * 3000, "d")], "n long, text string, turns string")
    found = {row.n: row for row in chat.format_transcripts(given, chat.Model({})).collect()}
    assert found[1].turns == [] and found[2].rendered == "" and len(found[3].line_roles) == 3 and len(found[4].line_roles) == 3001
    assert chat.format_transcripts(given.filter("false"), model()).count() == 0


def test_accuracy_on_conversations_not_trained_on(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    transcripts = chat.as_transcripts(table).withColumn("held", F.xxhash64("conv_id", F.lit("half")) % 2 == 0)
    fitted = chat.train(transcripts.filter("NOT held"))
    found = chat.format_transcripts(transcripts.filter("held"), fitted).select("labels", "line_roles").collect()
    right = [a.rstrip("+") == b for row in found for a, b in zip(row.labels, row.line_roles, strict=True)]
    assert len(right) > 300 and sum(right) / len(right) > 0.85


def test_nulls_in_conversations(spark):
    table = spark.createDataFrame([(1, 0, "user", None), (None, None, None, "x\ny"), (1, 1, "assistant", "b"), (1, 600, "user", "c")], "conv_id long, turn long, role string, text string")
    table = table.unionByName(table.filter("conv_id IS NULL"))
    found = chat.as_transcripts(table).collect()
    assert sorted(len(row.text.split("\n")) for row in found if row.conv_id is None) == [2, 2]  # each alone
    assert len(found) == 3
    assert all(len(row.labels) == len(row.text.split("\n")) or row.text == "" for row in found)
    chat.train(chat.as_transcripts(table))


def by_hand(rows):
    """The query in plain Python, given its transcripts' texts and labels."""
    fitted = chat.Model(chat.count_labelled([(row.text, row.labels) for row in rows]))
    out = []
    for row in rows:
        roles, turns = fitted.parse(row.text)
        right = sum(a.rstrip("+") == b for a, b in zip(row.labels, roles))  # an empty text has no line
        out.append((row.conv_id, len(turns), ",".join(role for role, _ in turns), len(roles), right, chat.render(turns)))
    return sorted(out, key=str)


def test_query_equals_plain_python_and_cuts_nothing(spark, folder):
    said = [(n, k, "user" if k % 2 == 0 else "assistant", f"line {k}\nand more of {n}" if k % 3 else f"Why {k}?")
            for n, size in ((1, 600), (2, 5000), (3, 2), (4, 1)) for k in range(size)]
    said += [(None, None, "user", "alone"), (None, 1, None, None), (3, None, "user", "first")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    found = chat.op3_chat_format(spark, folder).collect()
    texts = chat.as_transcripts(spark.read.parquet(f"{folder}/conversations.parquet")).collect()
    assert sorted(map(tuple, found), key=str) == by_hand(texts)
    assert sorted((row.conv_id or 0) for row in found) == [0, 0, 1, 2, 3, 4]
    lines = {row.conv_id: row.n_lines for row in found if row.conv_id}
    assert lines[1] >= 600 and lines[2] >= 5000


def test_empty_conversations(spark, folder):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    assert chat.op3_chat_format(spark, folder).collect() == []
