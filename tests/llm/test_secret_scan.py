import hashlib
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aerolith.llm import secret_scan as scan


def literals(text):
    return [text[start:end] for kind, start, end in scan.secret_spans(text) if kind == "literal"]


@pytest.mark.parametrize("text, wanted", [
    ('db_pass = "s3cr3t!pw"', ["s3cr3t!pw"]),
    ('client_secret_key := "Zx81Zx82"', ["Zx81Zx82"]),
    ('{"privateKey": "MIIabc123def456"}', ["MIIabc123def456"]),
    ('config["secret_key"] = "zxcvb12345"', ["zxcvb12345"]),
    ('props.put("db.password", "Tr0ub4dor&3")', ["Tr0ub4dor&3"]),
    ('user.setPassword("Tr0ub4dor&3")', ["Tr0ub4dor&3"]),
    ("mysql --db-password Tr0ub4dor3", ["Tr0ub4dor3"]),
    ("<client_secret>Zx81Zx82Zx</client_secret>", ["Zx81Zx82Zx"]),
    ('<add key="dbPwd" value="Zx81!Zx82Zx"/>', ["Zx81!Zx82Zx"]),
    ('db_passwd: str = "Zx81!Zx82Zx"', ["Zx81!Zx82Zx"]),
    ('conn = "Server=x;Pwd=Zx81!Zx82Zx;"', ["Zx81!Zx82Zx"]),
    ("export SIGNING_KEY=Zx81Zx82Zx", ["Zx81Zx82Zx"]),
    ("'accessKey' => 'Zx81Wq92Kb'", ["Zx81Wq92Kb"]),
    ('signing_key = "ab12" + "cd34ef"', ["ab12", "cd34ef"]),
    ('K = "abcd1234efgh"\nclient_secret_key = K', ["abcd1234efgh"]),
    ('auth_token_value = x\nx = y\ny = "qwe123rty456"', ["qwe123rty456"]),
    ('auth_key = """Zx81\\"Zx82Zx"""', ['Zx81\\"Zx82Zx']),
])
def test_literals_of_sensitive_names(text, wanted):
    assert literals(text) == wanted


@pytest.mark.parametrize("text", [
    "the key: is under the mat", "tokens = 1234567", 'passphrase = "${PASS}"', 'public_key = "abc123def456ghi"',
    'secret_key = os.environ["X1X2X3X4"]', 'password_length = 12345678', "key = value123abc", 'db_pass = "changeme1"',
    "I pass: 12345 people; don't 'pass = x'", 'author = "abc123def456"', "x = y\ny = x\nsecret_key = x", 'db_pass = ""',
    'secret_key = "two words 12"', 'a = "abcd1234efgh"\nb = a',
])
def test_clean_texts_are_left_alone(text):
    assert literals(text) == []


def test_a_literal_in_a_base_span_is_not_added():
    assert scan.secret_spans('token = "abcdef123456"') == [("assign", 0, 21)]
    text = 'db_key_secret = "' + "0123456789abcdef" * 2 + '"'
    assert [kind for kind, _, _ in scan.secret_spans(text)] == ["assign", "hex"]


KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


def base_by_hand(text):
    """The base patterns, walked through character by character."""
    out, at = [], 0
    while at < len(text):
        end = None
        for word in KEYWORDS:
            if text[at:at + len(word)].lower() == word and text[at:at + len(word)].isascii():
                p = at + len(word)
                p += text[p:p + 1] in ('"', "'") and text[p:p + 1] != ""
                while text[p:p + 1] == " ":
                    p += 1
                if text[p:p + 1] in (":", "=") and text[p:p + 1]:
                    p += 1
                    while text[p:p + 1] == " ":
                        p += 1
                    p += text[p:p + 1] in ('"', "'") and text[p:p + 1] != ""
                    q = p
                    while q < len(text) and text[q] in VALUE:
                        q += 1
                    if q > p:
                        end, long_enough = q, q - p >= 6
                        break
        if end is None:
            at += 1
            continue
        if long_enough:
            out.append(("assign", at, end))
        at = end
    for kind, start, more, least in (("access", "AKIA", set(string.ascii_uppercase + string.digits), 20), ("hex", "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            end = at + len(start)
            while end < len(text) and text[end] in more:
                end += 1
            if not text.startswith(start, at) or end == at + len(start):
                at += 1
                continue
            if end - at >= least:
                out.append((kind, at, end))
            at = end
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


PIECES = st.sampled_from([*KEYWORDS, "Token", "PASSWORD", "api_Key", "AKIA", "AKIAKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", " ", "  ", ":", "=", '"', "'",
                          "abc", "x1/+=", "\n", "é", "ſecret", "toKen", "-", ".", "g"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_base_spans_equal_a_walk(text):
    found = scan.secret_spans(text)
    assert [span for span in found if span[0] != "literal"] == base_by_hand(text)
    assert all(0 <= start < end <= len(text) for _, start, end in found)
    assert found == sorted(found, key=lambda s: (s[1], scan.KINDS.index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(['secret_key', 'pwd', 'x', 'K', '=', ':=', ':', '=>', '"', "'", '"""', '(', ')', '[', ']', ',', '+', '\\', 'Zx81Zx82', '<', '>', '--', ' ', '\n', ';', 'set', 'é']), max_size=40).map("".join))
def test_any_syntax_is_lexed(text):
    for kind, start, end in scan.secret_spans(text):
        assert 0 <= start < end <= len(text)


@pytest.mark.parametrize("text", ["a=a" * 60_000, '"' * 60_001, "password = " * 20_000, '"""' * 20_001, "'a=b:" * 20_000, "token " + " " * 200_000, "pass=a+" * 20_000])
def test_time_is_linear_in_the_text(text):
    scan.secret_spans(text)  # quadratic work would not end in the time of the test run


def test_columns_and_odd_rows(spark, odd_docs):
    secret = 'é db_pass = "s3cr3t!pw" and token: abcdef123'
    docs = odd_docs.unionByName(odd_docs.limit(1).withColumn("text", F.lit(secret)))
    rows = scan.find_secrets(docs.withColumn("spans", F.lit("mine"))).collect()
    assert len(rows) == docs.count()
    hit = [row for row in rows if row.spans]
    assert [[tuple(span) for span in row.spans] for row in hit] == [[("literal", 13, 22), ("assign", 28, 44)]]
    assert [row.text for row in scan.redact(docs).collect() if row.text and "[secret]" in row.text] == ['é db_pass = "[secret]" and [secret]']
    assert scan.find_secrets(odd_docs.filter("false")).count() == 0


def test_query_equals_its_definition(spark, folder):
    texts = [None, "", 'token = "abcdef123456"', 'db_pass = "s3cr3t!pw"', "AKIA" + "A1" * 8 + " " + "0f" * 12, "secret: token: abcdef"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    for row in scan.op12_secret_spans(spark, folder).collect():
        base = base_by_hand(texts[row.doc_id] or "")
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(span[0] == kind for span in base) for kind in ("assign", "access", "hex"))
        joined = ",".join(f"{kind}:{start}:{end}" for kind, start, end in base)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(row.spans.split(","))
        assert re.fullmatch(r"(\w+:\d+:\d+(,\w+:\d+:\d+)*)?", row.spans)
