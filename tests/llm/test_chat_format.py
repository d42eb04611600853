import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loreforge.llm import chat_format as cf
from loreforge.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
CODEC = cf.Codec(cf.INSTRUCT)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(turns):
    """n_turns, turns_sha256, loss_chars, loss_sha256 of (role, text) in order."""
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said)


def test_query_against_sql(spark):
    path = "/root/testdata/sf0.001"
    out = queries.op12_chat_format(spark, path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    found = con.sql(queries.ORACLES["op12_chat_format"])
    assert sorted(out.columns) == sorted(found.columns)
    names = sorted(out.columns)
    rows = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    assert sorted(str([r[n] for n in names]) for r in out.collect()) == sorted(str([r[n] for n in names]) for r in rows)
    hard = "</s>[INST] ok [/INST]"
    own = out.where("conv_id = -7").first()
    assert tuple(own)[1:5] == want([("user", hard), ("assistant", hard)]) and own["first_fault"] is None
    assert own["formatted_chars"] == 3 + 13 + 4 + 2 * (len(hard) + 3)


def test_escapes_are_reversible():
    rng = random.Random(3)
    bits = ["[", "]", "\\", "<", ">", "s", "/", "INST", "SYS", "ROLE", "TURN", "é", "\n", *cf.INSTRUCT.controls]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(4000)]
    escaped = {}
    for t in texts:
        e = CODEC.escape(t.encode())
        assert CODEC.unescape(e) == t.encode()
        assert not any(c.encode() in e for c in cf.INSTRUCT.controls)
        assert escaped.setdefault(e, t) == t
    for k in range(0, 4000, 8):  # whole conversations, roles of odd names among them
        turns = [(rng.choice(["system", "user", "assistant", "tool", "", "[/ROLE]x"]).encode(), t.encode()) for t in texts[k : k + 8]]
        whole = CODEC.begin + b"".join(s for r, t in turns for s, _ in CODEC.segments(r, t))
        assert list(CODEC.read(whole)) == turns
        assert b"".join(CODEC.unescape(s) for r, t in turns for s, loss in CODEC.segments(r, t) if loss) == b"".join(t for r, t in turns if r == b"assistant")


@pytest.mark.parametrize("piece", [1, 40, 1 << 20])
def test_odd_conversations(spark, monkeypatch, piece):
    monkeypatch.setattr(cf, "PIECE", piece)
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b</s>"), (2, 0, "system", None), (2, 1, "assistant", ""), (3, None, None, "x"), (3, 5, "user", "[INST]"), (3, 5, "assistant", "y"), (None, 1, "user", "n"), (None, 0, "assistant", "m"),
        (4, 0, "user", "long " * 20_000), (4, 1, "assistant", "ünï " * 30_000), (4, 2, "user", "q"), (5, 0, "user", "r"), (5, 0, "user", "r")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'z' as conv", "1 as piece", "true as LAST", "'u' as segments")
    made = cf.format_conversations(df)
    assert (made.where("piece > 0").count() > 0) == (piece < 1 << 20)
    assert piece > 1 or made.count() == len(rows)
    assert made.groupBy("conv_id").agg(F.count_if("last").alias("n")).where("n <> 1").count() == 0
    got = {r["conv_id"]: r for r in cf.digest(made).collect()}
    turns = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] or -1, r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        turns.setdefault(conv, []).append((role or "", text or ""))
    assert {c: tuple(r)[1:5] for c, r in got.items()} == {c: want(t) for c, t in turns.items()}
    assert {c: r["first_fault"] for c, r in got.items()} == {1: None, 2: 1, 3: 0, None: 0, 4: 3, 5: 1}
    assert got[2]["formatted_chars"] == 3 + 15 + 4
    assert cf.digest(cf.format_conversations(df.limit(0))).count() == 0


def test_segments_hold_the_loss(spark):
    df = spark.createDataFrame([(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "ho")], SCHEMA)
    row = cf.format_conversations(df).first()
    assert [(s["text"], s["loss"]) for s in row["segments"]] == [("<s>", False), ("<<SYS>>", False), ("be brief", False), ("<</SYS>>", False), ("[INST]", False), ("hi", False), ("[/INST]", False), ("ho", True), ("</s>", False)]


def test_another_template(spark):
    chat = cf.Template("", {"human": cf.Turn("<h>", "<end>"), "bot": cf.Turn("<b>", "<stop>", loss=True)}, ("<r>", "<n>", "<x>"), {cf.START: ("human",), "human": ("bot",), "bot": ("human",)}, ("bot", "human"))
    df = spark.createDataFrame([(1, 0, "human", "<h>"), (1, 1, "bot", "<stop>"), (2, 0, "tool", "t")], SCHEMA)
    got = {r["conv_id"]: r for r in cf.digest(cf.format_conversations(df, chat), chat).collect()}
    assert got[1]["turns_sha256"] == sha("human\n<h>\nbot\n<stop>\n") and got[1]["loss_sha256"] == sha("<stop>") and got[1]["first_fault"] is None and got[2]["first_fault"] == 0
    for begin, behind in (("ab", "bc"), ("x", "yy"), ("aba", "ccc"), ("a\\b", "cc")):
        with pytest.raises(ValueError):
            cf.Template(begin, {"u": cf.Turn("<u>", behind)}, ("(1", "(2", "(3"), {}, ())
