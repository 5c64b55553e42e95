"""Chat formatting: the text is read back as it was, whatever it holds."""

from __future__ import annotations

import hashlib

import duckdb
from pyspark.sql import functions as F

from skeinlake.llm import chat, queries

ROWS = "conv_id long, turn long, role string, text string"
ODD = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> <s", "", "<", "[", None, "<<<SYS>>>", "<<s>", "</turn>3:abc", "日本\n</s>", "<\\<SYS>>", "[\\INST]", "[INST", "\\", "$1\\$2", "é<s>" * 3, "<s>" * 50]
ROLES = ["user", "assistant", "system", "tool", None, "a:b\n</s>", "3:x", "</turn>"]


def test_read_back(spark):
    rows = [(i // 6, i % 6, ROLES[(i * 5 + i // 8) % len(ROLES)], ODD[i % len(ODD)]) for i in range(480)]
    found = chat.formatted(spark.createDataFrame(rows, ROWS)).withColumns({"t": chat.parsed(F.col("formatted")), "l": chat.loss_text(F.col("formatted"), F.col("loss_spans"))}).collect()
    want: dict[int, list[tuple[str, str]]] = {}
    for conv, _, role, text in rows:
        want.setdefault(conv, []).append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.t] for r in found} == want
    assert {r.conv_id: r.l for r in found} == {c: "".join(x for role, x in v if role == "assistant") for c, v in want.items()}


def test_not_a_sequence_of_turns(spark):
    rows = spark.createDataFrame([("x",), ("[INST]a</s>",), ("[INST]a[/INST] ",), ("<s>a</s>",), ("<turn>x</turn>",), ("",)], "f string")
    assert [r[0] and [tuple(t) for t in r[0]] for r in rows.select(chat.parsed(F.col("f"))).collect()] == [None, None, None, [("assistant", "a")], None, []]


def test_texts_without_marks_stay_as_they_are(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a < b [c] \\n </ s>"), (1, 1, "assistant", "<p>x</p>")], ROWS)
    assert chat.formatted(rows).first().formatted == "[INST]a < b [c] \\n </ s>[/INST]<s><p>x</p></s>"


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (2, 1, "user", "b"), (2, 1, "user", "b"), (2, 1, "assistant", "c"), (3, 0, "assistant", "long " * 200_000)]
    df = spark.createDataFrame(rows, ROWS).withColumns({"k": F.lit(1), "form": F.lit("x"), "start": F.lit(1), "formatted": F.lit("x")})
    got = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    sha = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    assert got[None].turns_sha256 == sha("\n\n", "user\na\n") and got[None].loss_chars == 0 and got[None].loss_sha256 == sha()
    assert got[2].n_turns == 3 and got[2].turns_sha256 == sha("assistant\nc\n", "user\nb\n" * 2)
    assert got[3].loss_chars == 1_000_000
    assert chat.digests(chat.formatted(df.where("false"))).count() == 0


def test_sql_on_hostile_texts(spark, tmp_path):
    rows = [(i // 6, i % 6, ROLES[i % len(ROLES)], ODD[i % len(ODD)]) for i in range(240)]
    spark.createDataFrame(rows, ROWS).write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.op13_grammar_roundtrip_chat(spark, str(tmp_path))
    assert not any(x in found._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    told = con.sql(queries.OP13_SQL)
    assert sorted(map(tuple, found.select(*told.columns).collect())) == sorted(told.fetchall())
    assert found.where("conv_id = -1").first().n_turns == 2
