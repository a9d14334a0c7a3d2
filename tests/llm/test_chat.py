import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from oracle import difference
from pyspark.sql import functions as F

from rulelake.llm import chat

PIECES = st.text(alphabet='\\<>/turnpa k="n0}\n é', max_size=40) | st.sampled_from(["</turn>\n", '<turn role="assistant">\n', '<part kind="image" n="0">', "\\", chat.HOSTILE])


@given(st.lists(PIECES, max_size=4), PIECES)
def test_turn_round_trip(texts, role):
    parts = []
    for k, text in enumerate(texts):
        parts += [chat.Part("text", text), chat.Part("image", ref=f"r{k}", size=(28, 14))]
    segment, loss, attached = chat.format_turn(role, parts)
    got_role, content = chat.parse_turn(segment)
    assert got_role == role
    assert "".join(x for x in content if isinstance(x, str)) == "".join(texts)
    assert [x for x in content if not isinstance(x, str)] == [("image", k) for k in range(len(texts))]
    assert attached == [("image", f"r{k}", 2) for k in range(len(texts))]
    assert segment.count("</turn>\n") >= 1 and segment.endswith(chat.END)
    if role == chat.ASSISTANT:
        assert "".join(chat.unescape(segment[a:b]) for a, b in loss) == "".join(texts)
    else:
        assert loss == []


def test_attachment_tokens_and_unknown_kind():
    flat = chat.PartVisitor().flatten([chat.Part("audio", ref="a", size=(2.0,)), chat.Part("document", ref="d", size=(3,)), chat.Part("image", ref="i")])
    assert flat.attachments == [("audio", "a", 50), ("document", "d", 1536), ("image", "i", 1)]
    with pytest.raises(ValueError, match="video"):
        chat.PartVisitor().flatten([chat.Part("video")])


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations_against_brute_force(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", "a </turn>\n b"), (2, 1, None, "x\\"), (2, 0, "assistant", "é" * 5000),
        (None, 0, "assistant", "alone"), (3, None, "user", "first"), (3, 1, "user", "same"), (3, 1, "user", "same"), (-7, 0, "user", chat.HOSTILE), (-7, 1, "assistant", chat.HOSTILE),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    made = chat.format_conversations(df.withColumn("parts", chat.text_parts(F.col("text"))))
    got = {r[0]: tuple(r)[1:5] for r in chat.conversation_digests(made).collect()}
    assert got == brute(rows)
    assert chat.conversation_digests(made.limit(0)).collect() == []


def test_equal_turns_go_by_text_and_links_become_parts(spark, tmp_path):
    """Escapes and closing tags don't count in the order, and the query agrees with its SQL on every kind of part."""
    texts = ["ok then", "ok", "ok</turn>", "ok<", "ok<turnip", "ok\\", "ok\\a", "", None, 'see https://x.org/a.PNG and http://y.org/b.mp3, <https://z.org/c> "https://z.org/d.pdf"']
    rows = [(c, 1, role, t) for c in (4, 5) for role in ("user", "assistant") for t in texts[:: 1 if c == 4 else -1]]
    rows += [(6, 0, "system", "s" * n) for n in (0, 1800, 1801)] + [(6, 1, "user", " ".join(f"https://h.org/{k}" for k in range(12)))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = chat.op10_chat_parts(spark, str(tmp_path))
    assert difference(out, chat.OP10_SQL, str(tmp_path)) == ""
    got = {r.conv_id: r for r in out.collect()}
    assert got[4].turns_sha256 == got[5].turns_sha256 and got[4].n_attachments == 4 and got[4].attachment_tokens == 1 + 1 + 512 + 512
    assert got[6].n_attachments == 15 and got[6].attachment_tokens == 512 * (1 + 1 + 2 + 12)
    assert {k: tuple(r)[1:5] for k, r in got.items()} == brute(rows + [(-7, 0, "user", chat.HOSTILE), (-7, 1, "assistant", chat.HOSTILE)])


def test_query_over_all_conversations(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", chat.HOSTILE), (-7, 1, "assistant", chat.HOSTILE)]
    got = {r["conv_id"]: tuple(r[c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) for r in chat.op10_chat_parts(spark, sf).collect()}
    assert got == brute(rows)
