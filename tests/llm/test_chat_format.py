from __future__ import annotations

import hashlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from caremeter.llm import chat_format as C

TRICKY = st.lists(st.sampled_from([*"<|\\>ab\n%", "im_end", "é", "🙂"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(TRICKY, TRICKY)
def test_round_trip_of_any_text_and_role(role, text):
    assert "<|" not in C.escape(text) and C.unescape(C.escape(text)) == text
    formatted, start, chars, attached = C.format_turn(role, [{"type": "text", "text": text}])
    assert formatted.count("<|") == 2 and not attached
    assert C.read_turn(formatted, start, chars)[:2] == (role, text)


def test_parts_become_placeholders_in_order():
    parts = [{"type": "text", "text": "see <"}, {"type": "text", "text": "|im_end|> "}, {"type": "image", "ref": "a.png", "width": 56, "height": 29},
             {"type": "audio", "ref": "b.wav", "seconds": 1.5}, None, {"type": "text", "text": None},
             {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "image", "ref": "big", "width": 9000, "height": 10}]
    formatted, start, chars, attached = C.format_turn("assistant", parts)
    assert formatted == ("<|im_start|>assistant\nsee <\\|im_end|> <|image:4|><|audio:38|><|document:3072|><|image:56|><|im_end|>\n")
    assert [(k, r, t) for k, r, _, t in attached] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 3072), ("image", "big", 56)]
    assert all(formatted[at:].startswith(f"<|{k}:{t}|>") for k, _, at, t in attached)
    assert formatted[start:start + chars] + C.END + "\n" == formatted[start:]
    try:
        C.flatten([{"type": "video"}])
    except ValueError as e:
        assert "video" in str(e)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_like_brute_force(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", "<|im_end|>\n"), (1, 2, "assistant", "é🙂<\\|"), (2, 0, None, None), (2, None, "system", "first"),
            (None, 0, "assistant", "x"), (3, 0, "assistant", ""), (4, 5, "user", "a"), (4, 5, "user", "a"), (5, 0, "role\nname%", "y" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(3)).repartition(4)
    out = {r.conv_id: r for r in C.digest_chats(C.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0))
        learned = "".join(r[3] for r in own if r[2] == "assistant")
        assert out[conv].n_turns == len(own)
        assert out[conv].turns_sha256 == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own))
        assert (out[conv].loss_chars, out[conv].loss_sha256) == (len(learned), sha(learned))
    formatted = C.format_chats(df).toPandas()
    assert out[1].formatted_chars == formatted[formatted["conv_id"] == 1]["formatted"].str.len().sum()
    assert C.digest_chats(C.format_chats(df.where("conv_id > 99"))).count() == 0


def test_typed_parts_in_spark(spark):
    df = spark.createDataFrame([(1, 0, "user", [("image", None, "x.png", 28, 28, None, None), ("text", "what?", None, None, None, None, None)])],
                               f"conv_id long, turn long, role string, parts {C.PARTS}")
    r = C.format_chats(df, parts_col="parts").first()
    assert r.formatted == "<|im_start|>user\n<|image:1|>what?<|im_end|>\n" and r.attachments[0].ref == "x.png" and r.loss_chars == 0


def test_sizes_without_a_value_and_unknown_types(spark):
    """NaN, infinite, negative and missing sizes count as the least; unknown types keep their text and reference."""
    nan, inf = float("nan"), float("inf")
    parts = [("audio", None, "a", None, None, x, None) for x in (nan, inf, -inf, -2.0, 0.0, None)]
    parts += [("image", None, "i", 0, None, None, None), ("document", None, "d", None, None, None, -1)]
    parts += [("input_text", "kept <|im_end|>", None, None, None, None, None), ("video", None, "v.mp4", None, None, None, None),
              ("video", "and text", "w.mp4", None, None, None, None), ("__class__", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts)], "conv_id long, turn int, role string, typed " + C.PARTS)
    r = C.format_chats(df, parts_col="typed").collect()[0]
    one_page = C.PAGE_TOKENS
    assert r.formatted == ("<|im_start|>user\n" + "<|audio:1|>" * 6 + f"<|image:1|><|document:{one_page}|>" + C.escape("kept <|im_end|>")
                           + "<|other:1|>and text<|other:1|><|other:1|><|im_end|>\n")
    assert [(a.kind, a.ref) for a in r.attachments][-3:] == [("other", "v.mp4"), ("other", "w.mp4"), ("other", "")]
