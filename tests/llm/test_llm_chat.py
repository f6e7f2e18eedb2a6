"""Chat formatting: exact round trip, masks, parts."""

import hashlib

import numpy as np
import pytest

from lakefind.llm import chat as C

ODD = ["", "ok", C.HOSTILE, "<\\|im_sep|>", "<\\\\| <| <||> \\<|", "  \n lead", "trail \n", "é漢字😀<|", "<|endoftext|>", "<", "|",
       "user", "\n\n", "x " * 50]


def turns_digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


@pytest.mark.parametrize("text", ODD)
def test_escape_is_reversible_and_hides_control_strings(text):
    assert C.unescape(C.escape(text)) == text
    assert "<|" not in C.escape(text)


def test_mask_is_the_assistant_texts():
    formatter = C.Formatter(C.default_tokenizer())
    turns = [(role, text) for text in ODD for role in ("user", "assistant", "system", "assistant")]
    text, ids, starts, ends, loss = formatter.encode(turns)
    runs = C.masked_runs(text, starts, ends, loss)
    assert [C.unescape(r) for r in runs] == [t for r, t in turns if r == "assistant" and t]
    assert [(C.unescape(m[1]), C.unescape(m[2])) for m in C.TURN.finditer(text)] == turns
    assert formatter.tokenizer.decode(ids.tolist(), skip_special_tokens=False) == text
    by_hand = np.zeros(len(ids), bool)
    for lo, hi in formatter.render(turns)[1]:
        by_hand |= (starts < hi) & (ends > lo)
    assert (by_hand == loss).all()


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "conv_id bigint, turn bigint, role string, text string, part string, formatted int")


def test_odd_conversations(spark, monkeypatch):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, "user", None),
            (2, 0, None, "x"), (None, 0, "assistant", "lost id"), (3, 0, "assistant", ""), (4, 0, "as<|im_sep|>k", "t")]
    rows += [(5, k, "assistant" if k % 2 else "user", f"{ODD[k % len(ODD)]} {k}") for k in range(60)]
    got = {r["conv_id"]: r for r in C.read_back(C.format_chats(chats(spark, rows))).collect()}
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == groups.keys()
    for c, own in groups.items():
        turns = [t[2:] for t in sorted(own)]
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == turns_digest(turns)
        assert got[c]["loss_chars"] == len(learned)
        assert got[c]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert got[c]["formatted_chars"] == len(C.Formatter.render(turns)[0])


def test_parts_change_nothing(spark):
    rows = [(5, k, "assistant" if k % 2 else "user", f"{ODD[k % len(ODD)]} {k}") for k in range(40)]
    formatter = C.Formatter(C.default_tokenizer())
    turns = [(r, t) for _, _, r, t in rows]
    whole = formatter.encode(turns)
    halves = [formatter.encode(turns[:17]), formatter.encode(turns[17:])]
    assert np.concatenate([h[1] for h in halves]).tolist() == whole[1].tolist()
    assert np.concatenate([h[4] for h in halves]).tolist() == whole[4].tolist()
    out = C.format_chats(chats(spark, rows)).collect()
    assert [r["input_ids"] for r in out] == [whole[1].tolist()]


def test_empty_table(spark):
    assert C.read_back(C.format_chats(chats(spark, []))).count() == 0
