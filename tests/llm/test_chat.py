import hashlib

from tidewake.llm.chat import CONTROL, END, format_examples, read_back

NASTY = ["", "\\", "<|end|>", "\\<|turn|>\\\\", "</s>[INST] ok [/INST]", "<<SYS>><</SYS>><s>", "<s", "a\nb", "😀<|😀", "[\\INST]", "<\\|body|>", "x" * 50_000]


def rows():
    out = [(c, t, "user" if t % 2 == 0 else "assistant", NASTY[(c + t) % len(NASTY)]) for c in range(12) for t in range(c % 5 + 1)]
    return [*out, (100, 0, "assistant", None), (100, 1, "as<|sistant", "x"), (100, 2, None, "<|"), (101, None, "user", "first"), (101, 0, "assistant", "b"), (101, 0, "assistant", "b"), (101, 0, "assistant", "a"), (None, 3, "assistant", "n")]


def test_round_trip(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in read_back(format_examples(df.selectExpr("*", "'clash' AS formatted", "1 AS example"))).collect()}
    convs = {}
    for c, t, role, text in rows():
        convs.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_every_reply_has_its_example_and_texts_hold_no_control_string(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")
    for r in format_examples(df).collect():
        marks = r.formatted.count("<|turn|>"), r.formatted.count("<|body|>"), r.formatted.count(END)
        assert marks[0] == marks[1] == marks[2] > 0
        assert r.formatted.count("<|") == 3 * marks[0]
        assert not any(c in r.formatted for c in CONTROL if c != "<|")
        assert r.formatted[r.loss_end :] == END
        if r.loss_end > r.loss_start:
            assert r.formatted[: r.loss_start].endswith("assistant<|body|>")
    assert format_examples(df.limit(0)).count() == 0
