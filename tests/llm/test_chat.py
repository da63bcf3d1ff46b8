import numpy as np
from hypothesis import given, settings, strategies as st

from callgauge.llm import chat

ROWS = "conv_id long, turn long, role string, text string"
TEXT = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "a", "é", "\n", "☃", "s>", "INST]"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT, TEXT)
def test_escaping_is_reversible(role, text):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text
    assert not any(c in shown for c in ("<s>", "</s>", "[INST]", "[/INST]"))
    one = f"[INST]{chat.escape(role)}[/INST]{shown}</s>"
    assert chat.turns(one * 2) == [(role, text)] * 2


def test_assembly():
    out, ends, starts, stops = chat.assemble([b"<h>", b"", b"long header"], np.array([2, 0, 1, 0]), np.frombuffer(b"abcde", np.uint8), np.array([0, 2, 2, 5, 5]))
    assert out.tobytes() == b"long headerab</s><h></s>cde</s><h></s>"
    assert [out[a:b].tobytes() for a, b in zip(starts, stops)] == [b"ab", b"", b"cde", b""]
    assert ends[-1] == len(out)


def test_assembly_in_steps(monkeypatch):
    monkeypatch.setattr(chat, "STEP", 5)
    texts = [b"x" * n for n in (0, 3, 17, 2, 2, 1, 0, 30)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    out, *_ = chat.assemble([b"(", b"[["], np.array([0, 1] * 4), np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert out.tobytes() == b"".join((b"(", b"[[")[i % 2] + t + b"</s>" for i, t in enumerate(texts))


def plain(rows):
    import hashlib

    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", 0)
    for conv, _, role, text in sorted(rows, key=key):
        role, text = role or "", text or ""
        n, said, loss, chars = out.get(conv, (0, "", "", 0))
        chars += len("[INST][/INST]</s>" + chat.escape(role) + chat.escape(text))
        out[conv] = (n + 1, f"{said}{role}\n{text}\n", loss + text * (role == "assistant"), chars)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (n, sha(said), len(loss), sha(loss), chars) for c, (n, said, loss, chars) in out.items()}


def test_read_back(spark):
    rows = [(c, t, ("user", "assistant", "system", None, "as[INST]s")[t % 5], None if t == 4 else f"</s> {t} \\ é{c} " * t) for c in range(30) for t in range(7)]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t} <s>") for t in range(3000)]
    rows += [(2**62 + i, 0, "assistant", f"{i}") for i in range(3)]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (31, 0, "user", "z" * 2_000_000)]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "'x' as piece", "1 as loss").repartition(5)
    pieces = chat.formatted(df)
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(pieces).collect()}
    assert got == plain(rows)


def test_small_batches(spark):
    """A conversation may go over any number of Arrow batches."""
    rows = [(c, t, "assistant", f"{c}:{t}") for c in range(3) for t in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.formatted(spark.createDataFrame(rows, ROWS))).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(rows)


def test_empty(spark):
    assert chat.read_back(chat.formatted(spark.createDataFrame([], ROWS))).count() == 0
