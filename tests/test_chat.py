"""G6, G8-G15 goldens from the template rules, on the edge cases the driver tables lack."""
from pyspark.sql import functions as F

from seqforge.functions import fixed
from seqforge.operators import chat

S, E = fixed.CHATML_START, fixed.CHATML_END

CONVS = {
    1: [("system", "SYS"), ("user", "hi"), ("assistant", "yo")],
    2: [("user", "hi"), ("assistant", " yo \n")],
    3: [("system", ""), ("user", "u")],
    4: [("user", "a"), ("user", "b")],
    5: [("user", "a"), ("tool", "t"), ("assistant", "b")],
    6: [("user", "a"), ("system", "late"), ("assistant", "b")],
}


def _msgs(spark):
    rows = [(c, t, r, x) for c, ms in CONVS.items() for t, (r, x) in enumerate(ms)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    return chat.collect_messages(df)


def _render(spark, fn):
    return {r["conv_id"]: r["t"] for r in _msgs(spark).select("conv_id", fn(F.col("messages")).alias("t")).collect()}


def test_chatml(spark):
    got = _render(spark, lambda m: chat.render_chatml(m, True))
    assert got[1] == f"{S}system\nSYS{E}\n{S}user\nhi{E}\n{S}assistant\nyo{E}\n{S}assistant\n"
    assert got[2].startswith(f"{S}system\n{fixed.DEFAULT_SYSTEM}{E}\n{S}user\nhi{E}\n")
    assert got[5] == f"{S}system\n{fixed.DEFAULT_SYSTEM}{E}\n{S}user\na{E}\n{S}assistant\nb{E}\n{S}assistant\n"
    assert f"{S}system\nlate{E}\n" in got[6]


def test_gemma_alternation_and_trim(spark):
    got = _render(spark, lambda m: chat.render_gemma(m))
    G, GE = fixed.GEMMA_START, fixed.GEMMA_END
    assert got[1] == f"<bos>{G}user\nSYS\nhi{GE}\n{G}model\nyo{GE}\n"
    assert got[2] == f"<bos>{G}user\n{fixed.DEFAULT_SYSTEM}\nhi{GE}\n{G}model\nyo{GE}\n"
    assert got[4] is None and got[5] is None and got[6] is None
    v = {(r["conv_id"], r["turn"]) for r in chat.alternation_violations(_msgs(spark)).collect()}
    assert v == {(4, 1), (5, 2), (6, 2)}   # a non-user role at an odd index is allowed


def test_llama_granite_generic(spark):
    h0, h1, eot = fixed.LLAMA_HEADER_START, fixed.LLAMA_HEADER_END, fixed.LLAMA_EOT
    ll = _render(spark, lambda m: chat.render_llama(m))
    assert ll[1] == f"{fixed.LLAMA_BOS}{h0}system{h1}\n\nSYS{eot}{h0}user{h1}\n\nhi{eot}{h0}assistant{h1}\n\nyo{eot}"
    assert ll[3] == f"{fixed.LLAMA_BOS}{h0}user{h1}\n\nu{eot}"      # empty system dropped
    gr = _render(spark, lambda m: chat.render_granite(m, True))
    assert gr[5] == ("<|start_of_role|>user<|end_of_role|>a<|end_of_text|>\n"
                     "<|start_of_role|>assistant<|end_of_role|>b<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>")
    ge = _render(spark, lambda m: chat.render_generic(m, True, "<s>", "</s>"))
    assert ge[4] == "<s>user: a</s>\n<s>user: b</s>\n<s>assistant: "
    mt = _render(spark, chat.messages_text)
    assert mt[1] == "system: SYS\n\nuser: hi\n\nassistant: yo"


def test_template_family(spark):
    rows = [("Qwen/Qwen2.5", []), ("google/gemma-2", []), ("meta/Llama-3", ["<|im_start|>"]),
            ("x/granite", []), ("mistralai/Mistral-7B", []), ("x/y", ["<start_of_turn>"]), ("x/y", [])]
    df = spark.createDataFrame(rows, "n string, t array<string>")
    got = [r[0] for r in df.select(chat.template_family("n", "t")).collect()]
    assert got == ["chatml", "gemma", "chatml", "granite", "generic", "gemma", "generic"]
    kept = df.select(chat.template_family("n", "t", F.lit("set"))).first()[0]
    assert kept == "keep"
