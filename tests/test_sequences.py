"""E3-E9, G5 and the builders: valid prefixes against a plain walk; edge positions of the first invalid step."""
import pytest
from pyspark.sql import functions as F

from seqforge.operators import chat, sequences, walk

RULES = [(0, "a", 1), (1, "b", 0), (1, "c", 2), (2, "a", 0)]
SEQS = {1: ["a", "b", "a", "c", "a"],   # all valid
        2: ["b", "a"],                  # fails at ply 1
        3: ["a", "a"],                  # fails at ply 2
        4: ["a", "b", "a", "c", "b"],   # fails at the last ply
        5: ["a"],                       # one step
        6: []}                          # empty


def _frames(spark):
    rules = spark.createDataFrame(RULES, "state int, action string, next_state int")
    seqs = spark.createDataFrame([(k, 0, "w", v) for k, v in SEQS.items()],
                                 "seq_id int, start_state int, start_side string, actions array<string>")
    return rules, seqs


def py_walk(actions):
    t = {(s, a): n for s, a, n in RULES}
    s, states = 0, [0]
    for a in actions:
        if (s, a) not in t:
            break
        s = t[(s, a)]
        states.append(s)
    return len(states) - 1, states


def test_fold_equals_python(spark):
    rules, seqs = _frames(spark)
    checked = sequences.valid_prefix_fold(seqs, rules)
    fold = {r["seq_id"]: (r["valid_len"], r["states"]) for r in checked.collect()}
    reached = {}
    for r in walk.walk(seqs, rules).orderBy("seq_id", "pos").collect():
        reached.setdefault(r["seq_id"], []).append(r["state"])
    for k, v in SEQS.items():
        assert fold[k] == py_walk(v) and reached[k] == py_walk(v)[1]
    assert [fold[k][0] for k in (2, 3, 4)] == [0, 1, 4]
    ok, failed = sequences.all_or_nothing(checked)
    assert {r["seq_id"] for r in ok.collect()} == {1, 5, 6} and {r["seq_id"] for r in failed.collect()} == {2, 3, 4}


def test_rules_given_twice_raise(spark):
    rules, seqs = _frames(spark)
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY|duplicate"):
        sequences.valid_prefix_fold(seqs, rules.unionByName(rules)).collect()


def test_many_rules(spark):
    """200,000 rules: prefixes and conversations need no limit."""
    from seqforge.operators import examples
    rules = spark.range(200_000).select((F.col("id") % 4).cast("int").alias("state"), F.concat(F.lit("m"), F.floor(F.col("id") / 4).cast("string")).alias("action"),
                                        ((F.col("id") + 1) % 4).cast("int").alias("next_state"))
    seqs = spark.range(50).select("id", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.concat(F.lit("m"), (F.col("id") * 997 + k).cast("string"))).alias("actions"))
    seqs = seqs.select(F.col("id").alias("seq_id"), F.lit(0).alias("start_state"), F.lit("b").alias("start_side"), "actions")
    assert {r["valid_len"] for r in sequences.valid_prefix_fold(seqs, rules, with_states=False).collect()} == {6}
    few = rules.where("state <> 2 OR action IN ('m1', 'm2', 'm999', 'm1000')")
    got = examples.game_conversations(seqs, few).select("seq_id", F.size("messages").alias("n")).collect()
    assert got and all(r["n"] >= 3 for r in got)


def test_observable_prefix_equals_fold_when_state_is_previous_action(spark):
    # state = previous action: the pair relation and a rules table keyed by the previous action agree
    pairs = [("", "a"), ("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")]
    p = spark.createDataFrame(pairs, "prev string, action string")
    rules = spark.createDataFrame([(x, y, y) for x, y in pairs], "state string, action string, next_state string")
    seqs = spark.createDataFrame([(k, "", v) for k, v in SEQS.items()], "seq_id int, start_state string, actions array<string>")
    a = {r["seq_id"]: r["valid_len"] for r in sequences.valid_prefix(seqs, p).collect()}
    b = {r["seq_id"]: r["valid_len"] for r in sequences.valid_prefix_fold(seqs, rules).collect()}
    assert all(a[k] == b[k] for k in a) and set(a) == {k for k, v in SEQS.items() if v}


def test_ply_expand_solver_side(spark):
    df = spark.createDataFrame([("p1", "x w - -", ["m1", "m2", "m3", "m4", "m5"], 1500, ["t"], "u", [])],
                               "puzzle_id string, fen string, moves array<string>, rating int, themes array<string>, "
                               "game_url string, opening_tags array<string>")
    first = sequences.ply_expand(df, 0).orderBy("idx").collect()
    assert [(r["move"], r["move_number"], r["solution"]) for r in first] == [
        ("m1", 1, ["m1", "m2", "m3", "m4", "m5"]), ("m3", 3, ["m3", "m4", "m5"]), ("m5", 5, ["m5"])]
    assert {r["side_to_move"] for r in first} == {"White"}
    second = sequences.ply_expand(df, 1).orderBy("idx").collect()
    assert [r["move"] for r in second] == ["m2", "m4"] and {r["side_to_move"] for r in second} == {"Black"}


def test_continuation_and_split(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"])], "id int, t array<string>")
    c = df.select(sequences.continuation(F.col("t"), F.lit(1), 6).alias("c"),
                  sequences.continuation(F.col("t"), F.lit(2), 0).alias("d")).first()
    assert c["c"]["target"] == "b" and c["c"]["window"] == ["b", "c"] and c["d"]["window"] == ["c"]
    s = spark.range(200).select(sequences.split_point("id", F.lit(7)).alias("s")).collect()
    assert {r["s"] for r in s} <= set(range(7)) and len({r["s"] for r in s}) == 7


def test_game_conversation_shape(spark):
    rules, seqs = _frames(spark)
    j = sequences.with_candidates(sequences.valid_prefix_fold(seqs, rules), rules)
    out = {}
    for white in (True, False):
        m = chat.game_conversation(F.col("actions"), F.col("states"), F.col("valid_len"), F.lit(white), sequences.candidates_of, F.lit("0"))
        out[white] = {r["seq_id"]: r["m"] for r in j.select("seq_id", m.alias("m")).collect()}
    w1 = out[True][1]
    assert [x["role"] for x in w1] == ["system", "user", "assistant", "user", "assistant", "user", "assistant"]
    assert w1[1]["content"] == "Position: 0\nLegal moves: a" and w1[2]["content"] == "<uci_move>a</uci_move>"
    assert w1[3]["content"].startswith("<uci_move>b</uci_move>\n\nPosition: 0")
    assert out[True][2] is None and out[False][3] is None and out[True][5] is None   # no assistant turn / too short
    assert "playing chess as Black. The user is White" in out[False][1][0]["content"]
    # Black starts: the white assistant answers at odd plies
    m = chat.game_conversation(F.col("actions"), F.col("states"), F.col("valid_len"), F.lit(True), sequences.candidates_of, F.lit("0"), F.lit(False))
    black_first = {r["seq_id"]: r["m"] for r in j.select("seq_id", m.alias("m")).collect()}[1]
    assert black_first[2]["content"] == "<uci_move>b</uci_move>" and "as White" in black_first[0]["content"]


def test_example_builders_keep_rows_and_widths(spark):
    from seqforge.operators import examples, tokens
    rules, seqs = _frames(spark)
    texts = examples.conversation_texts(seqs, rules)
    vocab = tokens.build_vocab(texts.where("ok").select("text"))
    marker = F.array(F.lit(vocab.where("token = 'uci_move'").first()["id"]))
    rows = {r["seq_id"]: r for r in examples.conversation_rows(texts, vocab, marker, 64).collect()}
    assert set(rows) == set(SEQS)                                   # one row per sequence
    for r in rows.values():
        assert len(r["input_ids"]) == len(r["attention_mask"]) == len(r["labels"]) == 64
        assert tokens.UNK_ID not in r["input_ids"]                  # the vocabulary covers the rendered text
    assert rows[2]["attention_mask"] == [0] * 64 and rows[2]["labels"] == [-100] * 64   # no conversation
    wide = {r["seq_id"]: r for r in examples.conversation_rows(texts, vocab, marker, 512).collect()}
    assert any(x != -100 for x in wide[1]["labels"])                # move-tag spans are trained
    lines = examples.valid_lines(seqs, rules)
    assert {r["seq_id"] for r in lines.collect()} == {1, 4}         # two valid steps or more, cut to them
    ex = examples.single_move_texts(lines)
    single = examples.single_move_rows(ex, vocab, 32).collect()
    assert single and all(len(r["input_ids"]) == 32 and len(r["labels"]) == 32 for r in single)
    for r in single:   # labels are either ignored or equal to the id at that position
        assert all(l == -100 or l == i for l, i in zip(r["labels"], r["input_ids"]))
    for epoch in range(6):
        for r in examples.prompt_rows(lines, epoch=epoch).collect():
            assert r["prompt"].endswith("<|im_start|>assistant\n") and r["correct_move"] in r["legal_moves"]
    train, test = examples.sample_and_split(lines, 2, 0.5)
    assert train.count() == 1 and test.count() == 1


def test_puzzles_are_discarded_whole_and_counted(spark):
    from seqforge.operators import examples
    rules, _ = _frames(spark)
    p = spark.createDataFrame([(f"p{k}", 0, "x w - -", v, 1500, ["t"], "u", [], k == 5) for k, v in SEQS.items()],
                              "puzzle_id string, start_state int, fen string, moves array<string>, rating int, themes array<string>, "
                              "game_url string, opening_tags array<string>, parse_error boolean")
    checked = examples.check_puzzles(p, rules)
    ex = examples.puzzle_examples(checked).select("metadata.puzzle_id", "metadata.move_number", "input.fen", "input.legal_moves", "output.move").collect()
    assert {r["puzzle_id"] for r in ex} == {"p1", "p5"}
    assert [(r["move_number"], r["fen"], r["legal_moves"], r["move"]) for r in sorted(ex, key=lambda r: r["move_number"]) if r["puzzle_id"] == "p1"] == [
        (1, "0", ["a"], "a"), (3, "0", ["a"], "a"), (5, "2", ["a"], "a")]
    r = examples.puzzle_report(checked, 1000, 2500).first()
    assert r.asDict() == {"errors": 1, "skipped": 0, "total": 5, "successful": 2, "failed": 3, "total_positions": 3}


def test_checkpoint_dir_keeps_configured_folder(spark):
    from seqforge.session import checkpoint_dir
    first = checkpoint_dir(spark)
    assert first and checkpoint_dir(spark) == first   # an existing setting is read, never replaced


def test_puzzle_plies_join_their_candidates(spark):
    """More rules than one map may hold: no puzzle's row is given the candidates of its states; plies of repeated puzzles and
    of states without a rule keep their rows."""
    from seqforge.operators import examples
    n = sequences.SMALL // 2 + 5
    rules = spark.range(n).select((F.col("id") % 2).cast("int").alias("state"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("action"),
                                  F.lit(1).alias("next_state"))
    rules = rules.unionByName(rules.where("state = 1").withColumn("state", F.lit(2))).unionByName(rules.withColumn("state", F.lit(3)))
    rows = [("a", 0, ["m0", "m1", "m3"]), ("b", 2, ["m1", "m5", "m7"]), ("c", 0, ["m1"]), ("d", 9, [])]
    p = spark.createDataFrame([(k, s, "x w - -", v, 1, ["t"], "u", []) for k, s, v in rows],
                              "puzzle_id string, start_state int, fen string, moves array<string>, rating int, themes array<string>, "
                              "game_url string, opening_tags array<string>")
    checked = examples.check_puzzles(p, rules, cands=False)
    assert "cands" not in checked.columns and rules.count() > sequences.SMALL
    cols = ["metadata.puzzle_id", "metadata.move_number", "input.fen", "input.legal_moves", "output.move"]
    got = sorted(tuple(r) for r in examples.puzzle_examples(checked, rules=rules).select(*cols).collect())
    assert got == sorted(tuple(r) for r in examples.puzzle_examples(examples.check_puzzles(p, rules)).select(*cols).collect())
    odd = sorted(f"m{k}" for k in range(1, n, 2))
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [("a", 1, "0", "m0"), ("a", 3, "1", "m3"), ("b", 1, "2", "m1"), ("b", 3, "1", "m7")]
    assert all(r[3] == (sorted(f"m{k}" for k in range(0, n, 2)) if r[2] == "0" else odd) for r in got)
    lone = checked.where("puzzle_id = 'a'").withColumn("states", F.array(*map(F.lit, (7, 1, 1))))
    assert [len(r["legal_moves"]) for r in examples.puzzle_examples(lone, rules=rules).select("input.legal_moves").collect()] == [0, len(odd)]
