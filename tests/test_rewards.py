"""W5-W8, W10-W14 goldens, computed by hand from the semantics."""
import pytest
from pyspark.sql import functions as F

from seqforge.functions import rewards as R
from seqforge.operators import scoring


def py_concise(r):
    if r is None:
        return -0.5
    s = len([x for x in r.split(".") if x.strip()])
    n = len(r)
    if s == 1 and n < 150:
        return 1.0
    if s <= 2 and n < 200:
        return 0.5
    return -0.5


CONCISE = [None, "", "...", "One.", "One. Two.", "One. Two. Three.", "a" * 149, "a" * 150, "a. " + "b" * 195,
           "a. " + "b" * 197, "no period at all", "  .  . x"]


def test_conciseness(spark):
    import re
    texts = ["no tags"] + [f"<rationale>{r}</rationale>" for r in CONCISE if r is not None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", R.r_conciseness("t").alias("v")).collect()}
    for i, t in enumerate(texts):
        m = re.search(r"<rationale>\s*(.+?)\s*</rationale>", t, re.DOTALL)
        assert got[i] == py_concise(m.group(1).strip() if m else None), (i, t)


def test_penalty_legality_correct(spark):
    df = spark.createDataFrame([
        ("a  b\tc d <uci_move>e2e4</uci_move>", ["e2e4"], "e2e4"),
        ("<uci_move>zz</uci_move>", ["e2e4"], "e2e4"),
        ("nothing", ["e2e4"], "e2e4"),
        ("<uci_move>e2e4</uci_move>", None, None),
    ], "t string, legal array<string>, correct string")
    rows = df.select(R.r_token_penalty("t").alias("p"), R.r_legality("t", "legal").alias("l"),
                     R.r_correct("t", "correct").alias("c")).collect()
    assert [r["p"] for r in rows] == [-0.002 * 5, -0.002 * 1, -0.002 * 1, -0.002 * 1]
    assert [r["l"] for r in rows] == [1.0, -2.0, -1.0, -1.0]
    assert [r["c"] for r in rows] == [3.0, -0.5, -0.5, -0.5]


def py_curve(p, c):
    if abs(c) >= 9000:
        if abs(p) >= 9000:
            return 3.0
        if p * c > 0 and abs(p) > 200:
            return 1.5
        return -1.0
    loss = c - p
    if loss <= 0:
        return 3.0
    if loss < 25:
        return 2.5
    if loss < 75:
        return 2.0 - (loss - 25) / 50 * 0.5
    if loss < 150:
        return 1.5 - (loss - 75) / 75 * 1.0
    if loss < 300:
        return 0.5 - (loss - 150) / 150 * 1.0
    return max(-2.0, -0.5 - (loss - 300) / 400)


def test_quality_curve_goldens(spark):
    losses = [-1, 0, 1, 24, 25, 74, 75, 149, 150, 299, 300, 900, 901]
    pairs = [(100 - l, 100) for l in losses] + [(-9995, 9998), (9990, 9998), (201, 9998), (200, 9998), (-300, -9998)]
    df = spark.createDataFrame(pairs, "p long, c long")
    got = [r["v"] for r in df.select(R.quality_curve("p", "c").alias("v")).collect()]
    assert got == [py_curve(p, c) for p, c in pairs]
    # hand values: steps at 25 (2.5 -> 2.0) and the floor at 900
    assert got[3] == 2.5 and got[4] == 2.0 and got[11] == -2.0 and got[12] == -2.0
    assert got[13] == 3.0   # mate vs mate of the other sign still 3.0 (sign not checked)


def test_fold_mate(spark):
    df = spark.createDataFrame([(5, None), (None, 3), (None, -2), (None, 0), (None, None)], "cp int, mate int")
    assert [r[0] for r in df.select(R.fold_mate("cp", "mate")).collect()] == [5, 9997, -9998, -10000, None]


def test_quality_reward_gate_and_missing(spark):
    comp = spark.createDataFrame([
        (1, "<uci_move>a</uci_move>", ["a", "b"], "b", "s"),   # both found -> curve
        (2, "no tags", ["a"], "a", "s"),                       # -3
        (3, "<uci_move>z</uci_move>", ["a"], "a", "s"),        # -4
        (4, "<uci_move>b</uci_move>", ["a", "b"], "c", "s"),   # reference value missing -> -1
    ], "completion_id int, completion string, legal_moves array<string>, correct_move string, fen string")
    ev = spark.createDataFrame([("s", "a", 3, 100, None), ("s", "b", 3, 150, None)],
                               "state string, action string, depth int, cp int, mate int")
    got = {r["completion_id"]: r["r_quality"] for r in scoring.quality_reward(comp, ev).collect()}
    assert got == {1: py_curve(100, 150), 2: -3.0, 3: -4.0, 4: -1.0}


def test_lookup_key_given_twice_raises(spark):
    comp = spark.createDataFrame([(1, "s", "a", "b")], "completion_id int, fen string, move string, correct_move string")
    ev = spark.createDataFrame([("s", "a", 3, 1, None), ("s", "a", 3, 2, None)], "state string, action string, depth int, cp int, mate int")
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY|duplicate"):
        scoring.lookup_values(comp, ev).collect()
    with pytest.raises(Exception, match="aligned columns"):
        scoring.align_columns(comp, comp.select("completion_id", F.lit(1).alias("x")).unionByName(comp.select("completion_id", F.lit(2).alias("x")))).collect()


def test_group_advantage_single_row_group(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "prompt_id int, total_reward double")
    got = {(r["prompt_id"], r["total_reward"]): r["advantage"] for r in scoring.group_advantage(df).collect()}
    import math
    sd = math.sqrt(2.0)
    assert got[(1, 1.0)] == pytest.approx(-1.0 / (sd + 1e-4))
    assert got[(2, 5.0)] == 0.0


def test_metric_names():
    assert R.metric_name("stockfish_eval", 3.0) == "stockfish_eval_x3"
    assert R.metric_name("combined_format", 0.5) == "combined_format_x0.5"
