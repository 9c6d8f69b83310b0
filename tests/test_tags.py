"""X1-X3 and W1-W4 goldens against plain Python ``re`` (the reference's patterns, Unicode \\s)."""
import re

import pytest
from pyspark.sql import functions as F

from seqforge.functions import rewards as R
from seqforge.functions.tags import extract_move, extract_rationale, parse_joint

RAT = r"<rationale>\s*(.+?)\s*</rationale>"
MOV = r"<uci_move>\s*(.+?)\s*</uci_move>"
STRICT = r"<rationale>([^<]*(?:<(?!/?rationale>)[^<]*)*)</rationale>\s*<uci_move>([^<]+)</uci_move>"
LOOSE = r"<rationale>\s*(.+?)\s*</rationale>.*?<uci_move>\s*(.+?)\s*</uci_move>"


def py_extract(p, t):
    m = re.search(p, t, re.DOTALL)
    return m.group(1).strip() if m else None


def py_joint(t):
    for p in (STRICT, LOOSE):
        m = re.search(p, t, re.DOTALL)
        if m:
            return m.group(1).strip(), m.group(2).strip(), True
    return None, None, False


CASES = [
    "<rationale></rationale><uci_move></uci_move>",
    "<rationale>   </rationale><uci_move>e2e4</uci_move>",
    "<rationale>\nline one\nline two\n</rationale>\n<uci_move>\ne2e4 \n</uci_move>",
    "<rationale> nbsp inside </rationale><uci_move> g1f3 </uci_move>",
    "<rationale>a</rationale><uci_move>b</uci_move><rationale>c</rationale><uci_move>d</uci_move>",
    "<rationale>outer <rationale>inner</rationale> tail</rationale><uci_move>a1a2</uci_move>",
    "<rationale>unclosed <uci_move>e2e4</uci_move>",
    "<uci_move>e2e4</uci_move><rationale>after</rationale>",
    "<rationale>ok</rationale> chatter <uci_move>h7h8q</uci_move>",
    "<rationale>has < less than</rationale><uci_move>x</uci_move>",
    "<rationale>move has tag</rationale><uci_move>a<b</uci_move>",
    "plain text",
    "",
    "<rationale>" + "<" * 20000 + "</rationale><uci_move>e2e4</uci_move>",
    "<rationale>\x1c sep \x1f</rationale><uci_move>\x1de2e4\u3000</uci_move>",
    "<rationale>\x85nel\u2003</rationale>\x1c<uci_move>a</uci_move>",
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string")
    j = parse_joint("t")
    rows = df.select("i", extract_rationale("t").alias("r"), extract_move("t").alias("m"),
                     j["rationale"].alias("jr"), j["move"].alias("jm"), j["has_format"].alias("jf"),
                     R.r_format("t").alias("w1"), R.r_combined_format("t").alias("w2"),
                     R.r_rationale_present("t").alias("w3"), R.r_move_present("t").alias("w4")).collect()
    return {r["i"]: r for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_parse_matches_python(parsed, i):
    t, r = CASES[i], parsed[i]
    assert r["r"] == py_extract(RAT, t)
    assert r["m"] == py_extract(MOV, t)
    jr, jm, jf = py_joint(t)
    assert (r["jr"], r["jm"], r["jf"]) == (jr, jm, jf)
    assert r["w1"] == (1.0 if jf else 0.0)
    both = py_extract(RAT, t) is not None and py_extract(MOV, t) is not None
    assert r["w2"] == (2.0 if both else -1.0)
    assert r["w3"] == (1.0 if py_extract(RAT, t) is not None else 0.0)
    assert r["w4"] == (1.0 if py_extract(MOV, t) is not None else 0.0)


def test_whitespace_only_is_empty_not_null(parsed):
    assert parsed[1]["r"] == ""
    assert parsed[0]["r"] is None
