"""File and line of bad rows, in compressed files and in plain files read in several blocks."""
import json
import os

import zstandard

from seqforge.sources import locate, readers


def _write(path, lines, packed):
    data = ("\n".join(lines) + "\n").encode()
    with open(path, "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(data) if packed else data)


def _records(n, bad):
    return ["{broken" if i in bad else "" if i % 11 == 5 else json.dumps({"fen": f"f{i}", "evals": [{"depth": 1, "knodes": 1, "pvs": [{"cp": 1, "line": "a " * 40}]}]}) for i in range(1, n + 1)]


def test_compressed_files(spark, scratch):
    bad = {"one": {3, 40}, "two": {1, 77, 100}}
    for name, rows in bad.items():
        _write(os.path.join(scratch, f"{name}.jsonl.zst"), _records(100, rows), True)
    got = {(os.path.basename(r["file"]).split(".")[0], r["line"]) for r in locate.bad_lines(spark, scratch, readers.EVAL_RECORD_SCHEMA).collect()}
    assert got == {(k, i) for k, v in bad.items() for i in v}
    assert locate.bad_report(spark, scratch, readers.EVAL_RECORD_SCHEMA, first=2).count() == 2


def test_plain_file_in_many_blocks(spark, scratch):
    bad = {2, 500, 1999}
    _write(os.path.join(scratch, "big.jsonl"), _records(2000, bad), False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = locate.bad_lines(spark, scratch, readers.EVAL_RECORD_SCHEMA)
        assert spark.read.text(scratch).rdd.getNumPartitions() > 4
        assert {r["line"] for r in df.collect()} == bad
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv(spark, scratch):
    head = "PuzzleId,FEN,Moves,Rating,Themes,GameUrl,OpeningTags"
    _write(os.path.join(scratch, "p.csv.zst"), [head, "a,f w,e2 e4,1500,fork,u,t", "short,row", "b,f w,e2 e4,1500,fork,u,t,extra", "c,f,m,1,t,u,"], True)
    got = [(r["line"], r["value"]) for r in locate.bad_lines(spark, scratch, readers.PUZZLE_CSV_SCHEMA, "csv").orderBy("line").collect()]
    assert [g[0] for g in got] == [3, 4] and got[0][1] == "short,row"
