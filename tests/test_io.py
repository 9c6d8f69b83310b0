"""S1-S3, S5, S6, S8, S13, S16, S17 with zstd fixtures written here (Spark reads zstd, cannot write it)."""
import json
import os

import zstandard as zstd
from pyspark.sql import functions as F

from seqforge.operators import project, tokens
from seqforge.sources import readers, sinks
from seqforge.streaming import extract


def _zst(path, text):
    with open(path, "wb") as f:
        f.write(zstd.ZstdCompressor().compress(text.encode("utf-8")))


def test_csv_zst_typing_and_errors(spark, scratch):
    csv = ("PuzzleId,FEN,Moves,Rating,Themes,GameUrl,OpeningTags\n"
           "p1,x w - -,e2e4 e7e5,1500,fork short,u1,Sicilian Najdorf\n"
           "p2,x b - -,a1a2  a2a3,,mate,u2,\n"
           "p3,x w - -,b1b2,abc,,u3,\n"
           "p5,x w - -,a1a2\n"                                            # no rating, no themes: an error row
           "p6,x w - -,,1200,,u6,\n"                                      # empty moves and themes are no error
           "p4,x w - -,c1c2 c2c3,2600,crushing,u4")                       # no final newline
    p = os.path.join(scratch, "puzzles.csv.zst")
    _zst(p, csv)
    raw = readers.scan_csv(spark, p, partitions=4)
    t = {r["puzzle_id"]: r for r in project.type_puzzles(raw).collect()}
    assert t["p1"]["moves"] == ["e2e4", "e7e5"] and t["p1"]["opening_tags"] == ["Sicilian", "Najdorf"]
    assert t["p2"]["rating"] == 0 and t["p2"]["moves"] == ["a1a2", "a2a3"] and t["p2"]["opening_tags"] == []
    assert t["p3"]["parse_error"] and t["p3"]["rating"] is None
    assert t["p4"]["rating"] == 2600
    good = project.good_rows(project.type_puzzles(raw))
    assert t["p5"]["parse_error"] and not t["p6"]["parse_error"] and t["p6"]["moves"] == []
    assert project.bad_rows(project.type_puzzles(raw)).count() == 2
    assert good.count() == 4
    assert project.rating_filter(good, 1000, 2500, enabled=True).count() == 2


def test_jsonl_zst_bad_blank_last_line(spark, scratch):
    recs = [{"fen": "f1", "evals": [{"depth": 20, "knodes": 5, "pvs": [{"cp": 10, "line": "a b c"}]}]},
            {"fen": "f2", "evals": [{"depth": 30, "pvs": [{"mate": -2, "line": "é"}]}]}]
    body = json.dumps(recs[0]) + "\n\n{not json\n" + json.dumps(recs[1], ensure_ascii=False)   # no final newline
    p = os.path.join(scratch, "evals.jsonl.zst")
    _zst(p, body)
    df = readers.scan_jsonl(spark, p)
    good, bad = readers.split_corrupt(df)
    assert good.count() == 2 and bad.count() == 1
    lines = extract.best_lines(good).collect()
    assert [(r["fen"], r["line"], r["knodes"]) for r in lines] == [("f1", "a b c", 5)]


def test_byte_slice_matches_chunk_reader(spark):
    import math
    sizes = [(i, 1000 + (i * 7919) % 50_000) for i in range(400)]
    df = spark.createDataFrame(sizes, "k int, n int")
    for skip_mb, target_mb in ((0, 1), (1, 2), (0.5, 0.3), (3, 100)):
        got = {r["k"] for r in readers.byte_slice(df, "k", F.col("n"), skip_mb, target_mb).collect()}
        s = math.ceil(skip_mb) * readers.MIB
        t = math.ceil(target_mb) * readers.MIB
        end, want = 0, set()
        for k, n in sizes:
            end += n
            if s <= end - 1 < s + t:
                want.add(k)
        assert got == want, (skip_mb, target_mb)


def test_write_jsonl_and_observed(spark, scratch):
    df = spark.range(25).select(F.col("id").alias("k"), F.lit("x").alias("line"))
    m = sinks.write_jsonl(df, os.path.join(scratch, "out"), max_records_per_file=10)
    assert m["rows"] == 25
    back = spark.read.json(os.path.join(scratch, "out"))
    assert back.count() == 25
    obs_df, obs = sinks.line_progress(df.withColumn("line", F.when(F.col("k") % 5 == 0, None).otherwise("ab")))
    obs_df.count()
    assert obs.get["records"] == 25 and obs.get["valid"] == 20 and obs.get["bytes"] == 60


def test_token_export_width(spark, scratch):
    df = spark.createDataFrame([([1, 2, 3],), ([4],)], "s array<int>")
    p = tokens.pack_fixed("s", 4)
    rows = df.select(p["input_ids"].alias("input_ids"), p["attention_mask"].alias("attention_mask"),
                     tokens.label_response(p["input_ids"], F.lit(0), F.size("s")).alias("labels"))
    assert tokens.token_export(rows, os.path.join(scratch, "tok"), 4) == 2
    assert spark.read.parquet(os.path.join(scratch, "tok")).columns == ["input_ids", "attention_mask", "labels"]


def test_stream_equals_batch(spark, scratch):
    src = os.path.join(scratch, "src")
    os.makedirs(src)
    for i in range(3):
        with open(os.path.join(src, f"part{i}.json"), "w") as f:
            for j in range(20):
                line = " ".join(f"m{x}" for x in range((i + j) % 5))
                f.write(json.dumps({"fen": f"f{i}-{j}", "evals": [{"depth": j, "knodes": i, "pvs": [{"cp": 1, "line": line}]}]}) + "\n")
    q = extract.start_extract(spark, src, os.path.join(scratch, "sink"), os.path.join(scratch, "ckpt"))
    q.awaitTermination(120)
    streamed = {tuple(r) for r in spark.read.parquet(os.path.join(scratch, "sink")).select("fen", "line", "depth", "knodes").collect()}
    batch = {tuple(r) for r in extract.extract_batch(spark, src).collect()}
    assert streamed == batch and len(batch) > 0
    # restart: nothing new, nothing duplicated
    q = extract.start_extract(spark, src, os.path.join(scratch, "sink"), os.path.join(scratch, "ckpt"))
    q.awaitTermination(120)
    assert spark.read.parquet(os.path.join(scratch, "sink")).count() == len(batch)


def test_stream_drops_lines_it_has_emitted(spark, scratch):
    """Repeated lines and files add nothing, within a run and after a restart; the result is the batch's distinct lines."""
    src, sink, ckpt = (os.path.join(scratch, n) for n in ("src", "sink", "ckpt"))
    os.makedirs(src)

    def put(name, ids):
        with open(os.path.join(src, name), "w") as f:
            for j in ids:
                f.write(json.dumps({"fen": f"f{j}", "evals": [{"depth": j, "knodes": 1, "pvs": [{"cp": 1, "line": f"a b m{j}"}]}]}) + "\n")

    def run():
        extract.start_extract(spark, src, sink, ckpt, max_files_per_trigger=1, once=True).awaitTermination(200)
        return sorted(tuple(r) for r in spark.read.parquet(sink).select("fen", "line", "depth", "knodes").collect())

    put("a.json", [1, 2, 3, 3, 2])
    put("b.json", [3, 4])
    want = sorted(tuple(r) for r in extract.extract_batch(spark, src).distinct().collect())
    assert run() == want and len(want) == 4
    put("c.json", [1, 2, 3, 4])
    put("d.json", [5, 5, 1])
    want = sorted(tuple(r) for r in extract.extract_batch(spark, src).distinct().collect())
    assert run() == want and len(want) == 5


def test_scan_lines_default_knodes(spark, scratch):
    p = os.path.join(scratch, "lines.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"fen": "a", "line": "x y", "depth": 3, "knodes": 7}) + "\n")
        f.write(json.dumps({"fen": "b", "line": "z", "depth": 4}) + "\n")
    rows = {r["fen"]: r for r in readers.scan_lines(spark, p, partitions=2).collect()}
    assert rows["a"]["knodes"] == 7 and rows["b"]["knodes"] == 0 and rows["b"]["depth"] == 4
