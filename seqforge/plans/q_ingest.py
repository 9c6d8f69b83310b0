"""Queries over the puzzle, evaluation, line and position views: ingest, projections, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqforge.functions import fixed
from seqforge.functions.text import joined, ws_split
from seqforge.operators import examples, frequent, increments, profile, project, sequences
from seqforge.plans import fixtures as fx
from seqforge.plans.catalog import register
from seqforge.plans.fixtures_sql import with_views
from seqforge.plans.views import v_best, v_puz
from seqforge.session import stored
from seqforge.sources import readers

WS = "list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"


def ws(c: str) -> str:
    return WS.format(c=c)


# ---- evaluation records: P5, P6, A8, E2, P9, A4, A5 ------------------------------------------

_BEST_SQL = """
SELECT rec_id, fen, evals[1].pvs[1].line AS line, evals[1].depth AS depth,
       coalesce(evals[1].knodes, 0) AS knodes
FROM v_eval WHERE evals[1].pvs[1].line IS NOT NULL
"""


@register("best_line", with_views(_BEST_SQL, "v_eval"))
def q_best_line(spark, sf):
    return sequences.best_line(fx.v_eval(spark, sf))


@register("min_len", with_views(f"SELECT * FROM ({_BEST_SQL}) WHERE len({ws('line')}) >= 2", "v_eval"))
def q_min_len(spark, sf):
    return v_best(spark, sf)


_LINE_REPORT_SQL = f"""
SELECT r.records, s.valid, round(s.valid * 100.0 / r.records, 1) AS success_pct,
       s.len_min, s.len_max, s.len_avg, s.depth_min, s.depth_max, s.depth_avg
FROM (SELECT count(*) AS records FROM v_eval) r,
     (SELECT count(*) AS valid, CAST(min(n) AS BIGINT) AS len_min, CAST(max(n) AS BIGINT) AS len_max,
             round(avg(n), 1) AS len_avg, CAST(min(depth) AS BIGINT) AS depth_min,
             CAST(max(depth) AS BIGINT) AS depth_max, round(avg(depth), 1) AS depth_avg
      FROM (SELECT len({ws('line')}) AS n, depth FROM ({_BEST_SQL})) WHERE n >= 2) s
"""


@register("line_report", with_views(_LINE_REPORT_SQL, "v_eval"))
def q_line_report(spark, sf):
    lines = sequences.best_line_all(fx.v_eval(spark, sf))
    valid = F.col("line").isNotNull() & (F.size(ws_split("line")) >= 2)
    return profile.line_report(lines, valid)


_EVALS_SQL = """
SELECT rec_id, CAST(i AS BIGINT) AS eval_idx, evals[i + 1] AS ev
FROM (SELECT rec_id, evals, unnest(range(len(evals))) AS i FROM v_eval)
"""
_PVS_SQL = f"""
SELECT rec_id, eval_idx, CAST(j AS BIGINT) AS pv_idx, ev.pvs[j + 1] AS pv
FROM (SELECT rec_id, eval_idx, ev, unnest(range(len(ev.pvs))) AS j FROM ({_EVALS_SQL}))
"""


@register("nested_explode", with_views(
    f"SELECT rec_id, eval_idx, ev.depth AS depth, ev.knodes AS knodes, CAST(len(ev.pvs) AS BIGINT) AS n_pvs "
    f"FROM ({_EVALS_SQL})", "v_eval"))
def q_nested_explode(spark, sf):
    e = sequences.explode_evals(fx.v_eval(spark, sf))
    return e.select("rec_id", F.col("eval_idx").cast("bigint"), "depth", "knodes",
                    F.col("n_pvs").cast("bigint"))


@register("score_label", with_views(
    f"SELECT rec_id, eval_idx, pv_idx, CASE WHEN pv.cp IS NOT NULL THEN 'cp' ELSE 'mate' END AS kind, "
    f"coalesce(CAST(pv.cp AS VARCHAR), CAST(pv.mate AS VARCHAR), 'N/A') AS value FROM ({_PVS_SQL})", "v_eval"))
def q_score_label(spark, sf):
    p = sequences.explode_pvs(fx.v_eval(spark, sf))
    kind, value = project.score_label("cp", "mate")
    return p.select("rec_id", F.col("eval_idx").cast("bigint"), F.col("pv_idx").cast("bigint"),
                    kind.alias("kind"), value.alias("value"))


@register("eval_profile", with_views(
    "SELECT count(*) AS n_evals, "
    + ", ".join(f"CAST(min({c}) AS BIGINT) AS {c}_min, CAST(max({c}) AS BIGINT) AS {c}_max, "
                f"round(avg({c}), 6) AS {c}_mean" for c in ("depth", "knodes", "n_pvs"))
    + f" FROM (SELECT ev.depth AS depth, ev.knodes AS knodes, len(ev.pvs) AS n_pvs FROM ({_EVALS_SQL}))",
    "v_eval"))
def q_eval_profile(spark, sf):
    return profile.eval_profile(sequences.explode_evals(fx.v_eval(spark, sf)))


@register("score_kind_counts", with_views(
    f"SELECT count(pv.cp) AS n_cp, count(pv.mate) AS n_mate FROM ({_PVS_SQL})", "v_eval"))
def q_score_kind_counts(spark, sf):
    return profile.score_kind_counts(sequences.explode_pvs(fx.v_eval(spark, sf)))


# ---- puzzle rows: P1-P4, S5, S7, A1-A3, A6, E1, E3, P10, P11, P15 ---------------------------

_TYPED_SQL = f"""
SELECT "PuzzleId" AS puzzle_id, "FEN" AS fen, array_to_string({ws('coalesce("Moves", \'\')')}, ' ') AS moves,
       CASE WHEN "Rating" IS NULL OR "Rating" = '' THEN 0 ELSE TRY_CAST("Rating" AS INTEGER) END AS rating,
       array_to_string({ws('coalesce("Themes", \'\')')}, ' ') AS themes, "GameUrl" AS game_url,
       CASE WHEN "OpeningTags" IS NULL OR "OpeningTags" = '' THEN '' ELSE array_to_string({ws('"OpeningTags"')}, ' ') END
         AS opening_tags,
       (CASE WHEN "Rating" IS NULL OR "Rating" = '' THEN 0 ELSE TRY_CAST("Rating" AS INTEGER) END) IS NULL
         OR "Moves" IS NULL OR "Themes" IS NULL AS parse_error
FROM v_raw
"""


@register("typed_puzzles", with_views(_TYPED_SQL, "v_raw"))
def q_typed_puzzles(spark, sf):
    t = project.type_puzzles(fx.v_raw(spark, sf))
    return t.select("puzzle_id", "fen", joined("moves").alias("moves"), "rating", joined("themes").alias("themes"),
                    "game_url", joined("opening_tags").alias("opening_tags"), "parse_error")


@register("defaults", with_views(
    "SELECT puzzle_id, rating, len(opening_tags) AS n_tags FROM v_puz "
    "UNION ALL SELECT CAST(seq_id AS VARCHAR), NULL, coalesce(knodes, 0) FROM v_lines", "v_puz", "v_lines"))
def q_defaults(spark, sf):
    p = v_puz(spark, sf).select("puzzle_id", "rating", F.size("opening_tags").cast("bigint").alias("n_tags"))
    lines = fx.v_lines(spark, sf).select(F.col("seq_id").cast("string").alias("puzzle_id"),
                                         F.lit(None).cast("int").alias("rating"),
                                         F.coalesce("knodes", F.lit(0)).cast("bigint").alias("n_tags"))
    return p.unionByName(lines)


@register("ingest_quality", with_views(
    f"SELECT count(*) AS total, count_if(NOT parse_error) AS n_good, count_if(parse_error) AS n_bad "
    f"FROM ({_TYPED_SQL})", "v_raw"))
def q_ingest_quality(spark, sf):
    t = project.type_puzzles(fx.v_raw(spark, sf))
    return t.agg(F.count("*").alias("total"), F.count_if(~F.col("parse_error")).alias("n_good"),
                 F.count_if(F.col("parse_error")).alias("n_bad"))


@register("bad_rows_sample", with_views(
    f"SELECT puzzle_id FROM ({_TYPED_SQL}) WHERE parse_error ORDER BY CAST(puzzle_id AS BIGINT) LIMIT 9", "v_raw"))
def q_bad_rows_sample(spark, sf):
    """The first 9 error rows are logged (a limit is the feature)."""
    b = project.bad_rows(project.type_puzzles(fx.v_raw(spark, sf)))
    return b.orderBy(F.col("puzzle_id").cast("bigint")).limit(9).select("puzzle_id")


@register("rating_filter", with_views(
    "SELECT puzzle_id, rating FROM v_puz WHERE rating BETWEEN 1000 AND 2500", "v_puz"))
def q_rating_filter(spark, sf):
    return project.rating_filter(v_puz(spark, sf), 1000, 2500, enabled=True).select("puzzle_id", "rating")


@register("rating_skipped", with_views(
    "SELECT count_if(NOT (rating BETWEEN 1000 AND 2500)) AS skipped, count(*) AS total FROM v_puz", "v_puz"))
def q_rating_skipped(spark, sf):
    p = v_puz(spark, sf)
    return p.agg(project.rating_skipped(p, 1000, 2500).alias("skipped"), F.count("*").alias("total"))


@register("limit_matched", with_views(
    "SELECT puzzle_id, rating FROM v_puz WHERE rating BETWEEN 1000 AND 2500 "
    "ORDER BY CAST(puzzle_id AS BIGINT) LIMIT 100", "v_puz"))
def q_limit_matched(spark, sf):
    p = project.rating_filter(v_puz(spark, sf), 1000, 2500, enabled=True)
    p = p.withColumn("_id", F.col("puzzle_id").cast("bigint"))
    return project.limit_matched(p, 100, ["_id"]).select("puzzle_id", "rating")


@register("head_n", with_views(
    "SELECT \"PuzzleId\" AS puzzle_id, \"Rating\" AS rating FROM v_raw ORDER BY CAST(\"PuzzleId\" AS BIGINT) LIMIT 1000",
    "v_raw"))
def q_head_n(spark, sf):
    r = fx.v_raw(spark, sf)
    return readers.head_n(r, 1000, F.col("PuzzleId").cast("bigint")).select(
        F.col("PuzzleId").alias("puzzle_id"), F.col("Rating").alias("rating"))


@register("rating_profile", with_views(
    "SELECT count(*) AS n, CAST(min(v) AS BIGINT) AS min_rating, CAST(max(v) AS BIGINT) AS max_rating, "
    "round(avg(v), 0) AS mean_rating, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC) AS BIGINT) AS median_rating "
    "FROM (SELECT TRY_CAST(\"Rating\" AS INTEGER) AS v FROM v_raw WHERE \"Rating\" <> '') WHERE v IS NOT NULL",
    "v_raw"))
def q_rating_profile(spark, sf):
    r = fx.v_raw(spark, sf).where(F.col("Rating") != "").select(
        F.expr("try_cast(Rating AS INT)").alias("rating_value"))
    return profile.rating_profile(r)


@register("top_tokens", with_views(
    "SELECT theme, cnt, round(cnt * 100.0 / (SELECT count(*) FROM v_puz), 1) AS pct FROM ("
    "SELECT theme, count(*) AS cnt FROM (SELECT unnest(themes) AS theme FROM v_puz) GROUP BY theme) "
    "ORDER BY cnt DESC, theme LIMIT 5", "v_puz"))
def q_top_tokens(spark, sf):
    p = v_puz(spark, sf)
    n = p.agg(F.count("*")).scalar()
    return profile.top_tokens(p.select(F.explode("themes").alias("theme")), 5, "theme", n)


@register("top_words", with_views(f"""
SELECT word, count(*) AS cnt FROM (SELECT unnest(string_split(line, ' ')) AS word FROM v_lines) GROUP BY word ORDER BY cnt DESC, word LIMIT 50
""", "v_lines"))
def q_top_words(spark, sf):
    """A2 over the long tail of all documents' words: candidates of every task, counted exactly."""
    words = fx.v_lines(spark, sf).select(F.explode(F.split("line", " ")).alias("word"))
    return frequent.top_tokens_long_tail(words, 50, "word")


@register("merged_profile", """
SELECT * FROM (WITH v AS (SELECT 'n_chars' AS measure, n_chars::DOUBLE AS v FROM documents UNION ALL SELECT 'bytes', strlen(text)::DOUBLE FROM documents),
h AS (SELECT measure, CAST(floor(v / 1000) * 1000 AS BIGINT) AS b, count(*) AS c FROM v WHERE v IS NOT NULL GROUP BY ALL)
SELECT measure, count(v) AS n, count_if(v IS NULL) AS nulls, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS greatest,
       (SELECT string_agg(b || ':' || c, ' ' ORDER BY b) FROM h WHERE h.measure = v.measure) AS histogram
FROM v GROUP BY measure)
""")
def q_merged_profile(spark, sf):
    """A1/A3/A6 merged from the states of parts (the documents' sources)."""
    d = fx.table(spark, sf, "documents")
    measures = {"n_chars": F.col("n_chars"), "bytes": F.octet_length("text")}
    states = stored(increments.part_state(d, F.coalesce("source", F.lit("")), measures, 1000), "states")
    r = increments.merged_profile(states)
    text = F.array_join(F.transform(F.sort_array(F.map_entries("histogram")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), " ")
    return r.select("measure", "n", "nulls", F.round("mean", 6).alias("mean"), "least", "greatest", text.alias("histogram"))


@register("length_profile", with_views(
    "SELECT CAST(min(n) AS BIGINT) AS len_min, CAST(max(n) AS BIGINT) AS len_max, round(avg(n), 6) AS len_mean "
    "FROM (SELECT len(moves) AS n FROM v_puz)", "v_puz"))
def q_length_profile(spark, sf):
    p = v_puz(spark, sf)
    return profile.length_profile(p, F.size("moves"))


@register("rating_histogram", with_views(
    "SELECT CAST(floor(rating / 100) * 100 AS BIGINT) AS bucket, count(*) AS cnt FROM v_puz GROUP BY 1", "v_puz"))
def q_rating_histogram(spark, sf):
    return profile.rating_histogram(v_puz(spark, sf))


@register("token_explode", with_views(
    "SELECT puzzle_id, unnest(themes) AS token FROM v_puz", "v_puz"))
def q_token_explode(spark, sf):
    raw = fx.v_raw(spark, sf)
    good = raw.where(~project.parse_error(raw)).select(F.col("PuzzleId").alias("puzzle_id"), "Themes")
    return sequences.token_explode(good, "Themes", keep=("puzzle_id",))


_PLY_SQL = """
SELECT puzzle_id, fen, rating, themes, game_url, opening_tags, moves[i + 1] AS move,
       CASE WHEN (split_part(fen, ' ', 2) = 'w') <> (i % 2 = 1) THEN 'White' ELSE 'Black' END AS side_to_move,
       i + 1 AS move_number, len(moves) AS total_moves, list_slice(moves, i + 1, len(moves)) AS solution
FROM (SELECT *, unnest(range(len(moves))) AS i FROM v_puz) WHERE i % 2 = 0
"""


def _ply_cols(df):
    return df.select("puzzle_id", "move", "side_to_move", F.col("move_number").cast("bigint"),
                     F.col("total_moves").cast("bigint"), joined("solution").alias("solution"))


@register("ply_expand", with_views(
    f"SELECT puzzle_id, move, side_to_move, CAST(move_number AS BIGINT) AS move_number, "
    f"CAST(total_moves AS BIGINT) AS total_moves, array_to_string(solution, ' ') AS solution FROM ({_PLY_SQL})",
    "v_puz"))
def q_ply_expand(spark, sf):
    return _ply_cols(sequences.ply_expand(v_puz(spark, sf)))


# L1: every move of a puzzle is checked against the rules, then each ply of the solving side gives an example.
_PUZ_WALK = """
SELECT puzzle_id, 0 AS pos, CAST(CAST(puzzle_id AS BIGINT) % 7 AS INTEGER) AS state, moves FROM v_puz
UNION ALL
SELECT w.puzzle_id, w.pos + 1, r.next_state, w.moves
FROM walk w JOIN v_puz_rules r ON r.state = w.state AND r.action = w.moves[w.pos + 1]
"""
_CHECKED = """
SELECT p.*, v.valid_len = len(p.moves) AS ok
FROM v_puz p JOIN (SELECT puzzle_id, max(pos) AS valid_len FROM walk GROUP BY puzzle_id) v ON v.puzzle_id = p.puzzle_id
"""
_EXAMPLES = """
SELECT c.puzzle_id, CAST(w.state AS VARCHAR) AS fen, array_to_string(coalesce(k.c, []::VARCHAR[]), ' ') AS legal_moves, rating,
       array_to_string(themes, ' ') AS themes, c.moves[i + 1] AS move,
       CASE WHEN (split_part(c.fen, ' ', 2) = 'w') <> (i % 2 = 1) THEN 'White' ELSE 'Black' END AS side_to_move,
       CAST(i + 1 AS BIGINT) AS move_number, CAST(len(c.moves) AS BIGINT) AS total_moves,
       array_to_string(list_slice(c.moves, i + 1, len(c.moves)), ' ') AS solution
FROM (SELECT *, unnest(range(len(moves))) AS i FROM checked WHERE ok) c
JOIN walk w ON w.puzzle_id = c.puzzle_id AND w.pos = c.i
LEFT JOIN (SELECT state, list_sort(list_distinct(list(action))) AS c FROM v_puz_rules GROUP BY state) k ON k.state = w.state
WHERE i % 2 = 0
"""


def _puzzle_sql(sql: str) -> str:
    return with_views(sql, "v_puz", "v_puz_rules", extra={"walk": _PUZ_WALK, "checked": _CHECKED, "examples": _EXAMPLES},
                      recursive=True)


def _checked(spark, sf, errors=False):
    """The checked puzzles without candidates, error rows among them if wanted, and the rules. The raw rows are made once, for
    the puzzles and the rules."""
    raw = stored(fx.v_raw(spark, sf), "raw-puzzles")
    p = project.type_puzzles(raw)
    p = (p if errors else project.good_rows(p)).withColumn("start_state", (F.col("puzzle_id").cast("bigint") % 7).cast("int"))
    rules = stored(fx.v_puz_rules(spark, sf, raw), "puzzle-rules")
    return examples.check_puzzles(p, rules, cands=False), rules


def _examples(spark, sf):
    checked, rules = _checked(spark, sf)
    return examples.puzzle_examples(checked, rules=rules)


@register("puzzle_examples", _puzzle_sql(
    "SELECT puzzle_id, move_number, fen, legal_moves, side_to_move, move, solution FROM examples"))
def q_puzzle_examples(spark, sf):
    ex = _examples(spark, sf)
    return ex.select(F.col("metadata.puzzle_id").alias("puzzle_id"), F.col("metadata.move_number").cast("bigint").alias("move_number"),
                     F.col("input.fen").alias("fen"), joined("input.legal_moves").alias("legal_moves"),
                     F.col("input.side_to_move").alias("side_to_move"), F.col("output.move").alias("move"),
                     joined("output.solution").alias("solution"))


@register("puzzle_report", _puzzle_sql(f"""
SELECT (SELECT count_if(parse_error) FROM ({_TYPED_SQL})) AS errors, count_if(NOT used) AS skipped, count_if(used) AS total,
       count_if(used AND ok) AS successful, count_if(used AND NOT ok) AS failed,
       CAST(coalesce(sum(CASE WHEN used AND ok THEN (len(moves) + 1) // 2 END), 0) AS BIGINT) AS total_positions
FROM (SELECT *, rating BETWEEN 1000 AND 2500 AS used FROM checked)
"""))
def q_puzzle_report(spark, sf):
    """A7/S11 counters of one extraction run: error rows, rows outside the ratings, failed and successful."""
    return examples.puzzle_report(_checked(spark, sf, True)[0], 1000, 2500)


@register("position_examples", _puzzle_sql(
    "SELECT fen AS input_fen, legal_moves AS input_legal_moves, side_to_move AS input_side_to_move, move AS output_move, "
    "solution AS output_solution, puzzle_id AS metadata_puzzle_id, rating AS metadata_rating, themes AS metadata_themes, "
    "move_number AS metadata_move_number, total_moves AS metadata_total_moves FROM examples"))
def q_position_examples(spark, sf):
    ex = _examples(spark, sf)
    return ex.select(F.col("input.fen").alias("input_fen"), joined("input.legal_moves").alias("input_legal_moves"),
                     F.col("input.side_to_move").alias("input_side_to_move"),
                     F.col("output.move").alias("output_move"), joined("output.solution").alias("output_solution"),
                     F.col("metadata.puzzle_id").alias("metadata_puzzle_id"),
                     F.col("metadata.rating").alias("metadata_rating"),
                     joined("metadata.themes").alias("metadata_themes"),
                     F.col("metadata.move_number").cast("bigint").alias("metadata_move_number"),
                     F.col("metadata.total_moves").cast("bigint").alias("metadata_total_moves"))


@register("flatten_example", _puzzle_sql(
    "SELECT fen, move AS correct_move, legal_moves, side_to_move, puzzle_id, rating, themes FROM examples"))
def q_flatten_example(spark, sf):
    f = project.flatten_example(_examples(spark, sf))
    return f.select("fen", "correct_move", joined("legal_moves").alias("legal_moves"), "side_to_move", "puzzle_id",
                    "rating", joined("themes").alias("themes"))


@register("theme_rationale", with_views(
    f"SELECT puzzle_id, CASE WHEN list_contains(themes, 'fork') THEN '{fixed.THEME_RATIONALE_FORK}' "
    f"WHEN list_contains(themes, 'mate') THEN '{fixed.THEME_RATIONALE_MATE}' "
    f"ELSE '{fixed.THEME_RATIONALE_OTHER}' END AS rationale FROM v_puz", "v_puz"))
def q_theme_rationale(spark, sf):
    p = v_puz(spark, sf)
    return p.select("puzzle_id", project.theme_rationale("themes").alias("rationale"))


# ---- positions: P12, P13, P14, G16 -------------------------------------------------------------

@register("position_fields", with_views(
    "SELECT pos_id, split_part(fen, ' ', 1) AS board, split_part(fen, ' ', 2) AS side, "
    "split_part(fen, ' ', 3) AS castling, split_part(fen, ' ', 4) AS en_passant, "
    "coalesce(nullif(split_part(fen, ' ', 5), ''), '0') AS halfmove, "
    "coalesce(nullif(split_part(fen, ' ', 6), ''), '1') AS fullmove FROM v_pos", "v_pos"))
def q_position_fields(spark, sf):
    p = fx.v_pos(spark, sf)
    return p.select("pos_id", project.position_fields("fen").alias("f")).select("pos_id", "f.*")


@register("side_to_move", with_views(
    "SELECT pos_id, CASE WHEN split_part(fen, ' ', 2) = 'w' THEN 'White' ELSE 'Black' END AS side_now, "
    "CASE WHEN (split_part(fen, ' ', 2) = 'w') <> (pos_id % 5 % 2 = 1) THEN 'White' ELSE 'Black' END AS side_after "
    "FROM v_pos", "v_pos"))
def q_side_to_move(spark, sf):
    p = fx.v_pos(spark, sf)
    s = F.get(F.split("fen", " "), 1)
    return p.select("pos_id", project.side_label(s).alias("side_now"),
                    project.side_label(s, F.col("pos_id") % 5).alias("side_after"))


@register("complexity_bucket", with_views(
    "SELECT pos_id, n_legal, CASE WHEN n_legal > 30 THEN 'High' WHEN n_legal > 20 THEN 'Medium' ELSE 'Low' END "
    "AS complexity FROM v_pos", "v_pos"))
def q_complexity_bucket(spark, sf):
    p = fx.v_pos(spark, sf)
    return p.select("pos_id", "n_legal", project.complexity_bucket("n_legal").alias("complexity"))


# ---- lines: S6, S14 ----------------------------------------------------------------------------

@register("byte_slice", with_views(
    "SELECT seq_id, o, line FROM (SELECT seq_id, line, sum(strlen(line) + 1) OVER (ORDER BY seq_id ROWS UNBOUNDED PRECEDING) - 1 AS o "
    "FROM v_lines) WHERE o >= 1048576 AND o < 2097152", "v_lines"))
def q_byte_slice(spark, sf):
    lines = fx.v_lines(spark, sf).select("seq_id", "line")
    return readers.byte_slice(lines, "seq_id", F.octet_length("line") + 1, skip_mb=1, target_mb=1).select(
        "seq_id", F.col("newline_offset").alias("o"), "line")


@register("preview", with_views(
    f"SELECT seq_id, substr(fen, 1, 60) AS fen60, array_to_string(list_slice({ws('line')}, 1, 10), ' ') AS moves10, "
    f"len({ws('line')}) AS n_moves, depth, knodes FROM v_lines ORDER BY seq_id LIMIT 3", "v_lines"))
def q_preview(spark, sf):
    lines = fx.v_lines(spark, sf)
    t = ws_split("line")
    return profile.preview(lines, ["seq_id"], 3).select(
        "seq_id", F.substring("fen", 1, 60).alias("fen60"), F.array_join(F.slice(t, 1, 10), " ").alias("moves10"),
        F.size(t).cast("bigint").alias("n_moves"), "depth", "knodes")


@register("scan_examples", "SELECT doc_id, lang, n_chars FROM documents")
def q_scan_examples(spark, sf):
    """Load a built example table; the projection reaches the parquet scan."""
    return readers.scan_examples(spark, f"{sf}/documents.parquet", ["doc_id", "lang", "n_chars"])


_SIDECAR = ("total bigint, total_positions bigint, successful bigint, failed bigint, themes map<string,bigint>, "
            "rating_buckets map<string,bigint>, move_stats struct<min:int,max:int,mean:double>, move_count_histogram map<string,bigint>")


@register("stats_sidecar", _puzzle_sql("""
SELECT * FROM (WITH ok AS (SELECT * FROM checked WHERE ok), n AS (SELECT len(moves) AS n FROM ok)
SELECT part, key, round(CAST(value AS DOUBLE), 6) AS value FROM (
SELECT 'total' AS part, '' AS key, (SELECT count(*) FROM checked) AS value
UNION ALL SELECT 'successful', '', (SELECT count(*) FROM ok)
UNION ALL SELECT 'failed', '', (SELECT count_if(NOT ok) FROM checked)
UNION ALL SELECT 'total_positions', '', (SELECT coalesce(sum((n + 1) // 2), 0) FROM n)
UNION ALL SELECT 'themes', theme, count(*) FROM (SELECT unnest(themes) AS theme FROM ok) GROUP BY theme
UNION ALL SELECT 'rating_buckets', CAST(CAST(floor(rating / 100) * 100 AS BIGINT) AS VARCHAR), count(*) FROM ok GROUP BY ALL
UNION ALL SELECT 'move_stats', 'min', (SELECT min(n) FROM n)
UNION ALL SELECT 'move_stats', 'max', (SELECT max(n) FROM n)
UNION ALL SELECT 'move_stats', 'mean', (SELECT avg(n) FROM n)
UNION ALL SELECT 'move_count_histogram', CAST(n AS VARCHAR), count(*) FROM n GROUP BY n))
"""))
def q_stats_sidecar(spark, sf):
    """The JSON document of one extraction run, taken apart again: part, key, value."""
    doc = profile.stats_sidecar(_checked(spark, sf)[0], F.col("ok")).select(F.from_json("stats_json", _SIDECAR).alias("j")).select("j.*")

    def entry(part: str, key, value):
        return F.struct(F.lit(part).alias("part"), key.alias("key"), F.round(value.cast("double"), 6).alias("value"))

    single = F.array(*[entry(c, F.lit(""), F.col(c)) for c in ("total", "successful", "failed", "total_positions")],
                     *[entry("move_stats", F.lit(k), F.col(f"move_stats.{k}")) for k in ("min", "max", "mean")])
    def entries(c: str):
        return F.transform(F.map_entries(c), lambda e: entry(c, e["key"], e["value"]))

    maps = [entries(c) for c in ("themes", "rating_buckets", "move_count_histogram")]
    return doc.select(F.explode(F.concat(single, *maps)).alias("e")).select("e.*")
