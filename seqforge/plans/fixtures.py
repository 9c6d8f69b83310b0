"""Fixture views over the driver's tables (Spark side).

Each view gives one of the reference's input shapes, derived by Spark from the given tables, so that
the work grows with them. ``fixtures_sql.py`` builds the same views in DuckDB SQL for the oracle;
the two must stay rule-for-rule equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.functions.text import hash32

# Fixture word tokens: ASCII whitespace runs, so that Java and RE2 split identically.
FIXTURE_WS = "[ \\t\\n\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(c: Column | str) -> Column:
    """Whitespace-separated words (no empty word)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(c, FIXTURE_WS), lambda x: x != "")


def side_letter(salt: str, id_col: Column) -> Column:
    return F.when(F.pmod(hash32(salt, id_col), F.lit(2)) == 0, F.lit("w")).otherwise(F.lit("b"))


def v_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puzzle CSV rows, all strings (M1), one per order: the moves are its line items in line order
    (bounded by the order's size; '' for an order without items), a rating that is sometimes empty or
    not a number, themes from the order's priority and status (plus 'fork'/'mate' on some orders),
    a URL, and tags that are absent on odd ids. On some orders the moves or the themes are missing."""
    li = table(spark, sf_dir, "lineitem")
    tok = F.concat(F.lower("l_returnflag"), F.col("l_linenumber").cast("string"), F.lower("l_linestatus"),
                   (F.pmod(F.col("l_partkey"), F.lit(8)) + 1).cast("string"))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_linestatus",
                    "l_returnflag", tok.alias("tok"))
    moves = (li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
             .select("l_orderkey", F.array_join(F.transform("items", lambda x: x["tok"]), " ").alias("moves")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    j = o.join(moves, o.o_orderkey == moves.l_orderkey, "left")
    i = F.col("o_orderkey")
    hr = hash32("r", i)
    rating = (F.when(hr % 10 == 0, F.lit("")).when(hr % 10 == 1, F.lit("abc"))
              .otherwise((F.lit(400) + hr % 2400).cast("string")))
    themes = F.concat_ws(" ", F.lower(F.split_part(F.col("o_orderpriority"), F.lit("-"), F.lit(2))),
                         F.concat(F.lit("status"), F.lower("o_orderstatus")),
                         F.when(hash32("t1", i) % 5 == 0, F.lit("fork")),
                         F.when(hash32("t2", i) % 4 == 0, F.lit("mate")))
    return j.select(
        i.cast("string").alias("PuzzleId"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(" "), side_letter("s", i),
                 F.lit(" - - 0 1")).alias("FEN"),
        F.when(hash32("nm", i) % 17 != 0, F.coalesce(F.col("moves"), F.lit(""))).alias("Moves"),
        rating.alias("Rating"),
        F.when(hash32("nt", i) % 19 != 0, themes).alias("Themes"),
        F.concat(F.lit("https://example.org/g/"), i.cast("string")).alias("GameUrl"),
        F.when(i % 2 == 1, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("OpeningTags"),
    )


def v_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested evaluation records (M3): one per order; one eval per return flag of its line items
    (bounded by the order's size); pvs = those line items in a total order. Some records have no eval, and
    some no pv in their first eval."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    line_tokens = F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")),
                          F.concat(F.lit("s"), F.col("l_suppkey").cast("string")),
                          F.lower("l_returnflag"), F.lower("l_linestatus"),
                          F.concat(F.lit("q"), q.cast("int").cast("string")))
    item = F.struct(
        F.col("l_returnflag").alias("flag"),
        F.col("l_linenumber").alias("k1"), F.col("l_partkey").alias("k2"), F.col("l_suppkey").alias("k3"),
        F.col("l_extendedprice").alias("k4"), q.alias("k5"), F.col("l_linestatus").alias("k6"),
        F.when(q < 45, F.floor("l_extendedprice").cast("int")).alias("cp"),
        F.when(q >= 45, (q - 47).cast("int")).alias("mate"),
        F.array_join(F.slice(line_tokens, 1, (F.lit(1) + hash32("l", F.col("l_partkey")) % 5).cast("int")),
                     " ").alias("line"))
    # One shuffle: line items grouped per order (sorted by flag, then the pv order); the join with
    # orders reuses that partitioning; evals are split per flag with array functions.
    per_order = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    rec = per_order.join(orders, per_order.l_orderkey == orders.o_orderkey)
    flags = F.array_distinct(F.transform("items", lambda x: x["flag"]))
    flags = F.when(hash32("ne", F.col("o_orderkey")) % 13 == 0, F.slice(flags, 1, 0)).otherwise(flags)
    no_line = hash32("np", F.col("o_orderkey")) % 11 == 0
    first = F.get(F.col("items"), 0)["flag"]

    def ev(flag: Column) -> Column:
        pvs = F.transform(F.filter("items", lambda x: (x["flag"] == flag) & ~(no_line & (flag == first))),
                          lambda x: F.struct(x["cp"].alias("cp"), x["mate"].alias("mate"), x["line"].alias("line")))
        return F.struct(((F.col("o_orderkey") + F.ascii(flag)) % 40 + 10).cast("int").alias("depth"),
                        F.floor("o_totalprice").cast("bigint").alias("knodes"), pvs.alias("pvs"))

    return rec.select(
        F.col("o_orderkey").alias("rec_id"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(" "), side_letter("s", F.col("o_orderkey")),
                 F.lit(" - - 0 1")).alias("fen"),
        F.transform(flags, ev).alias("evals"))


def v_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line records (M5) from whole documents: every word of the text is one step."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    i = F.col("doc_id")
    return d.select(
        i.alias("seq_id"),
        F.concat(F.col("source"), F.lit(" "), side_letter("s", i), F.lit(" - - 0 1")).alias("fen"),
        F.array_join(words("text"), " ").alias("line"),
        (F.col("n_chars") % 40).cast("int").alias("depth"),
        F.when(F.pmod(hash32("k", i), F.lit(7)) == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("n_chars")).alias("knodes"))


def v_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered action sequences (seq_id, start_state=0, start_side, actions[]): user x week of events,
    ordered by (ts, event_id); one shuffle. Nothing bounds a user's events of one week: all are one row."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("bigint")
    g = (e.groupBy((F.col("user_id") * 10 + week).alias("seq_id"))
         .agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("a")))
    return g.select("seq_id", F.lit(0).alias("start_state"), side_letter("ss", F.col("seq_id")).alias("start_side"),
                    F.transform("a", lambda x: x["event_type"]).alias("actions"))


def v_user_steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Steps (seq_id, ts, event_id, action) of each user's whole history, of any length, and its start state 0, in long form."""
    e = table(spark, sf_dir, "events")
    steps = e.select(F.col("user_id").alias("seq_id"), "ts", "event_id", F.col("event_type").alias("action"))
    return steps, steps.select("seq_id").distinct().withColumn("start_state", F.lit(0))


def v_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition relation rules(state, action, next_state): states 0-6 for each action of the
    events' vocabulary; next = (3*state + length(action)) % 7; pairs with
    (state + ascii(action)) % 11 = 0 are not allowed. Unique per (state, action)."""
    acts = table(spark, sf_dir, "events").select(F.col("event_type").alias("action")).distinct()
    r = acts.select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("state"), "action")
    return (r.where((F.col("state") + F.ascii("action")) % 11 != 0)
            .select("state", "action", ((F.col("state") * 3 + F.length("action")) % 7).cast("int").alias("next_state")))


def v_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observable-state rules: allowed (previous action, action) pairs ('' is the start), taken from
    the pairs that occur in the sequences and kept when (length(prev) + 2*ascii(action)) % 9 <> 0."""
    from seqforge.operators.sequences import step_pairs
    p = step_pairs(v_seq(spark, sf_dir)).select("prev", "action").distinct()
    return p.where((F.length("prev") + F.ascii("action") * 2) % 9 != 0)


def v_puz_rules(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """Transition relation over the puzzles' moves: states 0-6; with d, e the codes of a move's second and
    fourth character, next = (3*state + 2*d + e) % 7; (state + d + e) % 13 = 0 is not allowed."""
    raw = v_raw(spark, sf_dir) if raw is None else raw
    acts = raw.select(F.explode(F.split("Moves", " ")).alias("action")).where("action <> ''").distinct()
    d, e = F.ascii(F.substring("action", 2, 1)), F.ascii(F.substring("action", 4, 1))
    r = acts.select("action", d.alias("d"), e.alias("e"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("state"))
    return (r.where((F.col("state") + F.col("d") + F.col("e")) % 13 != 0)
            .select("state", "action", ((F.col("state") * 3 + F.col("d") * 2 + F.col("e")) % 7).cast("int").alias("next_state")))


def v_comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions (M12) built from assistant turns in eight text variants, with aligned columns; the
    move is a 4-hex-digit key derived from the whole turn text."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    cid = F.col("conv_id") * 100 + F.col("turn")
    c = c.select(cid.alias("completion_id"), F.col("conv_id").alias("prompt_id"),
                 F.col("text").alias("r"), F.substring(F.md5("text"), 1, 4).alias("m"))
    v = F.pmod(hash32("v", F.col("completion_id")), F.lit(8))
    r, m = F.col("r"), F.col("m")
    text = (F.when(v == 0, F.concat(F.lit("<rationale>"), r, F.lit("</rationale><uci_move>"), m, F.lit("</uci_move>")))
            .when(v == 1, F.concat(F.lit("<rationale>\n  "), r, F.lit("  \n</rationale>\n<uci_move> "), m,
                                   F.lit(" </uci_move>\n")))
            .when(v == 2, F.concat(F.lit("<uci_move>"), m, F.lit("</uci_move>")))
            .when(v == 3, F.concat(F.lit("<rationale>"), r, F.lit("</rationale>")))
            .when(v == 4, F.lit("<rationale></rationale><uci_move></uci_move>"))
            .when(v == 5, F.concat(F.lit("<rationale>   </rationale> so I think <uci_move>"), m, F.lit("</uci_move>")))
            .when(v == 6, F.concat(F.lit("<rationale>"), r, F.lit(" "), r, F.lit("</rationale><uci_move>zz"), m,
                                   F.lit("</uci_move>")))
            .otherwise(r))
    correct = F.when(F.pmod(hash32("c", F.col("completion_id")), F.lit(3)) == 0, F.lit("aa")).otherwise(m)
    return c.select("completion_id", "prompt_id", v.cast("int").alias("variant"), text.alias("completion"),
                    correct.alias("correct_move"), F.array(m, F.lit("aa")).alias("legal_moves"),
                    F.concat(F.lit("p"), F.col("prompt_id").cast("string")).alias("fen"))


def v_val(spark: SparkSession, sf_dir: str, depth: int = 3) -> DataFrame:
    """Evaluation lookup evals(state, action, depth, cp, mate), unique per key, for every (position,
    move) pair the completions can ask for; every 13th key has no value (cp and mate NULL)."""
    comp = v_comp(spark, sf_dir)
    keys = (comp.select("fen", F.explode(F.array_union("legal_moves", F.array("correct_move"))).alias("action"))
            .distinct())
    k = F.concat_ws(" ", F.col("fen"), F.col("action"), F.lit(str(depth)))
    has = F.pmod(hash32("x", k), F.lit(13)) != 0
    is_mate = F.pmod(hash32("e2", k), F.lit(10)) == 0
    return keys.select(
        F.col("fen").alias("state"), "action", F.lit(depth).alias("depth"),
        F.when(has & ~is_mate, (F.pmod(hash32("e", k), F.lit(2001)) - 1000).cast("int")).alias("cp"),
        F.when(has & is_mate, ((F.pmod(hash32("e3", k), F.lit(9)) + 1)
                               * F.when(F.pmod(hash32("e4", k), F.lit(2)) == 0, 1).otherwise(-1)).cast("int")).alias("mate"))


def v_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position texts (M14): six fields, the short four-field form on every third row."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    i = F.col("doc_id")
    castling = F.when(i % 4 == 0, F.lit("-")).otherwise(F.lit("KQkq"))
    base = F.concat_ws(" ", F.concat(F.col("source"), F.lit("/8/"), F.col("lang")), side_letter("s", i), castling,
                       F.lit("-"))
    full = F.concat_ws(" ", base, (F.col("n_chars") % 50).cast("string"), (i % 90 + 1).cast("string"))
    return d.select(i.alias("pos_id"), F.when(i % 3 == 0, base).otherwise(full).alias("fen"),
                    (F.col("n_chars") % 45).cast("int").alias("n_legal"))


def v_tok_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt/response text pairs: a user turn and the assistant turn right after it."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("response"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("pair_id"),
                                                  "prompt", "response")
