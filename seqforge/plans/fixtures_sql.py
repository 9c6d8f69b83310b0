"""The fixture views of ``fixtures.py`` in DuckDB SQL, for the oracle side of the correctness check.

``with_views(sql, *names)`` prefixes a query with the CTEs it needs (dependencies included).
"""

from __future__ import annotations


def h32(salt: str, expr: str) -> str:
    return f"(('0x' || substr(md5('{salt}' || ':' || CAST({expr} AS VARCHAR)), 1, 8))::BIGINT)"


WORDS = "list_filter(regexp_split_to_array({c}, '[ \\t\\n\\r]+'), lambda x: x <> '')"


def words(c: str) -> str:
    return WORDS.format(c=c)


def side(salt: str, expr: str) -> str:
    return f"(CASE WHEN {h32(salt, expr)} % 2 = 0 THEN 'w' ELSE 'b' END)"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

VIEWS["v_raw"] = ((), f"""
SELECT CAST(o.o_orderkey AS VARCHAR) AS "PuzzleId",
       'c' || CAST(o.o_custkey AS VARCHAR) || ' ' || {side('s', 'o.o_orderkey')} || ' - - 0 1' AS "FEN",
       CASE WHEN {h32('nm', 'o.o_orderkey')} % 17 <> 0 THEN coalesce(m.moves, '') END AS "Moves",
       CASE WHEN {h32('r', 'o.o_orderkey')} % 10 = 0 THEN ''
            WHEN {h32('r', 'o.o_orderkey')} % 10 = 1 THEN 'abc'
            ELSE CAST(400 + {h32('r', 'o.o_orderkey')} % 2400 AS VARCHAR) END AS "Rating",
       CASE WHEN {h32('nt', 'o.o_orderkey')} % 19 <> 0 THEN
       concat_ws(' ', lower(split_part(o.o_orderpriority, '-', 2)), 'status' || lower(o.o_orderstatus),
                 CASE WHEN {h32('t1', 'o.o_orderkey')} % 5 = 0 THEN 'fork' END,
                 CASE WHEN {h32('t2', 'o.o_orderkey')} % 4 = 0 THEN 'mate' END) END AS "Themes",
       'https://example.org/g/' || CAST(o.o_orderkey AS VARCHAR) AS "GameUrl",
       CASE WHEN o.o_orderkey % 2 = 1 THEN NULL ELSE o.o_orderpriority END AS "OpeningTags"
FROM orders o LEFT JOIN (
  SELECT l_orderkey,
         string_agg(lower(l_returnflag) || CAST(l_linenumber AS VARCHAR) || lower(l_linestatus)
                    || CAST(l_partkey % 8 + 1 AS VARCHAR), ' '
                    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_linestatus, l_returnflag)
           AS moves
  FROM lineitem GROUP BY l_orderkey) m ON m.l_orderkey = o.o_orderkey
""")

# Typed puzzles (P1/P2): rating '' -> 0; non-numeric rating, missing moves or themes -> error row (removed here).
VIEWS["v_puz"] = (("v_raw",), """
SELECT "PuzzleId" AS puzzle_id, "FEN" AS fen,
       list_filter(regexp_split_to_array("Moves", '\\s+'), lambda x: x <> '') AS moves,
       CASE WHEN "Rating" = '' THEN 0 ELSE TRY_CAST("Rating" AS INTEGER) END AS rating,
       list_filter(regexp_split_to_array("Themes", '\\s+'), lambda x: x <> '') AS themes,
       "GameUrl" AS game_url,
       CASE WHEN "OpeningTags" IS NULL OR "OpeningTags" = '' THEN []::VARCHAR[]
            ELSE list_filter(regexp_split_to_array("OpeningTags", '\\s+'), lambda x: x <> '') END AS opening_tags
FROM v_raw
WHERE ("Rating" = '' OR TRY_CAST("Rating" AS INTEGER) IS NOT NULL) AND "Moves" IS NOT NULL AND "Themes" IS NOT NULL
""")

VIEWS["v_eval"] = ((), f"""
SELECT rec_id, fen, evals FROM (
  SELECT f.l_orderkey AS rec_id,
         'o' || CAST(f.l_orderkey AS VARCHAR) || ' ' || {side('s', 'f.l_orderkey')} || ' - - 0 1' AS fen,
         CASE WHEN {h32('ne', 'f.l_orderkey')} % 13 = 0 THEN [] ELSE
         list(struct_pack(depth := CAST((f.l_orderkey + ascii(f.l_returnflag)) % 40 + 10 AS INTEGER),
                          knodes := CAST(floor(o.o_totalprice) AS BIGINT),
                          pvs := CASE WHEN {h32('np', 'f.l_orderkey')} % 11 = 0 AND f.l_returnflag = f.first_flag THEN [] ELSE f.pvs END)
              ORDER BY f.l_returnflag) END AS evals
  FROM (SELECT *, min(l_returnflag) OVER (PARTITION BY l_orderkey) AS first_flag FROM (
    SELECT l_orderkey, l_returnflag,
           list(struct_pack(cp := CASE WHEN l_quantity < 45 THEN CAST(floor(l_extendedprice) AS INTEGER) END,
                            mate := CASE WHEN l_quantity >= 45 THEN CAST(l_quantity - 47 AS INTEGER) END,
                            line := array_to_string(list_slice(
                                      ['p' || CAST(l_partkey AS VARCHAR), 's' || CAST(l_suppkey AS VARCHAR),
                                       lower(l_returnflag), lower(l_linestatus),
                                       'q' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)],
                                      1, 1 + {h32('l', 'l_partkey')} % 5), ' '))
                ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_linestatus) AS pvs
    FROM lineitem GROUP BY l_orderkey, l_returnflag)) f
  JOIN orders o ON f.l_orderkey = o.o_orderkey
  GROUP BY f.l_orderkey)
""")

VIEWS["v_lines"] = ((), f"""
SELECT doc_id AS seq_id,
       source || ' ' || {side('s', 'doc_id')} || ' - - 0 1' AS fen,
       array_to_string({words('text')}, ' ') AS line,
       CAST(n_chars % 40 AS INTEGER) AS depth,
       CASE WHEN {h32('k', 'doc_id')} % 7 = 0 THEN NULL ELSE n_chars END AS knodes
FROM documents
""")

VIEWS["v_seq_long"] = ((), """
SELECT seq_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY ts, event_id) AS INTEGER) AS pos,
       event_type AS action
FROM (SELECT *, user_id * 10 + CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS seq_id
      FROM events)
""")

VIEWS["v_seq"] = (("v_seq_long",), """
SELECT seq_id, 0 AS start_state, """ + side('ss', 'seq_id') + """ AS start_side, list(action ORDER BY pos) AS actions
FROM v_seq_long GROUP BY seq_id
""")

VIEWS["v_user_steps"] = ((), """
SELECT user_id AS seq_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos, event_type AS action
FROM events
""")

VIEWS["v_rules"] = ((), """
SELECT CAST(s.state AS INTEGER) AS state, a.action,
       CAST((s.state * 3 + length(a.action)) % 7 AS INTEGER) AS next_state
FROM (SELECT range AS state FROM range(7)) s, (SELECT DISTINCT event_type AS action FROM events) a
WHERE (s.state + ascii(a.action)) % 11 <> 0
""")

VIEWS["v_puz_rules"] = (("v_raw",), """
SELECT CAST(s.state AS INTEGER) AS state, a.action, CAST((s.state * 3 + d * 2 + e) % 7 AS INTEGER) AS next_state
FROM (SELECT range AS state FROM range(7)) s,
     (SELECT action, ascii(substr(action, 2, 1)) AS d, ascii(substr(action, 4, 1)) AS e
      FROM (SELECT DISTINCT unnest(string_split("Moves", ' ')) AS action FROM v_raw) WHERE action <> '') a
WHERE (s.state + d + e) % 13 <> 0
""")

VIEWS["v_pairs"] = (("v_seq_long",), """
SELECT prev, action FROM (
  SELECT DISTINCT coalesce(p.action, '') AS prev, l.action
  FROM v_seq_long l LEFT JOIN v_seq_long p ON p.seq_id = l.seq_id AND p.pos + 1 = l.pos)
WHERE (length(prev) + ascii(action) * 2) % 9 <> 0
""")

VIEWS["v_comp"] = ((), f"""
SELECT completion_id, prompt_id, variant,
       CASE variant
         WHEN 0 THEN '<rationale>' || r || '</rationale><uci_move>' || m || '</uci_move>'
         WHEN 1 THEN '<rationale>' || chr(10) || '  ' || r || '  ' || chr(10) || '</rationale>' || chr(10)
                     || '<uci_move> ' || m || ' </uci_move>' || chr(10)
         WHEN 2 THEN '<uci_move>' || m || '</uci_move>'
         WHEN 3 THEN '<rationale>' || r || '</rationale>'
         WHEN 4 THEN '<rationale></rationale><uci_move></uci_move>'
         WHEN 5 THEN '<rationale>   </rationale> so I think <uci_move>' || m || '</uci_move>'
         WHEN 6 THEN '<rationale>' || r || ' ' || r || '</rationale><uci_move>zz' || m || '</uci_move>'
         ELSE r END AS completion,
       CASE WHEN {h32('c', 'completion_id')} % 3 = 0 THEN 'aa' ELSE m END AS correct_move,
       [m, 'aa'] AS legal_moves,
       'p' || CAST(prompt_id AS VARCHAR) AS fen
FROM (SELECT conv_id * 100 + turn AS completion_id, conv_id AS prompt_id, text AS r,
             substr(md5(text), 1, 4) AS m,
             CAST({h32('v', 'conv_id * 100 + turn')} % 8 AS INTEGER) AS variant
      FROM conversations WHERE role = 'assistant')
""")

_K = "fen || ' ' || action || ' 3'"
VIEWS["v_val"] = (("v_comp",), f"""
SELECT fen AS state, action, 3 AS depth,
       CASE WHEN {h32('x', _K)} % 13 <> 0 AND {h32('e2', _K)} % 10 <> 0
            THEN CAST({h32('e', _K)} % 2001 - 1000 AS INTEGER) END AS cp,
       CASE WHEN {h32('x', _K)} % 13 <> 0 AND {h32('e2', _K)} % 10 = 0
            THEN CAST(({h32('e3', _K)} % 9 + 1) * (CASE WHEN {h32('e4', _K)} % 2 = 0 THEN 1 ELSE -1 END) AS INTEGER)
       END AS mate
FROM (SELECT DISTINCT fen, action FROM (
        SELECT fen, unnest(list_distinct(list_concat(legal_moves, [correct_move]))) AS action FROM v_comp))
""")

VIEWS["v_pos"] = ((), f"""
SELECT doc_id AS pos_id,
       CASE WHEN doc_id % 3 = 0 THEN base
            ELSE base || ' ' || CAST(n_chars % 50 AS VARCHAR) || ' ' || CAST(doc_id % 90 + 1 AS VARCHAR) END AS fen,
       CAST(n_chars % 45 AS INTEGER) AS n_legal
FROM (SELECT doc_id, n_chars,
             source || '/8/' || lang || ' ' || {side('s', 'doc_id')} || ' '
             || (CASE WHEN doc_id % 4 = 0 THEN '-' ELSE 'KQkq' END) || ' -' AS base
      FROM documents)
""")

VIEWS["v_tok_pairs"] = ((), """
SELECT u.conv_id * 100 + u.turn AS pair_id, u.text AS prompt, a.text AS response
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
""")


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        for dep in VIEWS[n][0]:
            visit(dep)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``WITH [RECURSIVE] <views in dependency order>, <extra CTEs> <sql>``."""
    parts = [f"{n} AS ({VIEWS[n][1].strip()})" for n in _order(names)]
    parts += [f"{k} AS ({v.strip()})" for k, v in (extra or {}).items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" + sql.strip()) if parts else sql.strip()


def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
