"""Mixing sources to target weights by a low-discrepancy schedule (operator 6, DataFrame operations only).

* ``targets``: sources in code-point order (null last) weigh 3, 1, 2, repeating; together they shall give
  ``share`` times all words; no source more than ``most`` times its size, what is above that goes to the
  others by weight (water level over the sources sorted by size for weight).
* Layout: the documents of a source in shuffled order (md5 of seed, doc_id and text), laid end to end and
  cut into blocks of equally many words (one more or less).
* ``schedule``: slot s lies at the golden-ratio point frac(s * phi); cumulative shares of the blocks the
  targets ask for turn the point into a source; the slots of a source are ranked in order; rank r takes
  block r mod n of its source in round r div n. Ranks of ``most`` rounds or more are left out.
* ``mix`` joins blocks and slots, and gives per document the words each round takes. As a source's ranks
  run on without gaps, what a round takes of a document is a prefix of it.

Sums and ranks run in two levels (bucket totals, then rows of a bucket), so a source with a third of all
rows spreads over many tasks. Only the table of sources passes through one task; the driver sees the
number of slots alone.

Defined results: null text has size 0; a document or source of size 0 is never taken (its target is 0);
null sources form one source, the last; repeated rows and equal ids each keep a row; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.llm.common import stored, word_count
from seqforge.operators.ordering import bucket_prefix

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2
SEED = "mix-42"
PHI = 0.6180339887498949            # 1 / golden ratio
PHI_HIGH = 0.8983942233824622       # frac(2**26 * PHI)
BLOCK_WORDS = 1024                  # a block is no longer than that
SLOTS_AT_LEAST = 131072             # blocks get shorter on small tables, for about as many slots
BLOCKS_AT_LEAST = 256               # of a source, if it has as many words
UNITS = 1 << 20                     # cumulative shares are counted in 2**-20 blocks, exact as integers
CHUNK = 4096                        # slots ranked together


def sized(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, source, size, and the order of the shuffle: place and its bucket."""
    place = F.md5(F.concat_ws("|", F.lit(SEED), F.col("doc_id").cast("string"), F.col("text")).cast("binary"))
    return (docs.select(*keep, "source", word_count(F.col("text")).alias("size"), place.alias("place"))
            .withColumn("bucket", F.conv(F.substring("place", 1, 3), 16, 10).cast("int")))


def targets(rows: DataFrame) -> DataFrame:
    """From ``sized`` rows, a row per source: idx (1, 2, ...), source, source_size, target, blocks (how many
    it is cut into), and the schedule's share lo, hi of all ``units``."""
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    named = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    s = (by_source.withColumn("idx", F.row_number().over(named))
         .withColumn("weight", F.element_at(weights, ((F.col("idx") - 1) % len(WEIGHTS) + 1).cast("int")))
         .withColumn("most", F.col("source_size") * MOST)
         .withColumn("total", F.sum("source_size").over(every)))
    level = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), "idx")
    full = F.coalesce(F.sum("most").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = (s.withColumn("pos", F.row_number().over(level))
         .withColumn("water", (F.col("total") * SHARE - full) / rest)
         .withColumn("open", F.col("water") <= F.col("most") / F.col("weight")))
    s = s.withColumn("water", F.min(F.when(F.col("open"), F.struct("pos", "water"))).over(every)["water"])
    s = s.withColumn("target", F.least(F.col("most").cast("double"), F.coalesce("water", F.lit(0.0)) * F.col("weight")))
    words = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("total") * SHARE / SLOTS_AT_LEAST))).cast("bigint")
    blocks = F.least(F.col("source_size"), F.greatest(F.ceil(F.col("source_size") / words), F.lit(BLOCKS_AT_LEAST)))
    s = s.withColumn("blocks", blocks.cast("bigint"))
    asked = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size") * UNITS)).otherwise(0)
    s = s.withColumn("asked", asked.cast("bigint"))
    upto = F.sum("asked").over(named.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return s.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("asked")).withColumn("units", F.sum("asked").over(every)).select(
        "idx", "source", "source_size", "target", "blocks", "lo", "hi", "units")


def point(slot: Column) -> Column:
    """frac(slot * phi), without loss for large slots."""
    low, high = slot % (1 << 26), F.floor(slot / (1 << 26))
    frac = lambda x: x - F.floor(x)
    return frac(frac(low * PHI) + frac(high * PHI_HIGH))


def schedule(sources: DataFrame) -> DataFrame:
    """Slots in order: slot, idx (of its source), rank (from 0), block and round. ``sources`` is a written
    table as of ``targets``."""
    spark = sources.sparkSession
    units = sources.agg(F.max("units").alias("u"), F.count("*").alias("n")).first()
    slots = -(-(units["u"] or 0) // UNITS)
    # The sources whose share meets a cell of the unit interval; a slot looks into its own cell only.
    cells = 4 * units["n"] + 1024
    cell_of = lambda at: F.least(F.floor(at * cells).cast("bigint"), F.lit(cells - 1))
    shares = sources.where("hi > lo").select(
        "idx", "blocks", (F.col("lo") / F.col("units")).alias("from"), (F.col("hi") / F.col("units")).alias("to"))
    shares = shares.withColumn("cell", F.explode(F.sequence(cell_of(F.col("from")), cell_of(F.col("to")))))
    at = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", point(F.col("slot")))
    hit = (at.withColumn("cell", cell_of(F.col("point"))).join(shares, "cell")
           .where((F.col("point") >= F.col("from")) & (F.col("point") < F.col("to"))))
    hit = hit.select("slot", "idx", "blocks", F.floor(F.col("slot") / CHUNK).cast("bigint").alias("chunk"))
    ranked = bucket_prefix(hit, "chunk", [F.col("slot")], F.lit(1), ["idx"], "rank")
    return (ranked.withColumn("block", F.col("rank") % F.col("blocks"))
            .withColumn("round", F.floor(F.col("rank") / F.col("blocks")).cast("int"))
            .where(F.col("round") < MOST).select("slot", "idx", "rank", "block", "round"))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: the columns ``keep`` (``doc_id`` among them), source, size, source_size, target,
    taken, and taken0, taken1: the words of the document's beginning that each round takes."""
    rows = stored(sized(docs, keep), "sized")
    sources = stored(targets(rows), "sources")
    takes = (schedule(sources).groupBy("idx", "block")
             .agg(*[F.max((F.col("round") == r).cast("int")).alias(f"in{r}") for r in range(MOST)]))
    # Each document's place in its source's layout.
    laid = bucket_prefix(rows.where("size > 0"), "bucket", [F.col("place"), F.col("size")], F.col("size"), ["source"], "start")
    laid = laid.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # The first ``more`` blocks have one word more than the others.
    laid = (laid.withColumn("len", F.floor(F.col("source_size") / F.col("blocks")).cast("bigint"))
            .withColumn("more", F.col("source_size") % F.col("blocks")))

    def block_of(word: Column) -> Column:
        wide = F.col("more") * (F.col("len") + 1)
        return F.when(word < wide, F.floor(word / (F.col("len") + 1))).otherwise(F.col("more") + F.floor((word - wide) / F.col("len"))).cast("bigint")

    begin = lambda i: i * F.col("len") + F.least(i, F.col("more"))
    end = F.col("start") + F.col("size")
    parts = laid.withColumn("block", F.explode(F.sequence(block_of(F.col("start")), block_of(end - 1))))
    words = F.least(end, begin(F.col("block") + 1)) - F.greatest(F.col("start"), begin(F.col("block")))
    got = parts.withColumn("words", words).join(takes, ["idx", "block"], "left")
    key = [*dict.fromkeys([*keep, "source", "size", "source_size", "target", "start"])]
    taken = [F.sum(F.col("words") * F.coalesce(F.col(f"in{r}"), F.lit(0))).alias(f"taken{r}") for r in range(MOST)]
    counted = got.groupBy(*key).agg(*taken).drop("start")
    none = (rows.where("size = 0").join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
            .select(*[k for k in key if k != "start"], *[F.lit(0).cast("bigint").alias(f"taken{r}") for r in range(MOST)]))
    return counted.unionByName(none).withColumn("taken", F.col("taken0") + F.col("taken1"))


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(concat_ws('|', '{SEED}', doc_id::VARCHAR, text)) AS place FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS idx, sum(source_size) OVER ()::BIGINT AS total FROM by_source),
s2 AS (SELECT *, [3.0, 1.0, 2.0][(idx - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2 AS most FROM s1),
s3 AS (SELECT *, row_number() OVER lv AS pos,
         (total::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(weight) OVER (ORDER BY most::DOUBLE / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water
       FROM s2 WINDOW lv AS (ORDER BY most::DOUBLE / weight, idx)),
lvl AS (SELECT min_by(water, pos) AS water FROM s3 WHERE water <= most::DOUBLE / weight),
s4 AS (SELECT s3.* EXCLUDE (water), least(most::DOUBLE, coalesce((SELECT water FROM lvl), 0) * weight) AS target,
         greatest(1, least({BLOCK_WORDS}, floor(total::DOUBLE * 1.5::DOUBLE / {SLOTS_AT_LEAST})))::BIGINT AS bw FROM s3),
s5 AS (SELECT *, least(source_size, greatest(ceil(source_size::DOUBLE / bw)::BIGINT, {BLOCKS_AT_LEAST})) AS blocks FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN round(target * blocks / source_size * {UNITS})::BIGINT ELSE 0 END AS asked FROM s5),
s7 AS (SELECT *, sum(asked) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING)::BIGINT AS hi, sum(asked) OVER ()::BIGINT AS units FROM s6),
src AS (SELECT *, hi - asked AS lo, source_size // greatest(blocks, 1) AS len, source_size % greatest(blocks, 1) AS more FROM s7),
slots AS (SELECT unnest(range((SELECT (max(units) + {UNITS - 1}) // {UNITS} FROM src))) AS slot),
points AS (SELECT slot, p - floor(p) AS point FROM (
  SELECT slot, ((slot % 67108864) * {PHI}::DOUBLE - floor((slot % 67108864) * {PHI}::DOUBLE))
             + ((slot // 67108864) * {PHI_HIGH}::DOUBLE - floor((slot // 67108864) * {PHI_HIGH}::DOUBLE)) AS p FROM slots)),
ranked AS (SELECT idx, blocks, row_number() OVER (PARTITION BY idx ORDER BY slot) - 1 AS rank FROM points JOIN src
           ON hi > lo AND point >= lo::DOUBLE / units AND point < hi::DOUBLE / units),
takes AS (SELECT idx, rank % blocks AS block, count(*) AS times FROM ranked WHERE rank < 2 * blocks GROUP BY ALL),
laid AS (SELECT doc_id, source, size, place, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
         FROM sized),
docs AS (SELECT laid.*, idx, source_size, target, blocks, len, more,
           CASE WHEN start < more * (len + 1) THEN start // (len + 1) ELSE more + (start - more * (len + 1)) // greatest(len, 1) END AS b0,
           CASE WHEN start + size - 1 < more * (len + 1) THEN (start + size - 1) // (len + 1) ELSE more + (start + size - 1 - more * (len + 1)) // greatest(len, 1) END AS b1,
           row_number() OVER () AS rid
         FROM laid JOIN src ON laid.source IS NOT DISTINCT FROM src.source),
parts AS (SELECT *, unnest(range(b0, b1 + 1)) AS block FROM docs WHERE size > 0),
cut AS (SELECT rid, (least(start + size, (block + 1) * len + least(block + 1, more)) - greatest(start, block * len + least(block, more))) * times AS words
        FROM parts JOIN takes USING (idx, block)),
got AS (SELECT rid, sum(words)::BIGINT AS taken FROM cut GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM docs LEFT JOIN got USING (rid)
"""
