"""T1 with subwords: pair-merge training on the table of distinct words, each distinct word encoded once, texts put together
from a dictionary of their own words.

A word is a row (word, cnt, sym), ``sym`` its symbols as ``<t><h><e>``; a merge of two symbols is a replacement of ``<t><h>`` by
``<th>``. Training repeats: count the neighbouring symbols of all words, weighted by ``cnt``; merge the most frequent pair
(ties: the pair whose newer symbol is older, then the older left one, then the right one; first symbols are in code point
order). One round does several merges, exactly those that training one by one would do next: down the ranked pairs, until
one holds a symbol of a pair merged in this round, as the merges before it change no count of it and every pair that they
make is at most as frequent and newer. The driver sees the best ``TOP`` pairs of a round and the merges, nothing else.

Text is cut into pieces as by :func:`seqforge.operators.tokens.pieces`; runs of word characters are words, any other piece
is a symbol of its own. Texts are cut into blocks of ``BLOCK`` pieces, so a dictionary is small and a lookup in it cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.operators.tokens import SPECIALS, UNK_ID, pieces
from seqforge.session import stored

TOP, BLOCK, REWRITE = 256, 256, 8    # pairs seen by a round, pieces of a block, rounds after which the words are rewritten
Merge = tuple[str, str]


def distinct_words(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, cnt, sym) of all texts, written: one shuffle, of each task's distinct pieces."""
    counts = texts.select(F.explode(pieces(text_col)).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
    return stored(counts.withColumn("sym", first_symbols(F.col("word"))), "words")


def first_symbols(word: Column) -> Column:
    return F.concat(F.lit("<"), F.array_join(F.split(word, ""), "><"), F.lit(">"))


def symbols(sym: Column) -> Column:
    """The symbols as an array ('<' and '>' are never merged: each is a whole piece)."""
    inner = F.substring(sym, F.lit(2), F.length(sym) - 2)
    return F.when(F.length(sym) == 3, F.array(inner)).otherwise(F.split(inner, "><"))


def merged(sym: Column, merges: Column) -> Column:
    """``sym`` after the merges, an array of struct<old, new>, in order."""
    return F.aggregate(merges, sym, lambda s, m: F.replace(s, m["old"], m["new"]))


def _literal(merges: list[Merge]) -> Column:
    return F.array(*[F.struct(F.lit(f"<{a}><{b}>").alias("old"), F.lit(f"<{a}{b}>").alias("new")) for a, b in merges])


def pair_counts(words: DataFrame) -> DataFrame:
    """(a, b, n): how often symbol b follows a, over all words."""
    s = symbols(F.col("sym"))
    pairs = F.arrays_zip(F.slice(s, F.lit(1), F.size(s) - 1).alias("a"), F.slice(s, F.lit(2), F.size(s) - 1).alias("b"))
    return (words.where(F.length("sym") > 3).select("cnt", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("cnt").alias("n")))


def train(words: DataFrame, merges: int, least: int = 2) -> list[tuple[str, str, int]]:
    """The first ``merges`` merges (left, right, count) of :func:`distinct_words`; fewer if no pair occurs ``least`` times."""
    base = [r[0] for r in words.select(F.explode(symbols(F.col("sym"))).alias("s")).distinct().orderBy("s").collect()]
    age = {s: i for i, s in enumerate(base)}
    out: list[tuple[str, str, int]] = []
    fresh: list[Merge] = []
    rounds = 0
    while len(out) < merges:
        now = words.withColumn("sym", merged(F.col("sym"), _literal(fresh))) if fresh else words
        if fresh and rounds % REWRITE == 0:
            now = words = stored(now, "words")
            fresh = []
        ranked = _ranked(pair_counts(now).where(F.col("n") >= least), age)
        if not ranked:
            break
        used: set[str] = set()
        for a, b, n in ranked:
            if len(out) == merges or used & {a, b}:
                break
            used |= {a, b}
            out.append((a, b, n))
            fresh.append((a, b))
            age.setdefault(a + b, len(age))
        rounds += 1
    return out


def _ranked(pairs: DataFrame, age: dict[str, int]) -> list[tuple[str, str, int]]:
    """The best ``TOP`` pairs, best first: each task keeps as many, and they are merged."""
    order = F.create_map(*[F.lit(x) for s, i in age.items() for x in (s, i)])
    aged = pairs.select("a", "b", "n", F.element_at(order, F.col("a")).alias("i"), F.element_at(order, F.col("b")).alias("j"))
    top = aged.orderBy(F.col("n").desc(), F.greatest("i", "j"), "i", "j").limit(TOP).collect()
    return [(r["a"], r["b"], r["n"]) for r in top]


def subword_vocab(words: DataFrame, merges: list[tuple[str, str, int]]) -> DataFrame:
    """(token, id): the special ids, then the first symbols in order, then the merges in order (bounded by their number and
    that of the letters in use)."""
    spark = words.sparkSession
    base = [r[0] for r in words.select(F.explode(symbols(first_symbols(F.col("word")))).alias("s")).distinct().orderBy("s").collect()]
    tokens = list(dict.fromkeys([*base, *[a + b for a, b, _ in merges]]))
    return spark.createDataFrame([(t, len(SPECIALS) + i) for i, t in enumerate(tokens)], "token string, id int")


def encode_words(words: DataFrame, merges: list[tuple[str, str, int]], vocab: DataFrame) -> DataFrame:
    """(word, ids) of every distinct word, written: each is merged and looked up once."""
    sym = merged(first_symbols(F.col("word")), _literal([(a, b) for a, b, _ in merges])) if merges else first_symbols(F.col("word"))
    each = words.select("word", F.posexplode(symbols(sym)).alias("pos", "token")).join(vocab, "token", "left")
    item = F.struct("pos", F.coalesce("id", F.lit(UNK_ID)).alias("id"))
    return stored(each.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["id"]).alias("ids")), "word-ids")


def encode_texts(df: DataFrame, text_col: str, encoded: DataFrame, key: str, out: str = "ids") -> DataFrame:
    """(key, ids) of every text, from :func:`encode_words`; ``key`` must be unique. A null or empty text gives []; a word that
    was not encoded gives UNK. Only a block's distinct pieces meet the encoded words; its text stays where it is."""
    p = pieces(F.coalesce(F.col(text_col), F.lit("")))
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(p) / BLOCK) - 1, F.lit(0)).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, BLOCK))
    blocks = stored(df.select(key, F.posexplode(cuts).alias("block", "p")), "blocks")
    own = blocks.select(key, "block", F.explode(F.array_distinct("p")).alias("word")).join(encoded, "word")
    dictionary = own.groupBy(key, "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "ids"))).alias("d"))
    unknown = F.array(F.lit(UNK_ID))
    ids = F.flatten(F.transform("p", lambda w: F.coalesce(F.try_element_at(F.col("d"), w), unknown)))
    done = blocks.join(dictionary, [key, "block"], "left").select(key, F.struct("block", F.when(F.size("p") > 0, ids).otherwise(F.array().cast("array<int>")).alias("ids")).alias("b"))
    return done.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["ids"])).alias(out))


def encode_many(df: DataFrame, key: str, texts: dict[str, str], encoded: DataFrame) -> DataFrame:
    """:func:`encode_texts` for several text columns at once: (key, <out>: ids[] per text column)."""
    names = list(texts)
    tagged = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col(c).alias("x")) for i, c in enumerate(texts.values())]))
    rows = df.select(F.col(key), tagged.alias("s")).select(F.struct(F.col(key).alias("key"), F.col("s.t").alias("t")).alias("k"), F.col("s.x").alias("x"))
    done = encode_texts(rows, "x", encoded, "k")
    return done.groupBy(F.col("k.key").alias(key)).agg(*[F.max(F.when(F.col("k.t") == i, F.col("ids"))).alias(n) for i, n in enumerate(names)])
