"""Token arrays.

T1 is re-aimed: a corpus vocabulary (frequency desc, token asc -> dense id after the special ids)
and encoding by join, so tokenisation is a Spark job. A model tokenizer can be plugged in instead
through ``encode_with`` (an Arrow-batched pandas UDF). T2-T8 are array expressions per row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.functions.fixed import IGNORE_INDEX
from seqforge.functions.text import col_of, let
from seqforge.operators.ordering import dense_index
from seqforge.session import stored

# Word pieces: runs of ASCII word characters, or one other non-space character.
TOKEN_RE = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r]"
SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>")
PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 2, 3
SENT = 500_000   # tokens of a vocabulary that is sent to every task


def pieces(text: Column | str) -> Column:
    return F.regexp_extract_all(col_of(text), F.lit(TOKEN_RE), 0)


def build_vocab(texts: DataFrame, text_col: str = "text", min_count: int = 1) -> DataFrame:
    """(token, cnt, id); ids after the special ids, by (count desc, token asc)."""
    counts = (texts.select(F.explode(pieces(text_col)).alias("token"))
              .groupBy("token").agg(F.count("*").alias("cnt")))
    if min_count > 1:
        counts = counts.where(F.col("cnt") >= min_count)
    counts = stored(counts, "token-counts")
    if counts.count() <= SENT:      # told by the written files: one task ranks them
        place = F.row_number().over(Window.orderBy(F.col("cnt").desc(), "token"))
        return counts.withColumn("id", (place - 1 + len(SPECIALS)).cast("int"))
    return dense_index(counts, [F.col("cnt").desc(), F.col("token")], start=len(SPECIALS))


def encode_many(df: DataFrame, key: str, texts: dict[str, str], vocab: DataFrame) -> DataFrame:
    """T1 for several text columns at once: (key, <out>: ids[] per text column). Unknown pieces map
    to UNK; a text without pieces gives []. One explode of all texts (tagged by column), as in :func:`encode`."""
    names = list(texts)
    tagged = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col(c).alias("x")) for i, c in enumerate(texts.values())]))
    df, v = _dealt(df, key, vocab)
    p = (df.select(key, tagged.alias("_s"))
         .select(key, F.col("_s.t").alias("_t"), F.posexplode_outer(pieces(F.col("_s.x"))).alias("_pos", "token")))
    j = p.join(v, "token", "left")
    item = F.when(F.col("_pos").isNotNull(),
                  F.struct("_t", "_pos", F.coalesce("id", F.lit(UNK_ID)).alias("id")))
    g = j.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_p"))
    def of_text(i: int) -> Column:
        # a one-argument lambda: PySpark reads a second parameter as the element index
        return F.transform(F.filter("_p", lambda x: x["_t"] == F.lit(i)), lambda x: x["id"])

    return g.select(key, *[of_text(i).alias(n) for i, n in enumerate(names)])


def _dealt(df: DataFrame, key: str, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, token and id): with a vocabulary of at most ``SENT`` tokens (counted), it goes to every task and the texts are
    dealt by key once, so their pieces meet their ids and are put together again without a shuffle; with a larger one the
    pieces meet it by hash (frequent pieces split by AQE) and are shuffled back to their key."""
    v = vocab.select("token", "id")
    return (df.repartition(key), F.broadcast(v)) if vocab.count() <= SENT else (df, v)


def encode(df: DataFrame, text_col: str, vocab: DataFrame, key: str, out: str = "ids",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """Token ids of ``text_col`` (unknown pieces -> UNK), in order; rows keep their key and the
    ``keep`` columns (which must be functions of the key). A NULL or empty text gives [].
    ``posexplode_outer`` keeps rows that have no piece, so no join back to the input is needed."""
    df, v = _dealt(df, key, vocab)
    p = df.select(key, *keep, F.posexplode_outer(pieces(text_col)).alias("_pos", "token"))
    j = p.join(v, "token", "left")
    item = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("id", F.lit(UNK_ID)).alias("id")))
    g = j.groupBy(key, *keep).agg(F.sort_array(F.collect_list(item)).alias("_p"))
    return g.select(key, *keep, F.transform("_p", lambda x: x["id"]).alias(out))


def encode_with(text: Column | str, tokenizer_fn) -> Column:
    """Plug-in tokenizer: ``tokenizer_fn(list[str]) -> list[list[int]]`` run on Arrow batches."""
    @F.pandas_udf("array<int>")
    def _enc(s: pd.Series) -> pd.Series:
        return pd.Series(tokenizer_fn(s.fillna("").tolist()))

    return _enc(col_of(text))


def encode_many_with(df: DataFrame, key: str, texts: dict[str, str], tokenizer_fn) -> DataFrame:
    """:func:`encode_many` by a model's tokenizer: (key, <out>: ids[] per text column); nothing is shuffled."""
    return df.select(key, *[encode_with(c, tokenizer_fn).alias(out) for out, c in texts.items()])


def truncate_reserve(prompt_ids: Column | str, response_ids: Column | str, max_length: int) -> Column:
    """Keep the response whole when possible: if p+r > L the prompt keeps its first L-r ids;
    if r > L the response keeps its first L and the prompt is empty."""
    p, r = col_of(prompt_ids), col_of(response_ids)
    L = F.lit(max_length)
    over = (F.size(p) + F.size(r)) > L
    keep = L - F.size(r)
    new_r = F.when(over & (keep < 0), F.slice(r, 1, max_length)).otherwise(r)
    new_p = (F.when(~over, p).when(keep < 0, F.array().cast("array<int>"))
             .otherwise(F.when(keep > 0, F.slice(p, 1, F.greatest(keep, F.lit(1)))).otherwise(F.array().cast("array<int>"))))
    return F.struct(new_p.alias("prompt_ids"), new_r.alias("response_ids"))


def pad_mask(ids: Column | str, max_length: int, pad_id: int = PAD_ID) -> Column:
    """struct<input_ids, attention_mask> padded on the right to L."""
    x = col_of(ids)
    n = F.size(x)
    pad_n = F.greatest(F.lit(max_length) - n, F.lit(0))
    return F.struct(F.concat(x, F.array_repeat(F.lit(pad_id), pad_n)).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), pad_n)).alias("attention_mask"))


def label_response(input_ids: Column | str, n_prompt: Column, n_response: Column, pad_id: int = PAD_ID) -> Column:
    """T4: -100 outside [n_prompt, n_prompt+n_response); inside, the id unless it equals the pad id.

    Built from slices (evaluated once), so the cost is linear in the length."""
    ids = col_of(input_ids)

    def body(v: Column) -> Column:
        n, a, b = F.size(v["ids"]), v["a"], v["b"]
        mid = F.transform(F.slice(v["ids"], a + 1, F.greatest(F.least(b, n) - a, F.lit(0))),
                          lambda x: F.when(x != pad_id, x).otherwise(F.lit(IGNORE_INDEX)))
        return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.least(a, n)), mid,
                        F.array_repeat(F.lit(IGNORE_INDEX), F.greatest(n - F.greatest(b, a), F.lit(0))))

    return let(F.struct(ids.alias("ids"), n_prompt.cast("int").alias("a"), (n_prompt + n_response).cast("int").alias("b")),
               body)


def find_subsequence(seq: Column | str, sub: list[int] | Column) -> Column:
    """T5: all 0-based starts where ``sub`` occurs (overlaps allowed); [] when seq is shorter. Only where the first id
    agrees is the rest compared."""
    subc = F.array(*[F.lit(v) for v in sub]) if isinstance(sub, list) else sub

    def body(v: Column) -> Column:
        s, q = v["s"], v["q"]
        m = F.size(q)
        starts = F.sequence(F.lit(0), F.size(s) - m)
        first = F.try_element_at(q, F.lit(1))
        here = lambda i: (first.isNull() | (F.element_at(s, i + 1) == first)) & (F.slice(s, i + 1, m) == q)
        return F.when(F.size(s) >= m, F.filter(starts, here)).otherwise(F.array().cast("array<int>"))

    return let(F.struct(col_of(seq).alias("s"), subc.alias("q")), body)


def find_many(seq: Column | str, markers: list[list[int]]) -> Column:
    """T5 for several markers in one pass over the sequence: array<struct<marker, start>>, by start, then marker. A position is
    looked at again only where some marker's first id stands."""
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(v) for v in m]).alias("m")) for i, m in enumerate(markers)])
    firsts = F.array(*[F.lit(v) for v in dict.fromkeys(m[0] for m in markers)])

    def body(v: Column) -> Column:
        s, t = v["s"], v["t"]
        hits = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.array_contains(v["f"], F.element_at(s, i + 1)))
        at = F.transform(hits, lambda i: F.transform(F.filter(t, lambda x: F.slice(s, i + 1, F.size(x["m"])) == x["m"]),
                                                     lambda x: F.struct(x["i"].alias("marker"), i.alias("start"))))
        return F.when(F.size(s) > 0, F.flatten(at)).otherwise(F.array().cast("array<struct<marker:int,start:int>>"))

    return let(F.struct(col_of(seq).alias("s"), table.alias("t"), firsts.alias("f")), body)


def span_positions(seq: Column | str, marker: list[int] | Column) -> Column:
    """Spans covered by paired marker hits (0,1),(2,3)...: from one before the opener to one
    after the closer's end (end exclusive); an odd last hit is ignored."""
    m = F.lit(len(marker)) if isinstance(marker, list) else F.size(marker)

    def body(occ: Column) -> Column:
        opens = F.filter(occ, lambda x, i: i % 2 == 0)
        closes = F.filter(occ, lambda x, i: i % 2 == 1)
        pairs = F.slice(F.arrays_zip(opens.alias("o"), closes.alias("c")), 1, F.size(closes))
        return F.transform(pairs, lambda p: F.struct((p["o"] - 1).alias("start"), (p["c"] + m + 1).alias("end")))

    return let(find_subsequence(seq, marker), body)


def label_spans(seq: Column | str, marker: list[int] | Column) -> Column:
    """labels = id inside a marker span, -100 elsewhere.

    Built from segments, one per span: a run of -100 up to the span, then the ids of the span (spans
    are ordered; overlaps with the previous span and the sequence ends are clipped), then a -100
    tail. Bulk slices and repeats, no per-token lambda, linear in the length."""
    ign = F.lit(IGNORE_INDEX)

    def body(v: Column) -> Column:
        ids, sp = v["s"], v["sp"]
        n = F.size(ids)
        ends = F.transform(sp, lambda x: F.least(x["end"], n))
        prev = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
        segs = F.transform(F.arrays_zip(sp.alias("sp"), ends.alias("e"), prev.alias("pe")), lambda z: F.struct(
            z["pe"].alias("pe"), F.greatest(z["sp"]["start"], z["pe"], F.lit(0)).alias("s"), z["e"].alias("e")))
        parts = F.transform(segs, lambda g: F.concat(
            F.array_repeat(ign, g["s"] - g["pe"]),
            F.slice(ids, g["s"] + 1, F.greatest(g["e"] - g["s"], F.lit(0)))))
        last = F.coalesce(F.element_at(ends, -1), F.lit(0))
        return F.concat(F.flatten(parts), F.array_repeat(ign, n - last))

    def guarded(v: Column) -> Column:
        # arrays_zip/element_at on an empty span list: all -100
        return F.when(F.size(v["sp"]) == 0, F.array_repeat(ign, F.size(v["s"]))).otherwise(body(v))

    return let(F.struct(col_of(seq).alias("s"), span_positions(seq, marker).alias("sp")), guarded)


def pack_fixed(ids: Column | str, max_length: int, pad_id: int = PAD_ID) -> Column:
    """Truncate to L then pad (struct<input_ids, attention_mask>)."""
    return pad_mask(F.slice(col_of(ids), 1, max_length), max_length, pad_id)


def placeholder(max_length: int, pad_id: int = PAD_ID) -> Column:
    """The all-pad row of a failed example (mask 0, labels -100): the row count is kept."""
    return F.struct(F.array_repeat(F.lit(pad_id), max_length).alias("input_ids"),
                    F.array_repeat(F.lit(0), max_length).alias("attention_mask"),
                    F.array_repeat(F.lit(IGNORE_INDEX), max_length).alias("labels"))


def token_export(df: DataFrame, path: str, max_length: int, mode: str = "overwrite") -> int:
    """Write exactly the three fixed-width columns; the width is asserted in the same job
    through an observed metric."""
    from pyspark.sql import Observation
    obs = Observation("token_export")
    bad = ((F.size("input_ids") != max_length) | (F.size("attention_mask") != max_length)
           | (F.size("labels") != max_length))
    out = df.select("input_ids", "attention_mask", "labels").observe(
        obs, F.count("*").alias("rows"), F.count_if(bad).alias("bad"))
    out.write.mode(mode).parquet(path)
    m = obs.get
    if m["bad"]:
        raise ValueError(f"{m['bad']} rows are not {max_length} wide")
    return m["rows"]
