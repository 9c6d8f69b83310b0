"""Small tables for the operator tests: nulls, empty and long texts, ties, repeated rows, clashing columns."""
import random

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}"
CLASHES = ("fp int, root int, score string, row_id int, rank int, size int, hash int, place int, bucket int, text_hash int, "
           "length int, start int, held_out int, run int, found int, toxic int, part int, blocks int, key int")


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    out = []
    for i in range(words):
        out.append(f"w{int(rng.random() ** 2 * vocabulary)}{'.' if i % 9 == 8 else ''}")
    return " ".join(out)


def rows(seed: int = 1) -> list[tuple]:
    """(doc_id, text, lang, source)."""
    rng = random.Random(seed)
    out = [(i, prose(rng, rng.randint(5, 120)), ("en", "de")[i % 2], f"s{i % 3}") for i in range(40)]
    base = prose(rng, 150)
    out += [(100 + i, base, "en", "s0") for i in range(6)]                             # exact copies
    out += [(110 + i, base + f" tail{i}", "en", "s0") for i in range(4)]               # near copies
    out += [(200, None, "en", "s1"), (201, "", None, "s1"), (202, "  \t\n ", "de", None), (203, "12345 678", "en", None),
            (204, prose(rng, 20000), "en", "s2"), (205, "x" * 50000, "en", "s2"), (None, prose(rng, 30), "en", "s1"),
            (None, None, None, None), (7, out[7][1], out[7][2], out[7][3]), (8, prose(rng, 12), None, "s1")]   # repeated row, repeated id
    return out


def docs(spark, data=None, clash: bool = True):
    data = rows() if data is None else data
    extra = CLASHES if clash else "more string"
    n = extra.count(",") + 1
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), *[None] * n) for i, t, la, s in data],
                                 DOC_SCHEMA.format(extra=extra))


def table_dir(folder: str, **tables) -> str:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return folder


def collected(df, *columns) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
