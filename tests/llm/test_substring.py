import random
import re

from seqforge.llm import substring
from seqforge.plans.check import compare, duck
from tests.llm.fixtures import collected, docs, prose, rows, table_dir


def brute(data):
    """Span texts by document id, then the cut texts; the first document by id keeps a span."""
    parsed = []
    for i, t, *_ in data:
        t = t or ""
        s, at = [], 0
        ends = {m.end() for m in re.finditer(r"[.!?][ \t-\r]+|\n", t)}
        for m in re.finditer(r"[^ \t-\r]+", t):
            blanks = re.match(r"[ \t\x0b-\r]+", t[m.end():])
            if len(m[0]) == substring.CUT and blanks:
                ends.add(m.end() + blanks.end())
        for b in [*sorted(ends), len(t)]:
            s.append((at, b, [w for w in re.split("[\x20\x09-\x0d]+", t[at:b]) if w]))
            at = b
        parsed.append((i, t, [x for x in s if x[2]]))
    first = {}
    order = lambda i: (i is None, i or 0)
    spans = []
    for i, _, s in parsed:
        own = []
        for k in range(len(s)):
            n = next((n for n in range(1, len(s) - k + 1) if sum(len(p[2]) for p in s[k:k + n]) >= substring.WORDS), None)
            if n:
                key = "\n".join(" ".join(p[2]) for p in s[k:k + n])
                own.append((key, k, n))
                if key not in first or order(i) < order(first[key]):
                    first[key] = i
        spans.append(own)
    out = []
    for (i, t, s), own in zip(parsed, spans, strict=True):
        gone, seen = set(), set()
        for key, k, n in own:
            if first[key] != i or key in seen:
                gone.update(range(k, k + n))
            seen.add(key)
        left, pos = [], 0
        for k in sorted(gone):
            left.append(t[pos:s[k][0]])
            pos = s[k][1]
        out.append((i, len(s), len(gone), "".join(left) + t[pos:]))
    return sorted(out, key=repr)


def test_query_equals_brute_force_and_sql(spark, scratch):
    rng = random.Random(5)
    shared = [prose(rng, 70) for _ in range(3)]
    data = rows() + [(300 + i, " ".join([prose(rng, 27), shared[i % 3], prose(rng, 18)]), "en", "s") for i in range(9)]
    data += [(400, "One two. " * 40, "en", "s"), (401, "a\n\nb\n \nc d e f g h i j\nk\n" * 3, "en", "s")]
    folder = table_dir(scratch, documents=docs(spark, data))
    assert collected(substring.op4_substring_dedup(spark, folder), "doc_id", "n_sentences", "n_removed", "text") == brute(data)


def test_sql_on_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    ok, message = compare(spark, duck(sf), sf, "op4", substring.op4_substring_dedup, substring.OP4_SQL)
    assert ok, message


def test_passage_stays_once_and_clean_text_is_untouched(spark):
    rng = random.Random(6)
    passage = " ".join(f"shared{k}{'.' if k % 11 == 10 else ''}" for k in range(66))
    data = [(i, f"Own{i} {' '.join(f'u{i}x{k}' for k in range(12))}. {passage} End {' '.join(f'v{i}x{k}' for k in range(9))}.", "en", "s") for i in range(5)]
    clean = [(50 + i, " ".join(f"c{i}x{rng.random()}" for k in range(40)) + ".", "en", "s") for i in range(5)]
    got = {r["doc_id"]: r["text"] for r in substring.dedup(docs(spark, data + clean)).collect()}
    assert [i for i in got if "shared0 " in got[i] or "shared60" in got[i]] == [0]
    assert all(got[i] == t for i, t, *_ in clean) and all(f"u{i}x0" in got[i] and f"v{i}x0" in got[i] for i in range(5))


def test_passages_of_every_shape_are_found(spark):
    """One long sentence, a list of two-word lines and two sentences of 28 words, each between a document's own words."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    shapes = [" ".join(word() for _ in range(60)), "\n".join(f"{word()} {word()}" for _ in range(30)),
              ". ".join(" ".join(word() for _ in range(28)) for _ in range(2))]
    data = [(10 * k + i, f"own{i}x{k} {word()} {shape} tail{i}x{k} {word()}", "en", "s") for k, shape in enumerate(shapes) for i in range(2)]
    got = {r["doc_id"]: r for r in substring.dedup(docs(spark, data)).collect()}
    for k in range(len(shapes)):
        assert got[10 * k]["text"] == data[2 * k][1]
        assert len(got[10 * k + 1]["text"].split()) < 40 and f"own1x{k}" in got[10 * k + 1]["text"]


def test_empty_table(spark, scratch):
    assert substring.op4_substring_dedup(spark, table_dir(scratch, documents=docs(spark, []))).count() == 0
