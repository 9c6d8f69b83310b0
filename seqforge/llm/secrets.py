"""Secret scans by a randomness test battery (operator 7, DataFrame operations only).

Base kinds are patterns: ``assign`` (a password-like name, a sign, a value of 12 or more characters),
``access`` (AKIA and capitals or digits, 18 or more characters) and ``hex`` (16 or more lower-case hex
digits). The battery adds ``random``: every maximal run of 20 or more characters of
``A-Z a-z 0-9 + / _ = -`` that no base span touches and that passes

* inferred encoding: decimal, hex, base32, letters of one case, base64 and its URL form, from the
  characters the run uses; it gives the alphabet of k symbols;
* three tests of randomness over the symbols' places in the alphabet: chi-squared uniformity, runs above
  and below the middle, serial correlation of neighbours; the smallest p-value, times three, must be
  ``PASS`` or more;
* false-discovery control: the p-value of the opposite claim, that ordinary text (whose symbols are
  concentrated as ``CONCENTRATION`` says, so that chi-squared grows with the length) looks so even, goes
  through Benjamini-Hochberg at ``FDR`` within its length class (lengths of the same binary logarithm)
  over all runs of all documents. A short run has little power and must be exceptional to pass.

Benjamini-Hochberg needs only a histogram of the p-values (1,024 bins of a 32nd of a power of ten, for
each length class), summed before it is shuffled; the driver sees one threshold per length class.
Everything else is per row: no document is shuffled.

Defined results: null or empty text has no spans; a null doc_id keeps its row; repeated rows each give a
row; an empty table gives an empty result; further columns are ignored (``spans``) or kept (``redact``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX_LONG = "[0-9a-f]{16,}"     # a run is maximal, so this finds those of [0-9a-f]+ with 16 or more
RUN = "[A-Za-z0-9+/_=-]{20,}"
PASS, FDR, BINS_PER_POWER, BINS = 0.01, 0.01, 32, 1024
MASK = "[SECRET]"

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: name, pattern of a run in it, alphabet, concentration of ordinary text: k * (sum of squared shares) - 1.
ENCODINGS = [
    ("decimal", "^[0-9]+$", DIGITS, 1.0),
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6], 1.0),
    ("HEX", "^[0-9A-F]+$", DIGITS + UPPER[:6], 1.0),
    ("lower", "^[a-z]+$", LOWER, 0.7),
    ("upper", "^[A-Z]+$", UPPER, 0.7),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567", 1.1),
    ("base36", "^[a-z0-9]+$", LOWER + DIGITS, 1.4),
    ("base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 2.8),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 2.8),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 2.8),
    ("other", "", UPPER + LOWER + DIGITS + "+/-_=", 2.8),
]


def _matches(text: Column, pattern: str, value_group: int, least: int) -> Column:
    """Start and end of the leftmost, non-overlapping matches whose group ``value_group`` has ``least`` or
    more characters."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    values = whole if value_group == 0 else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), F.length)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + x["whole"]
        out = F.when(x["value"] >= least, F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["out"])
        return F.struct(end.alias("pos"), out.alias("out"))

    # One gap more than matches: the last gap is dropped.
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), values.alias("value"))
    found = F.aggregate(rows, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def _spans(text: Column, kind: int) -> Column:
    found = [lambda: _matches(text, ASSIGN, 2, 12), lambda: _matches(text, ACCESS, 0, 18), lambda: _matches(text, HEX_LONG, 0, 16)][kind]()
    if kind == 1:   # a plain search for the letters is much faster than the pattern
        found = F.when(F.contains(text, F.lit("AKIA")), found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _upper_tail(z: Column) -> Column:
    """P(normal >= z), within a third of a per cent for every z."""
    a = F.abs(z)
    q = F.exp(-a * a / 2) / (2.5066282746310002 * (0.661 * a + 0.339 * F.sqrt(a * a + 5.51)))
    return F.when(z >= 0, q).otherwise(1 - q)


def _by_encoding(run: Column, pick) -> Column:
    out = F.lit(pick(ENCODINGS[-1]))
    for e in reversed(ENCODINGS[:-1]):
        out = F.when(run.rlike(e[1]), F.lit(pick(e))).otherwise(out)
    return out


def battery(run: Column) -> Column:
    """struct(p_random, p_text, size_class) of a run of characters. ``p_random``: the smallest of the three
    tests' p-values, times three; ``p_text``: that ordinary text is so even."""
    body = F.rtrim(run, F.lit("="))
    body = F.when(F.length(body) < 2, run).otherwise(body)

    def tests(s: Column) -> Column:
        n, alphabet = F.length(s["body"]).cast("double"), s["alphabet"]
        k = F.length(alphabet).cast("double")
        symbols = F.split(alphabet, "")
        squares = F.aggregate(symbols, F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(s["body"], c, F.lit(""))), F.lit(2.0)))
        chi = squares * k / n - n
        p_chi = _upper_tail((chi - (k - 1)) / F.sqrt(2 * (k - 1)))
        lam = n * s["concentration"]
        p_text = _upper_tail(((k - 1 + lam) - chi) / F.sqrt(2 * (k - 1 + 2 * lam)))
        at = F.transform(F.split(s["body"], ""), lambda c: F.instr(alphabet, c).cast("double"))
        mid = (k + 1) / 2
        up = F.size(F.filter(at, lambda v: v > mid)).cast("double")
        down = n - up
        pairs = F.zip_with(F.slice(at, F.lit(1), (n - 1).cast("int")), F.slice(at, F.lit(2), (n - 1).cast("int")),
                           lambda a, b: F.struct(((a > mid) != (b > mid)).cast("double").alias("turn"), ((a - mid) * (b - mid)).alias("product")))
        sums = F.aggregate(pairs, F.struct(F.lit(0.0).alias("turn"), F.lit(0.0).alias("product")),
                           lambda acc, x: F.struct((acc["turn"] + x["turn"]).alias("turn"), (acc["product"] + x["product"]).alias("product")))
        mean = 2 * up * down / n + 1
        var = F.greatest((mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9))
        p_runs = F.when((up == 0) | (down == 0), F.lit(0.0)).otherwise(2 * _upper_tail(F.abs(sums["turn"] + 1 - mean) / F.sqrt(var)))
        spread = (k * k - 1) / 12          # variance of a uniform symbol's place
        p_serial = 2 * _upper_tail(F.abs(sums["product"]) / (spread * F.sqrt(n - 1)))
        return F.struct(F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial)).alias("p_random"), p_text.alias("p_text"),
                        F.floor(F.log2(n)).cast("int").alias("size_class"))

    given = F.array(F.struct(body.alias("body"), _by_encoding(body, lambda e: e[2]).alias("alphabet"),
                             _by_encoding(body, lambda e: e[3]).alias("concentration")))
    return F.element_at(F.transform(given, tests), 1)


def _bin(test: Column) -> Column:
    """0: not random; else by the power of ten of ``p_text``, the smallest p-values highest."""
    power = F.floor(-F.log10(F.greatest(test["p_text"], F.lit(1e-31))) * BINS_PER_POWER).cast("int")
    return F.when(test["p_random"] < PASS, F.lit(0)).otherwise(F.least(F.greatest(power, F.lit(0)), F.lit(BINS - 1)))


def _tested(run: Column) -> Column:
    t = F.transform(F.array(battery(run)), lambda x: F.struct(x["size_class"].alias("size_class"), _bin(x).alias("bin")))
    return F.element_at(t, 1)


def thresholds(docs: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """For each length class the smallest bin that Benjamini-Hochberg accepts over all runs of ``docs``; no
    entry if it accepts none."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    hist = runs.select(_tested(F.col("run")).alias("t")).groupBy("t.size_class", "t.bin").agg(F.count("*").alias("n"))
    of_class = Window.partitionBy("size_class")
    upwards = of_class.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    accepted = (hist.withColumn("found", F.sum("n").over(upwards)).withColumn("all", F.sum("n").over(of_class))
                .where((F.col("bin") > 0) & (F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_POWER) <= fdr * F.col("found") / F.col("all"))))
    return {r["size_class"]: r["bin"] for r in accepted.groupBy("size_class").agg(F.min("bin").alias("bin")).collect()}


def spans(text: Column, accept: dict[int, int]) -> Column:
    """All spans of a text as an array of struct(start, kind, end), in order; kind is an index into KINDS,
    start and end are code points (end exclusive)."""
    text = F.coalesce(text, F.lit(""))
    base = F.concat(_spans(text, 0), _spans(text, 1), _spans(text, 2))
    runs = _matches(text, RUN, 0, 20)
    if accept:
        limits = F.create_map(*[F.lit(v) for kv in sorted(accept.items()) for v in kv])
        limit = lambda size_class: F.try_element_at(limits, size_class)

        def fresh(known: Column, r: Column) -> Column:
            t = _tested(F.substring(text, r["start"] + 1, r["end"] - r["start"]))
            free = ~F.exists(known, lambda b: (b["start"] < r["end"]) & (b["end"] > r["start"]))
            return free & F.exists(F.array(t), lambda x: F.coalesce(x["bin"] >= limit(x["size_class"]), F.lit(False)))

        both = F.transform(F.array(F.struct(base.alias("base"), runs.alias("runs"))), lambda s: F.concat(
            s["base"], F.transform(F.filter(s["runs"], lambda r: fresh(s["base"], r)),
                                   lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))))
        base = F.element_at(both, 1)
    return F.array_sort(base)


def _listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), fdr: float = FDR) -> DataFrame:
    """The columns ``keep`` and ``found``, the spans of each text."""
    return docs.select(*keep, spans(F.col("text"), thresholds(docs, fdr)).alias("found"))


def redact(docs: DataFrame, fdr: float = FDR, mask: str = MASK) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mask``; overlapping spans count as one. ``n_chars``,
    where there is such a column, is set anew for the texts that changed."""
    found, text = spans(F.col("text"), thresholds(docs, fdr)), F.col("text")

    def step(acc: Column, s: Column) -> Column:
        plain = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mask))
        return F.struct(F.when(s["start"] < acc["pos"], acc["out"]).otherwise(plain).alias("out"),
                        F.greatest(acc["pos"], s["end"]).alias("pos"))

    marked = docs.withColumn("_found", found)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))
    new = F.aggregate("_found", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    hit = F.size("_found") > 0
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.when(hit, F.col("_new")).otherwise(text).alias("text"))
        elif c == "n_chars":
            columns.append(F.when(hit, F.length("_new")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col(c))
    return marked.withColumn("_new", F.when(hit, new)).select(*columns)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("found", lambda s: s["kind"] < 3)
    return scan(docs).select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
                             F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))
