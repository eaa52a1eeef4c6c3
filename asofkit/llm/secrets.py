"""Secret scans in DataFrame functions alone: fixed patterns, and a randomness test battery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed patterns. Group 2 of an assignment must have 12 characters or more.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of 18 or more is the whole run from its first AKIA
HEX = r"[0-9a-f]{16,}"  # likewise
KINDS = ("assign", "access", "hex", "random")

#: What the battery tests: runs of at least 16 characters of the usual encodings, and their parts
#: between '/', '-' and '_' that are as long, or UUIDs.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
UUID = r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
PART = rf"{UUID}|[A-Za-z0-9+]{{16,}}={{0,2}}"
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encoding, what its strings look like, its alphabet. The first that fits is inferred; a digit
#: and a letter, or for the mixed ones both cases, must occur, as one class alone is a word or a number.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", _DIGITS + _LOWER),
    ("BASE36", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", _DIGITS + _UPPER),
    ("base62", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: Bins of p; the first edge is the least cut. A cut is raised on this many standard errors.
BINS, SURE = 100, 3.0
#: Items that one fold over an array takes.
CHUNK = 64


def with_value(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunked(items: Column) -> Column:
    """An array as an array of arrays of CHUNK items (one empty one for an empty array)."""
    parts = F.greatest(F.ceil(F.size(items) / CHUNK).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.slice(items, j * CHUNK + 1, F.lit(CHUNK)))


def running(values: Column, zero: int, merge) -> Column:
    """The running result of an associative merge over an array of int.

    Each chunk is folded alone and what came before it is merged in after, so no array grows with a
    text's matches, as it would in one fold, and the work is nearly linear in them.
    """
    start = F.lit(zero)

    def inside(chunk: Column) -> Column:
        def step(s: Column, v: Column) -> Column:
            return with_value(merge(s["at"], v), lambda m: F.struct(m.alias("at"), F.concat(s["all"], F.array(m)).alias("all")))

        return F.aggregate(chunk, F.struct(start.alias("at"), F.array().cast("array<int>").alias("all")), step)

    def carried(folds: Column) -> Column:
        def join(ends: Column) -> Column:
            def after(fold: Column, j: Column) -> Column:
                return with_value(F.aggregate(F.slice(ends, F.lit(1), j), start, merge), lambda before: F.transform(fold["all"], lambda v: merge(before, v)))

            return F.flatten(F.transform(folds, after))

        return with_value(F.transform(folds, lambda f: f["at"]), join)

    return with_value(values, lambda v: with_value(F.transform(chunked(v), inside), carried))


def located(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as structs (start, end, match), in code points."""
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def placed(found: Column) -> Column:
        # The pieces between matches and the matches themselves, in turn, make up the text.
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = running(F.zip_with(found, gaps, lambda m, gap: F.char_length(m) + F.char_length(gap)), 0, lambda a, b: a + b)
        at = F.zip_with(found, ends, lambda m, end: F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("match")))
        return F.when(F.size(found) == 0, empty).otherwise(at)

    return with_value(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def spans_of(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def normal_tail(z: Column) -> Column:
    """P(Z > z), by the polynomial 26.2.17 of Abramowitz and Stegun (error below 1e-7)."""

    def tail(z: Column) -> Column:
        def poly(t: Column) -> Column:
            return t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))

        upper = F.exp(-z * z / 2) * 0.3989422804014327 * with_value(1 / (1 + 0.2316419 * F.abs(z)), poly)
        return with_value(upper, lambda u: F.when(z >= 0, u).otherwise(1 - u))

    return with_value(z, tail)


def battery(token: Column) -> Column:
    """How well a token passes for random in its inferred encoding: a struct (length, p), or null.

    p combines, by Fisher's method, a chi-squared test that the alphabet's characters are equally
    frequent (Wilson-Hilferty), a runs test about the alphabet's middle, and a test of the
    correlation of neighbours. It is uniform for random tokens and near 0 for others.
    """

    def stats(v: Column) -> Column:
        x, k, n = v["x"], v["k"], F.size(v["x"]).cast("double")
        add = lambda a, b: a + b
        zero = F.lit(0.0)
        counts = F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda c: F.size(F.filter(x, lambda y: y == c)).cast("double"))
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        high = F.size(F.filter(x, lambda y: y >= k / 2)).cast("double")
        sums = F.struct(
            F.aggregate(counts, zero, lambda a, c: a + c * c).alias("squares"),
            high.alias("n1"), (n - high).alias("n2"), n.alias("n"), k.alias("k"), pairs.alias("pairs"),
            (F.aggregate(x, zero, add) / n).alias("mean"),
        )

        def tests(s: Column) -> Column:
            n, k, n1, n2, m = s["n"], s["k"], s["n1"], s["n2"], s["mean"]
            spread = 2 / (9 * (k - 1))
            z1 = (F.pow(F.greatest(k / n * s["squares"] - n, zero) / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
            runs = 1 + F.size(F.filter(s["pairs"], lambda p: (p["a"] >= k / 2) != (p["b"] >= k / 2))).cast("double")
            var = 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
            z2 = with_value(var, lambda w: F.when(w > 0, F.abs((runs - 2 * n1 * n2 / n - 1) / F.sqrt(F.greatest(w, F.lit(1e-9))))).otherwise(40.0))
            square = F.aggregate(x, zero, lambda a, y: a + (y - m) * (y - m))
            joint = F.aggregate(s["pairs"], zero, lambda a, p: a + (p["a"] - m) * (p["b"] - m))
            z3 = with_value(square, lambda q: F.when(q > 0, F.abs((joint / F.greatest(q, F.lit(1e-9)) + 1 / n) * F.sqrt(n))).otherwise(40.0))
            log = lambda p: F.ln(F.greatest(p, F.lit(1e-12)))
            half = -(log(normal_tail(z1)) + log(2 * normal_tail(z2)) + log(2 * normal_tail(z3)))
            p = with_value(half, lambda h: F.least(F.lit(1.0), F.exp(-h) * (1 + h + h * h / 2)))
            return F.struct(n.cast("int").alias("length"), p.alias("p"))

        return with_value(sums, tests)

    def coded(body: Column) -> Column:
        alphabet = F.lit(None).cast("string")
        for _, shape, letters in reversed(ENCODINGS):
            alphabet = F.when(body.rlike(shape), F.lit(letters)).otherwise(alphabet)

        def values(alphabet: Column) -> Column:
            x = F.transform(F.split(body, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
            v = F.struct(x.alias("x"), F.char_length(alphabet).cast("double").alias("k"))
            return F.when(alphabet.isNotNull(), with_value(v, stats))

        return with_value(alphabet, values)

    bare = F.regexp_replace(token, "=+$", "")
    return with_value(F.when(bare.rlike(f"^{UUID}$"), F.replace(bare, F.lit("-"), F.lit(""))).otherwise(bare), coded)


def band(length: Column) -> Column:
    return F.floor(F.log2(length.cast("double"))).cast("int")


def candidates(text: Column) -> Column:
    """Structs (start, end, length, p, match, whole) of the tokens that have an encoding: whole runs and their parts."""

    def tested(m: Column) -> Column:
        fields = [m[c].alias(c) for c in ("match", "whole")]
        return with_value(battery(m["match"]), lambda b: F.struct(m["start"].alias("start"), m["end"].alias("end"), b["length"].alias("length"), b["p"].alias("p"), *fields))

    def pieces(m: Column) -> Column:
        parts = F.filter(located(m["match"], PART), lambda x: x["match"] != m["match"])
        placed = F.transform(parts, lambda x: F.struct((m["start"] + x["start"]).alias("start"), (m["start"] + x["end"]).alias("end"), x["match"].alias("match"), F.lit(False).alias("whole")))
        return F.concat(F.array(F.struct(m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), F.lit(True).alias("whole"))), placed)

    runs = F.flatten(F.transform(located(text, CANDIDATE), pieces))
    return F.filter(F.transform(runs, tested), lambda c: c["p"].isNotNull())


def cut_of(n: list[int], rate: float) -> float:
    """The least p of a random token, from the histogram n of different tokens' p in BINS bins.

    Random tokens have uniform p, so the upper half tells how many of them each bin holds; what
    lies beyond that below 0.5 are other tokens. The cut is the lowest bin edge above which these
    are at most ``rate`` of all, or not shown by ``SURE`` standard errors to be more. It is at least
    the first edge, which loses one random token in BINS. A cut raised to x loses a share x.
    """
    half = BINS // 2
    top = sum(n[half:])
    for k in range(1, half):
        low, x = sum(n[k:half]), k / BINS
        excess = low - (1 - 2 * x) * top
        if excess - SURE * (low + (1 - 2 * x) ** 2 * (top + 1)) ** 0.5 <= rate * (low + top):
            return x
    return half / BINS


def thresholds(docs: DataFrame, rate: float = 0.05) -> dict[int, float]:
    """For each band of lengths the least p that a random token must have, from all documents.

    Every different token counts once, so copies of a token or a document move no cut. Bands
    differ in the power of the tests, so each is controlled alone. The histogram has at most
    32 * BINS rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    c = docs.select(F.explode(candidates(text)).alias("c"))
    bins = F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int")
    different = c.groupBy("c.match").agg(F.first(band(F.col("c.length"))).alias("band"), F.first(bins).alias("bin"))
    out: dict[int, list[int]] = {}
    for r in different.groupBy("band", "bin").count().collect():
        out.setdefault(r["band"], [0] * BINS)[r["bin"]] = r["count"]
    return {b: cut_of(n, rate) for b, n in sorted(out.items())}


def with_spans(docs: DataFrame, cuts: dict[int, float]) -> DataFrame:
    """Each row as ``doc``, its text (never null), and all spans as structs (start, kind, end), sorted; kind is the place in KINDS.

    Tokens that the battery finds are added where they touch no span of the fixed patterns, and
    parts only where their whole run is not found. Base spans and tokens are brought into one order; what
    reaches into a token from before or begins within it is told by running results over that order.
    """
    text, far = F.col("text"), (1 << 31) - 1
    most, least = lambda a, b: F.greatest(a, b), lambda a, b: F.least(a, b)

    def cut_for(length: Column) -> Column:
        cut = F.lit(2.0)
        for b, x in cuts.items():
            cut = F.when(band(length) == b, x).otherwise(cut)
        return cut

    def item(x: Column, order: int, fit: Column, whole: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(order).alias("order"), (-x["end"]).alias("back"), x["end"].alias("end"), fit.alias("fit"), whole.alias("whole"))

    # Step by step, as columns nested any deeper take Spark long to resolve.
    assign = F.filter(located(text, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["match"], ASSIGN, 2)) >= ASSIGN_LEAST)
    df = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("base", F.array_sort(F.concat(spans_of(assign, 0), spans_of(located(text, ACCESS), 1), spans_of(located(text, HEX), 2))))
    df = df.withColumn("tokens", candidates(text))
    fixed = F.transform("base", lambda s: item(s, 0, F.lit(False), F.lit(False)))
    tokens = F.transform("tokens", lambda c: item(c, 1, c["p"] >= cut_for(c["length"]), c["whole"]))
    # Base spans first where they start alike, and of the tokens longer ones first.
    df = df.withColumn("items", F.array_sort(F.concat(fixed, tokens))).drop("tokens")
    df = df.withColumn("reach", running(F.transform("items", lambda x: F.when(x["order"] == 0, x["end"]).otherwise(0)), 0, most))
    ahead = running(F.transform(F.reverse("items"), lambda x: F.when(x["order"] == 0, x["start"]).otherwise(far)), far, least)
    around = F.zip_with("reach", F.reverse(ahead), lambda a, b: F.struct(a.alias("reach"), b.alias("ahead")))
    free = F.zip_with("items", around, lambda x, y: F.when((x["order"] == 1) & x["fit"] & (y["reach"] <= x["start"]) & (y["ahead"] >= x["end"]), x))
    df = df.withColumn("free", F.filter(free, lambda x: x.isNotNull())).drop("items", "reach")
    # Runs come before their parts, and don't overlap.
    within = running(F.transform("free", lambda x: F.when(x["whole"], x["end"]).otherwise(0)), 0, most)
    outer = F.filter(F.zip_with("free", within, lambda x, end: F.when(x["whole"] | (end < x["end"]), x)), lambda x: x.isNotNull())
    return df.select("doc", "text", F.array_sort(F.concat("base", spans_of(outer, 3))).alias("spans"))


def as_text(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted spans of all secrets in each whole text.

    Null and empty texts have no spans; a very long text is scanned whole, in time nearly linear in its
    matches; ids may be null or repeat; extra columns are ignored; an empty table gives an empty result.
    """
    return with_spans(docs.select("doc_id", "text"), thresholds(docs)).select("doc.doc_id", "spans")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The same documents with every span (overlapping ones as one) replaced by ``mask``.

    All columns stay; n_chars, if there is one, is counted anew where text was replaced. Texts
    without spans, null ones too, stay as they are.
    """
    df = with_spans(docs, thresholds(docs))
    text = F.col("text")
    # A span counts from where the ones before it end; what lies between is copied, a chunk of spans from one part of the text.
    df = df.withColumn("reach", running(F.transform("spans", lambda s: s["end"]), 0, lambda a, b: F.greatest(a, b)))
    before = F.concat(F.array(F.lit(0)), F.slice("reach", F.lit(1), F.greatest(F.size("spans") - 1, F.lit(0))))
    edges = F.zip_with("spans", before, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["end"].alias("end")))
    df = df.withColumn("edges", F.filter(edges, lambda s: s["start"] >= s["at"]))

    def chunk(c: Column) -> Column:
        low = F.element_at(c, 1)["at"]
        part = F.substr(text, low + 1, F.element_at(c, -1)["start"] - low)
        return with_value(part, lambda p: F.array_join(F.transform(c, lambda s: F.concat(F.substr(p, s["at"] - low + 1, s["start"] - s["at"]), F.lit(mask))), ""))

    masked = F.concat(F.array_join(F.transform(chunked(F.col("edges")), chunk), ""), F.substr(text, F.array_max("reach") + 1, F.char_length(text)))
    df = df.withColumn("masked", F.when(F.size("spans") == 0, F.col("doc.text")).otherwise(masked))
    columns = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("masked").isNull(), F.col("doc.n_chars").cast("long")).otherwise(F.char_length("masked").cast("long"))
    return df.select(*[v.alias(c) for c, v in columns.items()])


def op6_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), n(3).alias("n_random"),
    )
