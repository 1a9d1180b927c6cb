"""Secret scans: fixed patterns, and tokens that pass a battery of randomness tests. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved

# The three base patterns, and the least characters of their matches (of assign: of group 2).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

#: What is tested for randomness: runs of encoding characters of at least TOKEN of them.
TOKEN = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}" % TOKEN
# Inferred encodings by the narrowest alphabet that holds the token.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base32 lower", r"^[a-z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36 lower", r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36", r"^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base58", r"^[1-9A-HJ-NP-Za-km-z]+$", "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"),
    ("base62", r"^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Natural tokens as a chain of classes (upper, lower, digit, symbol; the last row is for the first character): chances of the next class, and below of the letters in a class.
CHAIN = ((0.66, 0.25, 0.04, 0.05), (0.04, 0.87, 0.03, 0.06), (0.08, 0.12, 0.6, 0.2), (0.2, 0.6, 0.1, 0.1), (0.25, 0.6, 0.05, 0.1))
#: Letters of English, a to z, in hundredths of a per cent; SPREAD of their chance is dealt evenly instead, for names and other languages.
LETTERS, SPREAD = (
    817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98,
    236, 15, 197, 7,
), 0.1
#: False-discovery rate, in each class of encodings and lengths by itself, among the tokens that the battery rejects as not uniform,
#: and among those that are called random.
RATE = 0.01
_BINS = 20  # a decade of the p-value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def prefix_sums(xs: Column, block: int = 256) -> Column:
    """For each element the sum of those before it; blocks keep long arrays from a square of work."""
    sums = lambda v: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")),
        lambda c: _sum(F.slice(v, c * block + 1, F.lit(block))),
    )
    before = lambda s: F.transform(s, lambda _, i: _sum(F.slice(s, F.lit(1), i)))
    whole = let(
        xs,
        lambda v: let(
            let(sums(v), before),
            lambda b: F.transform(
                v,
                lambda _, i: F.get(b, F.floor(i / block).cast("int")) + _sum(F.slice(v, F.floor(i / block).cast("int") * block + 1, i % block)),
            ),
        ),
    )
    return F.when(F.size(xs) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, value) of every leftmost non-overlapping match, in code points; value is the group asked for.

    A match starts after all pieces between matches and all matches before it.
    """
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x).cast("long"))
    gaps = lengths(F.split(text, pattern, -1))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    spans = let(F.struct(gaps.alias("g"), lengths(found).alias("m"), values.alias("v")), lambda s: let(
        F.struct(
            prefix_sums(F.zip_with(F.slice(s["g"], F.lit(1), F.size(s["m"])), s["m"], lambda g, m: g + m)).alias("p"),
            s["g"].alias("g"), s["m"].alias("m"), s["v"].alias("v"),
        ),
        lambda t: F.transform(
            t["p"],
            lambda p, i: F.struct(
                (p + F.get(t["g"], i)).alias("start"), (p + F.get(t["g"], i) + F.get(t["m"], i)).alias("end"),
                F.get(t["v"], i).alias("value"),
            ),
        ),
    ))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))


def upper_tail(z: Column) -> Column:
    """Chance that a standard normal number exceeds z (Abramowitz and Stegun 26.2.17)."""
    a = F.least(F.abs(z), F.lit(38.0))
    t = 1 / (1 + 0.2316419 * a)
    # Fixed values of that formula.
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def combined(*chances: Column) -> Column:
    """Fisher's combination of three chances, each taken as 10 ** -100 at least."""
    x = -sum((F.log(F.greatest(p, F.lit(1e-100))) for p in chances[1:]), F.log(F.greatest(chances[0], F.lit(1e-100))))
    return let(F.greatest(x, F.lit(0.0)), lambda x: F.exp(-x) * (1 + x + x * x / 2))


def battery(token: Column) -> Column:
    """(encoding, n, p_chi, p_runs, p_serial, p_all) of a token.

    The first three are chances, were the token uniform over its inferred alphabet of k:
    of so uneven letter counts (chi-squared, Wilson and Hilferty's normal form), of so odd
    a number of runs above and below the middle (Wald and Wolfowitz, two-sided) and of so
    strong a correlation of neighbours (two-sided). p_all is the three combined (Fisher:
    of minus the sum of their logarithms, x, the chance of more is exp(-x) (1 + x + x^2 / 2)).
    """
    clean = F.translate(token, "-_", "+/")
    which = F.coalesce(*[F.when(clean.rlike(p), F.lit(i)) for i, (_, p, _) in enumerate(ENCODINGS) if p], F.lit(len(ENCODINGS) - 1))
    pick = lambda i, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), i + 1)
    state = "struct<last:bigint,n:bigint,high:bigint,runs:bigint,s:bigint,ss:bigint,sx:bigint,first:bigint>"
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(-1).cast("long").alias("last"), *[zero.alias(c) for c in ("n", "high", "runs", "s", "ss", "sx", "first")])

    def read(t: Column) -> Column:
        values = F.transform(F.split(t["text"], ""), lambda c: (F.instr(t["alphabet"], c) - 1).cast("long"))

        def step(a: Column, v: Column) -> Column:
            high = lambda x: (x * 2 >= t["k"]).cast("long")
            changed = F.when((a["n"] == 0) | (high(v) != high(a["last"])), 1).otherwise(0)
            return F.struct(
                v.alias("last"), (a["n"] + 1).alias("n"), (a["high"] + high(v)).alias("high"),
                (a["runs"] + changed).alias("runs"), (a["s"] + v).alias("s"), (a["ss"] + v * v).alias("ss"),
                (a["sx"] + F.when(a["n"] > 0, a["last"] * v).otherwise(0)).alias("sx"),
                F.when(a["n"] == 0, v).otherwise(a["first"]).alias("first"),
            ).cast(state)

        squares = F.aggregate(
            F.array_sort(values), F.struct(F.lit(-1).cast("long").alias("last"), zero.alias("run"), zero.alias("sum")),
            lambda a, v: F.struct(
                v.alias("last"), F.when(v == a["last"], a["run"] + 1).otherwise(1).cast("long").alias("run"),
                (a["sum"] + F.when(v == a["last"], 2 * a["run"] + 1).otherwise(1)).cast("long").alias("sum"),
            ),
        )["sum"]
        return F.struct(
            F.aggregate(values, start.cast(state), step).alias("a"), squares.alias("c2"),
            t["k"].cast("double").alias("k"), t["which"].alias("which"),
        )

    def tests(r: Column) -> Column:
        a, k, c2 = r["a"], r["k"], r["c2"]
        n, df = a["n"].cast("double"), r["k"] - 1
        chi = k / n * c2 - n
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        mean = 2 * a["high"] * (n - a["high"]) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when(spread <= 0, 0.0).otherwise(2 * upper_tail(F.abs(a["runs"] - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9)))))
        mu = a["s"] / n
        varies = a["ss"] - n * mu * mu
        serial = a["sx"] - mu * (2 * a["s"] - a["first"] - a["last"]) + (n - 1) * mu * mu
        p_serial = F.when(varies <= 1e-9, 0.0).otherwise(2 * upper_tail(F.abs(serial / F.greatest(varies, F.lit(1e-9)) + 1 / n) * F.sqrt(n)))
        chances = F.struct(upper_tail(z_chi).alias("p_chi"), p_runs.alias("p_runs"), p_serial.alias("p_serial"))
        return let(
            chances,
            lambda p: F.struct(
                pick(r["which"], [e for e, _, _ in ENCODINGS]).alias("encoding"), a["n"].alias("n"),
                p["p_chi"].alias("p_chi"), p["p_runs"].alias("p_runs"), p["p_serial"].alias("p_serial"),
                combined(p["p_chi"], p["p_runs"], p["p_serial"]).alias("p_all"),
            ),
        )

    named = let(
        F.struct(clean.alias("text"), which.alias("which")),
        lambda t: F.struct(
            t["text"].alias("text"), t["which"].alias("which"),
            pick(t["which"], [x for _, _, x in ENCODINGS]).alias("alphabet"),
            pick(t["which"], [len(x) for _, _, x in ENCODINGS]).alias("k"),
        ),
    )
    return let(let(named, read), tests)


def _costs() -> list[float]:
    """Log chances of natural text: 64 characters (in base64's order) after each class, then 64 for a first character."""
    letter = [(1 - SPREAD) * x / sum(LETTERS) + SPREAD / 26 for x in LETTERS]
    within = [(c, p) for c, ps in enumerate((letter, letter, [0.1] * 10, [0.5] * 2)) for p in ps]
    return [math.log(row[c] * p) for row in CHAIN for c, p in within]


def p_natural(token: Column, t: Column) -> Column:
    """Bound on the chance that natural text looks so random: so much likelier under the uniform law of the token's encoding than under its own, and so well-behaved to the battery.

    A likelihood ratio Q / P has mean 1 under P, so P(Q / P >= x) <= 1 / x at every length
    (Markov). P is the chain of classes and letters above, so alternating cases and digits
    and rare letters count. The battery's combined chance u joins as a factor 2 u, whose
    mean is 1 where u is uniform and less where natural text makes it small.
    """
    values = F.transform(F.split(F.translate(token, "-_", "+/"), ""), lambda c: F.instr(F.lit(ENCODINGS[-1][2]), c) - 1)
    costs = F.array(*[F.lit(x) for x in _costs()])
    zero = F.struct(F.lit(4).alias("after"), F.lit(0.0).alias("log"))
    of = lambda v: F.when(v < 26, 0).when(v < 52, 1).when(v < 62, 2).otherwise(3)
    log = F.aggregate(
        values, zero,
        lambda a, v: F.struct(of(v).alias("after"), (a["log"] + F.get(costs, a["after"] * 64 + v)).alias("log")),
    )["log"]
    sizes = F.create_map(*[F.lit(x) for name, _, letters in ENCODINGS for x in (name, float(len(letters)))])
    ratio = log + t["n"] * F.log(F.element_at(sizes, t["encoding"])) - F.log(2 * F.greatest(t["p_all"], F.lit(1e-300)))
    return F.exp(F.least(ratio, F.lit(0.0)))


def _class(t: Column) -> Column:
    """Encoding and length class, in which the false-discovery rate is held."""
    return F.concat_ws(":", t["encoding"], F.floor(F.log2(t["n"])).cast("int").cast("string"))


def _bin(p: Column) -> Column:
    """The larger, the less likely; a bin's tokens all have a p-value of at most 10 ** (-bin / _BINS)."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * _BINS), F.lit(300 * _BINS)).cast("int")


def bars(tested: DataFrame, rate: float = RATE) -> dict[str, int]:
    """By encoding and length class the least bin that is a discovery: Benjamini and Hochberg's step-up over all of the class's tokens.

    One aggregate over (c, p) rows; what comes back has at most 31 classes an encoding times 6001 bins.
    """
    counted = tested.groupBy("c", _bin(F.col("p")).alias("b")).count().collect()
    out = {}
    for c in {r["c"] for r in counted}:
        own = sorted(((r["b"], r["count"]) for r in counted if r["c"] == c), reverse=True)
        total, seen = sum(n for _, n in own), 0
        for b, n in own:
            seen += n
            if 10 ** (-b / _BINS) * total <= rate * seen:
                out[c] = b
    return out


def _base_spans(found: Column, order: int, least: int) -> Column:
    long_enough = F.filter(found, lambda s: F.length(s["value"]) >= least)
    return F.transform(
        long_enough,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("kind"), s["end"].alias("end"),
            s["value"].alias("value"), F.lit("").alias("detail"),
        ),
    )


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, spans) of every row: spans is an array of (start, kind, end, value, detail), by start and then kind.

    The base kinds hold their patterns' matches. ``random`` spans are encoded-looking
    tokens outside base spans that the battery does not reject as uniform and that natural
    text of their length would match too rarely, after the false-discovery correction
    over all tokens of all documents. A null text counts as empty; repeated rows each have
    their spans; null doc_ids pass through; further columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    base = []
    for order, (pattern, group, gate, least) in enumerate((
        (ASSIGN, 2, None, 6), (ACCESS, 0, "AKIA[A-Z0-9]{16}", 20), (HEX, 0, "[0-9a-f]{24}", 24),
    )):
        # Runs are maximal, so leaving out short ones in the pattern gives the same matches as dropping them.
        exact = pattern if gate is None else f"AKIA[A-Z0-9]{{{least - 4},}}" if "AKIA" in pattern else f"[0-9a-f]{{{least},}}"
        base.append(_base_spans(located(text, exact, group), order, least))
    tokens = F.transform(
        located(text, CANDIDATE),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), battery(s["value"]).alias("t")),
    )
    tokens = F.transform(tokens, lambda s: s.withField("p", p_natural(s["value"], s["t"])))
    rows = saved(docs.select("doc_id", F.concat(*base).alias("base"), tokens.alias("tokens")))
    as_map = lambda limits: F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]).cast("map<string,int>") if limits else F.create_map().cast("map<string,int>")
    found = lambda p, c, limits: F.coalesce(_bin(p) >= F.element_at(as_map(limits), c), F.lit(False))
    each = rows.select(F.explode("tokens").alias("s")).select(_class(F.col("s.t")).alias("c"), F.col("s.t.p_all").alias("u"), "s.p")
    uneven = bars(each.select("c", F.col("u").alias("p")), rate)
    # What is not uniform takes part with chance 1: only what can be reported may be a discovery.
    limits = bars(each.select("c", F.when(found(F.col("u"), F.col("c"), uneven), 1.0).otherwise(F.col("p")).alias("p")), rate)
    inside = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    random = F.filter(
        "tokens",
        lambda s: ~found(s["t"]["p_all"], _class(s["t"]), uneven) & found(s["p"], _class(s["t"]), limits) & ~inside(s),
    )
    named = F.transform(
        random,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"),
            s["value"].alias("value"), s["t"]["encoding"].alias("detail"),
        ),
    )
    spans = F.array_sort(F.concat("base", named))
    return rows.select(
        "doc_id",
        F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1).alias("kind"),
                s["end"].alias("end"), s["value"].alias("value"), s["detail"].alias("detail"),
            ),
        ).alias("spans"),
    )


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts[:3], F.sha2(joined(of(*KINDS[:3])).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), counts[3],
    )
