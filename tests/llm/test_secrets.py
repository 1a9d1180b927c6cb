import hashlib
import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def slow_base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def slow_battery(token):
    clean = token.replace("-", "+").replace("_", "/")
    name, _, alphabet = next(e for e in secrets.ENCODINGS if re.match(e[1] or "", clean))
    v, n, k = [alphabet.index(c) for c in clean], len(clean), len(alphabet)
    c2 = sum(clean.count(c) ** 2 for c in set(clean))
    df = k - 1
    chi = ((max(0, k / n * c2 - n) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = [2 * x >= k for x in v]
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * sum(high) * (n - sum(high)) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    mu = sum(v) / n
    var = sum((x - mu) ** 2 for x in v)
    serial = sum((a - mu) * (b - mu) for a, b in zip(v, v[1:]))
    three = tail(chi), 2 * tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 0, 2 * tail(abs(serial / var + 1 / n) * math.sqrt(n)) if var > 1e-9 else 0
    x = max(0, -sum(math.log(max(p, 1e-100)) for p in three))
    return name, n, *three, math.exp(-x) * (1 + x + x * x / 2)


def slow_chance(token, name, n, u):
    """Natural text's likelihood against the uniform one's, times 2 u, as a bound on a chance."""
    letters = [(1 - secrets.SPREAD) * x / sum(secrets.LETTERS) + secrets.SPREAD / 26 for x in secrets.LETTERS]
    after, log = 4, 0.0
    for c in token.replace("-", "+").replace("_", "/"):
        of = 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3
        log += math.log(secrets.CHAIN[after][of] * (letters[ord(c.lower()) - 97] if of < 2 else 0.1 if of == 2 else 0.5))
        after = of
    size = next(len(e[2]) for e in secrets.ENCODINGS if e[0] == name)
    return math.exp(min(0, log + n * math.log(size) - math.log(2 * max(u, 1e-300))))


def steps_up(chances, rate):
    """The greatest chance that Benjamini and Hochberg's procedure lets pass, of a list; chances rounded up to a twentieth of a decade."""
    rounded = sorted(10 ** (-min(math.floor(-math.log10(max(p, 1e-300)) * 20), 6000) / 20) for p in chances)
    passing = [p for k, p in enumerate(rounded) if p * len(rounded) <= rate * sum(q <= p * 1.0000001 for q in rounded)]
    return (max(passing) if passing else -1) * 1.0000001


def slow_random(docs, rate=0.01):
    """{(place of the text, start, end)} of the random spans of texts."""
    tokens = [(i, m.start(), m.end(), m[0], *slow_battery(m[0])[:2], slow_battery(m[0])[-1]) for i, t in enumerate(docs) for m in re.finditer("[A-Za-z0-9+/_-]{20,}", t)]
    groups = {}
    for t in tokens:
        groups.setdefault((t[4], int(math.log2(t[5]))), []).append(t)
    out = set()
    for own in groups.values():
        even = steps_up([t[6] for t in own], rate)
        chances = [1.0 if t[6] <= even else slow_chance(t[3], *t[4:]) for t in own]
        least = steps_up(chances, rate)
        out |= {t[:3] for t, p in zip(own, chances) if p <= least and t[6] > even}
    return {s for s in out if not any(a <= s[1] and s[2] <= b for a, _, b in slow_base(docs[s[0]]))}


def test_random_spans_against_plain_arithmetic(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("etaoinshrdlucm", k=rng.randrange(2, 9))) for _ in range(300)]
    docs = []
    for i in range(400):
        own = rng.choices(words, k=20) + [rng.choice(["", "_", "-"]).join(rng.choices(words, k=5))]
        if i % 3 == 0:
            alphabet = rng.choice([string.ascii_letters + string.digits, string.ascii_uppercase + "234567", "0123456789abcdef", string.ascii_letters + string.digits + "+/"])
            own.insert(rng.randrange(20), rng.choice(["", "token="]) + "".join(rng.choices(alphabet, k=rng.randrange(16, 60))))
        docs.append("é " + " ".join(own))
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r["doc_id"], s["start"], s["end"]) for r in secrets.scan(frame).collect() for s in r["spans"] if s["kind"] == "random"}
    assert got == slow_random(docs) and len(got) > 40


def random_tokens(n=60, seed=5):
    rng = random.Random(seed)
    out = ["a" * 30, "-" * 40, "abababababababababababab", "0123456789abcdef01234567", "thequickbrownfoxjumpsoverthelazydogagain"]
    for _ in range(n):
        alphabet = rng.choice(["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", string.ascii_letters + string.digits + "-_", string.ascii_letters + string.digits + "+/", "etaoinshr"])
        out.append("".join(rng.choices(alphabet, k=rng.randrange(20, 90))))
    return out


def test_battery_against_plain_arithmetic(spark):
    tokens = random_tokens()
    got = {r["t"]: r["b"] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.battery(F.col("t")).alias("b")).collect()}
    for t in tokens:
        want = slow_battery(t)
        assert tuple(got[t])[:2] == want[:2]
        assert tuple(got[t])[2:5] == pytest.approx(want[2:5], abs=2e-7) and got[t]["p_all"] == pytest.approx(want[5], abs=1e-5)


def test_query_base_spans(spark):
    small = "/root/testdata/sf0.01"
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op3_secrets(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and sum(r["n_assign"] for r in rows)
    for r in rows:
        want = slow_base(docs[r["doc_id"]])
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(w[1] == k for w in want) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(r["spans"].split(","))


def test_random_tokens_are_found_and_words_left(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(400)]
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=40)) for _ in range(60)]
    rows = []
    for i in range(300):
        own = rng.choices(words, k=30) + ["".join(rng.choices(words, k=6))]
        rows.append((i, "é " + " ".join(own + ([keys[i]] if i < 60 else []))))
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(any(s["value"] == keys[i] and s["kind"] == "random" for s in found[i]) for i in range(60)) >= 57
    wrong = [s for i, spans in found.items() for s in spans if s["value"] not in keys]
    assert len(wrong) <= 3
    for i in range(60):
        assert all(rows[i][1][s["start"] : s["end"]] == s["value"] for s in found[i])


def test_odd_rows(spark):
    texts = [None, "", "token: token: abcdefgh secret=secret=abcdefgh", "PassWord='x.y=z/_-+'", "naïve 😀 api_key = \"abcdef\" AKIA" + "A" * 16, "AKIA" + "B" * 15, "f" * 100_000 + "g", ("token=abcdef " * 3000), "ſecret=abcdefgh toKen=abcdefgh", "token=abc token=abcdef1"]
    docs = spark.createDataFrame([(i % 7, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = sorted(((r["doc_id"], [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["kind"] != "random"]) for r in secrets.scan(docs).collect()), key=str)
    assert got == sorted(((i % 7, slow_base(t)) for i, t in enumerate(texts)), key=str)
    assert secrets.digest(secrets.scan(docs.limit(0))).collect() == []
