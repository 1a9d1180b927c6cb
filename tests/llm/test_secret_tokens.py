"""op3's random tokens: rare short keys among natural tokens, and further alphabets."""

import random
import string

from tidemark.llm import secrets

WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name president team minute idea kid body information back parent face others level office door health person art war history party result change morning reason research girl guy moment air teacher force education".split()


def natural(rng):
    style = rng.randrange(5)
    own = rng.choices(WORDS, k=rng.randrange(4, 7))
    if style == 0:
        token = "".join(own)
    elif style == 1:
        token = rng.choice("-_/").join(own)
    elif style == 2:
        token = own[0] + "".join(w.title() for w in own[1:])
    elif style == 3:
        token = "_".join(own).upper()
    else:
        token = "/".join(own) + str(rng.randrange(1990, 2030))
    return token if len(token) >= 20 else natural(rng)


def found(spark, keys, rng, others=4000):
    tokens = keys + [natural(rng) for _ in range(others)]
    docs = spark.createDataFrame([(i, "see " + t + " there") for i, t in enumerate(tokens)], "doc_id long, text string")
    # Base spans cover their tokens, so these count as found as well.
    return {s["value"] for r in secrets.scan(docs).collect() for s in r["spans"]}


def test_rare_short_keys_among_natural_tokens(spark):
    rng = random.Random(3)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    keys = ["".join(rng.choices(a, k=n)) for a in alphabets for n in (20, 22, 24, 28, 31) for _ in range(4)]
    got = found(spark, keys, rng)
    assert sum(k in got for k in keys) >= 0.9 * len(keys)
    assert len(got - set(keys)) <= 0.05 * len(got)


def test_long_keys_of_further_alphabets(spark):
    rng = random.Random(8)
    lower, digits = string.ascii_lowercase, string.digits
    base58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
    alphabets = (lower + "234567", lower + digits, lower.upper() + digits, base58, string.ascii_letters + digits, digits)
    keys = {i: ["".join(rng.choices(a, k=n)) for n in (20, 24, 32, 48, 56, 64, 80, 100) for _ in range(4)] for i, a in enumerate(alphabets)}
    got = found(spark, [k for own in keys.values() for k in own], rng, 1000)
    missed = {i: sum(k not in got for k in own) for i, own in keys.items()}
    assert max(missed.values()) <= 3, missed
