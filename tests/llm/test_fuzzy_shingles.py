"""op6 against the definition: a shingle of five characters at every character."""

import random

from tidemark.llm import fuzzy_lines


def grams(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def linked(spark, pairs):
    """For each pair of lines, whether the operator puts both in one group."""
    frame = spark.createDataFrame([(i, f"{a}\n{b}") for i, (a, b) in enumerate(pairs)], "doc_id long, text string")
    groups = {}
    for r in fuzzy_lines.line_groups(frame).collect():
        groups.setdefault(r["doc_id"], set()).add((r["group_doc_id"], r["group_line_no"]))
    return [len(groups[i]) == 1 for i in range(len(pairs))]


def test_one_typo_at_every_length(spark):
    rng = random.Random(6)
    pairs = []
    for alphabet, spaces in (("abcdefghijklmnopqrstuvwxyz", True), ("".join(map(chr, range(0x4E00, 0x5200))), False), ("abc😀é", False)):
        for i in range(60):
            line = list("".join(rng.choices(alphabet, k=rng.randrange(3, 200))))
            if spaces:
                line[5::7] = " " * len(line[5::7])
            typo = rng.randrange(len(line))
            pairs.append(("".join(line).strip(), "".join(line[:typo] + ["#"] + line[typo + 1 :]).strip()))
    want = [len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)) for a, b in pairs]
    got = linked(spark, pairs)
    assert 60 < sum(want) < len(want)
    assert not any(g and not w for g, w in zip(got, want))
    assert sum(w and not g for g, w in zip(got, want)) <= 3


def test_recall_of_short_lines_at_the_least_similarity(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    cut = [(w, w[:8]) for w in (word(9) for _ in range(1000))]
    edited = [(w, w[:12] + "#") for w in (word(13) for _ in range(1000))]
    for pairs in (cut, edited):
        assert all(len(grams(a) & grams(b)) == 0.8 * len(grams(a) | grams(b)) for a, b in pairs)
        assert sum(linked(spark, pairs)) >= 990
