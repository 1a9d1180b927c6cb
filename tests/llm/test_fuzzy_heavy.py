"""op6 on one large group of lines that are near one another and mostly not linked."""

import random

import numpy as np
import pyarrow as pa

from tidemark.llm import fuzzy_lines


def grams(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def alike(a, b):
    return len(a & b) / len(a | b)


def crowd(rng, lines=300, length=500, edits=9):
    """Copies of one line, most with several edits of their own, some edited once more."""
    letters = "abcdefghijklmnopqrstuvwxyz     "
    base, out = rng.choices(letters, k=length), []
    for i in range(lines):
        own = list(base) if i % 20 else list(out[-1] if out else base)
        for _ in range(edits if i % 20 else 1):
            own[rng.randrange(len(own))] = rng.choice(letters)
        out.append("".join(own))
    return sorted({x.strip() for x in out})


def test_few_pairs_beyond_the_links_are_compared(spark, monkeypatch):
    lines = crowd(random.Random(11))
    sets = [grams(x) for x in lines]
    pairs = [(i, j, alike(sets[i], sets[j])) for i in range(len(sets)) for j in range(i)]
    links = [(i, j) for i, j, s in pairs if s >= 0.8]
    assert 300 < len(links) < 0.01 * len(pairs) and np.median([s for *_, s in pairs]) > 0.72
    asked, checked = [], fuzzy_lines._checked

    def counting(some, texts, least):
        asked.append(some.count())
        return checked(some, texts, least)

    monkeypatch.setattr(fuzzy_lines, "_checked", counting)
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    group = {r["doc_id"]: r["group_doc_id"] for r in fuzzy_lines.line_groups(frame).collect()}
    assert sum(group[i] == group[j] for i, j in links) >= 0.997 * len(links)
    assert sum(asked) <= 0.2 * len(pairs)  # all but 1 in 80 without prints


def test_prints_deny_no_link(spark):
    rng = random.Random(12)
    lines = ["", "abc", "a" * 400, "ab" * 300, "日本語のテキストです" * 9, "é" * 40]
    lines += crowd(rng, 30, 60, 1) + crowd(rng, 30, 900, 8) + crowd(rng, 20, 8000, 60)
    sets = [grams(x) if x else set() for x in lines]
    bits, size = fuzzy_lines.prints(pa.array(lines))
    assert size.tolist() == [len(x) for x in sets]
    differing = lambda i, j: int(np.bitwise_count(bits[i] ^ bits[j]).sum())
    assert all(differing(i, j) <= len(sets[i] ^ sets[j]) for i in range(len(sets)) for j in range(i))
    rows = fuzzy_lines.with_prints(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    near = rows.alias("x").join(rows.alias("y"), fuzzy_lines._may_link("x", "y", 0.8))
    allowed = {(r[0], r[1]) for r in near.select("x.id", "y.id").collect()}
    links = {(i, j) for i in range(1, len(sets)) for j in range(1, len(sets)) if alike(sets[i], sets[j]) >= 0.8}
    assert links <= allowed and len(links) > 200


def test_lines_of_each_blank_are_left_out(spark):
    text = "\n".join([" ", "\t", "\x0b", "\f", "\r", " \t\x0b\f\r ", "", "\t x \r", " "])
    rows = fuzzy_lines.lines_of(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r["line_no"], r["line"]) for r in rows] == [(7, "\t x \r"), (8, " ")]
