"""Phrase collocations against a brute-force version, and the automaton alone."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from barlake.llm import phrase_automata
from barlake.llm.phrase_automata import Transducer, summed

SCHEMA = "doc_id long, text string, lang string"
LOWER = {k: k + 32 for k in range(65, 91)}


def brute(rows, top=2000):
    counts, total = {}, Counter()
    for _, text, lang in rows:
        c = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        n = sum(a for p, a in c.items() if len(p) == 1)
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= 10}
        kept = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in cands.items()):
                continue
            cuts = [(1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)  # noqa: E741
            kept.append((lang, " ".join(p), a, l, r, n, score))
        kept.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], k + 1, *x[1:]) for k, x in enumerate(kept[:top])]
    return sorted(out)


def fixture():
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(30)] + ["É", "é", "Ünder", "日本", "a-b", "\x1cx", "of", "OF"]
    say = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", "", ".", ", x", "\n", "\x0b", "\t\t", " ; ;"]) for _ in range(n))
    rows = [(k, say(rng.randint(0, 120)), rng.choice(["en", "en", "en", "fr", None, "und", ""])) for k in range(150)]
    rows += [(200 + k, "New  York\tCity is New york city! once upon a time", "en") for k in range(12)]
    rows += [(300, None, "en"), (301, "", None), (302, " \t\n", "fr"), (303, "ha " * 60_000, "fr"), (304, "x", None), (305, "!?.", "en"),
             (None, "once upon a time", "en")]
    return rows + rows[:5]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS l", "1 AS h", "2 AS f", "3 AS rank", "4 AS word", "5 AS rng")
    return sorted(tuple(r) for r in phrase_automata.collocations(df, **options).collect())


def test_phrases_match_brute_force(spark):
    rows = fixture()
    got = found(spark, rows)
    assert got == brute(rows) and {r[0] for r in got} >= {"en", "und", "fr"}


def test_small_runs_ranges_and_ties(spark, monkeypatch):
    for name, value in (("RUN_NGRAMS", 300), ("RANGE_NGRAMS", 100), ("WORDS_KEPT", 20), ("TABLE_BITS", 1 << 10), ("COPIES", 3)):
        monkeypatch.setattr(phrase_automata, name, value)  # many runs and ranges, heavy first words, a full bit table
    rows = fixture()
    assert found(spark, rows, top=40) == brute(rows, top=40)


def test_clashing_symbols_are_drawn_again(spark, monkeypatch):
    real = phrase_automata.symbol
    monkeypatch.setattr(phrase_automata, "symbol", lambda word, seed: real(word, seed) if seed else real(word, 0) % 8 + 1)
    rows = spark.createDataFrame([("en", f"word{k}") for k in range(40)], "lang string, text string")
    words, seed = phrase_automata.word_counts(rows)
    assert seed == 1 and words.select("h").distinct().count() == 40


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "too few", "en")] * 9])
def test_no_candidates(spark, rows):
    assert found(spark, rows) == []


def test_transducer_round_trip_and_walk():
    rng = np.random.default_rng(2)
    for labels, n, depth in ((3, 200, 4), (50, 5000, 3), (2 ** 63, 100, 2), (5, 1, 3)):
        paths, weights = summed(rng.integers(1, labels + 1, (n, depth), dtype=np.uint64), rng.integers(1, 3, n))
        machine = Transducer.load(Transducer.of(paths, weights).dump())
        p, w = machine.paths()
        assert (p == paths).all() and (w == weights).all()
        asked = np.concatenate([paths, rng.integers(1, labels + 3, (500, depth), dtype=np.uint64)])
        table = {tuple(x): y for x, y in zip(paths.tolist(), weights.tolist())}
        assert machine.weight(asked).tolist() == [table.get(tuple(x), 0) for x in asked.tolist()]


def test_transducer_shares_equal_states():
    paths = np.array([[a, b, c] for a in range(1, 9) for b in range(1, 5) for c in (1, 2)], np.uint64)
    machine = Transducer.of(paths, np.ones(len(paths), np.int64))
    assert [len(x) for x in machine.labels] == [8, 4, 2]


def test_bit_table_reaches_the_driver_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(phrase_automata, "TABLE_BITS", 1 << 20)
    monkeypatch.setattr(phrase_automata, "CHUNK_WORDS", 1 << 10)
    asked = []
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "toPandas", lambda self: pytest.fail("a row per word"))
    real = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: asked.append(real(self)) or asked[-1])
    rng = np.random.default_rng(8)
    word, bits = rng.integers(0, 1 << 14, 9000), rng.integers(-2 ** 63, 2 ** 63, 9000)
    want = np.zeros(1 << 14, np.uint64)
    np.bitwise_or.at(want, word, bits.view(np.uint64))
    rows = spark.createDataFrame(list(zip(word.tolist(), bits.tolist())), "word long, bits long")
    assert (phrase_automata._bits(rows) == want).all() and sum(map(len, asked)) <= 16
    assert not phrase_automata._bits(rows.limit(0)).any()
