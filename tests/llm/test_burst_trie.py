"""The conversation trie against a brute-force version."""
import hashlib
import random
import zlib

import pytest

from barlake.llm import burst_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        own_saved = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += own_saved
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talk(rng, convs, words, longest):
    rows = []
    for c in convs:
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(words)))
    return rows


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS ids", "1 AS lo", "2 AS hd", "3 AS head", "4 AS path")
    return [tuple(r) for r in burst_trie.conversation_trie(df, **options).collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("container", [1, 3, 8192])
def test_trie_matches_brute_force(spark, container):
    rng = random.Random(7)
    rows = talk(rng, range(0, 260, 3), ["a", "bé", "", None, "long " * 50], 7)
    rows += [(c, t, "user", f"same {t}") for c in range(500, 540) for t in range(30)]  # copies of one long conversation
    rows += [(c, 30, "user", str(c)) for c in range(520, 540)]
    rows += [(700, None, "user", "no turn"), (700, None, None, None), (700, 1, "user", "x"), (700, 1, "user", "x"), (None, 1, "user", "lost"),
             (799, 5, "user", "short"), (901, 0, "user", "no first of its family"), (12_345, 0, "ab", "c"), (12_346, 0, "a", "bc")]
    rng.shuffle(rows)
    assert order(found(spark, rows, container=container)) == order(brute(rows))


def test_trie_turnless_and_long_texts(spark):
    turnless = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(turnless, 0, "user", "falls to the absent first turns")]
    assert found(spark, rows) == brute(rows) and len(brute(rows)) == 1
    rows = [(c, 0, "user", "long " * 200_000) for c in (1, 2, 100, 200)] + [(100, 1, "user", "é" * 10)]
    assert order(found(spark, rows)) == order(brute(rows))


def test_trie_of_an_empty_table(spark):
    assert found(spark, []) == []
