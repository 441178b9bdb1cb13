"""Phrase polarity against a plain version; rule by rule, on a large mixed-case lexicon, and with odd input."""

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barlake.operators import phrase_packs, polarity as P
from barlake.operators import sentiment as S


def plain(title, lexicon):
    lex = {}
    for token, v in lexicon:
        key = " ".join(re.findall(r"[^\W\d_]+", token.lower()))
        lex[key] = max(v, lex.get(key, v))
    words = re.findall(r"[^\W\d_]+", title or "")
    low, caps = [w.lower() for w in words], [w.upper() == w and len(w) > 1 for w in words]
    best = {}
    for i in range(len(low)):
        for k in (1, 2, 3):
            if i + k <= len(low) and " ".join(low[i:i + k]) in lex:
                best[i] = k
    meets = lambda i, j: i < j + best[j] and j < i + best[i]
    kept = [i for i in best if not any(j != i and meets(i, j) and (best[j] > best[i] or best[j] == best[i] and j < i) for j in best)]
    turn = next((i for i, w in enumerate(low) if w in P.CONTRASTS), None)
    total = 0.0
    for i in kept:
        v = lex[" ".join(low[i:i + best[i]])]
        sign = lambda x: (x > 0) - (x < 0)
        score = v + (P.CAPS_INCR * sign(v) if not all(caps) and all(caps[i:i + best[i]]) else 0)
        for d in (1, 2, 3):
            before = low[i - d] if i >= d else ""
            if before not in lex:
                step = S.BOOST_INCR if before in S.BOOSTERS_UP else S.BOOST_DECR if before in S.BOOSTERS_DOWN else 0
                score += step * S.DISTANCE_DECAY[d - 1] * sign(score)
            if before in S.NEGATIONS:
                score *= S.NEGATION_SCALAR
        total += score * (1 if turn is None or i == turn else P.BEFORE_CONTRAST if i < turn else P.AFTER_CONTRAST)
    if not kept:
        return None
    marks, asks = (title or "").count("!"), (title or "").count("?")
    mark = min(marks, 4) * P.EXCLAMATION_INCR + (0 if asks <= 1 else asks * P.QUESTION_INCR if asks <= 3 else P.QUESTION_MANY)
    total += ((total > 0) - (total < 0)) * mark
    return total / (total * total + S.NORMALIZE_ALPHA) ** 0.5


def _scores(spark, titles, lexicon):
    df = spark.createDataFrame(list(enumerate(titles)), "n int, title string")
    lex = spark.createDataFrame(lexicon, "token string, valence double")
    return {r.n: r["compound"] for r in P.headline_polarity(df, lex, ["n"]).collect()}


LEX = [("Good", 1.9), ("bad", -2.5), ("bad", -2.0), ("broken heart", -2.9), ("heart", 1.2), ("kiss of death", -1.5), ("of death", -3.0), ("death", -2.9),
       ("kiss", 1.8), ("very", 0.4), ("flat", 0.0), ("to die for", 3.0)]


def test_polarity_equals_plain_rules(spark):
    rng = random.Random(8)
    vocabulary = ["good", "GOOD", "Bad", "broken", "heart", "Kiss", "of", "death", "very", "really", "slightly", "not", "but", "to", "die", "for", "x", "flat", "!", "?", "7"]
    titles = [None, "", "!!!", "good but bad", "A broken heart", "The kiss of death!", "not a really GOOD day?", "GOOD BAD", "good good good " * 2000]
    titles += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    got = _scores(spark, titles, LEX)
    for n, title in enumerate(titles):
        want = plain(title, LEX)
        assert (n in got) == (want is not None), title
        assert want is None or abs(got[n] - want) < 1e-9, (title, got[n], want)


def test_each_rule_changes_the_score(spark):
    titles = ["a good day", "a GOOD day", "a good day!!", "a good day???", "a good day but rain", "rain but a good day", "a broken heart", "a heart broken"]
    s = _scores(spark, titles, LEX)
    assert s[1] > s[0] and s[2] > s[0] and s[3] > s[0] and s[4] < s[0] < s[5] and s[6] < 0 < s[7]


def test_large_mixed_case_lexicon(spark):
    spell = lambda k: "".join(chr(97 + (k // 26 ** d) % 26) for d in range(4))
    lexicon = spark.range(100_000).select(
        F.expr("concat(char(65 + id % 26), char(97 + (id div 26) % 26), char(97 + (id div 676) % 26), char(97 + (id div 17576) % 26))").alias("token"),
        ((F.col("id") % 9) - 4).cast("double").alias("valence"))
    ids = [5, 77_777, 99_999, 31_415]
    df = spark.createDataFrame([(k, f"the {spell(k).upper()} and {spell(k + 1)}") for k in ids], "n int, title string")
    got = {r.n: r["compound"] for r in P.headline_polarity(df, lexicon, ["n"]).collect()}
    for k in ids:
        near = [(spell(j), float(j % 9 - 4)) for j in (k, k + 1) if j < 100_000]
        assert abs(got[k] - plain(f"the {spell(k).upper()} and {spell(k + 1)}", near)) < 1e-9


def test_tickers_lexicons_and_odd_input(spark):
    heads = spark.createDataFrame([("A", "good"), ("A", None), ("B", "nothing here"), ("B", "")], "ticker string, title string")
    lex = spark.createDataFrame(LEX, "token string, valence double")
    rows = {r.ticker: r for r in P.ticker_polarity(heads, lex).collect()}
    assert rows["B"].sentiment_score == 0 and rows["B"].n_scored == 0 and rows["A"].n_headlines == 2
    assert abs(rows["A"].sentiment_score - plain("good", LEX) / 2) < 1e-12
    assert P.headline_polarity(heads, lex.limit(0), ["ticker"]).count() == 0
    with pytest.raises(Exception, match="too long"):
        P.headline_polarity(heads, spark.createDataFrame([("four words are many", 1.0)], "token string, valence double"), ["ticker"]).count()
    texts = spark.createDataFrame([("Fine fine words", 1)] * 6 + [("poor words", 0)] * 6 + [(None, 1)], "text string, y int")
    learned = {r.token: r.valence for r in P.learned_lexicon(texts, "y").collect()}
    assert learned["fine words"] == 4 * 6 / 16 and learned["poor"] == -4 * 6 / 16 and "words" not in learned


def test_runs_outside_the_lexicon_stay_out_of_the_join(spark):
    lex = P.phrase_lexicon(spark.createDataFrame([(f"a{chr(97 + k % 26)}{chr(97 + k // 26)} listed", 1.0) for k in range(300)], "token string, valence double"))
    other = spark.range(5000).selectExpr("concat('x', id, ' other') AS token", "false AS listed")
    rows = lex.selectExpr("token", "true AS listed").union(other)
    let = {r.listed: r["n"] for r in rows.where(P._maybe_listed(F.col("token"), lex)).groupBy("listed").agg(F.count("*").alias("n")).collect()}
    assert let[True] == 300 and let.get(False, 0) < 50
    assert rows.where(P._maybe_listed(F.col("token"), lex.limit(0))).count() == 0


def _rows(batches, *by):
    """All rows of the batches as one, in the order of a shuffle that sorts by these columns."""
    table = pa.Table.from_batches(batches)
    return table.sort_by([(c, "ascending") for c in by]).combine_chunks().to_batches() if by else table.to_batches()


def _table(blobs, bits, *more):
    return phrase_packs.Table(bits, [(r["b"], r["data"]) for b in phrase_packs.table_slices(iter(_rows(blobs, "b")), bits, *more) for r in b.to_pylist()])


def _small_packs(monkeypatch):
    for name, value in (("PACK_WORDS", 300), ("SPAN_WORDS", 64), ("HELD", 400)):
        monkeypatch.setattr(phrase_packs, name, value)


def _lists(texts):
    return pa.array([re.findall(r"[^\W\d_]+", t or "") for t in texts], pa.list_(pa.string()))


def test_runs_of_packs_count_as_by_text(monkeypatch):
    _small_packs(monkeypatch)
    rng = random.Random(4)
    texts = ["", *[" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 40))) for _ in range(200)]]
    y = [rng.randint(0, 1) for _ in texts]
    batch = pa.RecordBatch.from_arrays([_lists(texts), pa.array(y, pa.int64())], names=["w", "y"])
    packs = list(phrase_packs.labelled_packs(batch.slice(k, 50) for k in range(0, 201, 50)))
    assert len(packs) > 3
    data = [b.select(["data"]) for b in packs]
    want = Counter()
    for t, label in zip(texts, y):
        w = t.split()
        for run in {" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)}:
            want[run, label] += 1
    for least in (1, 5, 60):
        often = list(phrase_packs.frequent(iter(_rows(list(phrase_packs.run_counts(iter(data), least)), "b")), least))
        assert sum(len(x) and x["n"] for b in often for x in b.to_pylist()) == sum(want[r, 0] + want[r, 1] >= least for r in {r for r, _ in want})
        table = _table(often, 20)
        tokens = [r for b in phrase_packs.token_counts(iter(_rows(list(phrase_packs.known_runs(iter(data), table)), "b"))) for r in b.to_pylist()]
        got = {r["token"]: (r["p"], r["n"]) for r in tokens if r["p"] + r["n"] >= least}
        assert len(got) == sum(r["p"] + r["n"] >= least for r in tokens)
        assert got == {r: (want[r, 1], want[r, 0]) for r in {r for r, _ in want} if want[r, 1] + want[r, 0] >= least}


def test_packs_score_as_plain_rules(monkeypatch):
    _small_packs(monkeypatch)
    monkeypatch.setattr(phrase_packs, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    rng = random.Random(5)
    words = ["good", "GOOD", "Bad", "broken", "heart", "Kiss", "of", "death", "very", "really", "not", "but", "x", "flat", "gone"]
    titles = ["", "good " * 500, *[" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(200)]]
    lex = dict(sorted((t.lower(), v) for t, v in LEX)) | {"bad": -2.0, "gone": None}
    blobs = list(phrase_packs.entries(iter([pa.RecordBatch.from_arrays([_lists(lex), pa.array(list(lex.values()), pa.float64())], names=["w", "v"])])))
    table = _table(blobs, 16, np.float64)
    raw = _lists(titles)
    caps = pa.array([[w.upper() == w and len(w) > 1 for w in t] for t in raw.to_pylist()], pa.list_(pa.bool_()))
    low = pa.array([[w.lower() for w in t] for t in raw.to_pylist()], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(titles))), pa.array([0.0] * len(titles)), low, caps], names=list("ntlc"))
    codes = {b"not": P._NEGATION, b"really": P._UP, b"but": P._TURN}
    packs = list(phrase_packs.packs((batch.slice(k, 40) for k in range(0, 202, 40)), table, codes))
    rows = [r for b in packs for r in b.to_pylist()]
    assert len({r["pack"] for r in rows}) > 3
    asked = [{"b": r["b"], "kind": 0, "pack": 0, "n": r["n"], "data": r["data"]} for b in blobs for r in b.to_pylist()]
    asked += [{"b": r["b"], "kind": 1, "pack": r["pack"], "n": r["n"], "data": r["data"]} for r in rows if r["b"] >= 0]
    asked = pa.RecordBatch.from_pylist(asked, schema=pa.schema([("b", pa.int32()), ("kind", pa.int32()), ("pack", pa.int64()), ("n", pa.int32()), ("data", pa.binary())]))
    found = list(phrase_packs.hits(iter(_rows([asked], "b", "kind"))))
    own = [b.filter(pa.compute.less(b.column(1), 0)) for b in packs]
    scored = [r for b in P._scored(iter(_rows([b for b in own if len(b)] + found, "pack", "b")), table, ["n", "compound"]) for r in b.to_pylist()]
    got = {r["n"]: r["compound"] for r in scored}
    assert len(got) == len(scored)
    only = [(t, v) for t, v in lex.items() if v is not None]
    for n, title in enumerate(titles):
        if "gone" in title.lower().split():
            with_null = plain(" ".join("x" if w == "gone" else w for w in title.split()), only)  # a null valence adds nothing
            assert n in got and (got[n] is None if with_null is None else abs(got[n] - with_null) < 1e-9), title
        else:
            want = plain(title, only)
            assert (n in got) == (want is not None) and (want is None or abs(got[n] - want) < 1e-9), title


def test_texts_and_runs_stay_small_on_their_way(spark, monkeypatch):
    rng = np.random.default_rng(6)
    hashes = np.unique(rng.integers(0, 1 << 64, 1 << 18, np.uint64))
    blobs = phrase_packs.blob_rows(hashes)
    assert sum(len(d.as_py()) for d in blobs.column(2)) < 6.5 * len(hashes)
    short = np.unique(hashes & ~np.uint64((1 << phrase_packs.LOW_BITS) - 1))
    blobs = phrase_packs.blob_rows(short, np.ones(len(short), np.uint32))
    assert sum(len(d.as_py()) for d in blobs.column(2)) < 4 * len(short)
    written, real = {}, P.staged
    monkeypatch.setattr(P, "staged", lambda df, name: written.setdefault(name, real(df, name)))
    vocabulary = ["".join(chr(97 + d) for d in rng.integers(0, 26, 6)) for _ in range(300)]
    titles = [" ".join(rng.choice(vocabulary, 400)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(titles)), "n int, title string").coalesce(2)
    lex = spark.createDataFrame([(w, 1.0) for w in vocabulary], "token string, valence double")
    assert P.headline_polarity(df, lex, ["n"]).count() == 100
    packs = written["polarity-packs"]  # 40,000 hits, of which no row each is shuffled
    assert packs.count() < 2 * (300 + 1) + 2 and packs.agg(F.sum(F.length("data"))).first()[0] < sum(map(len, titles)) / 2
