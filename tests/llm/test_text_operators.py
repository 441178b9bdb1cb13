"""Token counts, token files, toxicity, personal data, tiling and the prefix join, against plain versions."""
import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.llm import bitplane, catalog, group_prefix_join, pii_bootstrap, shared, shingles, tiling, token_counts, toxicity_ftrl

from test_small_operators import LONG, documents

ODD = [None, "", " ", "a", " a", "a ", "\n", "a\n\nb", "a  b", "x <|endoftext|> y <s></s><unk>", "don't, stop. it's...", "é,ñ. ß\x00z", "\t a", "日本語, テスト",
       "a b  c", "▁a ▁ b▁", "A1.2,b", "..", "a ,b", ".\n,", "İstanbul naïve ﬁ", LONG, "word " * 3000, "😀😀 ok", "a​b\r\nc"]


def odd_rows():
    return [(k, t, "s") for k, t in enumerate(ODD)] + [(3, "a", "s"), (3, "other text, same id.", "s"), (None, "no id here", "s")]


def test_token_counts_equal_the_library(spark):
    import sentencepiece
    path = catalog.tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = odd_rows()
    got = token_counts.count_tokens(documents(spark, rows), path, limit=3000).collect()
    expected = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 3000) for i, t, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert token_counts.count_tokens(documents(spark, []), path).count() == 0


@pytest.mark.parametrize("plane_bits", [8, 1])
def test_token_files_round_trip(spark, tmp_path, plane_bits):
    from tokenizers import Tokenizer
    path = catalog.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = odd_rows()
    out = str(tmp_path / "ids")
    bitplane.write_token_files(documents(spark, rows), out, path, block_ids=512, segment_ids=1500, plane_bits=plane_bits)
    texts = sorted(((-1 if i is None else i, t or "") for i, t, _ in rows), key=lambda r: r[0])
    ids = [(i, [*library.encode(t, add_special_tokens=False).ids, 0]) for i, t in texts]
    back = [(-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in bitplane.read_ids(spark, out).collect()]
    assert sorted(back) == sorted(ids)
    docs = sorted(bitplane.read_documents(spark, out).collect(), key=lambda r: r.start)
    assert [-1 if r.doc_id is None else r.doc_id for r in docs] == [i for i, _ in ids]
    at, left = 0, {}
    for i, x in ids:
        left.setdefault(i, []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    for r in docs:
        assert r.start == at
        left[-1 if r.doc_id is None else r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert bitplane.token_files(documents(spark, []), path).count() == 0


def test_words_are_learned_together(monkeypatch):
    from barlake.llm.shared import Generations
    path, one_by_one = catalog.tokenizer("byte_bpe_50k.json"), []
    real = Generations.put
    monkeypatch.setattr(Generations, "put", lambda self, key, value: one_by_one.append(key) or real(self, key, value))
    texts = [" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{x}" for k in range(500)) for x in ("é", "q", "q,", "z\nA")]
    encode = bitplane.Encoder(path)
    assert list(encode(texts)) == [encode._whole(t) for t in texts] and len(one_by_one) < 10
    cache = Generations(len, 10)
    for k in range(5):
        cache.put_all([f"{k}-{j}" for j in range(4)], [k] * 4)
        assert len(cache) <= 10 and len(cache.old) <= 10


def test_marks_are_no_part_of_a_learned_word():
    path = catalog.tokenizer("byte_bpe_50k.json")
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}é" for k in range(500)]
    texts = [" ".join(w + marks for w in words) for marks in ("", ",", ".", "!?", "\"")]
    encode = bitplane.Encoder(path)
    assert list(encode(texts)) == [encode._whole(t) for t in texts] and len(encode.pieces) < 520
    rng = random.Random(8)
    parts = ["it's", "don't", "a", "B", "é", "ñ", "e\u0301", "日本", "7", "42", "x9", "9x", "'", "'s", ",", "...", "!", "-", "$", "©", "«", "_", "😀", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 40))).strip() for _ in range(3000)]
    for limit in (40, bitplane.CACHE_ENTRIES):
        encode.pieces.limit = limit
        assert list(encode(texts)) == [encode._whole(t) if t else b"" for t in texts]


def test_planes():
    ids = np.random.default_rng(0).integers(0, 2**32, 1001, dtype=np.uint64).astype("<u4")
    for bits in (8, 1):
        assert (bitplane.from_planes(bitplane.to_planes(ids, bits), len(ids), bits) == ids).all()


def toxic_fixture():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    rows, labels = [], []
    for k in range(900):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = k % 6 == 0
        for _ in range(toxic * rng.randint(1, 3)):
            words.insert(rng.randint(0, len(words)), rng.choice(["vile", "scumbag", "nasty"]))
        rows.append((k, " ".join(words), "s"))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_learns_and_keeps_out_held_out_labels(spark):
    rows, labels = toxic_fixture()
    more = [(2000, None, None), (2001, "", "s"), (2002, LONG, "s"), (None, "vile", "s"), (5, rows[5][1], "s")]
    docs = documents(spark, rows + more)
    schema = "doc_id long, quality int, toxic int"
    extra = [(None, 1, 1), (7, None, None), (0, 1, 1)]
    got = toxicity_ftrl.score(docs, spark.createDataFrame(labels + extra, schema)).collect()
    assert len(got) == len(rows) + len(more) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.predicted, labels[r.doc_id][2]) for r in got if r.held_out and r.doc_id < 900]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert sum(p and t for p, t in held) / sum(t for _, t in held) > 0.9
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    again = toxicity_ftrl.score(docs, spark.createDataFrame(turned + extra, schema)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_toxicity_without_labels(spark):
    rows, _ = toxic_fixture()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity_ftrl.score(documents(spark, rows[:5]), none).collect()
    assert [r.score for r in got] == [0.5] * 5
    assert toxicity_ftrl.score(documents(spark, []), none).count() == 0


def plain_pii(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_pii_base_rules_on_random_strings():
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "B", "@", ".", "1", "25", "0", "+", "-", " ", "(", ")", "%", "é", "\n", "4111111111111111", "x.y", "2.3"]) for _ in range(rng.randint(0, 40)))
        assert pii_bootstrap.base_spans(t) == plain_pii(t), t
    pii_bootstrap.base_spans("1" * 300_000 + "a" * 300_000 + "@" * 1000 + "1." * 50_000 + "+1 " * 1000)


def test_pii_discovers_by_context_only(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join("".join(rng.choice("klmnop") for _ in range(4)) for _ in range(n))
    rows = [(k, f"{filler(8)} please call +1 (555) {100 + k}-{2000 + k} {filler(5)}", "s") for k in range(12)]
    rows += [(50 + k, f"{filler(6)} please call 0{k}71/998{k}7 {filler(6)}", "s") for k in range(3)]
    rows += [(80 + k, f"{filler(6)} model {k}77{k}1 {filler(6)}", "s") for k in range(6)]
    rows += [(90, None, None), (91, "", "s"), (92, LONG, "s"), (93, "x" * 50_000 + "@", "s"), (50, rows[12][1], "s"), (None, rows[13][1], "s")]
    got = pii_bootstrap.personal_data(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, t or "")
    for r in got:
        base = ",".join(f"{pii_bootstrap.KINDS[k]}:{a}:{b}" for a, k, b in plain_pii(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        new = r.doc_id is None or 50 <= r.doc_id < 53
        assert r.n_discovered == int(new) and (new or r.spans == base)
        if new:
            kind, a, b = r.spans.split(":")
            assert kind == "phone" and re.fullmatch(r"0\d71/998\d7", texts[r.doc_id][int(a):int(b)])
    assert pii_bootstrap.personal_data(documents(spark, [])).count() == 0


def plain_discovery(texts):
    """The graph over words instead of hashes, and without tables: spans that the method adds to each text."""
    found = []
    for i, t in enumerate(texts):
        w = [(m.start(), m.end()) for m in re.finditer(r"[^ \t-\r]+", t)]
        low = [t[a:b].translate({c: c + 32 for c in range(65, 91)}) for a, b in w]
        for m in pii_bootstrap.mentions(t):
            first = max(k for k, x in enumerate(w) if x[0] <= m["start"])
            last = max(k for k, x in enumerate(w) if x[0] < m["end"])
            p = [("two", *low[first - 2:first])] if first > 1 else []
            if first == last and 0 < first < len(w) - 1:
                p.append(("around", low[first - 1], low[first + 1]))
            found.append((i, m["start"], m["end"], m["kind"], t[m["start"]:m["end"]].lower(), p))
    edges, total = {}, {}
    for *_, inst, p in found:
        for x in p:
            edges.setdefault(x, {}).setdefault(inst, 0)
            edges[x][inst] += 1
    edges = {x: e for x, e in edges.items() if len(e) >= 3}
    for t in texts:
        low = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^ \t-\r]+", t)]
        for x in [("two", *low[k - 2:k]) for k in range(2, len(low))] + [("around", low[k - 1], low[k + 1]) for k in range(1, len(low) - 1)]:
            total[x] = total.get(x, 0) + 1
    seeds = {}
    for _, _, _, kind, inst, _ in found:
        if kind is not None:
            seeds[inst] = (1.0, min(kind, seeds.get(inst, (1, kind))[1]))
    known = dict(seeds)
    for _ in range(3):
        scored = {}
        for x, e in edges.items():
            good = {}
            for inst, n in e.items():
                if inst in known:
                    good[known[inst][1]] = good.get(known[inst][1], 0) + known[inst][0] * n
            if sum(good.values()) > 0:
                kind = max(good, key=lambda k: (good[k], -k))
                scored[x] = (min(sum(good.values()) / (total[x] + 1), 0.999), kind, sum(known.get(y, (0, 0))[0] >= 0.5 for y in e))
        known = dict(seeds)
        for inst in {y for e in edges.values() for y in e} - set(seeds):
            mine = [(e[inst], scored.get(x)) for x, e in edges.items() if inst in e]
            if any(s and s[2] >= 3 for _, s in mine):
                best = max((s[0], -s[1]) for _, s in mine if s)
                known[inst] = (sum(n * s[0] for n, s in mine if s) / sum(n for n, _ in mine), -best[1])
    out = [[] for _ in texts]
    for i, a, b, kind, _, p in found:
        high = [scored[x] for x in p if x in scored and scored[x][0] >= 0.6 and scored[x][2] >= 3]
        if kind is None and high:
            out[i].append((a, -max((s, -k) for s, k, _ in high)[1], b))
    return out


def test_pii_runs_of_any_shape_are_found_by_context(spark):
    rng = random.Random(9)
    filler = lambda n: " ".join("".join(rng.choice("klmnop") for _ in range(3)) for _ in range(n))
    new = ["(017) 555-7713", "123", "9807 9157 6280 4490", "0 1 2 3", "A7", "me@home"]
    texts = [f"{filler(8)} please call +1 (555) {100 + k}-{2000 + k} {filler(5)}" for k in range(16)]
    texts += [f"{filler(6)} please call {x}, {filler(6)}" for x in new]
    # a context that new instances alone carry, numbers that stand everywhere, and a long row of numbers
    texts += [f"{filler(6)} dial now {x} {filler(6)}" for x in new[:4]] + [f"{filler(4)} chapter no {k % 3} {filler(4)}" for k in range(30)]
    texts += [f"{filler(3)} " + " ".join(str(k) for k in range(200)) + f" {filler(3)}", "@", "1", "@@ 5 (", "+ 7) +8"]
    got = {r.doc_id: r for r in pii_bootstrap.personal_data(documents(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    more = plain_discovery(texts)
    for k, t in enumerate(texts):
        spans = sorted([(a, kind, b) for a, kind, b in plain_pii(t)] + more[k])
        assert got[k].n_discovered == len(more[k])
        assert got[k].spans == ",".join(f"{pii_bootstrap.KINDS[kind]}:{a}:{b}" for a, kind, b in spans), t
    for k, x in enumerate(new):
        assert [texts[16 + k][a:b] for a, _, b in more[16 + k]] == [x]
    assert not any(more[26:])


def plain_tiles(item, doc, least):
    """Greedy string tiling as defined: all maximal matches of the greatest length, marked in order."""
    free_i, free_d, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        best, found = least, []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and free_i[i + k] and free_d[j + k]:
                    k += 1
                if k >= best:
                    best, found = k, [*(found if k == best else []), (i, j)]
        if not found:
            return covered
        for i, j in found:
            if all(free_i[i:i + best]) and all(free_d[j:j + best]):
                free_i[i:i + best], free_d[j:j + best] = [False] * best, [False] * best
                covered += best


def test_tiles_equal_plain_tiling():
    rng = random.Random(6)
    for _ in range(400):
        item, doc = [rng.randint(0, 4) for _ in range(rng.randint(0, 30))], [rng.randint(0, 4) for _ in range(rng.randint(0, 40))]
        for a in range(0, len(item) - 8, 9):
            at = rng.randint(0, len(doc))
            doc[at:at] = item[a:a + 9]
        got = sum(t[2] for t in tiling.tiles(np.array(item, np.int64), [np.array(doc, np.int64)], 3))
        assert got == plain_tiles(item, doc, 3), (item, doc)


def test_contamination_matches_plain_tiling(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("rstuvw") for _ in range(5)) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.randint(3, 40))) for k in range(12)] + [(12, None), (13, ""), (14, "a b"), (15, LONG[:3000]), (0, "second text of item zero " + say(20))]
    rows = []
    for k in range(60):
        parts = rng.choice(items[:12])[1].split()
        cut = len(parts) // 2
        body = {0: " ".join(parts[cut:] + parts[:cut]), 1: " ".join(parts).upper() + ".", 2: " ".join(parts[: len(parts) // 3]), 3: ""}[k % 4]
        rows.append((k, f"{say(30)}\n{body} {say(30)}", "s"))
    rows += [(90, None, None), (91, "", "s"), (92, LONG, "s"), (0, rows[0][1], "s"), (None, rows[1][1], "s"), (0, say(40), "s")]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = tiling.contamination(docs, bench).collect()
    assert len(got) == len(rows)
    codes = lambda t: tiling.word_codes(t).tolist()
    least = lambda t: max(1, min(5, len(codes(t))))
    expected = []
    for i, t, _ in rows:
        if t == LONG:
            best = max(sum(x[2] for x in tiling.tiles(tiling.word_codes(b), [tiling.word_codes(t)], least(b))) / max(1, len(codes(b))) for _, b in items)
        else:
            best = max(plain_tiles(codes(b), codes(t), least(b)) / max(1, len(codes(b))) for _, b in items if len(codes(b)) < 100)
        expected.append((i, best >= tiling.COVERAGE))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.contaminated) for r in got), key=key) == sorted(expected, key=key)
    assert {r.doc_id for r in got if r.contaminated} > {0, 1, 5}  # reordered, verbatim
    kept = tiling.clean_rows(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not c for _, c in expected)
    assert tiling.contamination(documents(spark, []), bench).count() == 0
    assert not any(r.contaminated for r in tiling.contamination(docs, bench.limit(0)).collect())


def test_short_items_are_tiled_whole(spark):
    """Items under the least match count where they stand whole, in any case and between any other words."""
    bench = spark.createDataFrame([(1, "four words stand whole"), (2, "two words"), (3, " . "), (4, "six words that stand here once")],
                                  "item_id long, text string")
    rows = [(1, "before Four words, stand WHOLE after", "s"), (2, "four words stand apart whole", "s"), (3, "just two words.", "s"),
            (4, "two other words", "s"), (5, "", "s"), (6, "four words stand", "s"), (7, "two words four words stand whole", "s")]
    got = {r.doc_id: r for r in tiling.contamination(documents(spark, rows), bench).collect()}
    assert {i: got[i].item_id for i in got if got[i].contaminated} == {1: 1, 3: 2, 7: 1}
    assert got[7].tiled_words == 4 and got[2].coverage == 0
    assert {r.doc_id for r in tiling.clean_rows(documents(spark, rows), bench).collect()} == {2, 4, 5, 6}


def plain_components(rows):
    sets, ids = {}, {}
    for i, t, _ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        s = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        ids.setdefault(i, []).append(s)
    parent = {i: i for i in ids}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in combinations(ids, 2):
        if any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in ids[a] for t in ids[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: {len(s) for s in v} for i, v in ids.items()}


def near_fixture(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(3)) for _ in range(200)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 90))]
        if g % 3 == 0:
            words = words[:20] + passage
        for _ in range(rng.choice([1, 2, 3, 25 if g == 0 else 6])):
            copy = list(words)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            text = " ".join(copy)
            rows.append((len(rows), text.upper() if rng.random() < 0.2 else text + rng.choice(["", "\n", "  "]), "s"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_join_components_match_all_pairs(spark, seed):
    rows = near_fixture(seed) + [(500, None, None), (501, "", "s"), (502, " \n", "s"), (503, "É é", "s"), (504, "é É", "s"), (505, LONG, "s"),
                                 (506, LONG + " tail", "s"), (507, "one two", "s"), (508, "ONE  two", "s")]
    rows += rows[:2]
    docs = documents(spark, rows)
    got = group_prefix_join.join_components(docs).collect()
    expected, sizes = plain_components(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert all(r.n_shingles in sizes[r.doc_id] for r in got)
    kept = group_prefix_join.first_rows(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


@pytest.mark.parametrize("block", [1024, 3])
def test_join_counts_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(group_prefix_join, "BLOCK_CLASSES", block)
    rng, rows = random.Random(3), near_fixture(4)
    base = [f"w{k}" for k in range(60)]
    for k in range(20):  # a group of near copies of many sizes, far ends of which don't link
        own = base[:60 - 2 * (k % 10)] + [f"x{rng.randrange(4)}" for _ in range(k % 3)]
        rows.append((600 + k, " ".join(own), "s"))
    rows += [(700, rows[-1][1], "s"), (700, rows[-1][1], "s"), (None, rows[-1][1], "s"), (701, "one two", "s"), (702, "ONE  two", "s"), (703, "", "s"), (704, None, "s")]
    words = {i: shingles.word_hashes(t) for i, t, _ in rows if i is not None}
    sets = {i: set(shingles.shingle_set(w).tolist()) for i, w in words.items()}
    links = {i: sum(100 * len(s & t) >= 75 * len(s | t) for j, t in sets.items() if j != i and s and t) for i, s in sets.items()}
    got = group_prefix_join.join_components(documents(spark, rows)).collect()
    assert len(got) == len(rows) and max(links.values()) >= 20
    assert all(r.n_links == (links[r.doc_id] if r.doc_id is not None else 0) for r in got)


def test_whole_texts_reach_workers_in_small_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    def spied(df, name, **options):
        if "MapInArrow" in plan(df):
            seen.append((name, spark.conf.get(key, None)))
        return shared.written(df, name, **options)

    monkeypatch.setattr(group_prefix_join, "written", spied)
    monkeypatch.setattr(tiling, "written", spied)
    docs = documents(spark, near_fixture(5))
    assert "MapInArrow" not in plan(group_prefix_join.join_components(docs))  # else it would run at the caller's batch size
    tiling.overlaps(docs, spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string"))
    assert {name for name, _ in seen} >= {"sets", "candidates", "links", "block-counts", "stretches"}
    assert all(size == str(shared.BATCH_BYTES) for name, size in seen if name not in ("items", "contents"))
    assert spark.conf.get(key, None) is None  # other queries keep their own


def test_common_sizes_equal_plain_intersections(monkeypatch):
    rng = np.random.default_rng(5)
    draw = lambda n: [np.unique(rng.integers(0, rng.choice([9, 400]), 40).astype(np.uint64)) for _ in range(n)]
    for met in (50, 1 << 21):
        monkeypatch.setattr(group_prefix_join, "MET", met)
        for a, b in ((draw(30), draw(50)), (draw(1), draw(3)), ([np.zeros(0, np.uint64)], draw(2))):
            assert group_prefix_join.common(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_first_rows_tell_texts_of_one_id_apart(spark):
    near = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"x{k}" for k in range(60))
    rows = [(1, near, "s"), (5, near + " more", "s"), (5, other, "s"), (5, other, "s"), (6, near, "s"), (7, "", "s"), (8, "", "s"), (7, "", "s"), (None, near, "s")]
    kept = sorted((r.doc_id or 0, r.text) for r in group_prefix_join.first_rows(documents(spark, rows)).collect())
    assert kept == [(0, near), (1, near), (5, other), (7, ""), (8, "")]


def test_join_with_hot_table(spark, monkeypatch):
    """A full hot table moves tokens in the order and salts them, but no link."""
    monkeypatch.setattr(group_prefix_join, "SAMPLE_SHARE", 1)
    monkeypatch.setattr(group_prefix_join, "HOT_COUNT", 2)
    rows = near_fixture(9)
    got = {r.doc_id: r.component_id for r in group_prefix_join.join_components(documents(spark, rows)).collect()}
    assert got == plain_components(rows)[0]


def test_join_null_ids_and_empty_table(spark):
    text = "a b c d e f g h"
    got = group_prefix_join.join_components(documents(spark, [(None, text, "s"), (4, text, "s"), (2, text, "s")])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.doc_id) == [(2, 2), (4, 2)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert group_prefix_join.join_components(documents(spark, [])).count() == 0


def test_prefix_and_parity_lose_no_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 60, 40).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        b = np.unique(np.concatenate([rng.permutation(a)[: int(len(a) * 0.9)], rng.integers(0, 60, 2).astype(np.uint64)]))
        hot = np.sort(rng.permutation(a)[:10])
        both = shingles.overlap(a, b)
        if 100 * both >= 75 * (len(a) + len(b) - both):
            rank = np.arange(len(hot))
            assert set(group_prefix_join.prefix(a, hot, rank)[0]) & set(group_prefix_join.prefix(b, hot, rank)[0])
            apart = sum(int(x).bit_count() for x in (group_prefix_join.parity(a) ^ group_prefix_join.parity(b)).view(np.uint64))
            assert 175 * apart <= 25 * (len(a) + len(b))


def test_bitmaps_in_the_join_lose_no_link(spark):
    rng, base, rows = random.Random(6), [f"w{k}" for k in range(300)], []
    for k in range(24):  # four groups of sets, some long, with members at all distances
        size = rng.choice([60, 60, 900])
        own = [f"v{j}" for j in range(size)] if size > 300 else base[:size]
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(size)] = f"x{rng.randrange(5000)}"
        rows.append((k, k % 4, own))
    sets = {k: np.sort(np.array([shingles.word_hashes(w)[0] for w in set(own)], np.uint64)) for k, _, own in rows}
    table = spark.createDataFrame([(k, g, len(sets[k]), [int(x) for x in group_prefix_join.parity(sets[k])]) for k, g, _ in rows],
                                  "cls long, g long, n long, sign array<long>").select("*", *group_prefix_join._marks("sign"))
    bits = [f"b{k}" for k in group_prefix_join.MARKS]
    groups = table.groupBy("g").agg(*[F.bit_and(b).alias(b) for b in bits], *[F.expr(f"~(bit_and({b}) ^ bit_or({b}))").alias("m" + b[1:]) for b in bits])
    grouped = table.drop(*bits).join(groups, "g")
    for side, sure in ((table, False), (grouped, True)):
        other = side.select(*[F.col(c).alias(f"o_{c}") for c in side.columns])
        met = {(r.cls, r.o_cls) for r in side.join(other, F.col("cls") < F.col("o_cls")).where(group_prefix_join._alike(75, sure)).collect()}
        close = {(a, b) for a in sets for b in sets if a < b and 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))}
        assert close and close <= met and (sure or len(met) < 24 * 23 // 2)
