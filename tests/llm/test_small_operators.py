"""Quality rules, source mix and WARC archives on small fixtures, against plain Python."""
import random
import re

import pytest

from barlake.llm import fair_mix, quality_lines, warc_merge

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 700}" for i in range(30_000))


def documents(spark, rows, extra=True):
    """rows: (doc_id, text, source); with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if not extra:
        return df
    names = ["id", "size", "key", "host", "w", "gone", "token", "at", "_id", "rank", "n_words"]
    return df.selectExpr("*", *[f"'x' AS `{n}`" for n in names])


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, hit = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def quality_fixture():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 9) + str(rng.randint(0, 10**6)) for _ in range(n))
    rows = [(k, say(60) + "\nall rights reserved 12\n" + say(5), "h") for k in range(30)]
    rows += [(100 + k, "all rights reserved 7 " + "\n" + "  ALL  rights reserved 7\n" * 12 + say(20), "h") for k in range(3)]
    rows += [(200 + k, "all rights reserved 1\n" + say(55), "other") for k in range(3)]
    rows += [(300, None, "h"), (301, "", "h"), (302, "a b c " * 40, "h"), (303, "x y", None), (304, LONG, None), (305, " \n\t\n", "h"),
             (306, "## é|ü 中文 < >\x0b\x0c tail\n" * 9, "h"), (307, say(70), "h"), (307, say(70), "h")]
    menu = "\n".join(say(9) for _ in range(8))  # a site's menu around little text of its own
    rows += [(400 + k, menu + "\n" + say(6), "menus") for k in range(25)]
    return rows + [rows[0], (None, say(80), None)]


def test_quality_matches_plain_python(spark):
    rows = quality_fixture()
    got = quality_lines.judged(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    contents, firsts = {}, {}

    def lines_of(text):
        return [(re.sub("[0-9]+", "0", " ".join(WORD.findall(x.lower()))), len(WORD.findall(x))) for x in (text or "").split("\n") if WORD.search(x)]

    for i, text, host in rows:
        for line, _ in lines_of(text):
            contents.setdefault((host, line), set()).add(text)
            firsts[host, line] = min(x for x in (firsts.get((host, line)), i) if x is not None) if (i, firsts.get((host, line))) != (None, None) else None
    expected = []
    for i, text, host in rows:
        b = base(text)
        gone = sum(n for line, n in lines_of(text) if len(contents[host, line]) > quality_lines.MAX_DOCS and firsts[host, line] != i)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        expected.append((i, *b, failed, gone, not failed and 100 * gone <= 50 * b[0]))
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)
    assert any(r.n_removed_words for r in got) and any(not r.kept and not r.base_failed for r in got)


def test_quality_rows_lose_lines_and_keep_columns(spark):
    rows = quality_fixture()
    docs = documents(spark, rows).selectExpr("*", "CAST(length(text) AS bigint) AS n_chars")
    out = quality_lines.kept_rows(docs, chars_col="n_chars")
    assert out.columns == docs.columns
    texts = {}
    for r in out.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert "all rights reserved 12" in texts[0][0] and len(texts[0]) == 2  # the host's first document keeps the line
    assert "all rights" not in texts[1][0] and "all rights" in texts[200][0]
    assert 300 not in texts and 302 not in texts and 100 not in texts and len(texts[307]) == 2


def test_empty_tables(spark):
    none = documents(spark, [])
    assert quality_lines.judged(none).count() == 0 and quality_lines.kept_rows(none).count() == 0
    assert fair_mix.mix(none).count() == 0 and fair_mix.mixed_rows(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_merge.archive_history(pages).count() == 0


def plain_mix(rows):
    """Targets by repeated resharing, then the queue in one list."""
    import hashlib
    sizes = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    names = sorted({s for _, s, _ in sizes}, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    own = {s: sum(n for _, x, n in sizes if x == s) for s in names}
    total, target, open_ = sum(own.values()), {}, set(names)
    while open_:
        left, share = total - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / share >= 3 * own[s]}
        if not over:
            target |= {s: left * weight[s] / share for s in open_}
            break
        target |= {s: 3.0 * own[s] for s in over}
        open_ -= over
    key = lambda i: hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()
    queue = []
    for k, s in enumerate(names):
        at = 0
        for i, n in sorted(((i, n) for i, x, n in sizes if x == s), key=lambda r: (key(r[0]), -1 if r[0] is None else r[0], r[1])):
            at += n
            queue += [((e * own[s] + at) / target[s], k, key(i), -1 if i is None else i, n, e, s) for e in range(3) if n]
    taken, run = {}, 0
    for q in sorted(queue):
        run += q[4]
        if run > total:
            break
        taken[q[3], q[4], q[6]] = taken.get((q[3], q[4], q[6]), 0) + q[4]
    return own, target, taken


@pytest.mark.parametrize("seed", range(3))
def test_mix_matches_plain_queue(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", None, "", "Z", "é"][: 2 + 2 * seed]
    rows = [(k, " ".join("w" * rng.randint(1, 30) for _ in range(rng.randint(0, 40))), names[0] if rng.random() < 0.4 else rng.choice(names)) for k in range(150)]
    rows += [(900, None, "a"), (901, "", "b"), (902, LONG[:2_000], "a")]
    own, target, taken = plain_mix(rows)
    docs = documents(spark, rows)
    got = fair_mix.mix(docs).collect()
    assert len(got) == len(rows)
    for r, s in ((r, next(x[2] for x in rows if x[0] == r.doc_id)) for r in got):
        assert (r.source_size, r.taken) == (own[s], taken.get((r.doc_id, r.size, s), 0))
        assert r.target == pytest.approx(target[s])
    mixed = fair_mix.mixed_rows(docs)
    assert mixed.columns == docs.columns
    count = {}
    for r in mixed.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert all(count.get(r.doc_id, 0) == (r.taken // r.size if r.size else 0) for r in got)


def test_mix_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c", "x")] * 4 + [(None, "d e", None)] * 2 + [(2, "f", "y"), (2, "g h i j", "y")]
    got = fair_mix.mix(documents(spark, rows)).collect()
    assert len(got) == 8 and all(r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got) <= sum(r.size for r in got)


def pages_fixture():
    big = "<p>" + "é中" * 80 + "\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\n</p>"
    rows = [(5, "http://www.B.com/x?b=2&a=1#f", big), (3, "http://b.com/x?a=1&b=2", big), (9, "bad url\r\n<x>", big), (1, None, None), (2, "", ""),
            (4, "http://a.org", "short"), (6, "http://a.org", "short"), (7, "http://[bad", "x" * 100), (8, "http://a.org:8080/p", "x" * 100), (10, "http://z.net/", LONG)]
    return rows + [(k, "http://hot.com/", "y" * 99 + str(k % 3)) for k in range(20, 400)]


def test_warc_round_trip_and_order(spark, tmp_path):
    import hashlib
    rows = pages_fixture()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS digest", "'u' AS payload")
    history = warc_merge.archive_history(pages, range_rows=60, file_bytes=4000)
    got = warc_merge.digest_rows(history).collect()
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    expected = set()
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and first[h] != i
        expected.add((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert {tuple(r)[:5] for r in got} == expected and len(got) == len(rows)
    ordered = sorted(got, key=lambda r: (r.range_id, r.place))
    keys = [(r.url_key, r.ts, r.page_id) for r in ordered]
    assert keys == sorted(keys)
    assert len({r.range_id for r in got if r.url_key == "com,hot)/"}) > 1  # one URL's captures span ranges
    assert warc_merge.url_key(rows[0][1]) == warc_merge.url_key(rows[1][1])


def test_warc_equal_rows_and_null_ids(spark):
    html = "z" * 200
    pages = spark.createDataFrame([(1, "http://a.b/", html), (1, "http://a.b/", html), (2, "http://a.b/", html), (None, "http://a.b/", html)],
                                  "page_id long, url string, html string")
    got = warc_merge.digest_rows(warc_merge.archive_history(pages)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [
        (0, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_loser_tree():
    rng = random.Random(1)
    for k in range(1, 9):
        lists = [sorted(rng.choices(range(30), k=rng.randint(0, 12))) for _ in range(k)]
        merged = [x[0] for x in warc_merge.LoserTree([iter([(v, None) for v in one]) for one in lists])]
        assert merged == sorted(sum(lists, []))
