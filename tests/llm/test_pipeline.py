"""run() of corpus_pipeline against the plain version of each stage, one after the other."""
import random
import re
import zlib

import numpy as np

import corpus_pipeline
from barlake.llm import catalog, quality_lines, tiling

from test_small_operators import WORD, base, plain_mix
from test_text_operators import plain_components, plain_tiles


def fixture():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(20)) for k in range(4)]
    rows = [(k, say(rng.randint(40, 90)) + "\nshared footer line 2024\n" + say(9), rng.choice(["a", "b", None])) for k in range(70)]
    for k in range(0, 60, 6):
        words = rows[k][1].split(" ")
        words[3] = "changed"
        rows.append((100 + k, " ".join(words), "b"))
        rows.append((101 + k, rows[k][1], rows[k][2]))
    rows += [(300 + k, say(30) + " " + items[k][1] + " " + say(30), "a") for k in range(3)]
    rows += [(400, None, "a"), (401, "", None), (402, "x " * 80, "a"), rows[0], (None, say(70), "b")]
    return rows, items


def plain_quality(rows):
    lines = lambda t: [(re.sub("[0-9]+", "0", " ".join(WORD.findall(x.lower()))), len(WORD.findall(x)), x) for x in (t or "").split("\n")]
    seen, first, out = {}, {}, []
    for i, t, s in rows:
        for line, n, _ in lines(t):
            if n:
                seen.setdefault((s, line), set()).add(t)
                if i is not None:
                    first[s, line] = min(i, first.get((s, line), i))
    for i, t, s in rows:
        b = base(t)
        over = [n > 0 and len(seen[s, line]) > quality_lines.MAX_DOCS and first.get((s, line)) != i for line, n, _ in lines(t)]
        gone = sum(n for (_, n, _), o in zip(lines(t), over) if o)
        if b[0] >= 50 and 2 * b[4] <= b[0] and 2 * gone <= b[0]:
            out.append((i, "\n".join(x for (_, _, x), o in zip(lines(t), over) if not o) if any(over) else t, s))
    return out


def test_pipeline_matches_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer
    rows, items = fixture()
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = plain_quality(rows)
    assert any("shared footer" not in t for _, t, _ in kept)
    named = [r for r in kept if r[0] is not None]
    component, _ = plain_components(named)
    kept = list({r[0]: r for r in named if component[r[0]] == r[0]}.values()) + [r for r in kept if r[0] is None]
    codes = lambda t: tiling.word_codes(t).tolist()
    kept = [r for r in kept if not any(plain_tiles(codes(b), codes(r[1]), 5) >= tiling.COVERAGE * len(codes(b)) for _, b in items)]
    assert not {300, 301, 302} & {r[0] for r in kept}
    _, _, taken = plain_mix(kept)
    mixed = []
    for i, t, s in kept:
        size = len(WORD.findall(t))
        mixed += [(-1 if i is None else i, t)] * (taken.get((-1 if i is None else i, size, s), 0) // size)
    library, at, expected = Tokenizer.from_file(catalog.tokenizer("byte_bpe_50k.json")), 0, []
    for i, t in sorted(mixed):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expected


def test_stages_on_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_columns():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mix", "token_files"]
