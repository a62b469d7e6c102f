"""Small tests for the findings of the fourth round."""

import os
import random
import re
import zipfile
from difflib import SequenceMatcher

import pytest

from corpusloom.functions.text import matched_share
from corpusloom.operators import sections as sc
from corpusloom.plans import files, queries
from corpusloom.sources.parsed import read_all_parsed, write_parsed

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_f4_share_is_that_of_matching_blocks():
    rng = random.Random(1)
    for _ in range(1500):
        letters = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ\0"[: rng.choice([2, 5, 26, 63])] + "éü"
        b = "".join(rng.choice(letters) if rng.random() < 0.9 else rng.choice(letters[:2]) for _ in range(rng.choice([5, 150, 199, 200, 201, 300, 700])))
        b += b[: rng.randrange(len(b))] if rng.random() < 0.3 else ""
        a = b[rng.randrange(len(b)) :][: rng.randrange(1, len(b))] if rng.random() < 0.3 else b[rng.randrange(3) : len(b) - rng.randrange(3)]
        assert matched_share(a, b) == SequenceMatcher(None, a, b).ratio()
    assert matched_share("", "") == 1 and matched_share("", "a") == 0


def test_f4_best_entries_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(40)]
    lines = [" ".join(rng.choices(words, k=rng.choice([1, 2, 5, 40, 60]))) for _ in range(60)]
    edited = []
    for x in lines + ["", "zzzz"]:
        x = list(x)
        for _ in range(rng.randint(0, len(x) // 6 + 1)):
            at = rng.randint(0, len(x))
            x[at : at + rng.randint(0, 1)] = rng.choices("abcz", k=rng.randint(0, 2))
        edited.append("".join(x))
    key = lambda x: x.replace(" ", "")
    lines += [lines[0][:1] + " " + lines[0][1:]]  # the same key
    toc = spark.createDataFrame([("s", key(x), x, i % 3) for i, x in enumerate(lines)] + [("t", "other", "other", 1), ("s", None, None, 1)], "source_id string, key string, text string, level int")
    titles = spark.createDataFrame([("s", i, x, key(x), None) for i, x in enumerate(edited)] + [("u", 1, "other", "other", None), ("s", 99, lines[1], key(lines[1]), "known")], "source_id string, pos int, text string, key string, match string")
    got = {r.pos: (r.match.toc_title, r.match.level, r.match.ratio) for r in sc.fuzzy_titles(titles, toc, ".", 0.85).collect()}
    want = {}
    for i, x in enumerate(edited):
        best = max((SequenceMatcher(None, key(x), key(y)).ratio(), y, j % 3) for j, y in enumerate(lines))
        if key(x) and best[0] >= 0.85:
            want[i] = (best[1], best[2], best[0])
    assert got == want and 20 < len(want) < 62


@tables
def test_f4_long_lines_are_matched_too(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lines = {(d, i): x for d, text in docs.items() for i, x in enumerate((text or "").split("\n")) if x.strip(" ")}
    got = {(r.source_id, r.pos): (r.toc_title, r.ratio) for r in queries()["fuzzy_titles"](spark, SF).collect()}
    assert sum(len(lines[x]) >= 60 for x in got) > len(got) / 2
    bare = lambda x: re.sub(r"\s+", "", x)
    for d in sorted(docs)[:60]:
        own = {bare(x): x for (of, _), x in sorted(lines.items()) if of == d}
        for (of, i), x in lines.items():
            if of == d and len(x) < 2000:
                best = max(((SequenceMatcher(None, bare(x[1:]), k).ratio(), y) for k, y in own.items() if bare(x[1:])), default=(0, ""))
                assert (d, i) in got if best[0] >= 0.85 else (d, i) not in got
                if best[0] >= 0.85:
                    assert got[d, i][1] == pytest.approx(best[0], abs=1e-6)


@tables
def test_f3_no_text_is_shuffled_to_count_chunks(spark):
    df = queries()["whole_chunking"](spark, SF)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", df._jdf.queryExecution().explainString(mode))
    assert moved and not [x for x in moved if re.search(r"\btext#|\br#", x)]


def test_f2_archives_hold_what_folders_hold(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i}", f"é text {i} " * i, '[[{"type": "title"}]]', "{}" if i % 5 else None, "{}" if i % 3 else None) for i in range(23)], "folder string, md string, content_list string, middle string, model string").repartition(3)
    read = lambda path: sorted((r.folder, r.md, r.content_list, r.middle, r.model, r.missing) for r in read_all_parsed(spark, f"file://{path}", 4).collect())
    for name, archived in (("plain", 0), ("zipped", 4), ("deep/down", 1)):
        write_parsed(rows, f"file://{tmp_path}/{name}", archived)
    assert read(tmp_path / "zipped") == read(tmp_path / "plain") == read(tmp_path / "deep") and len(read(tmp_path / "deep")) == 23
    held = list((tmp_path / "zipped").iterdir())
    assert len(held) <= 8 and all(x.suffix == ".zip" for x in held)
    (tmp_path / "zipped" / "own").mkdir()
    (tmp_path / "zipped" / "own" / "x.md").write_text("own")
    with zipfile.ZipFile(tmp_path / "zipped" / "bare.zip", "w") as z:
        z.writestr("y.md", "bare")
    assert [(r[0], r[1]) for r in read(tmp_path / "zipped") if r[0] in ("own", "bare")] == [("bare", "bare"), ("own", "own")] and len(read(tmp_path / "zipped")) == 25


@tables
def test_f2_small_files_take_no_block_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_folder", lambda t: f"file://{tmp_path}")
    n = queries()["parse_results"](spark, SF).count()
    assert n == spark.read.parquet(f"{SF}/documents.parquet").count() and len(list(tmp_path.rglob("*"))) < n / 5
