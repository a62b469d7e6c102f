"""The other operators on small fixtures, each against a plain computation."""

import base64
import collections
import hashlib
import math
import random
import re
import time
import uuid
import zlib

import numpy as np
import pytest

from corpusloom.llm import mixing, neighbours, quality, rules, toxicity, warc, webpages
from corpusloom.llm.work import shared_dir


def test_archive(spark):
    rows = [(5, "http://a/x", "same"), (3, "http://b/\r\ny", "same"), (9, None, None), (7, "u", ""), (2, "v", "<p>é</p>\r\n\r\nWARC/1.1"), (None, "w", "same"), (1, "z", "other")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha256 int")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(df, path)
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(spark, path).collect()}
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = set()
    for p, _, h in rows:
        b = (h or "").encode()
        again = p is not None and first[h or ""] != p
        want.add((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == want
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in rows})
    payload = {r.page_id: bytes(r.payload) for r in warc.records(spark, path).collect()}
    assert payload == {p: (h or "").encode() for p, _, h in rows}
    warc.export(spark, path, f"{path}/plain")
    raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(f"{path}/plain/part-*").collect())
    assert raw.count(b"WARC-Type: response") + raw.count(b"WARC-Type: revisit") == len(rows)
    seen = 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[n : n + 4] == b"\r\n\r\n"
        raw, seen = rest[n + 4 :], seen + 1
    assert seen == len(rows)


def test_small_payloads_are_responses_and_empty_archive(spark):
    df = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(df, path, least=5)
    assert sorted((r.page_id, r.record_type) for r in warc.read_archive(spark, path).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    warc.write_archive(df.limit(0), path + "e")
    assert warc.read_archive(spark, path + "e").count() == 0


def test_urls_that_look_like_header_lines(spark):
    signs = ["\u2028", "\u2029", "\u0085", "\x0b", "\x0c", "\r", "\n", "\r\n"]
    rows = [(i, f"http://a/{sign}WARC-Refers-To: <urn:page:77>{sign}WARC-Payload-Digest: sha1:X{sign}WARC-Type: revisit{sign}", f"text {i}") for i, sign in enumerate(signs)]
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r.page_id: (r.url, r.record_type, r.refers_to) for r in warc.read_archive(spark, path).collect()}
    assert got == {i: (re.sub("[\r\n]+", "", url), "response", None) for i, url, _ in rows}


def test_very_long_payload(spark):
    rows = [(2, "u", "x" * 5_000_000), (1, "v", "x" * 5_000_000), (3, "w", "x" * 4_999_999)]
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archive(spark, path).collect()}
    assert got == {1: (5_000_000, "response", None), 2: (5_000_000, "revisit", 1), 3: (4_999_999, "response", None)}


def test_mix_of_clashing_names_ties_and_repeated_ids(spark):
    rows = [(i // 2, " ".join(f"w{i}x{j}" for j in range(10)), "ab"[i % 3 == 0], i, "keep", True, "t", "r") for i in range(60)]
    rows += [(None, "no id at all", "a", -1, "keep", True, "t", "r"), (99, None, "b", -2, "keep", True, "t", "r"), (98, "long " * 200_000, "b", -3, "keep", True, "t", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _id long, _copy string, _take boolean, take string, row string")
    out = mixing.mixed(df, [1, 2], 3)
    assert out.columns == df.columns
    got = out.collect()
    assert {(r._copy, r._take, r.take, r.row) for r in got} == {("keep", True, "t", "r")}
    by = {r[3]: r for r in rows}
    assert all((r.text or "") == (by[r._id][1] or "")[: len(r.text or "")] for r in got)
    plan = mixing.mixture(df, [1, 2], 3).collect()
    want = collections.Counter()
    for r in plan:
        want[r.source] += r.taken
    taken = collections.Counter()
    for r in got:
        taken[r.source] += len((r.text or "").split())
    assert taken == want
    assert mixing.mixed(df.limit(0)).count() == 0


def fair(sizes, weights, most):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


def test_mixture(spark):
    rng = random.Random(3)
    sources = ["b", "a", None, "é", "tiny", "empty"]
    docs = [(i, None if i % 17 == 0 else " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 60))), s) for i, s in enumerate(rng.choices(sources[:4], [6, 2, 1, 1], k=300))]
    docs += [(1000, "one two", "tiny"), (1001, "", "empty"), (None, "null id here", "a")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int")
    out = mixing.mixture(df).collect()
    sizes = collections.Counter()
    for d, t, s in docs:
        sizes[s] += len((t or "").split())
    want = fair(sizes, [1, 2, 3], 3)
    assert len(out) == len(docs)
    taken = collections.Counter()
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) < 1
    again = mixing.mixture(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r.source] += len((r.text or "").split())
    assert words == +taken
    assert mixing.mixture(df.limit(0)).count() == 0


def brute_segments(score):
    """Maximal scoring segments by definition: the best segment, then the same left and right of it."""
    best, where = 0.0, None
    for i in range(len(score)):
        total = 0.0
        for j in range(i, len(score)):
            total += score[j]
            if total > best + 1e-12:
                best, where = total, (i, j + 1)
    if where is None:
        return []
    i, j = where
    return brute_segments(score[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in brute_segments(score[j:])]


def test_maximal_segments():
    rng = np.random.default_rng(1)
    for _ in range(200):
        score = np.round(rng.normal(-0.3, 1, rng.integers(0, 25)), 3)
        got = toxicity.maximal_segments(score)
        want = brute_segments(score.tolist())
        assert sorted((a, b) for a, b, _ in got) == sorted((a, b) for a, b, _ in want)
        assert sorted(s for _, _, s in got) == pytest.approx(sorted(s for _, _, s in want))


def test_segment_scan_is_linear():
    rng = np.random.default_rng(3)
    n = 1_000_000
    for score in (np.full(n, 0.1), np.tile([1.0, -0.5], n // 2), np.tile([1.0, -1.5], n // 2), -np.abs(rng.normal(0, 1, n)) * (rng.random(n) < 0.5) + 0.3, np.linspace(2, 0.1, n) * np.tile([1, -1], n // 2)):
        begin = time.process_time()
        toxicity.maximal_segments(score)
        assert time.process_time() - begin < 10  # a quadratic scan takes hours


def test_scores_are_those_of_a_plain_version(spark):
    docs, labels = toxic_corpus(150)
    docs += [(500, "vile " * 30_000 + "x " * 100_000), (501, ""), (502, None), (7, docs[7][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, lab)
    got = sorted((r.doc_id, r.score, [(p.start, p.end) for p in r.passages]) for r in toxicity.scores(d, lab).collect())
    want = []
    for i, text in docs:
        b = (text or "").encode()
        spans = [m.span() for m in re.finditer(rb"[A-Za-z\x80-\xff]+", b)]
        s = [float(model.score(toxicity.tokens([b[p:q]])[0])[0]) for p, q in spans] if len(spans) < 1000 else [float(model.score(toxicity.tokens([w])[0])[0]) for w in (b"vile", b"x") for _ in range(30_000 if w == b"vile" else 100_000)]
        found = brute_segments(s) if len(s) < 1000 else [(0, 30_000, s[0] * 30_000)]
        marks = [(model.rate * x - model.size - np.log(max(1, len(s))), p, q) for p, q, x in found]
        good = [m for m in marks if m[0] > 0]
        x = sum(m[0] for m in good) if good else max([-model.least, *(m[0] for m in marks)])
        want.append((i, 1 / (1 + np.exp(-(model.slope * min(20.0, max(-20.0, x)) / 10 + model.shift))), sorted((spans[p][0], spans[q - 1][1]) for _, p, q in good)))
    want.sort()
    assert [(i, sorted(p)) for i, _, p in got] == [(i, p) for i, _, p in want]
    assert [x for _, x, _ in got] == pytest.approx([x for _, x, _ in want])


def toxic_corpus(n=400):
    rng = random.Random(9)
    vocab = [f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(30, 200))
        bad = i % 6 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["Vile,", "foul", "nasty."]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_labels(spark):
    docs, labels = toxic_corpus()
    d = spark.createDataFrame([(*r, "x", "y", 1) for r in docs] + [(900, None, None, None, 1), (None, "", None, None, 1)], "doc_id long, text string, lang string, source string, score int")
    lab = spark.createDataFrame(labels + [(901, 1, 1), (902, None, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.scores(d, lab).collect()}
    truth = {i: t for i, _, t in labels}
    held = [r for r in out.values() if r.held_out and r.doc_id in truth]
    assert len(held) > 40
    assert all(r.predicted == truth[r.doc_id] for r in held)
    bad = next(r for r in out.values() if truth.get(r.doc_id) == 1)
    text = dict(docs)[bad.doc_id].encode()
    assert bad.passages and any(w in text[p.start : p.end].lower() for p in bad.passages for w in (b"vile", b"foul", b"nasty"))
    assert 0 < out[900].score < 0.5 and out[None].score == out[900].score
    kept = toxicity.without_toxic(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, t in truth.items() if not t} | {900, None}


def test_rare_words_of_a_large_vocabulary_keep_their_own_counts(spark):
    rng = random.Random(4)
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(5))
    docs, labels = [], []
    for i in range(600):  # words that no other document has: far more than 2 ** 18 in all
        words = [name(i * 1000 + j) for j in range(1000)]
        bad = i % 30 == 0
        words += rng.choices(["vilest", "foulest"], k=8) if bad else []
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    own, _, _, _ = toxicity.tokens([b"vilest foulest"])
    every = np.unique(toxicity.tokens([t.encode() for _, t in docs])[0])
    assert len(every) == 600_002  # one for each word
    assert (model.score(own) > 0).all() and set(every[model.score(every) > 0]) == set(own)


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r.score, 6) for r in toxicity.scores(d, lab).collect()} == {0.5}
    assert toxicity.scores(d.limit(0), lab).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((400, 16)) * rng.uniform(0.5, 2, (400, 1))
    rows = [(i, [float(x) for x in v[i].astype(np.float32)], 1, 0.5) for i in range(400)]
    rows[7] = (7, None, 1, 0.0)
    rows[8] = (8, [0.0] * 16, 1, 0.0)
    rows[9] = (9, [float("nan")] + [1.0] * 15, 1, 0.0)
    rows[10] = (10, [None] + [1.0] * 15, 1, 0.0)
    rows[41] = (41, rows[40][1], 1, 0.0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, every=20, k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    use = {i: np.array(e, dtype=np.float32).astype(float) for i, e, _, _ in rows if i not in (7, 8, 9, 10)}
    assert sorted(got) == [i for i in use if i % 20 == 0]
    hits = total = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {i for _, i, _ in found}
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(s == pytest.approx(float(use[i] @ use[q]), abs=1e-12) for _, i, s in found)
        best = sorted((-float(use[i] @ use[q]), i) for i in use if i != q)[:20]
        hits += len({i for _, i in best} & {i for _, i, _ in found})
        total += 20
    assert hits / total >= 0.9
    few = df.where("vec_id < 5 or vec_id = 20")
    assert neighbours.nearest(few).groupBy("query_id").count().collect()[0]["count"] == 5
    assert neighbours.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    found = collections.defaultdict(set)
    for r in neighbours.nearest(df).collect():
        found[r.query_id].add(r.vec_id)
    rows = df.select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = v @ v[i]
        score[i] = -np.inf
        hits += len(found[int(ids[i])] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
        total += 20
    assert hits / total >= 0.9


@pytest.mark.parametrize("size", [1e-170, 1e-310, 1.0, 1e150])
def test_neighbours_of_any_size(spark, size):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 8))
    v[::3] *= size
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(20, v[20].tolist()), (320, [0.5] * 7), (340, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {i: 20 for i in range(0, 300, 20)}


def test_equal_vectors_are_ranked_by_id(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in neighbours.nearest(df, 20, 20).where("query_id = 0").orderBy("rank").collect()]
    assert got == list(range(1, 21))


def test_quality(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(40, 90))]
        docs.append((i, " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words[:8] * 6), "s1" if i % 3 else "s2", "en", 1.0))
        labels.append((i, int(good), 0))
    df = spark.createDataFrame(docs + [(900, None, None, None, None)], "doc_id long, text string, source string, lang string, score double")
    out = {r.doc_id: r for r in quality.scores(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [r for r in out.values() if r.held_out and r.doc_id < 300]
    assert len(held) > 30 and all(r.kept == (labels[r.doc_id][1] == 1) for r in held)
    assert 0 <= out[900].score <= 1
    assert quality.scores(df.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_site_posteriors_are_those_of_a_plain_version(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        good = rng.random() < (0.9 if i % 5 else 0.3)
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(40)) if good else "BUY NOW!!! " * rng.randint(5, 20)
        docs.append((i, text, None if i % 11 == 0 else f"s{i % 5}", f"p{i % 3}", 1))
        if i % 2:
            labels.append((i, int(good)))
    docs += [(7, docs[7][1], "s2", "p1", 1), (None, "no id", "s1", None, 1), (800, None, "s1", "p1", 1), (801, "", None, None, 1), (802, "word " * 300_000, "lonely", "p", 1)]
    labels += [(7, 0), (999, 1), (None, 1), (10, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, evidence int")
    got = quality.scores(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(docs)
    trained = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            trained[i] = min(y, trained.get(i, 1))
    evidence = collections.defaultdict(list)
    for r in got:
        evidence[r.doc_id].append(r)
    site = lambda d: (d[2] or "", d[3] or "")
    n, good = collections.Counter(), collections.Counter()
    for d in docs:
        x = evidence[d[0]][0].evidence
        w = 1.0 if d[0] in trained else 0.1
        for key in (site(d), site(d)[0], "all"):
            n[key] += w
            good[key] += trained[d[0]] if d[0] in trained else w / (1 + math.exp(-x))
    mean = good["all"] / n["all"]

    def strength(keys):
        big = [k for k in keys if n[k] > 1]
        beyond = sum((good[k] / n[k] - mean) ** 2 - mean * (1 - mean) / n[k] for k in big) / len(big)
        return min(1e6, max(1.0, mean * (1 - mean) / beyond - 1)) if beyond > 0 else 1e6

    hosts, paths = {site(d)[0] for d in docs}, {site(d) for d in docs}
    k, m = strength(hosts), strength(paths)
    logit = lambda p: math.log(p / (1 - p))
    want = collections.defaultdict(list)
    for d in docs:
        host_rate = (good[site(d)[0]] + k * mean) / (n[site(d)[0]] + k)
        path_rate = (good[site(d)] + m * host_rate) / (n[site(d)] + m)
        want[d[0]].append((host_rate, path_rate, 1 / (1 + math.exp(-(evidence[d[0]][0].evidence + logit(path_rate) - logit(mean))))))
    for i, rows in evidence.items():
        assert sorted((r.host_rate, r.path_rate, r.score) for r in rows) == [pytest.approx(x) for x in sorted(want[i])]


def test_sparse_sites_shrink_to_the_level_above(spark):
    groups = spark.createDataFrame([("a", 1000, 900.0), ("b", 1000, 100.0), ("c", 1000, 500.0)], "host string, n long, s double")
    assert quality._strength(groups, 0.5) < 10
    assert quality._strength(spark.createDataFrame([("a", 10, 5.0), ("b", 10, 5.0)], "host string, n long, s double"), 0.5) == 1e6


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    spots = collections.defaultdict(list)
    for i in range(len(words) - 4):
        spots[tuple(words[i : i + 5])].append(i)
    covered = {j for v in spots.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_rules(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x " * 30, "one\n\none\n one\none\r\nTwo ##  é$\x0b\n", "a b c d e f " * 3 + "tail"]
    texts += [" ".join(rng.choice(["ab", "cd", "efgh", "ü#", "\n", "ij\nkl", "mn", "op"]) for _ in range(rng.randint(0, 80))) for _ in range(120)]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s", "t", None]), 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = {r.doc_id: r for r in rules.judged(df).collect()}
    assert len(got) == len(rows)
    for i, t, _, _, _ in rows:
        n, c, s, d, w = measures(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, c, s, d, w), i
        assert r.base_failed == (n < 10 or 100 * w > 20 * n) and not (r.base_failed and r.kept)
    assert rules.judged(df.limit(0)).count() == 0


def test_rules_of_long_texts_repeated_rows_and_clashing_names(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(60_000)) + " a b c d e" * 5_000
    rows = [(1, long, "en", "s", "x", 1, True), (2, "one two three", "en", "s", "x", 1, True), (2, "one two three", "en", "s", "x", 1, True), (3, "y" * 2_000_000, "en", "s", "x", 1, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _words string, kept int, base_failed boolean")
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.judged(df).collect())
    assert got == sorted((r[0], *measures(r[1])) for r in rows)


def test_thresholds_adapt_to_their_group(spark):
    rng = random.Random(7)
    text = lambda n, tail: " ".join("".join(rng.choice("abcdefghij") for _ in range(n + rng.randint(-1, 1))) + tail for _ in range(40))
    rows = [(i, text(5, ""), "en", "plain") for i in range(200)] + [(1000 + i, text(5, "##"), "en", "code") for i in range(200)]
    rows += [(5000, text(5, "##"), "en", "plain"), (5001, text(40, ""), "en", "plain")]
    got = {r.doc_id: r.kept for r in rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(200)) and all(got[1000 + i] for i in range(200))
    assert not got[5000] and not got[5001]


def test_limits_of_a_uniform_group_are_tighter_than_fixed_ones(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    text = lambda n: "\n".join(" ".join(word(n + rng.randint(-1, 1)) for _ in range(8)) for _ in range(8))
    odd = {900: text(9), 901: text(3), 902: text(5).replace(" ", " # ", 8), 903: text(5) + "\nsame line\nsame line\nsame line", 904: text(5) + " once more the very same" * 2}
    rows = [(i, text(5), "en", "plain") for i in range(200)] + [(i, t, "en", "plain") for i, t in odd.items()]
    # a group in which one in two repeats lines keeps what the uniform one rejects
    rows += [(2000 + i, text(5) + ("\nsame line" * 3 if i % 2 == 0 else ""), "en", "loose") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in rules.judged(df).collect()}
    assert not any(got[i].base_failed for i in odd)
    assert {i for i, r in got.items() if not r.kept} == set(odd)
    limits = {r.source: r for r in rules.thresholds(rules.measured(df)).collect()}["plain"]
    assert limits.word_length_to < 12 and limits.word_length_from > 2.5 and limits.symbols_to < 0.25 and limits.dup_lines_to < 0.3 and limits.repeats_to < 0.2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="cookie-notice">accept</div>
<div class=content><article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>
 text.<br>next<p>Second &lt;b&gt; para &#233;<!-- no --><ul><li>one<li>two</ul>
<aside>side</aside><form><p>mail</p></form><div id="comments"><p>nice!</p></div></article></div>
<footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "http://h/1", PAGE, 1), (2, None, None, 1), (3, "http://h/2", "", 1), (4, "x", "plain < text &nbsp; only", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: (r.text, r.n_chars) for r in webpages.main_text(df).collect()}
    want = "Title & more\nFirst bold text. next\nSecond <b> para é\none\ntwo"
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("plain < text only", 17)}
    assert webpages.main_text(df.limit(0)).count() == 0


def test_style_tree_drops_what_every_page_of_a_host_has(spark):
    page = lambda i: f"<body><div class=top>Same words everywhere</div><div class=main><h1>Title {i}</h1><p>Body text number {i} of this page.</p></div><div class=bottom>Always the same end</div></body>"
    rows = [(i, f"https://Host.example/{i}", page(i)) for i in range(12)] + [(100, "https://few.example/", page(100))]
    got = {r.page_id: r.text for r in webpages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3\nBody text number 3 of this page."
    assert got[100].startswith("Same words everywhere\nTitle 100")


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in webpages.main_text(df).collect()}


def test_style_tree_works_inside_articles_and_articles_are_a_hint(spark):
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    page = lambda i: f"<body><article><h1>Title {i}</h1><div class=line>Tell your friends</div><table><tr><td>0<td>0<td>{i}</table><p>{words(i, 30)}</p></article><div>{words(-i - 1, 5)}</div></body>"
    teasers = lambda i: "".join(f"<article><p>Teaser {i} {j}</p></article>" for j in range(3))
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", f"<body><div class=text><p>{words(i, 40)}</p></div>{teasers(i)}</body>") for i in range(3)]
    rows += [(200 + i, f"http://c.example/{i}", f"<body><article><p>The same article.</p></article><div>{words(i, 2)}</div></body>") for i in range(10)]
    rows += [(300, "http://d.example/", "<body><article><ul>" + "<li>0" * 20 + "</ul></article></body>")]
    got = extracted(spark, rows)
    assert got[3] == f"Title 3\n0\n0\n3\n{words(3, 30)}"
    assert words(1, 40) in got[101]
    assert got[205] == "The same article."
    assert got[300] == "\n".join("0" * 20)  # repeated on one page, which says nothing about the host


def test_names_drop_whole_names_only_and_no_article(spark):
    text = "Words of the article that is read. " * 5
    article = f"<article><h2 id='related-work'>Related work</h2><h2 id=comments>On comments</h2><section id='social-impact'><p>Impact</p></section><div class='search-algorithm'>Search</div><p>{text}</p><div class=share>Share</div></article>"
    want = f"Related work\nOn comments\nImpact\nSearch\n{text.strip()}"
    rows = [(1, "http://a/", f"<body><div class='layout with-sidebar'>{article}</div></body>"), (2, "http://b/", f"<body><div class=sidebar>{article}</div></body>")]
    rows += [(3, "http://c/", f"<body><form id=search><div><p>{text}</p></div></form><div class=ad>Buy</div></body>"), (4, "http://d/", f"<body><main>{text}<div id=comments><article>Nice</article></div></main></body>")]
    rows += [(5, "http://e/", f"<body><div class=ad>{text}</div><article>Short.</article></body>")]
    assert extracted(spark, rows) == {1: want, 2: want, 3: text.strip(), 4: text.strip(), 5: "Short."}


def test_a_rooted_page_loses_a_branch_because_of_the_tree(spark):
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    page = lambda i: f"<main><h1>T{i}</h1><div class=neutral><p>Written by the staff of this site.</p></div><p>{words(i, 20)}</p></main>"
    many = extracted(spark, [(i, f"http://a/{i}", page(i)) for i in range(20)])
    assert many[4] == f"T4\n{words(4, 20)}"
    assert extracted(spark, [(4, "http://a/4", page(4))])[4] == f"T4\nWritten by the staff of this site.\n{words(4, 20)}"


def test_names_and_attributes_that_are_no_boilerplate(spark):
    rows = [(1, "http://a/", '<div class="container has-sidebar"><h1>T</h1><p>Real article text.</p></div>')]
    rows += [(2, "http://b/", '<article><h1>T</h1><div class="post-body share-enabled"><p>Long text.</p></div></article>')]
    rows += [(3, "http://c/", "<p>a</p><script src=/a/>var x=1;</script><p>b <svg a=1 /> c</p><svg data=x/>no</svg><style media=all/>p{}</style>d")]
    assert extracted(spark, rows) == {1: "T\nReal article text.", 2: "T\nLong text.", 3: "a\nb c\nd"}


@pytest.mark.parametrize("tag", ["div", "form", "b", "ul"])
def test_deep_pages_take_linear_memory(tag):
    import tracemalloc

    used = []
    for depth in (5_000, 20_000):
        source = f"<{tag}>x" * depth + "</i>" * depth
        tracemalloc.start()
        page = webpages.Page(source)
        n = len(list(page.nodes()))
        text = page.text({webpages.node_id(e.path) for e in page.elements[2:3]})
        used.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert text.replace("\n", "").startswith("x") and n <= depth
    assert used[1] < 8 * used[0] and used[1] < 60_000_000


def test_importance_is_that_of_plain_entropies(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        parts = "".join(f"<div class={c}><p>{rng.choice(texts)}</p>{rng.choice(['', '<hr><h2>x</h2>'])}</div>" for c, texts in (("a", ["same"]), ("b", ["one", "two"]), ("share-line", [f"n{k}" for k in range(40)])))
        rows.append((i, f"http://{rng.choice(['h', 'g', 'lone%d' % i])}/{i}", f"<body>{parts}</body>"))
    rows += [(100, None, "<body><div class=a>same</div></body>"), (101, "http://h/", None), (102, "http://h/", ""), rows[0]]
    seen = collections.defaultdict(lambda: (collections.Counter(), collections.Counter()))
    path = lambda *styles: __import__("functools").reduce(lambda h, x: __import__("xxhash").xxh64_intdigest(x, seed=h), styles, 0)
    for _, url, html in rows:
        host = re.match("http://([^/]*)", url)[1] if url else ""
        for c in re.findall("<div class=([^>]*)>(.*?)</div>", html or ""):
            where = webpages.node_id(path("body.", f"div.{c[0]}"))
            seen[host, where][0][re.sub("[^<]*(<[^>]*>)[^<]*", r"\1", c[1])] += 1
            seen[host, where][1][re.sub("<[^>]*>", "|", c[1])] += 1
    entropy = lambda c: -sum(k / c.total() * math.log(k / c.total()) for k in c.values()) / math.log(c.total()) if c.total() > 1 else 1.0
    got = {(r.host, r.node): r for r in webpages.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    doubt = webpages.node_id(path("body.", "div.share-line"))
    assert seen
    for key, (look, read) in seen.items():
        n, unseen = look.total(), 8.0 if key[1] == doubt else 1.4
        assert got[key].pages == n and got[key].doubtful == (key[1] == doubt)
        assert got[key].importance == pytest.approx((n * (0.1 * entropy(look) + 0.9 * entropy(read)) + unseen) / (n + unseen))


def test_very_long_page_and_repeated_rows(spark):
    html = "<article>" + "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(30_000)) + "</article>"
    rows = [(1, "http://a/", html), (1, "http://a/", html), (2, "http://b/", "y" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = webpages.main_text(df).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == sorted([(1, len(got[0].text if got[0].page_id == 1 else got[1].text))] * 2 + [(2, 3_000_000)])
    assert all(r.text.count("\n") == 29_999 for r in got if r.page_id == 1)


COMPOUND = "comment-list user-comments commentlist comments-section cookie-banner ad-slot main-menu share-buttons site-footer site-header post-comments".split()


@pytest.mark.parametrize("n", [1, 5, 30])
def test_comments_and_compound_names_go(spark, n):
    words = lambda i, k: " ".join(f"w{i}x{j}" for j in range(k))
    said = lambda i, k: "".join(f"<article class='comment'><p>{words(1000 + i + j, 12)}</p></article>" for j in range(k))
    body = lambda i: f"<article><h1>T{i}</h1><p>{words(i, 40)}</p></article>"
    want = lambda i: f"T{i}\n{words(i, 40)}"
    rows = [(i, f"http://a/{i}", f"<body>{body(i)}<section id='comments'>{said(i, 1 + i % 20)}</section></body>") for i in range(n)]
    rows += [(1000 + i, f"http://b/{i}", "<body>" + body(i) + "".join(f"<div class='{c}'>{words(50 + i, 3)}</div>" for c in COMPOUND) + "</body>") for i in range(n)]
    rows += [(2000 + i, f"http://c/{i}", f"<body><div class=text><p>{words(i, 40)}</p></div><div class='comment-list'>{said(i, 9)}</div></body>") for i in range(n)]
    rows += [(3000 + i, f"http://d/{i}", f"<body><div class='comment-wrapper'>{body(i)}</div></body>") for i in range(n)]
    rows += [(4000 + i, f"http://e/{i}", f"<body>{body(i)}<article class=comment>{words(i, 90)}</article><aside class=related><article>{words(7, 60)}</article></aside></body>") for i in range(n)]
    got = extracted(spark, rows)
    for i in range(n):
        assert [got[k + i] for k in (0, 1000, 3000, 4000)] == [want(i)] * 4 and got[2000 + i] == words(i, 40)


def test_tokens_are_found_in_linear_time():
    for part in ("<x ", '<x "', "<x '\"", '<x ">" ', "<script></script ", "<!-", "<a b='>", "</", "<p title='", "<!x "):
        for tail in ("", ">", '">'):
            began = time.process_time()
            webpages.Page(part * 300_000 + tail).text(set())
            assert time.process_time() - began < 8, (part, tail)
    page = webpages.Page('<p title="a > b">one</p><p title="odd>two</p><p>three</p>').text(set())
    assert page == "one\ntwo\nthree"
    assert webpages.Page("a < b <c").text(set()) == "a < b <c" and webpages.Page("x<!-- y > z").text(set()) == "x"
