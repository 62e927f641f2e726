"""Spelling variants, line runs and whitening: odd rows, empty tables and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.llm import lines, spelling, whitening

DOC = "doc_id long, text string"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def groups(counts, factor=10):
    """The definition, pair by pair."""
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), None if form[w] is None else counts[form[w]]) for w, n in counts.items()}


@pytest.mark.parametrize("symbols", [None, 2, 32])
def test_variants_brute_force(spark, symbols):
    rng = random.Random(4)
    letters = "abcdeéßÿ×"
    counts = {}
    for _ in range(60):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(7, 12)))
        for _ in range(6):
            counts[word] = 10 ** rng.randint(0, 6) + rng.randint(0, 3)
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1:], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1:]])
            if len(word) < 7:
                break
    counts |= {"aaaaaaa": 5, "aaaaaaaa": 500, "aaaaaaaaa": 50_000, "tieaaaax": 1, "tieaaaay": 90, "tieaaaaz": 90}
    got = spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long"), symbols=symbols)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = {tuple(r) for r in got.collect()}
    assert found == groups(counts)
    by = {r[0]: r for r in found}
    assert by["aaaaaaa"][2] == "aaaaaaaaa" and by["tieaaaax"][1] == "tieaaaay"


def test_words_are_counted(odd, empty):
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if h % 3 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                want[run] += 1
    got = {r["word"]: r["n"] for r in spelling.word_counts(odd, min_length=5, damage=3).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2} and len(got) > 50
    assert spelling.variant_groups(spelling.word_counts(empty)).collect() == []


def test_very_long_words(spark):
    long = "".join(random.Random(1).choice("abcdefghij") for _ in range(30_000))
    rows = [("x" + long, 2), (long, 40), ("short" * 2, 3)]
    got = {r["n"]: r for r in spelling.variant_groups(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got[2]["form"] == got[2]["root"] == long and got[40]["n_near"] == 1 and got[3]["n_near"] == 0
    with pytest.raises(ValueError):
        spelling.variant_groups(spark.createDataFrame(rows, "word string, n long"), factor=1)


def test_neighbourhoods_are_distinct_and_whole():
    codes = spelling.Codes(3)
    rng = random.Random(2)
    for n in (1, 2, 5, 9):
        word = [rng.randint(1, 3) for _ in range(n)]
        around = {tuple(word)} | {tuple(word[:i] + word[i + 1:]) for i in range(n)}
        around |= {tuple(word[:i] + [c] + word[i + 1:]) for i in range(n) for c in (1, 2, 3)}
        around |= {tuple(word[:i] + [c] + word[i:]) for i in range(n + 1) for c in (1, 2, 3)}
        found = [int(c) for _, part in codes.around(np.array([word], np.uint64)) for c in part]
        want = {int(spelling.mixed(codes.prefixes(np.array([w], np.uint64))[0, -1:])[0]) for w in around}
        assert len(found) == len(set(found)) and set(found) == want


def cleaned(rows, least):
    keys = lambda text: [line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for line in (text or "").split("\n")]
    counts = Counter(k for _, text in rows for k in set(keys(text)) if k)
    out = Counter()
    for doc, text in rows:
        parts = (text or "").split("\n")
        kept = [p for p, k in zip(parts, keys(text)) if counts[k] < least]
        out[(doc, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


def page(rng, common):
    return "\n".join(rng.choice([rng.choice(common), f"own {rng.random()}", "", " \t", " " + rng.choice(common).upper() + "\r"]) for _ in range(rng.randint(1, 12)))


def digests(frame):
    rows = frame.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect()
    return Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    common = [f"Shared line {i} é" for i in range(40)]
    rows = [(i, page(rng, common[:rng.randint(1, 40)])) for i in range(300)]
    return rows + [(None, rows[0][1]), (5, rows[5][1]), (5, "x"), (900, None), (901, ""), (902, "\n\n"), (903, "Shared line 0 é" * 20_000),
                   (904, "\n".join(f"line {i % 999}" for i in range(30_000))), (905, "shared line 0 É"), (906, "\x0bshared LINE 0 é\x0c")]


@pytest.mark.parametrize("batches,fanout,sent", [(1, 3, 1 << 20), (9, 2, 1 << 20), (7, 3, 0)])
def test_lines_brute_force(spark, texts, batches, fanout, sent):
    docs = spark.createDataFrame(texts, DOC).repartition(5).withColumn("n_lines", F.lit("extra")).withColumn("h1", F.lit("extra"))
    frequent = lines.frequent_lines(docs, batches=batches, fanout=fanout)
    want = cleaned(texts, 10)
    assert digests(lines.drop_lines(docs, frequent, sent_bytes=sent)) == want
    assert sum(k[2] for k in want) > 300


def test_lines_odd(odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    frequent = lines.frequent_lines(odd, min_docs=2, batches=2)
    assert digests(lines.drop_lines(odd, frequent)) == cleaned(rows, 2)
    assert lines.drop_lines(empty, lines.frequent_lines(empty)).collect() == []


def test_runs_are_levelled_and_reopened(spark, texts):
    docs = spark.createDataFrame(texts, DOC)
    runs = lines.LineRuns(spark, fanout=2, buckets=3)
    counts = lines.line_counts(docs.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(8))), "text", "part").cache()
    sizes = []
    for i in range(8):
        runs.add(counts.filter(F.col("batch") == i))
        sizes.append([len(level) for level in runs.levels])
        if i == 4:  # another session goes on
            runs = lines.LineRuns.reopened(spark, runs.manifest)
    assert max(map(sum, sizes)) <= 4 and sizes[-1][:3] == [0, 0, 0]  # 8 batches of fanout 2: one run at level 3
    assert 1 <= len(runs.settled) <= 3
    table = spark.table(runs.levels[3][0])
    plan = table.join(spark.table(runs.settled[0]).hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # runs meet where they are
    total = Counter()
    for _, text in texts:
        total.update({d for d in map(lines.Digests().__getitem__, (text or "").encode().split(b"\n")) if d})
    low = (1 << 64) - 1
    got = {((r["h1"] & low) << 64) | (r["h2"] & low) for r in runs.frequent().collect()}
    assert got == {d for d, n in total.items() if n >= 10}
    kept = {r["h1"] for r in table.collect()}
    assert not kept & {r["h1"] for name in runs.settled for r in spark.table(name).collect()}  # settled keys are counted no more


def test_keys_that_share_a_half():
    known = lines.KeySet(np.array([5, 5, 7]), np.array([2, 1, 1]))
    assert known.has(np.array([5, 5, 5, 7, 9, 1]), np.array([1, 2, 3, 1, 1, 1])).tolist() == [True, True, False, True, False, False]
    assert not lines.KeySet(np.zeros(0, np.int64), np.zeros(0, np.int64)).has(np.array([1]), np.array([1])).any()


def whitened(vectors, k=8):
    """By numpy and exact integers."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    centred = (x - s / n).astype(float)
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1], parts[:, ::-1]
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    return centred @ parts[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), [int(((n * row - s) ** 2).sum()) for row in x]


@pytest.mark.parametrize("block", [(1024, 1024), (7, 4)])
def test_whitening_brute_force(spark, block):
    rng = np.random.default_rng(3)
    good = (rng.normal(0, 1, (90, 12)) * np.linspace(1, 3, 12)).astype(np.float32).tolist()
    odd = [(200, None), (201, [None] * 12), (202, [1.0] * 11 + [float("nan")]), (203, [float("inf")] + [0.0] * 11), (204, [1.0]), (205, [])]
    ids = [*range(88), None, 5]
    rows = [*zip(ids, good), *odd]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).withColumn("index", F.lit("extra")).withColumn("x", F.lit(1))
    got = whitening.whiten(frame, rows_per_block=block[0], columns_per_block=block[1]).collect()
    score, explained, deviation = whitened(good)
    assert Counter(r["vec_id"] for r in got) == Counter({i: 8 for i in ids} | {5: 16})
    sign = {}
    by = {(r["vec_id"], r["component"]): r for r in got if r["vec_id"] != 5}
    for i, vec in enumerate(ids):
        for c in range(8):
            if vec == 5:
                continue
            r = by[vec, c + 1]
            sign.setdefault(c, np.sign(r["whitened"] * score[i, c]))
            assert r["whitened"] * sign[c] == pytest.approx(score[i, c], abs=1e-8)
            assert r["explained"] == pytest.approx(explained[c], rel=1e-9) and r["n"] == 90 and r["deviation"] == deviation[i]
            assert r["identity_error"] < 1e-9


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 5.0, 2.0 * i]) for i in range(9)], kind)).collect()
    assert len(flat) == 9 and {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1)
    wide = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])], kind)).collect()
    assert {r["deviation"] for r in wide} >= {None} and all(math.isfinite(r["whitened"]) for r in wide)


def test_words_of_the_check_sql(spark, tmp_path):
    """Only the six white-space characters part words, in the code and in its SQL."""
    import duckdb

    from tonearm.llm import substrings
    passage = "a\x0bb\x0cc\rd\te\nf g\x85h\xa0i " + " ".join(f"w{i}" for i in range(20))
    frame = spark.createDataFrame([(1, passage), (2, "x " + passage.replace("\x0b", "\r")), (3, "\r\x0c"), (4, None)], DOC)
    frame.write.parquet(str(tmp_path / "t"))
    want = duckdb.execute(f"WITH {substrings.repeats_sql('documents')} SELECT doc_id, n_words, n_removed, sha256(kept) FROM cut".replace(
        "FROM documents", f"FROM read_parquet('{tmp_path}/t/*.parquet')")).fetchall()
    got = substrings.substring_report(frame).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sorted(want)[0][1] == 27


def test_signs_are_no_letters():
    from tonearm.llm import language
    assert language.text_words("½ ② ³ 42 _ Ⅷ 𝟛 🄋 𐄇") == []
    assert language.text_words("x𐄇y 𠀀𠀁 𝟛z") == ["x", "y", "𠀀𠀁", "z"]
    assert language.text_words("Ein½mal naïve 漢字 ǅ") == ["ein", "mal", "naïve", "漢字", "ǆ"]


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_rules_without_a_host(spark, limit):
    from tonearm.llm import urls
    pages = spark.createDataFrame([(1, "http:///x/1"), (2, "http://a.b./x/1"), (3, "http://b/x"), (4, None)], "page_id long, url string")
    rules = spark.createDataFrame([("/x", "block"), ("b/x", "block"), ("", "block")], "rule string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, rules, max_bytes=limit).collect()}
    assert got == {1: (None, "allow"), 2: (None, "allow"), 3: ("b/x", "block"), 4: (None, "allow")}
