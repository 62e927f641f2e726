"""Operators on documents: odd rows, empty tables and brute force."""

import hashlib
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SMALL
from tonearm.llm import decontaminate, language, mixing, near, quality, substrings, tokens, toxicity


def shingles(text, size=5):
    words = (text or "").encode().split()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def test_quality_odd(odd):
    rows = quality.host_rules(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[100]["n_words"] == 0 and by[100]["base_failed"] and not by[100]["kept"]
    assert by[107]["n_repeat_words"] == 40 and by[107]["base_failed"]
    assert by[108]["n_words"] == 60_000
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in kept.select("doc_id").collect()) == sorted(r["doc_id"] or -1 for r in rows if r["kept"])


def test_quality_bad_host(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), f"h{i % 4}") for i in range(80)]
    bad = [(1000 + i, "too short", "spam") for i in range(60)] + [(2000, good[0][1], "spam")]
    kept = quality.host_rules(spark.createDataFrame(good + bad, "doc_id long, text string, source string"))
    assert {r["doc_id"] for r in kept.filter("kept").collect()} == {r[0] for r in good}  # the good text of a bad host goes too


def test_substrings_brute_force(odd):
    rows = odd.select("doc_id", "text").collect()
    first = {}
    for r in rows:
        words = (r["text"] or "").encode().split()
        for i in range(len(words) - 12):
            w = tuple(words[i:i + 13])
            first[w] = min(first.get(w, (1 << 63)), r["doc_id"] if r["doc_id"] is not None else (1 << 63) - 1)
    want = Counter()
    for r in rows:
        words, rank = (r["text"] or "").encode().split(), r["doc_id"] if r["doc_id"] is not None else (1 << 63) - 1
        gone = {j for i in range(len(words) - 12) if first[tuple(words[i:i + 13])] < rank for j in range(i, i + 13)}
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        want[(r["doc_id"], len(words), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    report = substrings.substring_report(odd).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in report) == want
    by = {r["doc_id"]: r for r in report}
    assert by[104]["n_removed"] >= 60 and by[0]["longest"] == 0 and by[None]["longest"] >= 13


def test_substrings_doubling(spark):
    rng = random.Random(1)
    passage = " ".join(f"p{rng.random()}" for _ in range(3000))
    rows = [(1, passage), (2, "a b c " + passage + " d"), (3, " ".join(f"q{i}" for i in range(50)))]
    found = {r["doc_id"]: r for r in substrings.substring_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1]["n_removed"], found[2]["n_removed"], found[3]["n_removed"]) == (0, 3000, 0)
    assert 26 <= found[2]["longest"] <= 3000 and found[1]["longest"] == 0  # 13 doubled as long as a chosen start survives


def test_substrings_keep_text(odd):
    kept = substrings.remove_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[102] == " \n\t " and texts[100] is None and texts[101] == ""


@pytest.mark.parametrize("blocks", [(512, 2_000_000), (2, 50)])
def test_near_brute_force(spark, blocks):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = [(1000, None), (1001, ""), (1002, "one two three"), (1003, "one two three"), (None, "one two three"), (1004, "one two")]
    for i in range(30):
        words = base[:]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(90)] = f"e{rng.random()}"
        rows.append((i, " ".join(words)))
    rows += [(2000 + i, " ".join(f"z{i}{j}" for j in range(40))) for i in range(5)] + [(2000, rows[-1][1])]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_sets=blocks[0], block_shingles=blocks[1]).collect()
    texts = {t: shingles(t) for _, t in rows if shingles(t)}
    links = Counter()
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in combinations(texts, 2):
        if 5 * len(texts[a] & texts[b]) >= 4 * len(texts[a] | texts[b]):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    last = (1 << 63) - 1
    rank = [(last if i is None else i, t) for i, t in rows]
    least = {}
    for i, t in rank:
        if t in texts:
            least[root(t)] = min(least.get(root(t), last), i)
    want = Counter((i, least[root(t)] if t in texts else i, links[t] if t in texts else 0) for i, t in rank)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want


def test_near_keeps_one(odd):
    kept = near.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(105) == 0 or ids.count(3) == 0  # 105 is a copy of 3
    assert 0 in ids and None not in ids and 100 in ids and 101 in ids


def test_prefix_is_shortened():
    assert near.prefix_length(0.8, 20, 8, 0.9999) == 4 and near.prefix_length(0.8, 20, 8, 0.9) > 4 and near.prefix_length(0.3, 2, 8, 0.999) == 1


def test_decontaminate(spark, odd):
    rng = random.Random(2)
    item = " ".join(f"Item{rng.randrange(10**6)}" for _ in range(20))
    changed = item.split()
    changed[0] = "else"
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, ""), (5, "five words are just enough"), (1, item)], "item_id long, text string")
    texts = [(1, f"{'x y z ' * 3000} {item.upper()}! {'t u v ' * 3000}"), (2, " ".join(changed)), (3, item[: len(item) // 2]), (4, None), (5, ""),
             (None, item), (6, "so five words, are just enough."), (1, "again")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("class", F.lit(1)).withColumn("item_id", F.lit(2))
    for limit in (decontaminate.MAX_BYTES, 0):
        got = {(r["doc_id"], r["item_id"]): r["n_shared"] for r in decontaminate.contained(docs, items, max_bytes=limit).collect()}
        assert got == {(1, 1): 16, (2, 1): 15, (None, 1): 16, (6, 5): 1}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()} == {3, 4, 5}
    assert decontaminate.drop_contaminated(odd, items).columns == odd.columns


def test_decontaminate_long_documents(spark):
    """An item of one shingle, and documents above the size classes that such an item once left."""
    rng = random.Random(9)
    item = " ".join(f"item{i}" for i in range(20))
    items = spark.createDataFrame([(1, "just five words of benchmark"), (2, item)], "item_id long, text string")

    def long_text(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        return " ".join(words[:n // 2]) + f" just five words of benchmark {item} " + " ".join(words[n // 2:])

    for n, miss in (((1 << 20) + 100, decontaminate.MISS), (40_000, 1e-9)):
        docs = spark.createDataFrame([(1, long_text(n)), (2, "w1 w2 w3 w4 w5 w6")], "doc_id long, text string")
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, items, miss=miss).collect()} == {(1, 1), (1, 2)}
    for miss in (1e-6, 1e-9, 1e-12):
        x = 2.0 ** -decontaminate.extra_bits(1, miss=miss)
        assert x / 2 - x * x / 6 <= miss * 1.001


def test_mix(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        part = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in part) == int(part[0]["target"])
    assert mixing.mix(empty).count() == 0
    again = mixing.mix(odd.repartition(3), rows_per_range=2).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in again) == Counter((r["doc_id"], r["taken"]) for r in rows)


def test_mix_favours_quality(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s") for i in range(2000)] + [(5000, "x " * 5000, "t")], "doc_id long, text string, source string")
    good = spark.createDataFrame([(i, 4.0) for i in range(0, 2000, 2)], "doc_id long, weight double")
    rows = mixing.mix(docs, quality=good, weights=(1, 6)).filter("source = 's'").collect()
    extra = Counter()
    for r in rows:
        extra[r["doc_id"] % 2] += r["taken"] - r["size"]  # beyond the complete epoch
    assert extra[0] > 2 * extra[1] > 0, extra


def test_language(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    found = language.identify(odd).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert {r["lang_pred"] for r in found if r["doc_id"] in (100, 101, 102)} == {"und"}
    assert language.identify(empty).count() == 0


def test_language_order_at_any_size(spark):
    rng = random.Random(6)
    rows = []
    for k in range(40):  # 40 languages with letters of their own: over 8 M numbers in dense arrays
        letters = [chr(0x4E00 + 300 * k + i) for i in range(300)]
        rows += [(f"l{k:02}", " ".join("".join(rng.choice(letters) for _ in range(8)) for _ in range(100))) for _ in range(4)]
    model = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.order == language.ORDER
    counts = {}
    for lang, text in rows:
        counts.setdefault(lang, Counter()).update(g for w in language.text_words(text) for g in language.grams(w, 4))
    assert 2 * len(set().union(*counts.values())) * len(counts) > 8_000_000
    want = language.Model.fit(counts, 4)
    names = [w for _, text in rows[::40] for w in language.text_words(text)[:5]] + ["abc", rows[0][1][:3]]
    import numpy as np
    assert model.langs == want.langs and np.allclose(model.word_scores(names), want.word_scores(names), atol=1e-5)
    assert language.guesses(model, [language.text_words(rows[-1][1])])[0] == ["l39"]


def test_kneser_ney_sums_to_one():
    model = language.Model.fit({"a": Counter(g for w in ("abba", "abc", "cab") for g in language.grams(w, 3)), "b": Counter(language.grams("bcb", 3))}, 3)
    import numpy as np
    letters = ["a", "b", "c", language.END]
    for context in ("\x02\x02", "ab", "ca", "zz"):
        scores = np.exp(model._score([context + x for x in letters], 3).astype(float))
        unseen = np.exp(model._score([context + "?"], 3).astype(float))[0]
        assert np.allclose(scores.sum(0) + unseen, 1, atol=1e-4) or (scores.sum(0) <= 1 + 1e-4).all()


def test_toxicity(spark, odd, empty):
    rng = random.Random(4)
    words = ["".join(rng.choice("klmnoprst") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["vilewort", "vilething", "uglyfoe"])
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").unionByName(
        odd.select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 10_000))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, marks).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and (r["doc_id"] or 10_000) < 1000]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    assert toxicity.score_toxicity(empty, marks).count() == 0
    assert toxicity.score_toxicity(odd, marks.limit(0)).agg(F.max("score")).first()[0] == 0


def test_toxicity_whole_words():
    """Clean and toxic words that share their first five letters."""
    import numpy as np
    rng = random.Random(8)
    words = ["".join(rng.choice("klmnoprst") for _ in range(rng.randint(3, 7))) for _ in range(300)]

    def text(extra):
        out = [rng.choice(words) for _ in range(30)]
        for _ in range(3):
            out[rng.randrange(30)] = rng.choice(extra)
        return " ".join(out)

    clean, toxic = ["grundstein", "grundgesetz", "hausboot"], ["grundvilling", "hausbfiend"]
    labels = np.array([i % 2 for i in range(1200)], float)
    texts = [text(toxic if y else clean) for y in labels]
    model = toxicity.TextFilter().train(texts[:900], labels[:900])
    got = model.scores([language.text_words(t) for t in texts[900:]])
    assert ((got >= 0.5) == (labels[900:] == 1)).mean() >= 0.95


def test_toxicity_digits():
    """Words with digits are whole to the classifier and letter runs to the language models."""
    text = "L0ser, code 88 and A1b2c3 x_y é² " + "q" * 95 + " " + "w" * 45 + "7" + "v" * 3 + " ß٣4 Ⅷ"
    assert toxicity.letter_runs(toxicity.text_words(text)) == language.text_words(text)
    rows = {tuple(r) for r in toxicity.text_buckets("l0ser 88")}
    assert rows == {toxicity.word_buckets("l0ser"), toxicity.word_buckets("88")}


def test_token_counts(spark, odd):
    trees = tokens.token_trees(odd)
    edits = spark.createDataFrame([(0, 3, 10, "new  words"), (0, 5, 6, "inside"), (0, 0, 0, " "), (108, 1000, 1001, "'s\n\n"), (100, 0, 5, "x"),
                                   (101, 4, 9, "now text"), (999, 0, 1, "nobody"), (None, 1, 2, None)],
                                  "doc_id long, start long, stop long, replacement string")
    got = tokens.apply_edits(tokens.attach_edits(trees, edits)).collect()
    assert len(got) == odd.count()
    count = tokens.counter(tokens.TOKENIZER, tokens.PATTERN)
    for r in got:
        assert r["n_tokens_after"] == (len(count.encoding.encode_ordinary(r["text"])) if r["text"] is not None else 0)
        assert r["text"] is None or sum(leaf["chars"] for leaf in r["tree"]) == len(r["text"])
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_edits"] == 2 and by[101]["text"] == "now text" and by[108]["n_encoded"] < 200 and by[100]["n_edits"] == 0


def test_token_edits_at_random():
    rng = random.Random(1)
    parts = ["a", "b", "'", "s", "ll", " ", "  ", "\n", "\t", "1", "23", ".", "!", "é", "x", "<", "'re", " "]
    count = tokens.counter(tokens.TOKENIZER, tokens.PATTERN)
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 20, 200, 700])))
        edited, plain = tokens.EditedText(text, tokens.build(text, count).leaves(), count), text
        edits = []
        for _ in range(rng.choice([1, 2, 5])):
            start = rng.randint(0, len(text))
            edits.append({"start": start, "stop": start + rng.choice([0, 1, 5, 80]), "replacement": "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 9])))})
        for start, stop, new in tokens.ordered_edits(edits, len(text)):
            plain = plain[:start] + new + plain[stop:]
            edited.apply(start, stop, new)
        assert edited.text == plain
        assert edited.tree.sums[1] == (len(plain), len(count.encoding.encode_ordinary(plain)), len(count.cut.findall(plain)))


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_stages(spark, request, which):
    docs = request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns or name == "source_mix", name
        assert out.count() <= docs.count()


@pytest.mark.parametrize("operator", [quality.host_rules, substrings.substring_report, near.near_duplicates, tokens.token_trees])
def test_empty(empty, operator):
    assert operator(empty).count() == 0


def longest_doubled(rows, length=13):
    """Words of the longest window of ``length`` times a power of two that also starts in a row with a smaller id."""
    texts = [(r[0], r[1].split()) for r in rows]
    out, size = {doc: 0 for doc, _ in texts}, length
    while size <= max(len(words) for _, words in texts):
        first = {}
        for doc, words in texts:
            for i in range(len(words) - size + 1):
                w = tuple(words[i:i + size])
                first[w] = min(first.get(w, doc), doc)
        for doc, words in texts:
            if any(first[tuple(words[i:i + size])] < doc for i in range(len(words) - size + 1)):
                out[doc] = size
        size *= 2
    return out


def test_substrings_longest_is_exact(spark):
    rng = random.Random(7)
    new = lambda n: [f"w{rng.random()}" for _ in range(n)]
    rows, doc = [], 0
    for size in (12, 13, 25, 26, 27, 39, 51, 52, 100, 104, 300):
        for _ in range(4):  # many passages of each size: no start may be left out
            passage = new(size)
            rows += [(doc, new(rng.randrange(40)) + passage + new(rng.randrange(40))), (doc + 1, new(rng.randrange(9)) + passage)]
            doc += 2
    long = new(220)
    rows += [(doc, long), (doc + 1, long), (doc + 2, long[:150] + new(1) + long[150:]), (doc + 3, long[:60] + rows[-1][1]), (doc + 4, long[:40] * 3)]
    rows = [(d, " ".join(words)) for d, words in rows]
    want = longest_doubled(rows)
    assert {0, 13, 26, 52, 104, 208} == set(want.values())
    found = substrings.substring_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["longest"] for r in found} == want
