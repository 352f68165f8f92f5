"""Large units, very long words, samples of many rows, and the rule ensemble by its rules."""

import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quillspan.llm import _common, pieces, quality, simhash


def groups_of(rows):
    """Ids by component of texts linked at a five-word Jaccard of 0.8 or more, compared all with all."""
    sets = [set(simhash.shingles(t).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                up[root(i)] = root(j)
    out = {}
    for i, (k, _) in enumerate(rows):
        out.setdefault(root(i), set()).add(k)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("unit", [3, 16])
def test_large_units_lose_no_link(spark, monkeypatch, unit):
    monkeypatch.setattr(simhash, "UNIT", unit)
    rng = np.random.default_rng(0)
    word = lambda: f"w{int(rng.integers(5000))}"
    rows, n = [], 0
    base = [word() for _ in range(60)]
    chain = list(base)
    for _ in range(60):  # variants of one text, and a chain that drifts away from it
        a = list(base)
        a[int(rng.integers(60))] = word()
        rows.append((n, " ".join(a)))
        chain[int(rng.integers(60))] = word()
        rows.append((n + 1, " ".join(chain)))
        n += 2
    half = base[:30] + [word() for _ in range(30)]  # shares a band now and then, but is no near copy of the base
    for _ in range(20):
        a = list(half)
        a[int(rng.integers(60))] = word()
        rows.append((n, " ".join(a)))
        n += 1
    rows += [(n + i, " ".join(word() for _ in range(40))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {}
    for r in simhash.near_copies(df).collect():
        got.setdefault(r.component, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == groups_of(rows)


@pytest.mark.parametrize("whole", [7, 1000])
def test_long_words_in_pieces(monkeypatch, whole):
    model, library = pieces.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    monkeypatch.setattr(pieces, "WHOLE", whole)
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("etaoinshrdlüß字🙂0_.\t"), size=n)) for n in (6, 7, 8, 13, 14, 15, 90, 1500, 4000)]
    texts = [*words, " ".join(words), "a" * 3000, "", None, "plain words beside " + words[-1]]
    ids, n = pieces.encode_texts(model, texts, {})
    at = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t or "")


def test_a_word_of_two_million_characters(spark):
    df = spark.createDataFrame([(0, "x" * 2_000_000), (1, None)], "doc_id long, text string")
    got = {r.doc_id: r.n for r in pieces.decode(pieces.encode(df)).select("doc_id", F.length("text").alias("n")).collect()}
    assert got == {0: 2_000_000, 1: 0}


def test_chance_is_fine_and_even(spark):
    x = np.array([r.c for r in spark.range(20_000).select(_common.chance("id").alias("c")).collect()])
    assert x.min() >= 0 and x.max() < 1 and np.abs(np.histogram(x, 10, (0, 1))[0] / 2000 - 1).max() < 0.1
    assert len(np.unique(np.floor(x * 2**52) % 8)) == 8  # finer than a millionth


def test_the_other_statistics(spark):
    texts = ["ÄBc dé", "no no yes yes", "a  a a\tb b.", "x = y ~ z; #1", "", None, "Echo echo echo", "ünï ünï"]
    got = {r.i: r for r in quality.with_statistics(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ["i"]).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        n, w = max(1, len(t)), max(1, len(t.split()))
        assert got[i].s_upper == pytest.approx(sum(c.isupper() for c in t) / n)
        assert got[i].s_odd == pytest.approx(sum(not (c.isalpha() or c.isdigit() or c.isspace() or c in ".,;:?'!|-") for c in t) / n)
        assert got[i].s_echo == pytest.approx(len(re.findall(r"(?<!\S)(\S+)\s+\1(?!\S)", t)) / w)


def test_compiled_score_is_the_sum_of_the_rules_that_hold(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["One", "two!", "three|", "4", "five,", "~"], size=int(rng.integers(0, 40)))) for _ in range(300)]
    rows = quality.with_statistics(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ["i"])
    got = rows.orderBy("i").toPandas()
    x = got[[f"s_{k}" for k in quality.NAMES]].to_numpy(float)
    model = quality.fit(x, (x[:, 0] + rng.normal(0, 0.3, 300) > np.median(x[:, 0])).astype(int))
    assert len(model["rules"]) > 3
    want = 1 / (1 + np.exp(-(model["base"] + sum(w * quality.holds(x, r) for r, w in model["rules"]))))
    score = [r.s for r in rows.select("i", quality.compiled(model).alias("s")).orderBy("i").collect()]
    assert score == pytest.approx(want.tolist(), abs=1e-12)


def test_training_with_doubled_labels_and_nulls(spark):
    docs = spark.createDataFrame([(i, "good text here. " * (i % 7 + 1) if i % 2 else "!!! |||| 1234 " * (i % 5 + 1)) for i in range(60)] + [(1, "good text again."), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (3, 1), (None, 1), (5, None), (999, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    score = {r.doc_id: r.s for r in quality.with_statistics(docs, ["doc_id"]).select("doc_id", quality.compiled(model).alias("s")).collect()}
    assert score[11] > 0.5 > score[10]


def test_lexicon_counts_each_text_once(spark):
    from quillspan.llm import imatch

    rows = [("a b c",)] * 50 + [("b c d",)] * 2 + [("c d e f",), ("c", ), (None,), ("",), ("",)]
    df = spark.createDataFrame(rows, "text string").repartition(3)
    got = [{r.h: r["mask"] for r in imatch.lexicon(df, "text", 0.0, 1.0, 2, limit).collect()} for limit in (10, 0)]
    h = {r.t: r.h for r in spark.createDataFrame([(t,) for t in "abcdef"], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    assert got[0] == got[1] and set(got[0]) == {h["b"], h["c"], h["d"]}


def test_the_near_dedup_stage_links_by_simhash_and_by_jaccard(spark):
    """Texts whose fingerprints are near but whose word sets are not stay once, as do those that share words but no near fingerprint."""
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choice(words, 12)) for _ in range(60)]
    once = [f"{t} {t}" for t in base]  # repeats change counts of shingles, not their set
    loud = "x y z " * 4000
    texts = [*base, *once, *(loud + t for t in base[:20])]  # one shingle's bits hold the fingerprint, the rest make the sets unlike
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    jaccard = [simhash.shingles(t) for t in texts[120:122]]
    assert len(np.intersect1d(*jaccard)) < 0.5 * len(np.union1d(*jaccard)) and bin(simhash.fingerprint(texts[120]) ^ simhash.fingerprint(texts[121])).count("1") <= 3
    kept = {r.doc_id for r in simhash.stage(spark, df, "").collect()}
    prints, n = [simhash.fingerprint(t) for t in texts], len(texts)
    sets, up = [simhash.shingles(t) for t in texts], list(range(n))
    for i in range(n):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3 or len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])):
                a, b = sorted((up[i], up[j]))
                up = [a if u == b else u for u in up]
    assert kept == set(up) and 120 in kept and not kept & set(range(121, 140))
