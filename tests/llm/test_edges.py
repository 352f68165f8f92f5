"""Clashing columns, very long texts, empty tables, and whole queries against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm import _common, chat, imatch, langid, linededup, mixing, pieces, quality, simhash, suffix, topk

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
INTERNAL = ("_n_lines", "_n_dropped", "_hits", "_t1", "_t2", "_id", "_fp", "_fpw", "_component", "_order", "_row_fp", "_leaf", "_t", "_h", "_v", "_cut", "_row", "mix_epoch", "mix_tokens", "h1", "keys", "held", "low", "fp", "component")


@pytest.fixture(scope="module")
def crowded(spark):
    """Rows with a column of every internal name and a map, some of them repeated, with null and repeated ids."""
    rows = [(i, f"shared line\nown words number {i} and some more of them {i}", "en", f"src{i % 3}", 40) for i in range(12)]
    rows += [rows[0], (1, "another text under the same id", "en", "src1", 3), (None, None, None, None, None), (None, "", "en", "src0", 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in INTERNAL})
    return df.withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id"))).cache()


def texts_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("broadcast_keys", [300_000, 0])
def test_line_dedup_beside_any_column(crowded, broadcast_keys):
    out = linededup.drop_frequent_lines(crowded, 10, broadcast_keys=broadcast_keys)
    assert out.columns == [*crowded.columns, "_n_lines_", "_n_dropped_"]
    want = Counter((r.doc_id, r.text.replace("shared line\n", "") if r.text else r.text) for r in crowded.collect())
    assert texts_of(out) == want and out.where("_n_lines <> 7 or _hits <> 7").count() == 0
    assert out.agg(F.sum("_n_dropped_")).first()[0] == 13


def test_keep_one_beside_any_column(crowded):
    for find, mark in ((simhash.near_duplicates, simhash.fingerprint), (simhash.near_copies, simhash.set_key)):
        kept = simhash.keep_one(crowded, find=find, mark=mark)
        groups = {r.component for r in find(crowded).collect()}
        assert kept.columns == crowded.columns and kept.count() == len(groups)
        alone = simhash.keep_one(crowded.where("doc_id > 1"), find=find, mark=mark)  # ids tell rows apart here
        assert alone.columns == crowded.columns and alone.where("_fp <> 7").count() == 0


def test_stages_beside_any_column(spark, crowded):
    for stage in (langid.stage, linededup.stage, simhash.stage, mixing.stage):
        out = stage(spark, crowded, SF)
        assert out.columns == crowded.columns and out.dtypes == crowded.dtypes and 0 < out.count() <= crowded.count()
    assert pieces.stage(spark, crowded, SF).columns == ["doc_id", "n_tokens", "ids"]


def test_refusals():
    assert _common.unused(["A", "b_"], "a", "b", "b") == ["a_", "b", "b__"]


@pytest.fixture(scope="module")
def long_texts(spark):
    texts = ["x" * 2_000_000, " " * 1_000_000, "ab cd " * 300_000, "word " * 400_000, "line\n" * 200_000, "short one"]
    return spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], SCHEMA).cache()


def test_long_texts(spark, long_texts):
    n = long_texts.count()
    model = langid.fit(long_texts)
    assert dict(langid.predict(long_texts, model).select("doc_id", "lang_pred").collect())[1] == "und"
    assert linededup.drop_frequent_lines(long_texts, 1).where("_n_lines > 100000").count() == 1
    assert simhash.near_duplicates(long_texts).count() == n and simhash.near_copies(long_texts).count() == n
    assert imatch.edited_likeness(long_texts).count() == n
    got = {r.doc_id: r for r in suffix.repeated_spans(long_texts).collect()}
    assert [bytes(got[i].kept) for i in range(6)] == [b"x", b" ", b"ab cd ", b"word ", b"line\n", b"short one"]  # a period stays, as its windows start first
    assert quality.with_statistics(long_texts, ["doc_id"]).count() == n
    assert pieces.decode(pieces.encode(long_texts)).where(F.length("text") > 100_000).count() == 5
    assert mixing.mix(long_texts, mixing.levels(), budget=1.0, max_epochs=1).agg(F.sum("mix_tokens")).first()[0] == 1 + 600_000 + 400_000 + 200_000 + 2


def test_long_turns(spark):
    rows = [(1, 0, "user", "a <s> " * 200_000), (1, 1, "assistant", "b\\" * 300_000)]
    ex = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = ex.select(chat.target_text(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss"), chat.read_back(F.col("text")).alias("turns")).collect()
    assert [r.loss for r in got] == [rows[1][3]] and [t.text for t in got[0].turns] == [r[3] for r in rows]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.expand(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    model = quality.train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert model["rules"] == [] and quality.with_statistics(empty, ["doc_id"]).count() == 0
    none = spark.createDataFrame([], "vec_id long, v array<double>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, v array<double>")
    assert topk.top_k(none, none).count() == topk.top_k(none, some).count() == topk.top_k(some, none).count() == topk.top_k(some, some).count() == 0
    assert linededup.frequent_keys(empty, 2, 1, 4).count() == 0
    for stage in (langid.stage, linededup.stage, simhash.stage, mixing.stage, pieces.stage):
        assert stage(spark, empty, SF).count() == 0


def test_compaction_moves_no_rows(spark):
    """Two runs are merged bucket by bucket: the plan has no exchange."""
    runs = linededup.LineRuns(spark, 10)
    a, b = (runs._write(spark.range(100).selectExpr("id as h1", "-id as h2", "1L as n"), True) for _ in range(2))
    plan = runs._merge([a, b])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "SelectedBucketsCount" in plan


def test_nothing_is_left_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    suffix.repeated_spans(spark.read.parquet(f"{SF}/documents.parquet")).count()
    linededup.op2_line_dedup(spark, SF).count()
    assert {t.name for t in spark.catalog.listTables()} == before


# Brute force.


def brute_language(rows, alpha=0.1):
    """Plain dictionaries: (words, n-grams by order) of labelled rows, and a function of a text."""
    counts: dict = {}
    langs = sorted({lang for _, lang in rows if lang is not None})
    for t, lang in rows:
        if lang is not None:
            for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
                w = "".join(c for c in w if c.isalpha())
                if w:
                    counts.setdefault(w, dict.fromkeys(langs, 0))[lang] += 1

    def logs(table):
        total = {x: sum(c[x] for c in table.values()) + alpha * max(1, len(table)) for x in langs}
        return {k: [math.log(c[x] + alpha) - math.log(total[x]) for x in langs] for k, c in table.items()}

    orders = []
    for n in (5, 4, 3, 2, 1):
        sums: dict = {}
        for w, c in counts.items():
            framed = f"^{w}$" if n > 1 else w
            for i in range(len(framed) - n + 1):
                g = sums.setdefault(framed[i : i + n], dict.fromkeys(langs, 0.0))
                for x in langs:
                    g[x] += math.log1p(c[x])
        orders.append((n, logs(sums)))
    known = logs(counts)

    def evidence(w):
        if w in known:
            return known[w]
        for n, table in orders:
            framed = f"^{w}$" if n > 1 else w
            if hits := [table[framed[i : i + n]] for i in range(len(framed) - n + 1) if framed[i : i + n] in table]:
                return [sum(h[k] for h in hits) / len(hits) for k in range(len(langs))]
        return [0.0] * len(langs)

    def predict(t):
        words = Counter("".join(c for c in w if c.isalpha()) for w in re.findall(r"[^\W\d_]+", (t or "").lower()))
        words.pop("", None)
        n = sum(words.values())
        if not n or not langs:
            return "und", 0.0
        total = [0.0] * len(langs)
        for w, c in words.items():
            for k, e in enumerate(evidence(w)):
                total[k] += c * e
        total = [x * min(1.0, 20 / n) for x in total]
        p = [math.exp(x - max(total)) for x in total]
        return langs[p.index(max(p))], max(p) / sum(p)

    return predict


def held_out(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 3 == 1


def test_op1_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    predict = brute_language([(r.text, r.lang) for r in rows if not held_out(r.doc_id)])
    got = {r.doc_id: r for r in langid.op1_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, score = predict(r.text)
        assert (got[r.doc_id].held_out, got[r.doc_id].lang_pred) == (held_out(r.doc_id), lang) and got[r.doc_id].score == pytest.approx(score, abs=1e-4)


def test_op1_and_op7_on_held_out_labels(spark):
    lang = dict(spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "lang").collect())
    got = [r for r in langid.op1_language_id(spark, SF2).collect() if r.held_out and lang[r.doc_id] is not None]
    assert len(got) > 100 and np.mean([r.lang_pred == lang[r.doc_id] for r in got]) >= 0.97
    label = dict(spark.read.parquet(f"{SF2}/labels.parquet").select("doc_id", "quality").collect())
    got = [r for r in quality.op7_quality_rules(spark, SF2).collect() if r.held_out and label.get(r.doc_id) is not None]
    pairs = [(a.score, b.score) for a in got for b in got if label[a.doc_id] > label[b.doc_id]]
    assert len(got) > 50 and np.mean([(a > b) + 0.5 * (a == b) for a, b in pairs]) >= 0.95 and np.mean([r.predicted == label[r.doc_id] for r in got]) >= 0.93


def test_op7_statistics_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in quality.with_statistics(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    for r in rows:
        t = r.text or ""
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
        n, w = max(1, len(t)), max(1, len(words))
        g = got[r.doc_id]
        assert (g.s_log_chars, g.s_log_words, g.s_mean_word, g.s_distinct) == pytest.approx((math.log1p(len(t)), math.log1p(len(words)), len(t) / w, len(set(words)) / w))
        assert (g.s_digit, g.s_stop, g.s_bang, g.s_bar, g.s_newline) == pytest.approx((len(re.findall("[0-9]", t)) / n, len(re.findall("[.,;:?]", t)) / n, t.count("!") / n, t.count("|") / n, t.count("\n") / n))


def xxh(value, seed=42):
    """Spark's xxhash64 of a string, a long or an array, as an unsigned number."""
    if isinstance(value, list):
        for v in value:
            seed = xxh(v, seed)
        return seed
    raw = value.encode() if isinstance(value, str) else (value & (2**64 - 1)).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(raw, seed)


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def test_op5_against_brute_force(spark):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    terms = lambda t: list(dict.fromkeys(w for w in re.split(r"[^\w]|_", t.lower()) if w))
    distinct = {t for _, t in rows}
    n = Counter(w for t in distinct for w in terms(t))

    def level_of(h, k):
        seeded = xxhash.xxh64_intdigest((k & 0xFFFFFFFF).to_bytes(4, "little"), xxh(signed(h)))
        return min(15, math.floor(-math.log2(((seeded >> 11) + 0.5) / 2**53)))

    lex = {xxh(w): [level_of(xxh(w), k) for k in range(imatch.DRAWS)] for w, c in n.items() if max(2, 0.0005 * len(distinct)) <= c <= 0.5 * len(distinct)}
    short = lambda h: max(1, h & 0x7FFFFFFF)

    def fingerprint(t):
        own = [xxh(w) for w in terms(t)]
        level = max(0, min(16 - imatch.LEVELS, math.floor(math.log2(max(1, len(own))) + 0.5) - 1))
        out = []
        for j in range(imatch.LEVELS):
            for k in range(imatch.DRAWS):
                kept = sorted(signed(h) for h in own if h in lex and lex[h][k] >= level + j)
                out.append(short(xxh(kept)) if kept else 0)
        if not any(out):
            out = [short(xxh(sorted(map(signed, own))) if own else xxh(t))] * len(out)
        return level, out

    def likeness(a, b):
        d, m = a[0] - b[0], imatch.DRAWS
        if abs(d) >= imatch.LEVELS:
            return 0.0
        size = (imatch.LEVELS - abs(d)) * m
        x, y = a[1][max(0, -d) * m :][:size], b[1][max(0, d) * m :][:size]
        return sum(p == q != 0 for p, q in zip(x, y, strict=True)) / max(1, sum((p, q) != (0, 0) for p, q in zip(x, y, strict=True)))

    got = {r.doc_id: r for r in imatch.op5_imatch(spark, SF).collect()}
    text = lambda f: f"{f[0]:X}-" + "".join(f"{x:08x}" for x in f[1])
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        f, e, a = map(fingerprint, (t, edited, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), text(f), text(e))
        assert (r.near_edited, r.near_next) == pytest.approx((likeness(f, e), likeness(f, a)))


def test_op5_tells_edits_from_neighbours(spark):
    got = imatch.op5_imatch(spark, SF2).collect()
    assert np.mean([r.near_edited > r.near_next for r in got]) >= 0.9


def test_pipeline_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    predict = brute_language([(r[1], r[2]) for r in rows if not held_out(r[0])])
    rows = [r for r in rows if (p := predict(r[1]))[0] != "und" and p[1] >= 0.3]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    found = Counter(k for r in rows for k in {key(x) for x in r[1].split("\n")} if k)
    rows = [(r[0], "\n".join(x for x in r[1].split("\n") if found[key(x)] < 10), *r[2:]) for r in rows]

    def held(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        return frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets, up = [held(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    best: dict = {}
    for k, r in enumerate(rows):
        if r[0] < best.get(root(k), r)[0] or root(k) not in best:
            best[root(k)] = r
    rows = [(r[0], r[1], r[2], r[3], len(r[1])) for r in best.values()]
    frame = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema)
    h = mixing.content_of(frame)
    keyed = frame.select("doc_id", "text", *[F.coalesce(c.cast("string"), F.lit("\0null")).alias(k) for k, c in mixing.levels().items()], h.alias("h"), F.struct(mixing.ordered(h, 17, F.lit(0)), h).alias("place")).collect()
    leaves: dict = {}
    for r in keyed:
        leaves.setdefault((r.domain, r.lang, r.source), []).append((tuple(r.place), len(re.findall("[^\x20\x09-\x0D]+", r.text)), r))
    size = {p: sum(n for _, n, _ in v) for p, v in leaves.items()}
    tree = {p: (tuple(mixing.WEIGHTS.get(p[: d + 1], 1.0) for d in range(3)), n) for p, n in size.items()}
    want, lib = {}, sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for p, n in mixing.shares(tree, int(0.6 * sum(size.values()))).items():
        spent = 0
        for _, t, r in sorted(leaves[p], key=lambda x: x[0]):
            if n > 0 and (n >= size[p] or spent < n):
                want[r.doc_id] = lib.encode(r.text)
                spent += t
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
