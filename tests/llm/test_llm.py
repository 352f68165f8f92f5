"""The text operators against brute force on small tables with nulls, ties, repeats and extra columns."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash

import corpus_pipeline
from quillspan.llm import _common, chat, imatch, langid, linededup, mixing, pieces, quality, simhash, suffix, topk
from quillspan.llm.entry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
BASE = "The quick brown fox jumps over the lazy dog while seven wizards brew a potion in the old stone tower near the river bank today"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [BASE, BASE, BASE + " again", None, "", "  ", "\n\n\n", "a", "x" * 500, "shared line\nown one", *[f"shared line\nown {k}\n Shared LINE\t" for k in range(11)], BASE.upper(), "é☃\0 tab\tend", "ab" * 300, BASE + "\n" + BASE]
    rows = [(i, t, "en" if i % 5 else None, f"src{i % 3}" if i % 7 else None, len(t or ""), 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id " + BASE, None, None, None, None)], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(fp, budget):
    up = list(range(len(fp)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fp)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= budget:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return [root(x) for x in range(len(fp))]


def brute_fingerprint(text):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(low))
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_language_backoff(spark, docs, empty):
    train = spark.createDataFrame([("the house and the tree", "en"), ("das Haus und der Baum", "de"), (None, "en"), ("the", None)], "text string, lang string")
    model = langid.fit(train)
    assert model["langs"] == ["de", "en"]
    assert langid.predict_one(model, "the tree")[0] == "en"
    assert langid.predict_one(model, "hausbaum")[0] == "de"  # unseen: character n-grams
    for t in (None, "", "123 !?", "½"):
        assert langid.predict_one(model, t) == ("und", 0.0)
    assert 0 <= langid.predict_one(model, "the " * 5000)[1] <= 1
    assert langid.predict(docs, model).count() == docs.count()
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").count() == 0


def test_language_fit_without_letters(spark):
    model = langid.fit(spark.createDataFrame([("12 34", "x"), ("", "y")], "text string, lang string"))
    assert model["langs"] == ["x", "y"] and len(model["words"]) == 0
    assert langid.predict_one(model, "word")[1] == pytest.approx(0.5)


def test_held_out(spark):
    got = {r.i: r.h for r in spark.range(20).select("id", _common.held_out("id").alias("h")).toDF("i", "h").collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(20)}


@pytest.mark.parametrize("broadcast_keys", [300_000, 0])
def test_line_dedup(docs, empty, broadcast_keys):
    out = linededup.drop_frequent_lines(docs, 10, broadcast_keys=broadcast_keys)
    got = {(r.doc_id, r._n_lines, r._n_dropped, r.text) for r in out.collect()}
    assert (10, 3, 2, "own 0") in got and (9, 2, 1, "own one") in got and (6, 4, 0, "\n\n\n") in got and (3, 1, 0, None) in got
    assert out.count() == docs.count()
    assert linededup.drop_frequent_lines(empty).count() == 0


def test_line_runs_levels(spark):
    runs = linededup.LineRuns(spark, 4)
    for _ in range(5):
        runs.ingest(spark.createDataFrame([(k, -k, 1) for k in range(20)] + [(100, 1, 3)], "h1 long, h2 long, n long"))
    assert {r.h1 for r in runs.settle().collect()} == {*range(20), 100}


def test_line_batches_grow(spark):
    assert [linededup.batches_for(n) for n in (0, 10_000, 50_000, 250_000, 15_000_000)] == [4, 4, 6, 10, 22]
    runs, levels = linededup.LineRuns(spark, 10), set()
    for _ in range(9):
        runs.ingest(spark.createDataFrame([(k, -k, 1 + k) for k in range(12)], "h1 long, h2 long, n long"))
        levels |= set(runs.levels)
        assert len(runs.settled) < 3
    assert 2 in levels and sorted(r.h1 for r in runs.settle().collect()) == list(range(1, 12))


@pytest.mark.parametrize("max_unit", [16384, 2])
def test_simhash_against_brute_force(spark, docs, max_unit):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = np.random.default_rng(1)
    words = BASE.split() * 8
    for k in range(60):
        w = list(words)
        w[rng.integers(len(w))] = f"w{k}"
        rows.append((1000 + k, " ".join(w)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), max_unit=max_unit).collect()
    fp = [brute_fingerprint(t) for _, t in rows]
    root = components(fp, 3)
    low = {}
    for (i, _), r in zip(rows, root, strict=True):
        low[r] = min(x for x in (low.get(r), i) if x is not None) if (low.get(r), i) != (None, None) else None
    want = sorted(((i, f, low[r]) for (i, _), f, r in zip(rows, fp, root, strict=True)), key=str)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=str) == want


def test_links_at_the_budget():
    rng = np.random.default_rng(3)
    key = np.sort(np.unique(np.concatenate([rng.integers(0, 2**64, 40, dtype=np.uint64), np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64))])))
    want = {(i, j) for j in range(len(key)) for i in range(j) if (int(key[i]) ^ int(key[j])).bit_count() <= 3}
    got = {tuple(sorted(p)) for i, j in simhash.links(np.zeros(len(key), np.int64), np.zeros(len(key), np.int32), key, 3) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == want


def test_keep_one(docs, empty):
    kept = simhash.keep_one(docs)
    comps = {r.component for r in simhash.near_duplicates(docs).collect()}
    assert kept.count() == len(comps) and kept.columns == docs.columns
    assert simhash.keep_one(empty).count() == 0


def test_stage_against_brute_force_jaccard(spark, docs, empty):
    rng = np.random.default_rng(4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for g in range(12):  # groups whose texts are about 0.8 alike, and chains of edits
        words = [f"g{g}v{k}" for k in rng.integers(0, 400, int(rng.integers(20, 300)))]
        for k in range(12):
            w = list(words)
            for _ in range(max(1, int(rng.integers(0, len(w) // 25 + 1)))):
                w[rng.integers(len(w))] = f"w{g}_{k}_{rng.integers(1000)}"
            words = w if k % 3 == 0 else words
            rows.append((1000 + 100 * g + k, " ".join(w)))

    def held(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        return frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets, up = [held(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    low = {}
    for k, (i, _) in enumerate(rows):
        low.setdefault(root(k), []).append(i)
    low = {r: min((x for x in i if x is not None), default=None) for r, i in low.items()}
    want = sorted(((i, low[root(k)]) for k, (i, _) in enumerate(rows)), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in simhash.near_copies(frame).collect()), key=str) == want
    kept = simhash.stage(spark, frame, SF)
    assert kept.count() == len(low) and {r.doc_id for r in kept.collect()} == set(low.values())
    assert simhash.stage(spark, empty, SF).count() == 0


def test_chat(spark, empty):
    said = ["</s>[INST] ok [/INST]", "\\ <s> \\<s> [INST", None, "", "<\\s>", "é☃"]
    rows = [(1, k, ("user", "assistant", "assistant", "system", None, "we<s>ird")[k], t) for k, t in enumerate(said)] + [(2, 0, "user", "x"), (None, None, "assistant", "y"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    ex = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    from pyspark.sql import functions as F

    got = ex.select("*", chat.read_back(F.col("text")).alias("turns"), chat.target_text(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss")).collect()
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.example)
    assert [r.trainable for r in one] == [True, True, False] and [r.loss for r in one[:2]] == [said[1], ""]
    assert [(t.role, t.text) for t in one[-1].turns] == [(r[2] or "", r[3] or "") for r in rows[:6]]
    assert [r.loss for r in sorted((r for r in got if r.conv_id == 3), key=lambda r: r.example)] == ["same", "same"]


def test_imatch(docs, empty):
    got = imatch.edited_likeness(docs.select("doc_id", "text"), min_docs=1, max_share=1.0, min_share=0.0).collect()
    rows = sorted(((r.doc_id if r.doc_id is not None else -(2**63), r.text or "") for r in docs.collect()))
    want = []
    for k, (i, t) in enumerate(rows):
        h = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - h] + rows[(k + 1) % len(rows)][1][:h]).encode()).hexdigest()))
    assert sorted((r.doc_id if r.doc_id is not None else -(2**63), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by[0] == by[1] and by[0] != by[8]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert imatch.edited_likeness(empty.select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("edited", [False, True])
def test_imatch_of_a_group_of_a_third(spark, edited):
    """Near copies stay alike when copies, or near copies, of their text are a third of all rows."""
    rng = np.random.default_rng(7)
    word = lambda: f"w{int(rng.zipf(1.5)) % 3000}"
    base = [f"h{k}" for k in range(120)]
    edits = [" ".join([*base[:k], f"edit{k}", *base[k + 1 :]]) for k in range(100)]
    group = edits if edited else [" ".join(base)] * 96 + edits[:4]
    texts = [*group, *[" ".join(word() for _ in range(80)) for _ in range(200)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lex = _common.cut(imatch.lexicon(docs))
    got = {r.doc_id: (r.level, r.prints) for r in imatch.fingerprint_rows(docs, ["doc_id"], "text", lex).collect()}
    print_ = "struct<level: int, prints: array<int>>"
    pairs = spark.createDataFrame([(got[96], got[k]) for k in range(97, 100)], f"a {print_}, b {print_}")
    assert all(r[0] > 0.5 for r in pairs.select(imatch.likeness(pairs.a, pairs.b)).collect())


def brute_spans(rows, window):
    seen, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            seen[w] = min(seen.get(w, (i, s)), (i, s))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, int)
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] != (i, s):
                gone[s + 1 : s + window + 1] = 1
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((i, kept, len(b), len(b) - len(kept), int((np.diff(gone) == 1).sum())))
    return sorted(out)


@pytest.mark.parametrize(("share", "hot"), [(0.01, 200), (1.0, 1)])
def test_suffix_dedup(docs, empty, share, hot):
    got = suffix.repeated_spans(docs, 40, sample_share=share, hot_records=hot).collect()
    rows = [(r.doc_id if r.doc_id is not None else -(2**63), r.text) for r in docs.collect()]
    assert sorted((r.doc_id if r.doc_id is not None else -(2**63), bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in got) == brute_spans(rows, 40)
    assert suffix.repeated_spans(empty).count() == 0


def test_rules_and_compiled_columns(spark, docs):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(quality.NAMES)))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(int)
    model = quality.fit(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"s_{k}" for k in quality.NAMES])
    p = np.array([r[0] for r in df.select(quality.compiled(model)).collect()])
    assert ((p >= 0.5) == (y == 1)).mean() > 0.97 and 0 < len(model["rules"]) < 400
    assert quality.fit(np.zeros((0, 12)), np.zeros(0, int))["rules"] == []
    assert quality.with_statistics(docs, ["doc_id"]).select("s_echo").count() == docs.count()


def test_pieces_match_the_library(docs, empty):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.decode(pieces.encode(docs)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert list(r.ids) == lib.encode(texts[r.doc_id] or "") and r.text == (texts[r.doc_id] or "")
    once = pieces.encode(docs, decoded=True).collect()
    assert sorted(map(str, once)) == sorted(map(str, got))
    assert pieces.encode(empty).count() == 0


def test_pieces_on_random_units():
    lib, model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.load()
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abenrst  \n<>0é☃日本"), size=int(n))) for n in rng.integers(0, 60, 300)]
    texts += ["", " ".join(texts), "".join(texts * 3), "ab" * 300]
    want = [lib.encode(t) for t in texts]
    for cache in ({}, {}):
        for _ in range(2):  # the second call reads the cache
            ids, n = pieces.encode_texts(model, texts, cache)
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    assert pieces.decode_ids(pieces.decoder(model), pa.array([*want, None], pa.list_(pa.int32()))).to_pylist() == [*texts, ""]


def test_pieces_of_a_score_model():
    """Relaxation by the largest sum of scores equals a plain search, for short and long units."""
    rng = np.random.default_rng(6)
    names = [pieces.SPACE, "a", "b", "ab", "ba", "aab", "bab", pieces.SPACE + "a", pieces.SPACE + "ba"]
    score = {i: float(-rng.integers(10, 90)) / 7 for i in range(len(names))}
    own = {p: i for i, p in enumerate(names)}
    model = {"text": dict(enumerate(names)), "pieces": own, "all": own, "score": score, "bytes": [None] * 256, "unknown": 99, "control": [], "merges": False, "crosses": False, "vocab": pieces.vocabulary(own), "scores": np.array([score[i] for i in range(len(names))])}
    texts = ["".join(rng.choice(list("abb "), size=int(n))) for n in [*rng.integers(0, 40, 60), 200]] + ["ab" * 60]

    def best(unit):
        sums = [0.0] + [-np.inf] * len(unit)
        for i in range(len(unit)):
            for p, t in own.items():
                if unit.startswith(p, i):
                    sums[i + len(p)] = max(sums[i + len(p)], sums[i] + score[t])
        return sums[-1]

    ids, n = pieces.encode_texts(model, texts, {})
    for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert "".join(names[i] for i in got) == "".join(pieces.units_of(t))
        assert sum(score[i] for i in got.tolist()) == pytest.approx(sum(map(best, pieces.units_of(t))))


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=20)]) for i in range(150)] + [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [0.0] * 20), (204, []), (205, [float("inf")])]
    rows.append((206, rows[3][1]))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", topk.quantised(F.col("e")).alias("v")).where("v is not null")
    for scale, block in ((1.0, 16_384), (1.0, 4), (1e6, 16_384)):
        d = df.select("vec_id", F.transform("v", lambda x: x * scale).alias("v"))
        got = sorted(tuple(r) for r in topk.top_k(d.where("vec_id % 20 = 0"), d, 5, block).collect())
        v = {r.vec_id: [int(x) for x in r.v] for r in d.collect()}
        want = []
        for i in (k for k in v if k % 20 == 0):
            s = sorted((-sum(a * b for a, b in zip(v[i], v[j], strict=False)), j) for j in v if j != i)[:5]
            want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
        assert got == sorted(want)


def test_shares():
    tree = {("a", "x"): ((1.0, 1.0), 10), ("a", "y"): ((1.0, 1.0), 100), ("b", "z"): ((1.0, 1.0), 100)}
    assert mixing.shares(tree, 100) == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}  # siblings first
    assert mixing.shares({**tree, ("a", "y"): ((1.0, 1.0), 20)}, 100) == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 70}  # then ancestors
    assert mixing.shares({}, 10) == {}
    assert sum(mixing.shares(tree, 10_000).values()) == 210


def brute_mix(rows, weights, budget, epochs, places):
    """Rows (leaf, tokens, key) taken by plain budgeting: ``places`` maps (key, epoch) to the order."""
    size = {}
    for leaf, t, _ in rows:
        size[leaf] = size.get(leaf, 0) + t
    tree = {p: (tuple(weights.get(p[: d + 1], 1.0) for d in range(len(p))), n * epochs) for p, n in size.items()}
    out = []
    for leaf, n in mixing.shares(tree, int(budget * sum(size.values()))).items():
        for e in range(epochs):
            spent = 0
            for t, k in sorted(((t, k) for x, t, k in rows if x == leaf), key=lambda x: places[x[1], e]):
                if n > 0 and (n >= (e + 1) * size[leaf] or n - e * size[leaf] > spent):  # a whole epoch, or its prefix
                    out.append((k, e))
                    spent += t
    return sorted(out)


@pytest.mark.parametrize("epochs", [1, 2])
def test_mixing_against_brute_force(spark, docs, empty, epochs):
    from pyspark.sql import functions as F

    extra = docs.withColumns({c: F.lit(1) for c in ("_leaf", "_t", "_h", "_v", "_cut", "_row")}).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    got = mixing.mix(extra, mixing.levels(), mixing.WEIGHTS, budget=0.6, max_epochs=epochs)
    assert got.columns == [*extra.columns, "mix_epoch", "mix_tokens"]
    h = mixing.content_of(extra)
    keyed = extra.select(*[c.alias(k) for k, c in mixing.levels().items()], "text", h.alias("h"), *[F.struct(mixing.ordered(h, 17, F.lit(e)), h).alias(f"p{e}") for e in range(epochs)]).collect()
    count = lambda t: len(re.findall("[^\\x20\\x09-\\x0D]+", t or ""))
    rows = [(tuple("\0null" if x is None else x for x in r[:3]), count(r.text), r.h) for r in keyed]
    places = {(r.h, e): tuple(r[f"p{e}"]) for r in keyed for e in range(epochs)}
    assert sorted(tuple(r) for r in got.select(mixing.content_of(extra), "mix_epoch").collect()) == brute_mix(rows, mixing.WEIGHTS, 0.6, epochs, places)
    assert mixing.mix(empty, mixing.levels()).count() == 0
    twice = mixing.mix(got, mixing.levels(), max_epochs=1)
    assert twice.columns == [*got.columns, "mix_epoch_", "mix_tokens_"]


def test_mixing_of_equal_rows(spark):
    """A leaf of one row, repeated: exactly as many are taken as the budget reaches."""
    docs = spark.createDataFrame([("a b c", "en", "src0")] * 50 + [(None, "en", "src0")], "text string, lang string, source string")
    got = mixing.mix(docs, mixing.levels(), budget=0.5, max_epochs=1)
    assert got.where("text is not null").count() == 25
    assert mixing.mix(docs, mixing.levels(), budget=10**9, max_epochs=2).where("text is not null").count() == 100


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, SF)
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    take = lambda rows, names: sorted(tuple(r[names.index(c)] for c in order) for r in rows)
    assert take(got.collect(), got.columns) == take(want.fetchall(), want.columns)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(out) <= docs.count() and len({r.doc_id for r in out}) == len(out)
    assert all(r.n_tokens == len(r.ids) for r in out)
