"""Language identification: known words first, then ever shorter character n-grams.

A word seen in training is scored by its log frequency in each language. An unseen word falls back to
its 5-grams with word boundaries; if none is known, to 4-grams, and so on down to single characters.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import chance, held_out, lean, modest_batches, read, slices

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
UNDETERMINED = "und"
CHUNK = 1 << 20  # bytes of text scored at once


def words_of(text: str | None) -> Counter:
    """Lower-cased letter runs of a text with their counts."""
    found = Counter(WORD.findall(text.lower())) if text else Counter()
    for w in [w for w in found if not w.isalpha()]:  # such as a fraction sign: numeric, but no letter
        n = found.pop(w)
        if kept := "".join(c for c in w if c.isalpha()):
            found[kept] += n
    return found


def _count_words(batches):
    for b in batches:
        for i, j in slices(b.column(0), 8 * CHUNK):
            counts: dict = defaultdict(Counter)
            for text, lang in zip(b.column(0).slice(i, j - i).to_pylist(), b.column(1).slice(i, j - i).to_pylist(), strict=True):
                counts[lang].update(words_of(text))
            words = pa.array([w for c in counts.values() for w in c], pa.string())
            langs = pa.array([lang for lang, c in counts.items() for _ in c], pa.string())
            yield pa.RecordBatch.from_arrays([words, langs, pa.array([n for c in counts.values() for n in c.values()], pa.int64())], names=["word", "lang", "n"])


def _hashes(strings, size: int = -1) -> np.ndarray:
    h64 = xxhash.xxh3_64_intdigest
    return np.fromiter((h64(s) for s in strings), np.uint64, size)


def fit(labelled: DataFrame, max_docs_per_lang: int = 4000, max_words: int | None = None, max_grams: int | None = None, alpha: float = 0.1) -> dict:
    """Learn word and n-gram tables from columns ``text`` and ``lang``; null languages are ignored.

    The sample's bound is a parameter: each language gives about ``max_docs_per_lang`` whole documents
    (chosen by a hash of text and language, so repeated rows come together). Every word and n-gram of the sample is kept, unless
    ``max_words`` (word, language) entries or ``max_grams`` n-grams of an order, the most frequent, are
    asked for; ties go to the smaller word, or the smaller hash. The model is packed: words and n-grams are sorted
    64-bit hashes with a row of log frequencies each. An empty table, or one without a language, gives a
    model without languages; null and empty texts teach nothing; a text of any length is read whole.
    """
    labelled = labelled.select("text", "lang").where("lang is not null")
    share = {r["lang"]: min(1.0, max_docs_per_lang / r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(share)
    if not langs:
        return {"langs": []}
    pick = F.lit(False)
    for lang, p in share.items():
        pick = pick | ((F.col("lang") == lang) & (chance("text", "lang") < p))
    rows = labelled.where(pick).mapInArrow(lean(_count_words), "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    if max_words is not None:
        rows = rows.orderBy(F.desc("n"), "word", "lang").limit(max_words)
    got = rows.toArrow().combine_chunks().sort_by("word")
    coded = pa.concat_arrays([pa.array([], pa.string()), *got.column("word").chunks]).dictionary_encode()
    words = coded.dictionary  # in order, held by Arrow; only pieces of it become Python strings
    table = np.zeros((len(words), len(langs)))
    if got.num_rows:
        table[coded.indices.to_numpy(), np.searchsorted(langs, got.column("lang").to_pylist())] = got.column("n").to_numpy()
    del got, coded
    parts = [words.slice(k, 1 << 15) for k in range(0, len(words), 1 << 15)]
    grams = []
    for n in ORDERS:
        keys, sums = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
        for k, part in enumerate(p.to_pylist() for p in parts):
            sizes = np.fromiter((max(0, len(w) + (3 if n > 1 else 1) - n) for w in part), np.int64, len(part))
            h = _hashes((g for w in part for g in grams_of(w, n)), int(sizes.sum()))
            weight = np.log1p(table[(k << 15) + np.repeat(np.arange(len(part)), sizes)])
            keys, gram = np.unique(np.concatenate([keys, h]), return_inverse=True)
            weight = np.concatenate([sums, weight])
            sums = np.stack([np.bincount(gram, weight[:, i], len(keys)) for i in range(len(langs))], axis=1)
        if max_grams is not None and len(keys) > max_grams:
            top = np.sort(np.lexsort([keys, -sums.sum(axis=1)])[:max_grams])
            keys, sums = keys[top], sums[top]
        grams.append((n, keys, _log_share(sums, alpha)))
    h = _hashes((w for part in parts for w in part.to_pylist()), len(words))
    order = np.argsort(h)
    return {"langs": langs, "words": h[order], "table": _log_share(table, alpha)[order], "grams": grams}


def _log_share(counts: np.ndarray, alpha: float) -> np.ndarray:
    total = counts.sum(axis=0) + alpha * max(1, len(counts))
    return (np.log(counts + alpha) - np.log(total)).astype(np.float32)


def grams_of(word: str, n: int) -> list[str]:
    framed = f"^{word}$" if n > 1 else word
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted hashes among sorted keys, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def evidence(model: dict, words: list[str]) -> np.ndarray:
    """A row a word: its log frequencies, or of an unseen word the mean of its known n-grams of the longest order that has any."""
    at, known = _find(model["words"], _hashes(words, len(words)))
    out = np.zeros((len(words), len(model["langs"])))
    out[known] = model["table"][at[known]]
    left = np.flatnonzero(~known)
    for n, keys, table in model["grams"]:
        if not len(left):
            break
        grams = [grams_of(words[i], n) for i in left.tolist()]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        at, hit = _find(keys, _hashes((g for x in grams for g in x), int(sizes.sum())))
        owner, at = np.repeat(np.arange(len(left)), sizes)[hit], at[hit]
        count = np.bincount(owner, minlength=len(left))
        told = count > 0
        for k in range(out.shape[1]):
            out[left[told], k] = np.bincount(owner, table[at, k], len(left))[told] / count[told]
        left = left[~told]
    return out


def predict_texts(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Languages and scores (0 to 1) of texts. Null or letterless text, or a model without languages: (``und``, 0.0). Ties go to the first name."""
    langs, index, docs, ids, counts = model["langs"], {}, [], [], []
    for i, t in enumerate(texts if langs else ()):
        found = words_of(t)
        docs.append(np.full(len(found), i, np.int32))
        ids += [index.setdefault(w, len(index)) for w in found]
        counts += found.values()
    score, best = np.zeros(len(texts)), np.full(len(texts), -1)
    if ids:
        docs, counts = np.concatenate(docs), np.array(counts, np.float64)
        of = evidence(model, list(index))[np.array(ids)] * counts[:, None]
        n = np.bincount(docs, counts, len(texts))
        total = np.stack([np.bincount(docs, of[:, k], len(texts)) for k in range(len(langs))], axis=1)
        total *= np.minimum(1.0, 20 / np.maximum(n, 1))[:, None]  # long texts do not saturate the score faster than 20 words
        p = np.exp(total - total.max(axis=1, keepdims=True))
        best = np.where(n > 0, p.argmax(axis=1), -1)
        score = np.where(n > 0, p.max(axis=1) / p.sum(axis=1), 0.0)
    return [langs[k] if k >= 0 else UNDETERMINED for k in best.tolist()], score


def predict_one(model: dict, text: str | None) -> tuple[str, float]:
    names, score = predict_texts(model, [text])
    return names[0], float(score[0])


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, repeated rows too; the whole text is read. Other columns play no part."""
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        for b in batches:
            for i, j in slices(b.column(1), CHUNK):
                names, p = predict_texts(m, b.column(1).slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(p)], names=["id", "lang_pred", "score"])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return frame.mapInArrow(lean(score), f"id {frame.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: dict, min_score: float = 0.3) -> DataFrame:
    """Rows of ``docs``, unchanged and with all their columns, whose language is determined with at least ``min_score``.

    Null, empty and letterless texts go, whatever else the row holds; a text of any length is read whole; repeated rows are judged alike, and an empty table stays empty.
    """
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def sift(batches):
        m = shared.value
        for b in batches:
            for i, j in slices(b.column(at), CHUNK):
                part = b.slice(i, j - i)
                names, p = predict_texts(m, part.column(at).to_pylist())
                yield part.filter(pa.array((np.array(names) != UNDETERMINED) & (p >= min_score)))

    return docs.mapInArrow(lean(sift), docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from rows that are not held out; see :func:`predict_one`."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out("doc_id")))
    out = predict(docs, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language cannot be told (as in ``keep_identified``) are rejected."""
    return keep_identified(docs, fit(docs.select("doc_id", "text", "lang").where(~held_out("doc_id"))))
