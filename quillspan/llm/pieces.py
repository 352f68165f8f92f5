"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (a space mark with the letters after it; no piece crosses into the next
mark) are concatenated and indexed by a suffix array that is sorted through the longest piece. Every
piece of the vocabulary is binary-searched for the range of its occurrences; the occurrences become
edges, which are sorted by position and relaxed from left to right. For a merge (BPE) model, the best
piece that ends at a position is the one that is compatible with the best piece that ends where it
begins: merging the two together leaves them apart. That yields the segmentation of the merge order.
For a unigram model the relaxation keeps the largest sum of scores.
"""

from __future__ import annotations

import heapq
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, modest_batches, read, settle_executors

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BATCH_UNITS, BATCH_CHARS = 15_000, 500_000


def load(path: str = MODEL) -> dict:
    """Vocabulary of a model file, read with the library: a plain dictionary of bounded size."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    text = {i: m.id_to_piece(i) for i in ids}
    normal = [i for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    raw = {m.id_to_piece(i): i for i in ids if m.is_byte(i)}
    special = [i for i in ids if m.is_control(i)]
    model = {"text": text, "pieces": {text[i]: i for i in normal}, "all": {text[i]: i for i in normal}, "score": {i: m.get_score(i) for i in normal}, "bytes": [raw.get(f"<0x{b:02X}>") for b in range(256)], "unknown": m.unk_id(), "control": special, "merges": _is_bpe(m, normal), "crosses": any(SPACE in text[i].lstrip(SPACE) for i in normal)}
    if model["merges"]:  # a piece that merging its characters does not rebuild never occurs as an edge
        model["pieces"] = {p: i for p, i in model["pieces"].items() if len(p) == 1 or merge(model, list(p)) == [p]}
    model["vocab"] = vocabulary(model["pieces"])
    model["scores"] = np.array([model["score"].get(i, -1e6) for i in ids])
    return model


def _is_bpe(m, normal) -> bool:
    """Merge models score their pieces by rank: whole numbers, none above zero."""
    return all(s <= 0 and s == int(s) for s in (m.get_score(i) for i in normal))


def units_of(text: str, crosses: bool = False) -> list[str]:
    """Units of a text, with the leading mark added; '' has none. Marks in a row start one unit."""
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    if crosses:
        return [marked]
    parts = marked[1:].split(SPACE)
    if all(parts):
        return [SPACE + p for p in parts]
    out, marks = [], 0
    for p in parts:
        marks += 1
        if p:
            out.append(SPACE * marks + p)
            marks = 0
    if marks:
        out.append(SPACE * marks)
    return out


def merge(model: dict, symbols: list[str]) -> list[str]:
    """Pieces left after all merges, best score first and leftmost on ties."""
    pieces, score = model["all"], model["score"]
    n = len(symbols)
    sym, nxt, prv = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
    heap: list = []

    def offer(i):
        j = nxt[i]
        if j >= 0 and (t := pieces.get(sym[i] + sym[j])) is not None:
            heapq.heappush(heap, (-score[t], i, j, sym[i] + sym[j]))

    for i in range(n):
        if nxt[i] >= 0:
            offer(i)
    while heap:
        _, i, j, s = heapq.heappop(heap)
        if sym[i] is None or nxt[i] != j or sym[i] + (sym[j] or "\0") != s:
            continue
        sym[i], sym[j] = s, None
        nxt[i] = nxt[j]
        if nxt[i] >= 0:
            prv[nxt[i]] = i
            offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return [s for s in sym if s is not None]


def compatible(model: dict, left: str, right: str) -> bool:
    return merge(model, [*left, *right]) == [left, right]


WIDTH, BITS = 3, 21  # code points of 21 bits that one 63-bit key holds


def _pack(codes: np.ndarray) -> np.ndarray:
    """Key of the ``WIDTH`` codes from each position on; zeros follow the end."""
    c = np.concatenate([codes, np.zeros(WIDTH, codes.dtype)]).astype(np.int64)
    n, key = len(codes), np.zeros(len(codes), np.int64)
    for k in range(WIDTH):
        key = key << BITS | c[k : n + k]
    return key


def suffix_array(key: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their first ``depth`` codes, given packed keys, by doubling of ranks; ties in any order."""
    have = WIDTH
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
        second = np.zeros_like(rank)
        second[:-have] = rank[have:]
        key, have = rank * (len(rank) + 1) + second, have * 2


def vocabulary(pieces: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces as (length, id, lowest and highest packed key of each block of ``WIDTH`` codes)."""
    names = sorted(pieces, key=len)
    length = np.fromiter(map(len, names), np.int64, len(names))
    ids = np.fromiter((pieces[p] for p in names), np.int64, len(names))
    blocks = -(-max(map(len, names), default=1) // WIDTH)
    low, high = np.zeros((blocks, len(names)), np.int64), np.zeros((blocks, len(names)), np.int64)
    for k, p in enumerate(names):
        for i in range(blocks * WIDTH):
            b, c = i // WIDTH, ord(p[i]) if i < len(p) else None
            low[b, k] = low[b, k] << BITS | (c or 0)
            high[b, k] = high[b, k] << BITS | ((1 << BITS) - 1 if c is None else c)
    return length, ids, low, high


def edges(units: list[str], vocab: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of every piece in the units: (position, length, piece id), the unit starts and the codes."""
    length, ids, low, high = vocab
    joined = "\0".join(units) + "\0"  # a unit may hold \0 itself; edges that cross a unit's end are dropped
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = np.cumsum([0, *[len(u) + 1 for u in units]])
    key = _pack(codes)
    sa = suffix_array(key, int(length[-1]) if len(length) else 1)
    ranked = key[sa]
    lo, hi = np.searchsorted(ranked, low[0], "left"), np.searchsorted(ranked, high[0], "right")
    key = np.concatenate([key, np.zeros(len(low) * WIDTH, np.int64)])
    for d in range(1, len(low)):  # the next codes narrow the range of each longer piece
        live = np.flatnonzero((length > d * WIDTH) & (lo < hi))
        lo[live], hi[live] = _search(key, sa, d * WIDTH, lo[live], hi[live], low[d, live], False), _search(key, sa, d * WIDTH, lo[live], hi[live], high[d, live], True)
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(length)), n)
    at = sa[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    unit = np.repeat(np.arange(len(units)), np.diff(starts))[at]
    inside = at + length[which] < starts[unit + 1]
    at, which = at[inside], which[inside]
    return at, length[which], ids[which], starts, codes


def _search(key: np.ndarray, sa: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of each wanted key at ``depth`` within its own range of the suffix array."""
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        x = key[sa[np.minimum(mid, len(sa) - 1)] + depth]
        up = open_ & ((x <= want) if after else (x < want))
        lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
    return lo


PLAIN = 1 << 24  # PLAIN + code point stands for a character that is no piece
MEMO_PAIRS, MEMO_NEW, CACHE_UNITS, LONG_UNIT, WHOLE = 1_000_000, 10_000, 100_000, 64, 50_000


class Memo:
    """Whether pairs of neighbouring tokens stay apart: up to MEMO_PAIRS answers as sorted arrays, and the latest in a dictionary."""

    def __init__(self):
        self.keys, self.fits, self.new = np.zeros(0, np.int64), np.zeros(0, bool), {}

    def one(self, model: dict, key: int) -> bool:
        f = self.new.get(key)
        if f is None and len(self.keys) and self.keys[at := min(int(np.searchsorted(self.keys, key)), len(self.keys) - 1)] == key:
            return bool(self.fits[at])
        if f is None:
            f = self.new[key] = compatible(model, _name(model, key >> 32), _name(model, key & 0xFFFFFFFF))
        return f

    def ask(self, model: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        out, known = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            out[known] = self.fits[at[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            todo, which = np.unique(keys[rest], return_inverse=True)
            out[rest] = np.fromiter((self.one(model, k) for k in todo.tolist()), bool, len(todo))[which]
            self.settle()
        return out

    def settle(self) -> None:
        if len(self.new) <= MEMO_NEW:
            return
        full = len(self.keys) > MEMO_PAIRS  # then it starts afresh
        keys = np.concatenate([self.keys[:0] if full else self.keys, np.fromiter(self.new, np.int64, len(self.new))])
        fits = np.concatenate([self.fits[:0] if full else self.fits, np.fromiter(self.new.values(), bool, len(self.new))])
        self.keys, first = np.unique(keys, return_index=True)
        self.fits, self.new = fits[first], {}


def _relax(model: dict, memo: Memo, at: np.ndarray, end: np.ndarray, ids: np.ndarray, cuts: np.ndarray, token: np.ndarray, back: np.ndarray) -> None:
    """Relax edges in runs of equal offset in their units (``cuts`` bounds the runs): within one, no two edges share an end."""
    best = None if model["merges"] else np.where(token == -2, 0.0, -np.inf)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        p, q, t = at[a:b], end[a:b], ids[a:b]
        left = token[p]
        if model["merges"]:
            ok = (left != -1) & (token[q] == -1)
            p, q, t, left = p[ok], q[ok], t[ok], left[ok]
            inner = np.flatnonzero(left != -2)
            ok = np.ones(len(p), bool)
            ok[inner] = memo.ask(model, left[inner], t[inner])
        else:
            sums = best[p] + np.where(t < PLAIN, model["scores"][np.minimum(t, len(model["scores"]) - 1)], -1e6)
            ok = sums > best[q]
            best[q[ok]] = sums[ok]
        token[q[ok]], back[q[ok]] = t[ok], p[ok]


def _relax_long(model: dict, memo: Memo, at: np.ndarray, end: np.ndarray, ids: np.ndarray, token: np.ndarray, back: np.ndarray, best: np.ndarray | None) -> None:
    """The same, edge by edge in order of position: a long unit has too few edges an offset for whole-array steps. ``best`` holds the sums of a unigram model."""
    score = model["scores"]
    for p, q, t in zip(at.tolist(), end.tolist(), ids.tolist(), strict=True):
        left = int(token[p])
        if not model["merges"]:
            total = (0.0 if left == -2 else best[p]) + (score[t] if t < PLAIN else -1e6)
            if total > best[q]:
                best[q], token[q], back[q] = total, t, p
        elif left != -1 and token[q] == -1:
            if left != -2:
                if not memo.one(model, left << 32 | t):
                    continue
            token[q], back[q] = t, p


def _all_edges(model: dict, units: list[str]) -> tuple[np.ndarray, ...]:
    """(begin, end, token) of every edge, one-character edges for characters that are no piece included, and the unit starts and codes."""
    at, length, ids, starts, codes = edges(units, model["vocab"])
    bare = np.ones(len(codes), bool)
    bare[at[length == 1]] = False
    bare[starts[1:] - 1] = False
    spots = np.flatnonzero(bare)
    at = np.concatenate([at, spots])
    end = at + np.concatenate([length, np.ones(len(spots), np.int64)])
    return at, end, np.concatenate([ids, PLAIN + codes[spots].astype(np.int64)]), starts, codes


def _spelt(model: dict, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of tokens, characters that are no piece as their bytes (or the unknown token), and the number of ids a token."""
    times, plain = np.ones(len(found), np.int64), np.flatnonzero(found >= PLAIN)
    raw = {t: _raw(model, t) for t in np.unique(found[plain]).tolist()}
    for i in plain.tolist():
        times[i] = len(raw[int(found[i])])
    flat = np.repeat(found, times)
    spots = np.cumsum(times) - times
    for i in plain.tolist():
        flat[spots[i] : spots[i] + times[i]] = raw[int(found[i])]
    return flat.astype(np.int32), times


def segment_long(model: dict, memo: Memo, unit: str) -> np.ndarray:
    """Token ids of one very long unit: edges are made for ``WHOLE`` characters at a time (and what a piece reaches beyond), so that memory beside 16 bytes a character does not grow with it."""
    n, reach = len(unit), int(model["vocab"][0][-1]) if len(model["vocab"][0]) else 1
    token, back = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
    best = None if model["merges"] else np.full(n + 1, -np.inf)
    token[0] = -2
    for a in range(0, n, WHOLE):
        at, end, ids, _, _ = _all_edges(model, [unit[a : a + WHOLE + reach]])
        own = np.flatnonzero(at < WHOLE)
        own = own[np.argsort(at[own], kind="stable")]
        _relax_long(model, memo, a + at[own], a + end[own], ids[own], token, back, best)
        memo.settle()
    used, here = np.zeros(n + 1, bool), n
    while here > 0:
        used[here] = True
        here = int(back[here])
    return _spelt(model, token[np.flatnonzero(used)])[0]


def segment(model: dict, memo: Memo, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the units one after the other, and their number a unit."""
    long = [i for i, u in enumerate(units) if len(u) > WHOLE]
    if not long:
        return _segment(model, memo, units)
    apart = set(long)
    short = [i for i in range(len(units)) if i not in apart]
    flat, size = _segment(model, memo, [units[i] for i in short]) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    own = [segment_long(model, memo, units[i]) for i in long]
    slot = np.empty(len(units), np.int64)
    slot[[*short, *long]] = np.arange(len(units))
    size = np.concatenate([size, np.array([len(x) for x in own], np.int64)])
    return _gather(np.concatenate([flat, *own]), size, slot), size[slot]


def _segment(model: dict, memo: Memo, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    at, end, ids, starts, codes = _all_edges(model, units)
    unit = np.repeat(np.arange(len(units)), np.diff(starts))
    token, back = np.full(len(codes) + 1, -1, np.int64), np.zeros(len(codes) + 1, np.int64)
    token[starts[:-1]] = -2  # a unit begins here
    long = np.diff(starts)[unit[at]] > LONG_UNIT
    few = np.flatnonzero(~long)
    offset = at[few] - starts[unit[at[few]]]
    few = few[np.argsort(offset, kind="stable")]
    _relax(model, memo, at[few], end[few], ids[few], np.concatenate([[0], np.cumsum(np.bincount(offset, minlength=1))]), token, back)
    many = np.flatnonzero(long)
    many = many[np.argsort(at[many], kind="stable")]
    _relax_long(model, memo, at[many], end[many], ids[many], token, back, None if model["merges"] else np.full(len(token), -np.inf))
    memo.settle()
    used, here = np.zeros(len(token), bool), starts[1:] - 1
    first = starts[:-1]
    while len(here):  # one step back in every unit that has not reached its start
        going = here > first
        here, first = here[going], first[going]
        used[here] = True
        here = back[here]
    ends = np.flatnonzero(used)
    flat, times = _spelt(model, token[ends])
    return flat, np.bincount(unit[ends - 1], times, len(units)).astype(np.int64)


def _raw(model: dict, token: int) -> list[int]:
    raw = [model["bytes"][x] for x in chr(int(token) - PLAIN).encode()]
    return [model["unknown"]] if None in raw else raw


def _name(model: dict, token: int) -> str:
    return model["text"][token] if token < PLAIN else chr(token - PLAIN)


def encode_texts(model: dict, texts: list[str | None], cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the texts one after the other, and their number a text.

    ``cache`` keeps the tokens of up to CACHE_UNITS units that a call meets twice, and the pairs compared so far.
    """
    if not cache:
        cache |= {"slot": {}, "flat": np.zeros(0, np.int32), "size": np.zeros(0, np.int64), "memo": Memo()}
    units: list[str] = []
    per_text = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = units_of(t or "", model["crosses"])
        per_text[i] = len(own)
        units += own
    slots = np.fromiter(map(cache["slot"].get, units, repeat(-1)), np.int64, len(units))
    missing, flat, size = np.flatnonzero(slots < 0), cache["flat"], cache["size"]
    if len(missing):
        new: dict[str, int] = {}
        code = np.array([new.setdefault(units[i], len(new)) for i in missing.tolist()], np.int64)
        names = list(new)
        runs = [segment(model, cache["memo"], names[k : k + BATCH_UNITS]) for k in range(0, len(names), BATCH_UNITS)]
        new_flat, new_size = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
        slots[missing] = len(size) + code
        flat, size = np.concatenate([flat, new_flat]), np.concatenate([size, new_size])
        keep = np.flatnonzero(np.bincount(code) > 1)[: max(CACHE_UNITS - len(cache["slot"]), 0)]
        cache["slot"].update(zip([names[i] for i in keep.tolist()], range(len(cache["size"]), len(cache["size"]) + len(keep)), strict=True))
        cache["flat"] = np.concatenate([cache["flat"], _gather(new_flat, new_size, keep)])
        cache["size"] = np.concatenate([cache["size"], new_size[keep]])
    ids = _gather(flat, size, slots)
    ends = np.concatenate([[0], np.cumsum(size[slots])])
    return ids, np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])


def _gather(flat: np.ndarray, size: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Runs ``slots`` of ``flat`` one after the other; run i has ``size[i]`` values."""
    n, begin = size[slots], (np.cumsum(size) - size)[slots]
    return flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def decoder(model: dict) -> pa.Array:
    """Bytes that each token id stands for; control tokens stand for none."""
    table = {i: t.encode() for i, t in model["text"].items()} | dict.fromkeys(model["control"], b"")
    table |= {t: bytes([b]) for b, t in enumerate(model["bytes"]) if t is not None} | {model["unknown"]: " ⁇ ".encode()}
    return pa.array([table[i] for i in range(len(table))], pa.binary())


def decode_ids(table: pa.Array, ids: pa.ListArray) -> pa.Array:
    """Texts of lists of token ids: bytes join into characters (bad ones give U+FFFD), marks become spaces, null gives ''."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
    parts = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), table.take(ids.flatten()).cast(pa.large_binary()))
    joined = pc.binary_join(parts, pa.scalar(b"", pa.large_binary()))
    try:
        text = joined.cast(pa.large_string())
    except pa.ArrowInvalid:
        text = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.large_string())
    return pc.replace_substring_regex(pc.replace_substring(text, SPACE, " "), r"\A ", "", max_replacements=1).cast(pa.string())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, decoded: bool = False) -> DataFrame:
    """(id, ids) of every whole text, and with ``decoded`` the text that the ids decode to. Null or empty text has no token.

    Repeated rows keep a row each, a text may be of any length (a unit of over ``LONG_UNIT`` characters is relaxed edge by edge, one of over ``WHOLE`` in pieces), an
    empty table gives no rows, and other columns play no part. The ids are those of the library for the same file. A text's own U+2581 is taken for a space, as
    there; every other text is restored exactly by :func:`decode`.
    """
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    names = ["id", "ids", "text"][: 2 + decoded]

    def run(batches):
        m = shared.value
        table = decoder(m) if decoded else None
        cache = m.setdefault("cache", {})
        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(sizes // BATCH_CHARS)) + 1, [len(sizes)]]))
            for k, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                ids, n = encode_texts(m, b.column(1).slice(k, end - k).to_pylist(), cache)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
                more = [decode_ids(table, lists)] if decoded else []
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, end - k), lists, *more], names=names)

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return frame.mapInArrow(lean(run), f"id {frame.schema['id'].dataType.simpleString()}, ids array<int>" + ", text string" * decoded).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", path: str = MODEL) -> DataFrame:
    """(id, ids, text) with the text of every row's ids.

    Null and empty lists give ''; bytes that are no UTF-8 give U+FFFD; lists may be of any length, repeated rows keep a row each, an empty table gives no rows. An id that the
    vocabulary lacks is an error.
    """
    table = decoder(load(path))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, decode_ids(table, b.column(1))], names=["id", "ids", "text"])

    frame = tokens.select(F.col(id_col).alias("id"), "ids")
    return frame.mapInArrow(lean(run), f"id {frame.schema['id'].dataType.simpleString()}, ids array<int>, text string").withColumnRenamed("id", id_col)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and digests of the ids and of the text that they decode to."""
    out = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: (doc_id, n_tokens, ids) of every document, repeated ones too; a null text has no token."""
    settle_executors(spark)
    return encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
