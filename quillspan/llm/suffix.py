"""Suffix-array dedup of repeated byte windows by most-significant-digit passes.

Suffixes are ordered only through ``window`` bytes; equal groups are exactly the repeated windows. Sorting
every suffix byte by byte would move each text a hundredfold, so a run of neighbouring suffixes travels as
one record, the digits are blocks of bytes, and suffixes that are alone in their group leave after each digit:

1. The first digit is the window's *anchor*: the 32-byte gram with the smallest hash among the grams in
   the window (leftmost on ties). Equal windows have the same anchor at the same offset, and neighbouring
   windows share one, so all of them are one run. Records are dealt by this digit.
2. Runs equal in the anchor and in their whole content are repeats, window by window, but for the first.
3. The next digits are the 8-byte blocks that follow and precede the anchor, a 4-bit code each. A window that
   begins d bytes before its anchor shares its d // 8 blocks before and its other whole blocks
   after the anchor with every equal window. For each d // 8 the runs are ordered by these digits, and windows
   that are alone leave before any text is opened.
4. The windows that are left are opened; their last digit is a 128-bit hash of all their bytes, and all but
   the first of each group are repeats.

Records travel as packed columns, a blob for each destination. Before each exchange a slice of a batch keeps the
first of equal records and reports the rest as repeats at once, so a passage in a third of all documents
reaches a task only once a slice. Grams with many records (found by a sampled count that affects the layout
alone) are dealt by content as well and opened always.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Tables, free_shuffles, lean, partitions, read, slices

GRAM, BLOCK, DIGITS = 32, 8, 8  # bytes of an anchor and of a later digit; later digits on each side
PIECE = 1 << 21  # bytes handled at once, so that temporary arrays stay small
SLICE = 1 << 24  # bytes of text whose records are sorted together
ODD1, ODD2, ODD3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
RUN = (np.uint64, np.uint64, np.uint32, np.uint32, np.int64, np.int64, np.int32, np.int32, np.int32)  # g, n, before, after, o, r, lo, hi - lo, at - lo
SPAN = (np.int64, np.int64, np.int32, np.int32)  # o, r, lo, hi - lo
WINDOW = (np.uint64, np.uint64, np.int64, np.int64, np.int32)  # two hashes, o, r, lo
BLOBS = "kind int, k int, blob binary"


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * ODD2
        h = (h ^ (h >> np.uint64(29))) * ODD3
    return h ^ (h >> np.uint64(32))


def _gram_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the 32 bytes from each position (len - 31 of them), by five doublings, and a 4-bit code of the 8 bytes."""
    h, base, width = b.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    with np.errstate(over="ignore"):
        while width < GRAM:
            if width == BLOCK:
                code = (_mixed(h) >> np.uint64(60)).astype(np.uint8)
            h = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
            width *= 2
    return _mixed(h), code


def _window_hashes(b: np.ndarray, window: int, seed: int) -> np.ndarray:
    """64-bit hash of the ``window`` bytes from each position, mixed at each doubling; the last two halves overlap."""
    width, h = 1, _mixed(b.astype(np.uint64) + np.uint64(seed))
    with np.errstate(over="ignore"):
        while 2 * width <= window:
            h = _mixed(h[:-width] * ODD1 + h[width:])
            width *= 2
        if width < window:
            k = window - width
            h = _mixed(h[:-k] * ODD1 + h[k:])
    return h


def _leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of the ``width`` values from each position."""
    low, at, have = h, np.arange(len(h), dtype=np.int32), 1

    def merge(step):
        left = low[: len(low) - step] <= low[step:]
        return np.where(left, low[: len(low) - step], low[step:]), np.where(left, at[: len(at) - step], at[step:])

    while 2 * have <= width:
        low, at = merge(have)
        have *= 2
    if have < width:
        low, at = merge(width - have)
    return at


def runs_of(data: bytes, starts: np.ndarray, window: int):
    """Runs of windows with one anchor in each text of ``data`` (texts begin at ``starts``, which ends with its length).

    Returns arrays: text number, first and last window start (both in ``data``), anchor position and hash, and
    the digits before and after the anchor, the nearest block in the highest bits (0 past a text's end).
    """
    b = np.frombuffer(data, np.uint8)
    if len(b) < window:
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] + [np.empty(0, np.uint32)] * 2
    h, code = _gram_hashes(b)
    at = _leftmost_minima(h, window - GRAM + 1)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(at)]
    valid = np.arange(len(at)) + window <= starts[text + 1]
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1] | (text[1:] != text[:-1])
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    text, anchor = text[lo], at[lo].astype(np.int64)
    sides = []
    for first, step in ((anchor - BLOCK, -BLOCK), (anchor + GRAM, BLOCK)):
        digits = np.zeros(len(lo), np.uint32)
        for k in range(DIGITS):
            p = first + k * step
            inside = (p >= starts[text]) & (p + BLOCK <= starts[text + 1])
            digits = digits << np.uint32(4) | np.where(inside, code[np.clip(p, 0, len(code) - 1)], 0).astype(np.uint32)
        sides.append(digits)
    return text, lo, hi, anchor, h[anchor], *sides


def _pieces(texts: list[bytes], window: int):
    """Lists of (text number, offset, bytes) of about PIECE bytes; a longer text is cut, pieces overlap by a window less one byte."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for k in range(0, max(1, len(t) - window + 1), PIECE):
            part = t[k : k + PIECE + window - 1] if len(t) > PIECE else t
            if held and size + len(part) > PIECE:
                yield held
                held, size = [], 0
            held.append((i, k, part))
            size += len(part)
    if held:
        yield held


def pack(columns) -> bytes:
    """Columns as compressed byte planes."""
    raw = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unpack(blob: bytes, kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for k, w in zip(kinds, sizes, strict=True):
        planes = np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n)
        out.append(np.ascontiguousarray(planes.T).view(k).reshape(n))
        at += n * w
    return out


def _together(blobs: list[bytes], kinds) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*(unpack(b, kinds) for b in blobs), strict=True)]


def _deal(kind: int, to: np.ndarray, columns, kinds) -> pa.RecordBatch:
    """A row (kind, destination, blob) for each destination in ``to``."""
    order = np.argsort(to, kind="stable")
    to, columns = to[order], [np.asarray(c)[order].astype(t, copy=False) for c, t in zip(columns, kinds, strict=True)]
    ends = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)] if len(to) else [0]
    blobs = [pack([c[a:b] for c in columns]) for a, b in zip(ends, ends[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(blobs), pa.int32()), pa.array([int(to[a]) for a in ends[: len(blobs)]], pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "k", "blob"])


def _home(o: np.ndarray, r: np.ndarray, n: int) -> np.ndarray:
    """Destination of a row's spans."""
    with np.errstate(over="ignore"):
        return (_mixed(o.astype(np.uint64) * ODD1 + r.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _spans(kind: int, o, r, lo, hi, gap: int, n: int) -> pa.RecordBatch:
    o, r, lo, hi = _joined(o, r, lo, hi, gap)
    return _deal(kind, _home(o, r, n), (o, r, lo, hi - lo), SPAN)


def _joined(o, r, lo, hi, gap: int):
    """Ranges of each row (o, r), those at most ``gap`` apart joined."""
    if not len(o):
        return o, r, lo, hi
    order = np.lexsort([lo, r, o])
    o, r, lo, hi = o[order], r[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    own = np.append(False, (o[1:] != o[:-1]) | (r[1:] != r[:-1]))
    base = np.cumsum(own) << 40
    reach = np.maximum.accumulate(base + hi) - base
    new = own | np.append(True, lo[1:] > reach[:-1] + gap)
    at = np.flatnonzero(new)
    return o[at], r[at], lo[at], np.maximum.reduceat(hi, at)


def _firsts(keys: list[np.ndarray], o: np.ndarray, lo: np.ndarray):
    """Order of rows by (keys, o, lo), and in that order: the group's lead, and which rows repeat an earlier place.

    Rows with the lead's own id and start (rows with an equal id) tie with it and do not count as repeats.
    """
    order = np.lexsort([lo, o, *keys[::-1]])
    lead = np.ones(len(order), bool)
    lead[1:] = False
    for k in keys:
        lead[1:] |= k[order][1:] != k[order][:-1]
    of = np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0)) if len(order) else order
    o, lo = o[order], lo[order]
    return order, lead, (o != o[of]) | (lo != lo[of])


def _first_runs(batches, window: int, hot: np.ndarray, n_to: int):
    """Digit 1. kind 0 (kind 2 of hot grams): the first record of each (gram, content) of a slice; kind 1: windows known to repeat."""
    for b in batches:
        for i, j in slices(b.column(2), SLICE):
            part = b.slice(i, j - i)
            texts = [t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()]
            o, r = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            got = []
            for piece in _pieces(texts, window):
                data, starts = b"".join(x for _, _, x in piece), np.cumsum([0, *(len(x) for _, _, x in piece)])
                text, lo, hi, at, g, before, after = runs_of(data, starts, window)
                view, h64 = memoryview(data), xxhash.xxh3_64_intdigest
                n = np.fromiter((h64(view[x : y + window], z) for x, y, z in zip(lo.tolist(), hi.tolist(), (at - lo).tolist(), strict=True)), np.uint64, len(lo))
                whose, offset = np.array([x for x, _, _ in piece])[text], np.array([x for _, x, _ in piece])[text]
                got.append((g >> np.uint64(16), n, before, after, o[whose], r[whose], lo - starts[text] + offset, hi - lo, at - lo))
            if not got:
                continue
            t = [np.concatenate(x) for x in zip(*got, strict=True)]
            order, _, again = _firsts([t[0], t[1]], t[4], t[6])
            t = [x[order] for x in t]
            g, n, _, _, o, r, lo, size, _ = t
            yield _spans(1, o[again], r[again], lo[again], lo[again] + size[again], 1, n_to)
            t = [x[~again] for x in t]
            is_hot = np.isin(t[0], hot)
            with np.errstate(over="ignore"):
                to = (np.where(is_hot, _mixed(t[0] + t[1] * ODD1), _mixed(t[0])) % np.uint64(n_to)).astype(np.int64)
            for kind, some in ((0, ~is_hot), (2, is_hot)):
                yield _deal(kind, to[some], [x[some] for x in t], RUN)


def _by_destination(batches):
    """(destination, kind, blobs) of rows sorted by destination and kind."""
    now, held = None, []
    for b in batches:
        for kind, k, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (k, kind) != now:
                if held:
                    yield *now, held
                now, held = (k, kind), []
            held.append(blob)
    if held:
        yield *now, held


def _resolve(batches, window: int, n_to: int):
    """Digits 2 and 3, over blobs sorted by destination. kind 1: windows that repeat; kind 3: windows to be opened."""
    room = window - GRAM  # bytes of a window outside its anchor
    for k, kind, blobs in _by_destination(batches):
        if kind == 1:
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(blobs), pa.int32()), pa.array([k] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "k", "blob"])
            continue
        t = _together(blobs, RUN)
        order, _, again = _firsts([t[0], t[1]], t[4], t[6])
        t = [x[order] for x in t]
        _, _, _, _, o, r, lo, size, _ = t
        yield _spans(1, o[again], r[again], lo[again], lo[again] + size[again], 1, n_to)
        g, n, before, after, o, r, lo, size, at = (x[~again] for x in t)
        if kind == 2:
            yield _spans(3, o, r, lo, lo + size, 1, n_to)
            continue
        opened = []
        for level in range(min(DIGITS, room // BLOCK) + 1):
            # Windows that begin from `near` to `far` bytes before the anchor; the last level takes what is left.
            near, far = level * BLOCK, room if level == DIGITS else min(room, level * BLOCK + BLOCK - 1)
            x = np.flatnonzero((at >= near) & (at - size <= far))
            blocks = min(DIGITS, (room - far) // BLOCK)
            digits = np.zeros(len(x), np.uint64)
            if level:
                digits |= (before[x] >> np.uint32(32 - 4 * level)).astype(np.uint64) << np.uint64(32)
            if blocks:
                digits |= (after[x] >> np.uint32(32 - 4 * blocks)).astype(np.uint64)
            order = np.lexsort([digits, g[x]])
            x, digits = x[order], digits[order]
            same = (g[x][1:] == g[x][:-1]) & (digits[1:] == digits[:-1])
            x = x[np.append(same, False) | np.append(False, same)] if len(x) else x
            opened.append((x, np.maximum(lo[x], lo[x] + at[x] - far), np.minimum(lo[x] + size[x], lo[x] + at[x] - near)))
        x, a, z = (np.concatenate(c) for c in zip(*opened, strict=True))
        yield _spans(3, o[x], r[x], a, z, 1, n_to)


def _rows(batches, gap: int):
    """(o, r, spans) with a row's ranges of window starts joined, as pairs of 32-bit numbers; over blobs sorted by destination."""
    held: list[bytes] = []
    for _, _, blobs in _by_destination(batches):
        o, r, lo, size = _together(blobs, SPAN)
        o, r, lo, hi = _joined(o, r, lo, lo + size, gap)
        at = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (r[1:] != r[:-1])))  # a blob has a span at least
        pairs = np.stack([lo, hi], axis=1).astype("<i4")
        held = [pairs[a:z].tobytes() for a, z in zip(at.tolist(), [*at.tolist()[1:], len(o)], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(o[at]), pa.array(r[at]), pa.array(held, pa.binary())], names=["o", "r", "spans"])


def _open(batches, window: int, n_to: int):
    """Digit 4. kind 0: every window to be opened, the first of a slice; kind 1: repeats within it."""
    for b in batches:
        for i, j in slices(b.column(2), SLICE // 4):
            part = b.slice(i, j - i)
            o, r = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            pairs = [np.frombuffer(x, "<i4").reshape(-1, 2) for x in part.column(3).to_pylist()]
            texts = part.column(2).cast(pa.binary()).to_pylist()
            data = b"".join(t[a : z + window] for t, x in zip(texts, pairs, strict=True) for a, z in x.tolist())
            row = np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])
            lo, hi = np.concatenate([*pairs, np.zeros((0, 2), np.int32)]).astype(np.int64).T
            n = hi - lo + 1  # windows of each range; its text has window - 1 bytes more
            begin = np.cumsum(n + window - 1) - (n + window - 1)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, row, lo = np.repeat(begin, n) + step, np.repeat(row, n), np.repeat(lo, n) + step
            hashes = [np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)]
            b8, cuts = np.frombuffer(data, np.uint8), np.searchsorted(at, np.arange(0, max(1, len(data)), PIECE)).tolist()
            for x, y in zip(cuts, [*cuts[1:], len(at)], strict=True):
                if x < y:
                    text = b8[at[x] : at[y - 1] + window]
                    for h, seed in zip(hashes, (1, 0x1234567), strict=True):
                        h[x:y] = _window_hashes(text, window, seed)[at[x:y] - at[x]]
            order, _, again = _firsts(hashes, o[row], lo)
            row, lo, h1, h2 = row[order], lo[order], hashes[0][order], hashes[1][order]
            own, rr = o[row], r[row]
            yield _spans(1, own[again], rr[again], lo[again], lo[again], 1, n_to)
            keep = ~again
            yield _deal(0, (h1[keep] % np.uint64(n_to)).astype(np.int64), (h1[keep], h2[keep], own[keep], rr[keep], lo[keep]), WINDOW)


def _later(batches, n_to: int):
    """Over blobs sorted by destination: the windows that are not the first of their group."""
    for k, kind, blobs in _by_destination(batches):
        if kind == 1:
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(blobs), pa.int32()), pa.array([k] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "k", "blob"])
            continue
        h1, h2, o, r, lo = _together(blobs, WINDOW)
        order, _, again = _firsts([h1, h2], o, lo)
        x = order[again]
        yield _spans(1, o[x], r[x], lo[x], lo[x], 1, n_to)


def repeated_spans(docs: DataFrame, window: int = 100, sample_share: float = 0.01, hot_records: int = 200) -> DataFrame:
    """(doc_id, kept bytes, n_bytes, n_removed, n_spans) of every row after its repeated windows went.

    A byte goes if a window of ``window`` bytes over it also starts earlier: in a row with a smaller
    integer doc_id (null counts as the smallest) or with the same doc_id at a smaller offset. Null
    text is empty; texts shorter than a window are kept; a text may be of any length (up to 2 GiB). Rows that repeat a doc_id are told apart by
    their text when results are joined; equal rows have equal results. An empty table gives no rows. Other columns play no part.
    """
    if window <= GRAM:
        raise ValueError(f"windows must be longer than {GRAM} bytes")
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    n_to = width = partitions(spark)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))
    rows = docs.select("doc_id", order.alias("o"), "text")
    several = rows.groupBy("o").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    rows = rows.select("doc_id", "o", (F.xxhash64("text") if several else F.lit(0)).cast("long").alias("r"), "text")
    texts = tables.bucketed(rows, width, ["o", "r"], "texts")  # texts move once
    free_shuffles(spark)

    def grams(batches):
        for b in _first_runs(batches, window, np.zeros(0, np.uint64), 1):
            for kind, blob in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if kind == 0:
                    yield pa.RecordBatch.from_arrays([pa.array(unpack(blob, RUN)[0].astype(np.int64))], names=["g"])

    sample = texts.where(F.pmod(F.xxhash64("o", F.lit(7)), F.lit(10_000)) < int(sample_share * 10_000)).select("o", "r", "text")
    counted = sample.mapInArrow(lean(grams), "g long").groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") >= max(2.0, hot_records * sample_share)).orderBy(F.desc("c"), "g").limit(10_000)
    hot = spark.sparkContext.broadcast(np.array([x["g"] for x in counted.collect()], np.uint64))

    def dealt(blobs):
        return blobs.repartitionById(width, "k").sortWithinPartitions("k", "kind")

    records = texts.select("o", "r", "text").mapInArrow(lean(lambda it: _first_runs(it, window, hot.value, n_to)), BLOBS)
    solved = tables.cut(dealt(records).mapInArrow(lean(lambda it: _resolve(it, window, n_to)), BLOBS), "passes")
    to_open = dealt(solved.where("kind = 3")).mapInArrow(lean(lambda it: _rows(it, 1)), "o long, r long, spans binary")
    opened = texts.join(to_open.hint("merge"), ["o", "r"]).select("o", "r", "text", "spans")
    windows = opened.mapInArrow(lean(lambda it: _open(it, window, n_to)), BLOBS)
    later = dealt(windows).mapInArrow(lean(lambda it: _later(it, n_to)), BLOBS)
    spans = dealt(solved.where("kind = 1").union(later)).mapInArrow(lean(lambda it: _rows(it, window)), "o long, r long, spans binary")

    def finish(batches):
        for b in batches:
            for i, j in slices(b.column(1), SLICE):
                part = b.slice(i, j - i)
                cols: list[list] = [[], [], [], []]
                for x, found in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    x = x or b""
                    gone = np.frombuffer(found or b"", "<i4").reshape(-1, 2).tolist()
                    ends = [0, *(z + window for _, z in gone)]
                    kept = b"".join(x[a:z] for a, z in zip(ends, [*(s for s, _ in gone), len(x)], strict=True))
                    for c, v in zip(cols, (kept, len(x), len(x) - len(kept), len(gone)), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    whole = texts.join(spans.hint("merge"), ["o", "r"], "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(lean(finish), f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte windows are removed from every document; digests of what stays."""
    out = repeated_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
