"""SimHash near-dedup by a binary-trie self-join.

Fingerprints are first collapsed to distinct values. Two of them within three bits agree on at least
one of four 16-bit blocks. So four tries are joined, each with the bits rotated so that another block comes first, and
in that block no bit of the budget may be spent: the nodes at depth 16, keyed by it, are the units that are dealt out. Within a
unit the values form a binary trie: pairs of nodes are traversed together, differing bits accumulate, and a pair is pruned once the budget is exceeded. A
unit that is too large for one task is first split by the same traversal on the cluster: its
members go to the pairs of child nodes that stay within the budget. Each task returns a spanning star of its links, so a
dense group costs rows in proportion to its members, and the stars meet in a distributed
connected-components step.

The pipeline stage (``near_copies``) links texts by the same fingerprints and trie join, and those of five-word Jaccard 0.8 or more too. Such pairs can
differ in too many of 64 bits for a join by Hamming distance, so bands of min-hashes say which further texts meet;
within such a unit an exact prefix-filtered set join finds the links, and no pair of a unit is written but those of a spanning star.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Tables, connected_components, cut, lean, modest_batches, partitions, read, settle_executors, slices, unused

BITS = 3  # fingerprints that differ in so many bits or fewer link
STEP = 8  # binary levels that one step of a split on the cluster takes
CHUNK = 1 << 20  # node pairs expanded at once
SLICE = 1 << 22  # bytes of text hashed at once
WORDS = 5  # words a shingle of the pipeline stage
HELD = 512  # shingles of a set that travel with it, as 32 bits each: up to so many whole, of larger sets the smallest hashes
UNIT = 4096  # sets of a unit; larger units are met block by block
LEADERS = 4  # sets of a large unit that meet all of its blocks
BANDS, ROWS = 32, 5  # a pair of Jaccard 0.8 shares none of the bands with probability (1 - 0.8**5)**32 = 3e-6


def fingerprint(text: str | None, n: int = 3) -> int:
    """64-bit SimHash of ``n``-word shingles, repeats included; 0 for a text without words (or null)."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-n] + 1).tolist()]
    h64 = xxhash.xxh64_intdigest
    h = np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        bits = np.unpackbits(h[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, fp) of every row, with fp the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            for i, j in slices(b.column(1), SLICE):
                fp = np.array([fingerprint(t, n) for t in b.column(1).slice(i, j - i).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fp)], names=["id", "fp"])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return frame.mapInArrow(lean(run), f"id {frame.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def _levels(unit: np.ndarray, side: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
    """Starts of the binary trie's nodes in the sorted rows, for each depth from 0 to 64."""
    edge = np.ones(len(key), bool)
    edge[1:] = (unit[1:] != unit[:-1]) | (side[1:] != side[:-1])
    out, differ = [np.flatnonzero(edge).astype(np.int32)], np.append(np.uint64(0), key[1:] ^ key[:-1])
    for depth in range(1, 65):
        if (fresh := ~edge & (differ >> np.uint64(64 - depth) != 0)).any():
            edge = edge | fresh
            out.append(np.flatnonzero(edge).astype(np.int32))
        else:
            out.append(out[-1])
    return out


def links(unit: np.ndarray, side: np.ndarray, key: np.ndarray, budget: int):
    """Yield arrays (i, j) of rows, sorted by (unit, side, key), whose keys differ in 1 to ``budget`` bits.

    Side 0 is joined with itself, side 1 with side 2 of the same unit. Pairs of nodes go down the binary
    trie together, bit by bit; a pair whose bits differ too often is pruned with all that is below it.
    """
    levels = _levels(unit, side, key)
    roots = levels[0]
    own = np.flatnonzero(side[roots] == 0)
    left = np.flatnonzero(side[roots] == 1)
    left = left[left + 1 < len(roots)]
    left = left[(unit[roots[left + 1]] == unit[roots[left]]) & (side[roots[left + 1]] == 2)]
    a, b = np.concatenate([own, left]).astype(np.int32), np.concatenate([own, left + 1]).astype(np.int32)
    stack = [(0, a, b, np.zeros(len(a), np.uint8))]
    while stack:
        depth, a, b, used = stack.pop()
        while depth < 64:
            if len(a) > CHUNK:  # the rest waits, so that the arrays stay small
                stack.append((depth, a[CHUNK:], b[CHUNK:], used[CHUNK:]))
                a, b, used = a[:CHUNK], b[:CHUNK], used[:CHUNK]
            up, down = levels[depth], levels[depth + 1]
            bit = lambda node, d=down, k=np.uint64(63 - depth): (key[d[node]] >> k & np.uint64(1)).astype(np.uint8)
            if up is down:  # no node branches here: bits of pairs still differ
                used = used + (bit(a) ^ bit(b))
            else:
                first = np.append(np.searchsorted(down, up), len(down)).astype(np.int32)
                both = [(first[a], first[b])]
                two_a, two_b = first[a + 1] - first[a] == 2, first[b + 1] - first[b] == 2
                both += [(first[a] + 1, first[b]), (first[a], first[b] + 1), (first[a] + 1, first[b] + 1)]
                take = [np.ones(len(a), bool), two_a & (a != b), two_b, two_a & two_b]  # of a node with itself one mixed pair
                x, y = (np.concatenate([c[k][t] for c, t in zip(both, take, strict=True)]) for k in (0, 1))
                used = np.concatenate([used[t] for t in take])
                a, b, used = x, y, used + (bit(x) ^ bit(y))
            go = used <= budget
            a, b, used, depth = a[go], b[go], used[go], depth + 1
            if not len(a):
                break
        apart = a != b
        if depth == 64 and apart.any():
            yield levels[64][a[apart]].astype(np.int64), levels[64][b[apart]].astype(np.int64)


def stars(unit: np.ndarray, side: np.ndarray, key: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the smallest row each is linked to, directly or through others, within these rows."""
    parent = np.arange(len(key))
    for i, j in links(unit, side, key, budget):
        while True:
            pi, pj = parent[i], parent[j]
            apart = pi != pj
            if not apart.any():
                break
            i, j, pi, pj = i[apart], j[apart], pi[apart], pj[apart]
            np.minimum.at(parent, np.maximum(pi, pj), np.minimum(pi, pj))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    rows = np.flatnonzero(parent != np.arange(len(key)))
    return rows, parent[rows]


def _rotated(fp, block: int):
    return F.expr(f"shiftleft({fp}, {16 * block}) | shiftrightunsigned({fp}, {64 - 16 * block})") if block else F.col(fp)


def _split(units: DataFrame, heavy: DataFrame, depth: int, budget: int) -> DataFrame:
    """Members of heavy units, dealt to the pairs of their nodes' children that stay within the budget."""
    digit = F.expr(f"shiftrightunsigned(key, {64 - depth - STEP}) & {2**STEP - 1}")
    rows = units.join(heavy.select("unit"), "unit").withColumn("x", digit)
    there = rows.select("unit", "side", "x").distinct()
    other = there.select("unit", F.when(F.col("side") == 0, 0).otherwise(3 - F.col("side")).alias("side"), F.col("x").alias("y"))
    spent = F.col("used") + F.expr("bit_count(x ^ y)")
    pairs = rows.join(other.groupBy("unit", "side").agg(F.collect_set("y").alias("ys")), ["unit", "side"])
    pairs = pairs.withColumn("y", F.explode("ys")).drop("ys").where(spent <= budget)
    low, high = F.when(F.col("side") == 2, F.col("y")).otherwise(F.col("x")), F.when(F.col("side") == 2, F.col("x")).otherwise(F.col("y"))
    low, high = F.when(F.col("side") == 0, F.least("x", "y")).otherwise(low), F.when(F.col("side") == 0, F.greatest("x", "y")).otherwise(high)
    side = F.when(F.col("side") != 0, F.col("side")).when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2)
    return pairs.select(F.xxhash64("unit", low, high, F.lit(depth)).alias("unit"), side.cast("int").alias("side"), "key", "block", spent.cast("int").alias("used"))


def link_stars(fps: DataFrame, budget: int = 3, max_unit: int = 16384) -> DataFrame:
    """(src, dst) spanning the graph of distinct fingerprints ``fp`` at most ``budget`` (up to 3) bits apart.

    A fingerprint that stands alone has no row; an empty input gives none. Units of more than ``max_unit`` members are dealt to pairs of their child nodes.
    """
    if not 0 <= budget <= 3:
        raise ValueError("four blocks find pairs of up to 3 differing bits")
    spark = fps.sparkSession
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), _rotated("fp", b).alias("key")) for b in range(4)])
    units = fps.select(F.explode(blocks).alias("u")).select(F.xxhash64(F.expr("shiftrightunsigned(u.key, 48)"), F.col("u.block")).alias("unit"), F.lit(0).alias("side"), F.col("u.key").alias("key"), F.col("u.block").alias("block"), F.lit(0).alias("used"))
    done = None
    for depth in range(16, 64, STEP):
        sizes = units.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") > max_unit)
        heavy = cut(sizes)
        if not heavy.limit(1).count():
            break
        light = units.join(heavy.select("unit"), "unit", "left_anti")
        done = light if done is None else done.union(light)
        units = cut(_split(units, heavy, depth, budget))
    units = units if done is None else done.union(units)

    def run(batches):
        held = None

        def star(t):
            order = np.lexsort([t[2], t[1], t[0]])
            unit, side, key, block = (x[order] for x in t)
            rows, to = stars(unit, side, key, budget)
            back = [_unrotate(key[k], block[k]) for k in (rows, to)]
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in back], names=["src", "dst"])

        for b in batches:
            t = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy()]
            t = t if held is None else [np.concatenate(x) for x in zip(held, t, strict=True)]
            if len(t[0]) < 50_000:
                held = t
                continue
            whole = int(np.searchsorted(t[0], t[0][-1]))  # the last unit may go on in the next batch
            held = [x[whole:] for x in t]
            if whole:
                yield star([x[:whole] for x in t])
        if held is not None and len(held[0]):
            yield star(held)

    dealt = units.select("unit", "side", "key", "block").repartition(partitions(spark), "unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(lean(run), "src long, dst long")


def _unrotate(key: np.ndarray, block: np.ndarray) -> np.ndarray:
    right = (16 * block).astype(np.uint64)
    return np.where(right == 0, key, (key >> right) | (key << ((np.uint64(64) - right) & np.uint64(63))))


def print_groups(prints: DataFrame, budget: int = BITS, max_unit: int = 16384) -> DataFrame:
    """(node, component) of distinct fingerprints ``fp`` that link to another within ``budget`` bits."""
    return connected_components(link_stars(prints, budget, max_unit))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, budget: int = BITS, max_unit: int = 16384) -> DataFrame:
    """(id, fp, component, component_id) of every row.

    ``component`` is the smallest fingerprint reachable and ``component_id`` the smallest non-null id
    reachable. Equal fingerprints (also those of texts without words, which are all zero) are in one
    component. Repeated rows and repeated ids keep a row each; null is an empty text, a text of any length is read whole, an empty table gives no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col, n))
    ids = prints.groupBy("fp").agg(F.min(id_col).alias("low"))
    groups = print_groups(ids.select("fp"), budget, max_unit)
    of = ids.join(groups, ids.fp == groups.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    low = of.groupBy("component").agg(F.min("low").alias("component_id"))
    of = of.join(low, "component").select("fp", "component", "component_id")
    return prints.join(of, "fp").select(id_col, "fp", "component", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and components at three or fewer differing bits."""
    out = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``n``-word shingles; of a shorter text one, of a text without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-n] + 1).tolist()]
    h64 = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts, ends[min(n, len(words)) - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def set_key(text: str | None) -> int:
    """64-bit key of a text's set of five-word shingles."""
    return xxhash.xxh64_intdigest(shingles(text).tobytes(), 42)


def band_keys(held: np.ndarray) -> np.ndarray:
    """Keys of the ``BANDS`` bands of ``ROWS`` min-hashes of a set that is not empty."""
    rng = np.random.default_rng(20)
    flip, odd = rng.integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
    odd |= np.uint64(1)
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(held), 1024):
        low = np.minimum(low, ((held[k : k + 1024] ^ flip) * odd).min(axis=1))
    return np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))), np.uint64, BANDS)


class _Forest:
    """Rows joined into trees, each known by its smallest row."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            pi, pj = self.up[i], self.up[j]
            apart = pi != pj
            if not apart.any():
                return
            i, j, pi, pj = i[apart], j[apart], pi[apart], pj[apart]
            np.minimum.at(self.up, np.maximum(pi, pj), np.minimum(pi, pj))
            while not np.array_equal(up := self.up[self.up], self.up):
                self.up = up


def set_links(size: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sure) that span the links of Jaccard 0.8 or more among sets of hashes.

    ``held`` has the upper halves of each set's sorted hashes, of a set larger than ``HELD`` the smallest. Links of whole sets
    are sure, and come as stars, if they would hold with one shared hash less (two halves may be equal by chance); a pair at that very line comes
    unsure, to be compared in full. So do pairs with a partly held set, if the hashes that
    both would hold are 0.72 alike (4.6 deviations below 0.8); those above 0.88 only as far as they span.
    Any set that holds 0.8 of a set's hashes holds one of any fifth (and one more) of them: only the rarest of
    each set, within these sets, are looked up. Sets are first compared with a few that share the most, and those in the largest
    group after that are looked up no more, only found.
    """
    n, held = len(size), [np.unique(x) for x in held]
    tokens, token, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    length = np.fromiter(map(len, held), np.int64, n)
    begin, row, total = np.cumsum(length) - length, np.repeat(np.arange(n), length), len(tokens) + 1
    code = row * total + token  # ascending
    limit = np.where(size > HELD, token[begin + length - 1], total - 1)  # the last number is no token
    sure, maybe, unsure = _Forest(n), _Forest(n), []

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        ok = 9 * np.minimum(size[i], size[j]) >= 4 * (size[i] + size[j])
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 1024):  # half a million hashes at once at most
            a, b = i[k : k + 1024], j[k : k + 1024]
            pair = np.repeat(np.arange(len(a)), length[a])
            at = np.repeat(begin[a] - (np.cumsum(length[a]) - length[a]), length[a]) + np.arange(len(pair))
            want = b[pair] * total + token[at]
            spot = np.minimum(np.searchsorted(code, want), len(code) - 1)
            both = np.bincount(pair[code[spot] == want], minlength=len(a))
            end = np.minimum(limit[a], limit[b])
            within = [np.searchsorted(code, x * total + end, "right") - begin[x] for x in (a, b)]
            whole = end == total - 1
            alike = whole & (9 * (both - 1) >= 4 * (within[0] + within[1]))
            sure.join(a[alike], b[alike])
            line = np.flatnonzero(whole & ~alike & (9 * both >= 4 * (within[0] + within[1])))
            unsure.extend(zip(a[line].tolist(), b[line].tolist(), strict=True))
            share = both / np.maximum(1, within[0] + within[1] - both)
            near = np.flatnonzero(~whole & (share >= 0.72))
            for x in near[np.argsort(-share[near], kind="stable")].tolist():
                if share[x] < 0.88 or maybe.up[a[x]] != maybe.up[b[x]]:
                    unsure.append((a[x], b[x]))
                    if share[x] >= 0.88:
                        maybe.join(a[x : x + 1], b[x : x + 1])

    def labels():
        both = _Forest(n)
        both.join(np.arange(n), sure.up)
        both.join(np.arange(n), maybe.up)
        return both.up

    score, left = np.bincount(row, count[token], n) / np.maximum(1, length), np.arange(n)
    for _ in range(8):  # stars of sets that share the most
        if len(left) < 3:
            break
        lead = left[np.argmax(score[left])]
        other = left[left != lead]
        compare(np.full(len(other), lead), other)
        own = labels()
        left = left[own[left] != own[lead]]
    own = labels()
    ask = np.flatnonzero(own != np.bincount(own).argmax()) if n > 1 else np.zeros(0, np.int64)
    need = np.where(size <= 0.8 * HELD, np.ceil(0.8 * length), np.ceil(0.57 * length)).astype(np.int64)
    rarest = np.lexsort([token, count[token], row])  # each row's hashes, rarest first
    by_token = np.argsort(token, kind="stable")
    first = np.cumsum(count) - count
    k = 0
    while k < len(ask):
        look, cost, stop = [], 0, k
        while stop < len(ask) and (cost < CHUNK or stop == k):
            m = ask[stop]
            look.append(rarest[begin[m] : begin[m] + length[m] - need[m] + 1])
            cost += int(count[token[look[-1]]].sum())
            stop += 1
        at = np.concatenate(look)
        hits = count[token[at]]
        other = row[by_token[np.repeat(first[token[at]] - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())]]
        mine = np.repeat(row[at], hits)
        own = sure.up
        new = np.unique((np.minimum(mine, other) * n + np.maximum(mine, other))[own[mine] != own[other]])
        compare(new // n, new % n)
        k = stop
    rows = np.flatnonzero(sure.up != np.arange(n))
    i, j = np.array(unsure, np.int64).reshape(-1, 2).T
    return np.concatenate([rows, i]), np.concatenate([sure.up[rows], j]), np.arange(len(rows) + len(i)) < len(rows)


def _unit_links(batches):
    """(src, dst, sure) of units, over rows (unit, fp, size, held) sorted by unit."""
    parts: list[list] = [[], [], []]
    now = None

    def found():
        fp, size = np.concatenate(parts[0]), np.concatenate(parts[1]).astype(np.int64)
        fp, keep = np.unique(fp, return_index=True)  # a set that several blocks bring counts once
        held = [parts[2][k] for k in keep.tolist()]
        i, j, sure = set_links(size[keep], held) if len(fp) > 1 else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j]), pa.array(sure.astype(bool))], names=["src", "dst", "sure"])

    for b in batches:
        unit, fp, size = (b.column(k).to_numpy() for k in range(3))
        flat, ends = b.column(3).flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(b.column(3)).to_numpy()))
        cuts = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)] if len(unit) else []
        for x, y in zip(cuts, cuts[1:], strict=False):
            if unit[x] != now and parts[0]:
                yield found()
                parts = [[], [], []]
            now = unit[x]
            parts[0].append(fp[x:y])
            parts[1].append(size[x:y])
            parts[2] += [flat[ends[k] : ends[k + 1]].view(np.uint32).copy() for k in range(x, y)]
    if parts[0]:
        yield found()


def _alike(docs: DataFrame, text_col: str, pairs: DataFrame, tables: Tables) -> DataFrame:
    """The (src, dst) of ``pairs`` whose Jaccard is 0.8 or more, counted in full."""

    def run(batches):
        for b in batches:
            for i, j in slices(b.column(0), SLICE):
                sets = [shingles(t) for t in b.column(0).slice(i, j - i).to_pylist()]
                fp = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
                ends = np.cumsum([0, *map(len, sets)])
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(fp), held], names=["fp", "held"])

    wanted = pairs.select(F.explode(F.array("src", "dst")).alias("fp")).distinct()
    found = docs.select(F.col(f"`{text_col}`")).mapInArrow(lean(run), "fp long, held array<long>").join(wanted, "fp", "left_semi")
    sets = tables.cut(found.groupBy("fp").agg(F.first("held").alias("held")))
    both = pairs.join(sets.select(F.col("fp").alias("dst"), F.col("held").alias("y")), "dst").join(sets.select(F.col("fp").alias("src"), F.col("held").alias("x")), "src")
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("src", "dst")


def _large_units(large: DataFrame, linked, tables: Tables):
    """Links of keys with more than ``UNIT`` sets (fp, key, n): stars first, then what these leave open.

    A key's sets are dealt to blocks, and a few leading sets go to every block. Sets that this joins to a leader's group need not meet each other; each of the
    others meets every block. So a key whose sets are mostly one group costs its sets a few times, however many they are, and no link between groups is missed.
    """
    blocks = F.ceil(F.col("n") / UNIT).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks)
    leads = large.groupBy("key", "n").agg(F.array(*[F.min(F.struct(F.xxhash64("fp", F.lit(s)).alias("h"), "fp"))["fp"] for s in range(LEADERS)]).alias("leads"))
    leads = tables.cut(leads)
    everywhere = leads.select(F.explode(F.array_distinct("leads")).alias("fp"), "key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("own"))
    unit = F.xxhash64("key", "own").alias("unit")
    stars_ = linked(large.withColumn("own", own).select("fp", unit).union(everywhere.select("fp", unit)))
    yield stars_
    groups = tables.cut(connected_components(stars_.where("sure").select("src", "dst")))
    of = large.join(groups, large.fp == groups.node, "left").select("fp", "key", "n", F.coalesce("component", "fp").alias("group"))
    heads = leads.select("key", F.col("leads")[0].alias("node")).join(groups, "node", "left").select("key", F.coalesce("component", "node").alias("head"))
    open_ = tables.cut(of.join(heads, "key").where(F.col("group") != F.col("head")).select("fp", "key", "n"))
    left = open_.groupBy("key").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("parts"))
    there = open_.join(left, "key").select("fp", "key", F.pmod(F.xxhash64("fp", F.lit(LEADERS)), "parts").alias("part"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("own"))
    every = large.withColumn("own", own).join(left, "key").select("fp", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "own")
    yield linked(there.union(every).select("fp", F.xxhash64("key", "part", "own").alias("unit")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None) -> DataFrame:
    """(id, fp, component, component_id) as of ``near_duplicates``, linked by a five-word Jaccard of 0.8 or more; with ``budget`` also by SimHash (see ``fingerprints``) within so many bits.

    ``fp`` is the key of the shingle set, so equal sets are one from the start, and sets that share no band with another leave
    at once. A unit is the sets of one band key (beyond ``UNIT`` sets, see ``_large_units``); it gives only
    links that span its groups. Texts without words are one component; null is an empty text; a text of any length is read whole;
    null and repeated ids keep a row each; an empty table gives no rows.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    modest_batches(spark)

    def run(batches):
        for b in batches:
            for i, j in slices(b.column(1), SLICE):
                texts = b.column(1).slice(i, j - i).to_pylist()
                marks = np.array([0 if budget is None else fingerprint(t) for t in texts], np.uint64).view(np.int64)
                sets = [shingles(t) for t in texts]
                fp = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
                lists = []
                for rows, signed in (([band_keys(x) if len(x) else x for x in sets], np.int64), ([(x[:HELD] >> np.uint64(32)).astype(np.uint32) for x in sets], np.int32)):
                    flat = np.concatenate([rows[0][:0] if rows else np.zeros(0, signed), *rows]).view(signed)
                    lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fp), pa.array([len(x) for x in sets], pa.int32()), pa.array(marks), *lists], names=["id", "fp", "size", "mark", "keys", "held"])

    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = frame.schema["id"].dataType
    prints = cut(frame.mapInArrow(lean(run), T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL("fp long, size int, mark long, keys array<long>, held array<int>").fields])))
    ids = prints.groupBy("fp").agg(F.min("id").alias("low"))
    once = tables.cut(prints.groupBy("fp").agg(F.first("keys").alias("keys")))
    members = once.select("fp", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = tables.cut(members.join(shared, "key"))
    sets = tables.cut(prints.join(members.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.first("size").alias("size"), F.first("held").alias("held")))

    settle_executors(spark)

    def linked(units: DataFrame) -> DataFrame:
        """Links within units (unit, fp), written."""
        dealt = units.join(sets, "fp").select("unit", "fp", "size", "held").repartition(partitions(spark), "unit").sortWithinPartitions("unit")
        return tables.cut(dealt.mapInArrow(lean(_unit_links), "src long, dst long, sure boolean"))

    found = linked(members.where(F.col("n") <= UNIT).select("fp", F.xxhash64("key").alias("unit")))
    large = members.where(F.col("n") > UNIT)
    if large.limit(1).count():
        for units in _large_units(large, linked, tables):
            found = found.union(units)
    edges = found.where("sure").select("src", "dst")
    unsure = tables.cut(found.where("not sure").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    if unsure.limit(1).count():
        edges = edges.union(_alike(docs, text_col, unsure, tables))
    if budget is not None:  # sets whose texts' fingerprints are in one group are linked through the smallest of them
        marks = tables.cut(prints.select("mark", "fp").distinct())
        alike = print_groups(marks.select(F.col("mark").alias("fp")).distinct(), budget)
        marks = tables.cut(marks.join(alike, marks.mark == alike.node, "left").select("fp", F.coalesce("component", "mark").alias("group")).distinct())
        hubs = marks.groupBy("group").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
        edges = edges.union(marks.join(hubs, "group").where("fp <> hub").select(F.col("hub").alias("src"), F.col("fp").alias("dst")))
    groups = connected_components(edges)
    tables.drop()
    of = ids.join(groups, ids.fp == groups.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    low = of.groupBy("component").agg(F.min("low").alias("component_id"))
    of = of.join(low, "component").select("fp", "component", "component_id")
    return prints.select("id", "fp").join(of, "fp").select(F.col("id").alias(id_col), "fp", "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=near_duplicates, mark=fingerprint) -> DataFrame:
    """``docs`` without near duplicates: of each component of ``find`` the row with the smallest id stays, with all its columns.

    ``mark`` gives the ``fp`` of ``find`` for a text. Ids that are null (they come last) or repeated cannot name a row; then the fingerprint is compared
    too, and of rows that still tie the smallest by all columns stays (columns that hold maps count as their JSON). Other
    columns may have any name. An empty table stays empty.
    """
    id_, fp_, component_, order_ = unused(docs.columns, "_id", "_fp", "_component", "_order")
    own_id = F.col(f"`{id_col}`")
    found = cut(find(docs.select(own_id, F.col(f"`{text_col}`")), id_col, text_col))
    best = found.groupBy("component").agg(F.min(F.struct(own_id.isNull().alias("none"), own_id.alias("id"), "fp")).alias("w"))
    winners = best.select(F.col("w.id").alias(id_), F.col("w.fp").alias(f"{fp_}w"), F.col("component").alias(component_))
    unclear = found.groupBy(own_id).agg(F.count("*").alias("n")).where((F.col("n") > 1) | own_id.isNull())
    if not unclear.limit(1).count():
        return docs.join(winners.select(id_), own_id == F.col(id_), "left_semi")
    at, names = docs.columns.index(text_col), docs.columns

    def tag(batches):
        for b in batches:
            for i, j in slices(b.column(at), SLICE):
                part = b.slice(i, j - i)
                fp = np.array([mark(t) for t in part.column(at).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp)], names=[*names, fp_])

    rows = docs.mapInArrow(lean(tag), T.StructType([*docs.schema.fields, T.StructField(fp_, T.LongType())]))
    rows = rows.join(winners, own_id.eqNullSafe(F.col(id_)) & (F.col(fp_) == F.col(f"{fp_}w")))
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    key = F.struct(*[F.to_json(F.struct(F.col(f"`{f.name}`").alias("x"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema])
    return rows.groupBy(component_).agg(F.min_by(whole, key).alias(order_)).select(f"{order_}.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of texts linked by SimHash (three or fewer differing bits) or by a five-word Jaccard of 0.8 or more one document stays, with its columns unchanged (nulls, ties and repeats as in ``keep_one``)."""
    settle_executors(spark)
    return keep_one(docs, find=partial(near_copies, budget=BITS), mark=set_key)
