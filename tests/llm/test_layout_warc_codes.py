"""Clustered layout, WARC archives and vector codes against plain computations, with nulls, ties, repeats, long and empty inputs."""

import gzip
import hashlib
import io
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import codes, layout, warc

DOCS = "doc_id long, text string, lang string, source string, z long, file long, position string"


def by_hand(rows, file_rows):
    """The layout of (doc_id, text, lang, source) rows, row by row."""
    size = lambda t: -1 if t is None else len(t.encode())
    mark = lambda s: b"" if s is None else b"\x01" + s.encode()
    values = {"source": [mark(r[3]) for r in rows], "lang": [mark(r[2]) for r in rows], "length": [size(r[1]) for r in rows], "date": [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 365 for r in rows]}
    n = len(rows)
    at = {d: [16 * sum(o < x for o in v) // n for x in v] for d, v in values.items()}
    cells = [tuple(at[d][i] for d in layout.DIMS) for i in range(n)]

    def z(i):
        return int("".join(f"{at[d][i]:04b}"[b] for b in range(4) for d in layout.ORDER), 2)

    order = sorted(range(n), key=lambda i: (z(i), rows[i][0] is not None, rows[i][0] or 0))
    file_of = {i: p // file_rows for p, i in enumerate(order)}
    members = {}
    for i, f in file_of.items():
        members.setdefault(f, []).append(cells[i])
    bounds = {f: [(min(c[d] for c in m), max(c[d] for c in m)) for d in range(4)] for f, m in members.items()}
    out = []
    for p, i in enumerate(order):
        s, g, le, da = cells[i]
        inside = lambda c: c[0] == s and c[1] == g and abs(c[2] - le) <= 2 and abs(c[3] - da) <= 2  # noqa: B023, E731
        meets = lambda b: b[0][0] <= s <= b[0][1] and b[1][0] <= g <= b[1][1] and b[2][0] <= le + 2 and b[2][1] >= le - 2 and b[3][0] <= da + 2 and b[3][1] >= da - 2  # noqa: B023, E731
        own = ",".join(f"{a},{b}" for a, b in bounds[file_of[i]])
        out.append((rows[i][0], z(i), p, file_of[i], sum(map(meets, bounds.values())), sum(any(map(inside, m)) for m in members.values()), own))
    return out


def laid_out(df, file_rows):
    made = layout.cluster(df, "doc_id", layout.document_dims(), layout.ORDER, file_rows=file_rows)
    return layout.pruning(made, layout.ORDER, layout.REACH).select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")


@pytest.fixture(scope="module")
def documents(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), "ä" * int(rng.integers(0, 60)), ["en", "de", None][int(rng.integers(3))], "hot" if i % 3 else f"s{int(rng.integers(9))}") for i in range(300)]
    rows += [rows[7]] * 40 + [(None, None, None, None)] * 3 + [(301, "x" * 1_000_000, "en", "y" * 5000), (302, "", "", "")]
    return rows, spark.createDataFrame([(*r, 7, 7, "clash") for r in rows], DOCS).repartition(7)


def test_layout_equals_row_by_row(documents):
    rows, df = documents
    want = by_hand(rows, 20)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in laid_out(df, 20).collect())


def test_layout_of_few_rows(spark, documents):
    assert laid_out(spark.createDataFrame([], DOCS), 20).count() == 0
    one = spark.createDataFrame([(5, "a", "en", "s", 0, 0, "")], DOCS)
    assert [tuple(r) for r in laid_out(one, 20).collect()] == by_hand([(5, "a", "en", "s")], 20)


def test_written_files_are_the_layout_and_are_pruned(spark, documents, tmp_path):
    rows, df = documents
    df = df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    made = layout.cluster(df, "doc_id", layout.document_dims(), layout.ORDER, file_rows=20)
    path = f"file://{tmp_path}/files"
    bounds = layout.write_files(df.drop("file"), made, "doc_id", path, files_a_task=3)
    data = spark.read.parquet(f"{path}/data")
    assert data.count() == df.count() and data.select("doc_id", "text", "lang").exceptAll(df.select("doc_id", "text", "lang")).count() == 0
    per_file = data.groupBy("file", F.input_file_name().alias("f")).count().collect()
    assert len(per_file) == bounds.count() and {r["count"] for r in per_file if r.file < len(per_file) - 1} == {20}
    box = {"source": (3, 3), "length": (0, 4)}
    got = layout.read_box(spark, path, box)
    files = {r.file for r in bounds.collect() if r.lo_source <= 3 <= r.hi_source and r.lo_length <= 4 and r.hi_length >= 0}
    assert {r.file for r in got.select("file").distinct().collect()} == files and len(files) < len(per_file)


# ---- WARC -------------------------------------------------------------------------------------------------------------

ODD = [b"", b"short", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 4, b"\0\xff" * 400_000, b"\r\n\r\n\n", bytes(range(256)) * 3]


def written(rows, sl=True, plain=False):
    out = b""
    for r in rows:
        data = warc.record_bytes({"date": "2024-01-01T00:00:00Z", **r})
        out += data if plain else warc.member(data) if sl else gzip.compress(data)
    return out


def read_back(data, compressed=True, wanted=lambda r: True, payloads=True):
    return list(warc.records(io.BufferedReader(io.BytesIO(data), 64), compressed, wanted, payloads))


@pytest.mark.parametrize("form", ["sl", "no sl", "one member", "plain"])
def test_records_come_back(form):
    rows = [{"record_type": ["response", "revisit", "resource"][i % 3], "record_id": f"<{i}>", "target_uri": "http://x/ü\r\nWARC-Type: bad" if i == 4 else None, "payload": p} for i, p in enumerate(ODD * 2)]
    data = written(rows, form == "sl", form in ("plain", "one member"))
    data = gzip.compress(data) if form == "one member" else data
    got = read_back(data, form != "plain")
    assert [(r["record_type"], r["record_id"], r["payload"]) for r in got] == [(r["record_type"], r["record_id"], b"" if r["record_type"] == "revisit" else r["payload"]) for r in rows]
    assert got[4]["target_uri"] == "http://x/ü%0D%0AWARC-Type: bad"
    some = read_back(data, form != "plain", lambda r: r["record_type"] == "resource", False)
    assert [r["record_id"] for r in some] == [r["record_id"] for r in rows if r["record_type"] == "resource"]
    with pytest.raises(warc.BrokenArchive):
        read_back(data[:-9], form != "plain", lambda r: False)


def test_unwanted_members_are_not_inflated(monkeypatch):
    rows = [{"record_type": "response", "record_id": f"<{i}>", "payload": np.random.default_rng(i).bytes(400_000)} for i in range(5)]
    seen, real = [], zlib.decompressobj

    class Counting:
        def __init__(self, *a):
            self.inner = real(*a)

        def decompress(self, *a):
            out = self.inner.decompress(*a)
            seen.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.inner, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    assert not read_back(written(rows), wanted=lambda r: False) and sum(seen) < 5 * 150_000
    seen.clear()
    assert not read_back(written(rows, sl=False), wanted=lambda r: False) and sum(seen) > 5 * 400_000


@pytest.fixture(scope="module")
def pages(spark):
    long_one = "p" * 100
    rows = [(5, "u5", long_one), (3, "u3", long_one), (3, "u3", long_one), (9, None, long_one), (None, "u", long_one), (1, "u1", None), (2, "u2", ""), (4, "u4", "p" * 99), (6, "u6", "p" * 99), (None, "n", "q" * 200), (None, "n", "q" * 200), (7, "bad\nuri", "é" * 60), (8, "u8", "é" * 60), (10, "u10", "x" * 3_000_000)]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(5)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_page_archive(spark, pages, tmp_path, compression):
    rows, df = pages
    path = f"file://{tmp_path}/pages"
    warc.write_archive(spark, warc.with_revisits(df), path, compression=compression, maxFileBytes="2000")
    got = warc.archived(spark, path).collect()
    kinds = sorted(((r.record_type, r.record_id.split(":")[2], (r.refers_to or "::").split(":")[2], len(r.payload)) for r in got), key=str)
    want = [("response", "3", "", 100)] * 2 + [("revisit", "5", "3", 0), ("revisit", "9", "3", 0), ("revisit", "", "3", 0), ("response", "1", "", 0), ("response", "2", "", 0), ("response", "4", "", 99), ("response", "6", "", 99)]
    want += [("response", "", "", 200)] * 2 + [("response", "7", "", 120), ("revisit", "8", "7", 0), ("response", "10", "", 3_000_000)]
    assert kinds == sorted(want, key=str) and not [f for f in (tmp_path / "pages").iterdir() if f.name.startswith("_")]
    for r in got:
        if r.record_type == "response":
            assert r.payload_digest == "sha256:" + hashlib.sha256(r.payload).hexdigest()
    assert warc.archived(spark, path, ["record_id"], types="revisit").count() == 4
    assert warc.archived(spark, path, ["record_id"], **{"header.WARC-Target-URI": "bad%0Auri"}).count() == 1


def test_filters_reach_the_archive(spark, pages, tmp_path):
    path = f"file://{tmp_path}/pages"
    warc.write_archive(spark, warc.with_revisits(pages[1]), path)
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name, None)
    with warc.pushing(spark):
        df = warc.archived(spark, path, pushdown="true")
        some = df.where("record_type = 'revisit' AND refers_to IS NOT NULL AND NOT (target_uri = 'u5') AND payload_digest IS NOT NULL")
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"\bFilter\b", plan)  # no filter is left to Spark
        assert sorted(r.target_uri or "" for r in some.collect()) == ["u", "u8"]  # the page without a uri: unknown
        assert df.where("target_uri LIKE 'u%' AND content_length > 1000000").count() == 1
        assert df.where("octet_length(payload) = 99").count() == 2  # stays with Spark
    assert spark.conf.get(name, None) == before


def test_broken_archive_is_named_or_kept_up_to_the_break(spark, tmp_path):
    data = written([{"record_type": "resource", "record_id": f"<{i}>", "payload": b"x" * 50} for i in range(3)], plain=True)
    (tmp_path / "a.warc").write_bytes(data[:-60])
    (tmp_path / "b.warc").write_bytes(b"")
    with pytest.raises(Exception, match="a.warc at"):
        warc.archived(spark, f"file://{tmp_path}").count()
    assert warc.archived(spark, f"file://{tmp_path}", mode="permissive").count() == 2


def test_empty_archive(spark, tmp_path):
    warc.write_archive(spark, warc.with_revisits(spark.createDataFrame([], "page_id long, url string, html string")), f"file://{tmp_path}/none")
    assert warc.archived(spark, f"file://{tmp_path}/none").count() == 0


# ---- codes ------------------------------------------------------------------------------------------------------------


def lloyd(rows, parts=8, entries=16, rounds=6):
    """Plain rounds in Python's integers: entries a part, and (code, error) of each row."""
    width = -(-max(len(v) for _, v in rows) // parts) * parts
    v = [(i, [int(x) for x in x] + [0] * (width - len(x))) for i, x in rows]
    w = width // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    first = [x for _, x in sorted(v, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    books = [[cut(x, p) for x in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, p: min(range(len(first)), key=lambda e: (far(cut(x, p), books[p][e]), e))
    for _ in range(rounds):
        chosen = [[near(x, p) for p in range(parts)] for _, x in v]
        for p in range(parts):
            for e in range(len(first)):
                own = [cut(x, p) for (_, x), c in zip(v, chosen, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return books, sorted((str(i), bytes(near(x, p) for p in range(parts)), min(2**63 - 1, sum(far(cut(x, p), books[p][near(x, p)]) for p in range(parts)))) for i, x in v)


def coded(df, **kw):
    made = codes.compress(df, "vec_id", F.col("v"), ["label", "code2"], **kw)
    return made, sorted((str(r.vec_id), bytes(r.code), r.error) for r in made.rows.collect())


@pytest.mark.parametrize("kind", ["plain", "ties", "large"])
def test_codes_equal_plain_rounds(spark, kind):
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, (20, 16))
    rows = [(int(i), (centres[i % 20] + rng.integers(-200, 200, 16)).tolist()) for i in range(240)]
    if kind == "ties":
        rows = [(i, [int(x) for x in rng.integers(0, 3, 16)]) for i in range(200)] + [(3, [1] * 16)] * 30 + [(None, [2] * 16), (7, [1, 2]), (8, [])]
    if kind == "large":
        rows = [(i, [int(x) * 2**40 for x in rng.integers(-9, 9, 16)]) for i in range(60)] + [(99, [2**62] * 16), (98, [-(2**62)] * 16)]
    df = spark.createDataFrame([(i, v, 1, None) for i, v in rows], "vec_id long, v array<long>, label int, code2 string").repartition(3)
    books, want = lloyd(rows)
    made, got = coded(df)
    assert [b.tolist() for b in made.books] == books and got == want
    assert len(made.scans) == 6 and made.scans[0] == 8 * len(rows)
    if kind == "plain":  # well apart: the bounds hold almost everywhere once entries settle
        assert made.scans[-1] < made.scans[0] / 10


def test_codes_of_few_rows(spark):
    schema = "vec_id long, v array<long>, label int, code2 string"
    assert coded(spark.createDataFrame([], schema))[1] == []
    rows = [(2, [5] * 8), (1, [3] * 8)]
    made, got = coded(spark.createDataFrame([(i, v, None, "x") for i, v in rows], schema))
    assert got == lloyd(rows)[1] and [b.tolist() for b in made.books] == lloyd(rows)[0]
    back = codes.decode(made.rows, made.books).select("vec_id", "decoded").collect()
    assert {r.vec_id: r.decoded for r in back} == dict(rows)


def test_scaled_floors_and_refuses(spark):
    df = spark.createDataFrame([([-0.5, 1e-9, -1e-9],), ([None, 1.0],), ([float("nan")],), ([float("-inf")],), (None,), ([3e38],), ([],)], "e array<float>")
    got = [r[0] for r in df.select(codes.scaled(F.col("e"))).collect()]
    assert got == [[-2048, 0, -1], None, None, None, None, [2**62], []]
