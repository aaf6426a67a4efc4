"""Files read one by one, the versioned store, pages of long texts, useful values at any depth."""

import random
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.nested import useful_within
from lumenfold.operators import paging
from lumenfold.sources import documents as D
from lumenfold.sources.job_files import Files, JobFilesReader, job_files, write_files
from lumenfold.sources.store import KeyedStore

XSD = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="A" type="xs:date"/></xs:schema>'
GOOD = {"1": '{"a": {"b": [1, 2.0]}}', "2": "<r><x>t</x></r>", "3": "[]", "4": ""}
BAD = {"5": '{"a": ', "6": "<r><x></r>", "7": '<!DOCTYPE r [<!ENTITY e "x">]><r>&e;</r>', "8": "no data"}


@pytest.fixture
def folder(tmp_path):
    for doc, text in (GOOD | BAD).items():
        (tmp_path / doc).mkdir()
        (tmp_path / doc / ("data.json" if text[:1] in "{[" else "data.xml")).write_text(text)
        (tmp_path / doc / "schema.xsd").write_text(XSD if doc in GOOD else XSD[:-5])
    (tmp_path / "9").mkdir()
    (tmp_path / "9" / "data.json").write_bytes(b"\xff\xfe{")
    (tmp_path / "9" / "_tmp.json").write_text("left out")
    return str(tmp_path)


def test_bad_files_are_rows_with_errors(spark, folder):
    rows = job_files(spark, folder, kind="data", groupFiles="2").collect()
    assert {(r.doc_id, r.key, r.value) for r in rows if not r.error} == {("1", "a.b.0", "1"), ("1", "a.b.1", "2.0"), ("2", "x", "t")}
    assert sorted(r.doc_id for r in rows if r.error) == ["5", "6", "7", "8", "9"] and all(r.key is None for r in rows if r.error)
    schemas = job_files(spark, folder, kind="xsd").collect()
    assert sorted((r.doc_id, r.name) for r in schemas if not r.error) == [(d, "A") for d in "1234"] and sorted(r.doc_id for r in schemas if r.error) == ["5", "6", "7", "8"]
    with pytest.raises(Exception, match="JSONDecodeError"):
        job_files(spark, folder, kind="data", mode="failfast").where("doc_id = '5'").collect()
    assert job_files(spark, f"{folder}/4", kind="data").count() == 0


def test_rows_of_texts_keep_bad_ones_on_request(spark):
    df = spark.createDataFrame(list((GOOD | BAD | {"0": None}).items()), "doc_id string, content string")
    got = D.data_fields(df, keep_bad=True).collect()
    assert sorted(r.doc_id for r in got if r.error) == ["5", "6", "7", "8"] and sorted(r.key for r in got if not r.error) == ["a.b.0", "a.b.1", "x"]
    assert [r.error is None for r in D.schema_fields(spark.createDataFrame([("1", XSD), ("2", "<")], "doc_id string, content string"), keep_bad=True).orderBy("doc_id").collect()] == [True, False]
    with pytest.raises(Exception):
        D.data_fields(df).collect()


def test_filters_on_doc_id_leave_files_unread(spark, folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = JobFilesReader({"path": folder, "kind": "data", "groupfiles": "2"}, None)
    assert [len(p.paths) for p in reader.partitions()] == [2, 2, 2, 2, 1]
    left = list(reader.pushFilters([In(("doc_id",), ("1", "2", "8")), EqualTo(("key",), "x"), GreaterThan(("doc_id",), "1")]))
    assert len(left) == 2 and [len(p.paths) for p in reader.partitions()] == [2, 1]
    list(reader.pushFilters([EqualTo(("doc_id",), "2")]))
    assert [p.paths[0].rsplit("/", 2)[-2:] for p in reader.partitions()] == [["2", "data.xml"]]
    list(reader.pushFilters([EqualTo(("doc_id",), "3")]))
    assert reader.partitions() == [Files([])] and list(reader.read(Files([]))) == []
    assert [r.value for r in job_files(spark, folder, kind="data").where("doc_id = '2' and key = 'x'").collect()] == ["t"]
    with pytest.raises(ValueError):
        JobFilesReader({"path": folder, "kind": "pdf"}, None)


def test_files_are_written_by_the_tasks_that_have_them(spark, tmp_path):
    rows = [(f"{i}/f.bin", bytes([i]) * i) for i in range(5)] + [("n", None)]
    got = write_files(spark.createDataFrame(rows, "path string, content binary").repartition(3), str(tmp_path)).collect()
    assert {r.path: r.bytes for r in got} == {p: len(c or b"") for p, c in rows} and all((tmp_path / p).read_bytes() == (c or b"") for p, c in rows)


def pairs(spark, **kv):
    return spark.createDataFrame(list(kv.items()), "key string, value string")


def values(df):
    return {r.key: (r.value, r.version) for r in df.collect()}


def test_versions_stay_readable_and_buckets_untouched(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path / "s"), 4)
    assert s.latest() == 0 and s.read().count() == 0
    assert s.put(pairs(spark, **{f"k{i}": "a" for i in range(20)})) == 1
    assert s.put(spark.createDataFrame([("k3", "b"), ("k3", "a"), (None, "x"), ("new", None)], "key string, value string")) == 2
    assert s.remove(pairs(spark, k4="", none="")) == 3
    assert values(s.read(1)) == {f"k{i}": ("a", 1) for i in range(20)}
    assert values(s.read(2)) == values(s.read(1)) | {"k3": ("b", 2), "new": (None, 2)}
    assert values(s.read()) == {k: v for k, v in values(s.read(2)).items() if k != "k4"}
    one, two = s._manifest(1)["files"], s._manifest(2)["files"]
    assert sum(one[b] != two[b] for b in one) <= 2 and sum(one[b] == two[b] for b in one) >= 2
    again = KeyedStore(spark, str(tmp_path / "s"), 99)
    assert again.buckets == 4 and again.reset() == 4 and again.read().count() == 0 and again.read(3).count() == 20
    assert s.put(pairs(spark)) == 4
    with pytest.raises(ValueError):
        s.read(77)


def test_a_writer_that_fails_leaves_the_version_before(spark, tmp_path, monkeypatch):
    s = KeyedStore(spark, str(tmp_path / "s"), 4)
    s.put(pairs(spark, a="1"))
    monkeypatch.setattr(s, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        s.put(pairs(spark, a="2", b="2"))
    monkeypatch.undo()
    assert values(s.read()) == {"a": ("1", 1)}
    boom = F.udf(lambda x: 1 / 0, "string")
    with pytest.raises(Exception):
        s.put(pairs(spark, a="3").withColumn("value", boom("value")))
    assert values(s.read()) == {"a": ("1", 1)} and s.put(pairs(spark, b="4")) == 2


def test_writers_at_once_lose_nothing(spark, tmp_path):
    stores = [KeyedStore(spark, str(tmp_path / "s"), 3) for _ in range(3)]
    failed = []

    def write(n):
        try:
            for k in range(2):
                stores[n].put(pairs(spark, **{f"w{n}-{k}": str(n), "shared": f"{n}{k}"}))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = values(stores[0].read())
    assert not failed and stores[0].latest() == 6 and {k for k in got} == {"shared"} | {f"w{n}-{k}" for n in range(3) for k in range(2)}


@pytest.mark.parametrize("limit,strict,most", [(1260.0, False, 10), (300.0, True, None), (1.0, False, None), (90.5, True, 3)])
def test_pages_as_by_a_fold(spark, limit, strict, most):
    rng = random.Random(1)
    rows = [(d, i, rng.choice([0, 0, 5, 89.5, 90.5, 300, 1259, 1260, 2000, None])) for d, n in (("a", 300), ("b", 1), ("c", 40)) for i in range(n)]
    rows += [("z", i, 0.0) for i in range(70)]
    want, now = {}, None
    for d, i, size in rows:
        size = size or 0
        if d != now:
            now, page, total, n = d, -1, 0, 0
        if page < 0 or (total + size > limit if strict else total + size >= limit) or (most and n >= most):
            page, total, n = page + 1, 0, 0
        total, n = total + size, n + 1
        want[d, i] = page
    df = spark.createDataFrame([(d, i, None if s is None else float(s)) for d, i, s in rows], "doc_id string, i int, size double")
    assert {(r.doc_id, r.i): r.page for r in paging.pages(df, limit, strict, most, block=16).collect()} == want


def test_texts_of_both_kinds_are_packed_as_by_a_fold(spark):
    """Short texts are folded as they are read, long ones have their words as rows; block 40 has both."""
    rng = random.Random(2)
    texts = [(d, " ".join("é" * rng.choice([0, 1, 5, 30, 99, 100, 250]) for _ in range(n))) for d, n in enumerate([1, 2, 39, 40, 41, 300, 1000])]
    texts += [(90, ""), (91, " "), (92, "x" * 300), (93, "  a  "), (94, " " * 30), (95, " " * 90)]
    want = set()
    for d, text in texts:
        page, n, letters = 0, 0, 0
        for size in map(len, text.split(" ")):
            if n == 12 or (n and letters + size >= 200):
                want.add((d, page, n, letters))
                page, n, letters = page + 1, 0, 0
            n, letters = n + 1, letters + size
        want.add((d, page, n, letters))
    df = spark.createDataFrame([*texts, (99, None), (None, "x y")], "doc_id long, text string")
    for block in (1, 40, 4096):
        got = [tuple(r) for r in paging.packed_texts(df, " ", 2, 100, 12, block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_next_breaks_are_told_in_linear_frames(spark):
    """A frame that runs on to the partition's end is summed anew for each row, so that a span of many lines takes their square."""
    rows = spark.createDataFrame([("a", 0, 1)], "doc_id string, i long, size int").withColumns({"size": F.col("size").cast(paging.SUM), "upto": F.col("size").cast(paging.SUM)})
    plan = paging._next(rows, 10.0, False, 3, 640.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_pages_of_nothing(spark):
    assert paging.packed_lines(spark.createDataFrame([], "doc_id long, i int, size int")).count() == 0 and paging.stacked_lines(spark.createDataFrame([(1, 0, 5)], "doc_id long, i int, size int"), 10.0, 2.0).collect()[0].page == 0


def plain(v, top=True):
    if isinstance(v, dict):
        return any(plain(x, False) for x in v.values())
    if v is None:
        return not top
    return len(v) > 0 if isinstance(v, list) else str(v).strip() != ""


def test_useful_at_any_depth(spark):
    kind = T.StructType.fromDDL("a struct<b: struct<c: string, d: array<string>>, n: int>, m map<string, struct<x: string>>, t string")
    at = lambda c=" ", d=(), n=0, m=None, t="": {"a": {"b": {"c": c, "d": list(d)}, "n": n}, "m": m or {}, "t": t}
    rows = [at(), {"a": {"b": {"c": "", "d": []}, "n": None}, "m": {}, "t": " "}, at(c="x"), at(d=[""]), at(t="y"), at(m={"k": {"x": " "}}), at(m={"k": {"x": "z"}}), None]
    df = spark.createDataFrame([(r,) for r in rows], T.StructType([T.StructField("v", kind)]))
    got = [r[0] for r in df.select(useful_within(F.col("v"), kind)).collect()]
    assert got == [plain(r) for r in rows] and got[0] and not got[-1]
    only = T.StructType.fromDDL("a struct<b: string, c: array<int>>, t string")
    rows = [{"a": {"b": " ", "c": []}, "t": ""}, {"a": None, "t": ""}, {"a": {"b": None, "c": []}, "t": " "}, {"a": {"b": "", "c": [1]}, "t": ""}]
    df = spark.createDataFrame([(r,) for r in rows], T.StructType([T.StructField("v", only)]))
    assert [tuple(r) for r in df.select(useful_within(F.col("v"), only), useful_within(F.col("v"), only, False)).collect()] == [(False, False), (True, False), (True, False), (True, True)]
    with pytest.raises(ValueError):
        useful_within(F.col("v"), T.StringType())
