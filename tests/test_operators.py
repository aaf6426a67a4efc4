"""Matching, reports, scores, rendering, sources and jobs."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import match as J
from lumenfold.operators import render, score
from lumenfold.operators import report as R
from lumenfold.sources import documents as S
from lumenfold.streaming import jobs as X
from tests.test_functions import model_name


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def confidence(t, n):
    if t == n:
        return 1.0
    lev = 1 - distance(t, n) / max(len(t), len(n)) if t and n else 0.0
    return 0.75 if lev < 0.75 and (t in n or n in t) else lev


def inputs(spark, seed):
    r = random.Random(seed)
    words = ["Nome", "nome_segurado", "Data", "data", "CPF", "Valor", "a", "—", "  ", "R$ 1.234,56", "Número", "zzz", "Cidade-UF"]
    blocks = [(d, i, r.choice(words), 0.1, 0.2, 0.3, 0.4, 1 + i // 3) for d in "AB" for i in range(12)]
    schema = [(d, i, n, "date" if i % 3 == 0 else "xs:decimal") for d in "AB" for i, n in enumerate(["NomeSegurado", "Data", "numero", "Valor", "Data", "QQQ"])]
    data = [("A", i, k, str(i)) for i, k in enumerate(["data", "Data", "extra.key", "VALOR", "extra.key"])]
    return (spark.createDataFrame(blocks, "doc_id string, block_idx long, text string, x double, y double, width double, height double, page int"),
            spark.createDataFrame(schema, "doc_id string, field_idx long, name string, type string"),
            spark.createDataFrame(data, "doc_id string, key_idx long, key string, value string"), blocks, schema, data)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_match_as_a_loop(spark, seed):
    b, s, d, blocks, schema, data = inputs(spark, seed)
    got = {(r.doc_id, r.part, r.ord): r for r in J.match_fields(b, s, d).collect()}
    for doc, k, name, _ in schema:
        best, text = 0.0, ""
        for bd, _, t, *_ in blocks:
            if bd == doc and t.strip() and (c := confidence(model_name(t), model_name(name))) > best:
                best, text = c, t
        keys = {model_name(x[2]): x[3] for x in data if x[0] == doc}
        r = got[doc, 0, k]
        assert (r.pdfText, r.raw_confidence, r.data_value) == (text, round(best, 4), keys.get(model_name(name), "")), (doc, name)
        missing = bool(keys) and model_name(name) not in keys
        assert r.status == ("not_found" if missing or best < 0.5 else "ok" if best >= 0.8 else "ambiguous")
        assert (r.boundingBox is None) == (text == "")
    assert sorted(r.jsonPath for r in got.values() if r.part == 1) == ["extra.key", "extra.key"]


def test_leaf_keys_candidates_and_edits(spark):
    b, s, d, *_ = inputs(spark, 1)
    nested = d.withColumn("key", F.concat(F.lit("root."), "key"))
    assert J.match_fields(b, s, nested).where("data_value != '' and part = 0").count() == 0 < J.match_fields(b, s, nested, "leaf").where("data_value != '' and part = 0").count()
    norm = lambda c: J.normalize_name(F.col(c))
    top = J.candidates(s.withColumn("norm", norm("name")), b.withColumn("norm", norm("text")), 2)
    assert top.where(F.size("candidates") > 2).count() == 0
    m = J.match_fields(b, s, d)
    edited = J.edit_mappings(m, m.where("ord = 0 and part = 0").select("id", F.lit("new").alias("path")))
    assert edited.where("isManual and status = 'ok' and jsonPath = 'new'").count() == 2 and edited.count() == m.count()
    assert J.cross_validate(s, d).where("problem = 'missing_in_schema'").count() == 2


def test_fields_of_blocks(spark):
    b = spark.createDataFrame([("A", 0, " Data "), ("A", 1, "x Nome y Data"), ("A", 2, "none")], "doc_id string, block_idx long, text string")
    f = spark.createDataFrame([("A", 0, "Nome"), ("A", 1, "Data")], "doc_id string, ord long, path string")
    assert {r.block_idx: r.field for r in J.fields_of_blocks(b, f).collect()} == {0: "Data", 1: "Nome", 2: None}


def test_pages_and_chunks(spark):
    df = spark.range(35).withColumn("g", F.lit("x"))
    rows = R.numbered(df, ["id"]).orderBy("id").collect()
    assert [r.rn for r in rows] == list(range(1, 36))
    p = R.pages(df, "id", ["id"], 16, extra_pages=3).orderBy("page").collect()
    assert [len(r["items"]) for r in p] == [16, 16, 3] and p[0].pages == 6 and p[0].first
    assert [r.n for r in R.pages(df, "id", ["id"], 18, first=15, partition=["g"]).select(F.size("items").alias("n"), "page").orderBy("page").collect()] == [15, 18, 2]
    assert R.full_chunks(df, "id", 16, ["g"], first=14).count() == 30 and R.full_chunks(df, "id", 5, ["g"], full_only=False).count() == 35


def test_packing_as_a_loop(spark):
    r = random.Random(4)
    lists = [[r.randint(0, 400) for _ in range(r.randint(0, 25))] for _ in range(60)] + [[2000, 10, 2000]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>")
    got = {q.i: q.p for q in rows.select("i", R.packed_pages(F.col("x")).alias("p")).collect()}
    for i, sizes in enumerate(lists):
        page, chars, n, want = -1, 0, 0, []
        for s in sizes:
            if page < 0 or (chars + s) / 90 >= 14 or n >= 10:
                page, chars, n = page + 1, 0, 0
            chars, n = chars + s, n + 1
            want.append(page)
        assert got[i] == want
    assert spark.range(1).select(R.height_pages(F.array(F.lit(5), F.lit(5), F.lit(3)), 11.0, 1.0)).first()[0] == [0, 0, 1]


def test_first_sums_and_lists(spark):
    df = spark.createDataFrame([(0, " a ", "1.234,50"), (1, "a", "x"), (2, "", "2,00"), (3, None, None)], "i int, k string, v string")
    assert {r.i for r in R.first_per_key(df, "k", "i").collect()} == {0} and R.first_per_key(df, "k", "i", trim=True).first().k == "a"
    assert float(df.agg(R.sum_br(F.col("v"))).first()[0]) == 1236.5
    assert df.agg(R.joined_list(F.col("k"), F.col("v"), F.col("i"))).first()[0] == " a : 1.234,50; a: x; : 2,00"
    assert R.multi_output(df, {"p": F.col("i") > 0, "q": F.col("i") > 2}).groupBy("output").count().orderBy("output").collect() == [("p", 3), ("q", 1)]
    assert R.totals(df, ["i"]).first()[0] == 6
    codes = spark.createDataFrame([(1,), (1,), (3,)], "c int")
    for bound in (10, 0):
        assert {r.i for r in R.in_list(df, "i", codes, "c", "f", bound).where("f").collect()} == {1, 3}


def test_scores_and_checks(spark):
    m = spark.createDataFrame([("A", "1", "high", "p", 1.0), ("A", "2", "low", "q", 0.123), ("A", "3", "high", "r", 0.9)], "doc_id string, id string, confidence string, jsonPath string, raw_confidence double")
    r = score.fidelity(m).first()
    assert (r.score, r.review) == (66.7, 1) and score.fidelity(m.limit(0)).first().score == 0.0
    assert score.suggestions(m).first().message.endswith("(raw: 0.12). Verificar manualmente.") and score.fidelity(m).first().comment == "66.7% dos campos mapeados com alta confiança. 1 campos requerem revisão."
    lit = F.lit
    c = score.checklist(lit("<a ./js/>"), lit("x"), lit("y"), lit("j"), F.array(lit("l")))
    assert spark.range(1).select(score.downloadable(c), score.downloadable(score.checklist(lit(""), lit("x"), lit("y"), lit("j"), F.array()))).first()[:] == (True, False)
    df = spark.createDataFrame([(None, "h")], "html string, indexHtml string")
    assert score.result_payload(df, {"out": (["html", "indexHtml", "none"], lit(""))}).first().out == "h"


def test_rendering(spark):
    one = spark.range(1)
    assert one.select(render.span(F.lit("a b"), F.lit("t"), F.lit(0.1234), F.lit(0.5))).first()[0] == '<span class="field" style="left:12.3%;top:50.0%;" data-bind="text: a_b"></span>'
    assert one.select(render.preview(F.lit("C {js}"), F.lit("S"), F.lit("J"), F.lit("E"), "{styles}|{content}|{js}")).first()[0] == "S|C E\nJ|E\nJ"
    df = spark.createDataFrame([("A", None, "c", "j", "e")], "doc_id string, html string, css string, js string, example string")
    z = zipfile.ZipFile(io.BytesIO(bytes(render.bundles(df).first().bundle)))
    assert z.read("index.html") == b"<!-- template vazio -->" and z.namelist() == ["index.html", "css/style.css", "js/base.js", "exemplo.js"]
    assert one.select(render.bind_template(F.lit("var data = ##TEMPLATE_DATA##;"), F.lit("{}"))).first()[0] == "var data = {};"
    m = spark.createDataFrame([("A", 0, 1, "b'", "it's", ""), ("A", 0, 0, "a", "t", "v")], "doc_id string, part int, ord int, jsonPath string, pdfText string, data_value string")
    r = render.scripts(m).first()
    assert r.js.index("  a: ko") < r.js.index("  b_: ko.observable('it\\'s'),") and r.example == r"""var exampleData = {"a": "t", "b_": "it\'s"};"""
    assert "self.a = ko.observable('t');" in render.scripts(m, valid=True).first().js


def test_sources(spark, tmp_path):
    xsd = '<xs:schema xmlns:xs="u"><xs:element name="R"><xs:complexType><xs:element name="A" type="xs:date" minOccurs="0"><xs:annotation><xs:documentation> hi </xs:documentation></xs:annotation></xs:element><xs:element ref="x"/><xs:element name="A"/></xs:complexType></xs:element></xs:schema>'
    f = spark.createDataFrame([("1", xsd), ("2", None)], "doc_id string, content string")
    assert [(r.name, r.type, r.min_occurs, r.description) for r in S.schema_fields(f).orderBy("field_idx").collect()] == [("R", "xs:string", "1", ""), ("A", "xs:date", "0", "hi"), ("A", "xs:string", "1", "")]
    d = spark.createDataFrame([("1", ' {"a": {"b": 1}}'), ("2", "<r><a>1</a><!-- c --><b> </b><a>2</a></r>")], "doc_id string, content string")
    assert sorted((r.doc_id, r.key, r.value) for r in S.data_fields(d).collect()) == [("1", "a.b", "1"), ("2", "a", "2")]
    for bad in ('{"a"', '<!DOCTYPE x><r>1</r>'):
        with pytest.raises(Exception, match="JSON|document type"):
            S.data_fields(spark.createDataFrame([("1", bad)], "doc_id string, content string")).collect()
    t = spark.createDataFrame([("1", "var data = {\"a\": [1, 2,], /* c */ \"b\": 1,};")], "doc_id string, content string")
    assert S.template_data(t).first().json.replace(" ", "") == '{"a":[1,2],"b":1}'
    c = spark.createDataFrame([(xsd, '{"a":1,"b":2}'), ("", "[1]")], "x string, j string")
    assert [(r[0].elements, r[0].optional, r[1]) for r in c.select(S.schema_counters(F.col("x")), S.top_level_keys(F.col("j"))).collect()] == [(4, 1, 2), (0, 0, 0)]
    job = tmp_path / "123e4567-e89b-42d3-a456-426614174000"
    job.mkdir()
    for name in ("input.pdf", "data.xml", "data.json", "other"):
        (job / name).write_text(name)
    (tmp_path / "not-a-job").mkdir()
    (tmp_path / "not-a-job" / "input.pdf").write_text("x")
    assert sorted((r.kind, bytes(r.content)) for r in S.load_jobs(spark, str(tmp_path)).collect()) == [("data", b"data.json"), ("pdf", b"input.pdf")]
    cells = spark.createDataFrame([("1", 1, 0, 1, ["c", None]), ("1", 1, 0, 0, ["a", "b"]), ("1", 1, 1, 0, [None, " "])], "doc_id string, page int, table int, row int, cells array<string>")
    assert sorted(r.text for r in S.tables_to_blocks(cells).collect()) == [" |  ", "a | b\nc | "] and S.table_text([["a", None]]) == "a | "
    assert S.open_project(S.save_project({"a": 1})) == {"version": "1.0", "a": 1}
    with pytest.raises(ValueError):
        S.open_project('{"version": "2.0"}')


EVENTS = [("a", "2024-01-01 00:00:00", "step", 20), ("a", "2024-01-01 00:00:10", "done", None), ("b", "2024-01-01 00:00:00", "step", 60), ("b", "2024-01-01 00:06:00", "step", 85), ("c", "2024-01-01 00:00:00", "error", None)]
FIELDS = "job_id string, ts timestamp, event string, step string, pct int, message string"


def events(spark):
    return spark.createDataFrame(EVENTS, "job_id string, t string, event string, pct int").selectExpr("job_id", "cast(t as timestamp) ts", "event", "event step", "pct", "'m' message")


def test_jobs(spark):
    e = events(spark)
    assert {r.job_id: (r.status, r.pct) for r in X.latest_state(e).collect()} == {"a": ("done", 100), "b": ("running", 85), "c": ("error", None)}
    assert X.with_timeouts(e).where("timed_out").select("job_id").collect() == [("b",)]
    assert {r.job_id: r.over for r in X.durations(e).collect()} == {"a": False, "b": True, "c": False}
    assert X.debounced(e, 20_000).count() == 4
    now = e.withColumn("now", F.expr("ts + interval 601 seconds"))
    assert now.where(X.expired("ts", "now")).count() == 5


def test_job_stream(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FIELDS).parquet(str(tmp_path / "in"))
    seen = {}
    X.fan_out(X.stream_states(stream), [lambda df, _: seen.update({r.job_id: (r.status, r.pct, r.message) for r in df.collect()}), lambda df, _: df.count()], str(tmp_path / "checkpoint")).awaitTermination(60)
    assert seen == {"a": ("done", 100, None), "b": ("running", 85, None), "c": ("error", 0, "m")}


def test_settings_and_bindings(spark, tmp_path):
    from lumenfold.operators import bindings as B
    from lumenfold.sources import settings

    change = lambda *kv: spark.createDataFrame(list(kv), "key string, value string")
    s = settings.put(settings.put(settings.empty(spark), change(("layout", "A4"), ("current", "1"))), change(("layout", "A5")))
    settings.save(s, str(tmp_path / "s"))
    assert {r.key: r.value for r in settings.load(spark, str(tmp_path / "s")).collect()} == {"layout": "A5", "current": "1"}
    assert [r.key for r in settings.remove(s, change(("layout", ""))).collect()] == ["current"]
    settings.reset(spark, str(tmp_path / "s"))
    assert settings.load(spark, str(tmp_path / "s")).count() == 0
    df = spark.createDataFrame([(1, ["a", "b"], ("x",)), (2, None, None)], "i int, l array<string>, s struct<t string>")
    assert [tuple(r) for r in B.foreach(df, "l", keep=["i"]).collect()] == [(1, 0, "a"), (1, 1, "b")]
    assert [r.t for r in B.scope(df, "s", ["i"]).collect()] == ["x"] and B.when(df, F.col("l").isNull()).count() == 1
    assert B.visible(df, F.col("s.t") == "x").where("visible").count() == 1


def test_waiting_periods(spark):
    from lumenfold.operators import certificates as C

    rows = [(1, [("Plano SAF", [(3, "Meses")], None, [(1, 9999, "Meses", 50.0)]), ("Vida", [(2, "meses"), (5, "dias")], [("x", 1, "dias")], [])]), (2, None)]
    df = spark.createDataFrame(rows, f"doc_id int, details {C.DETAILS}")
    got = sorted((r.branch, r.detail_idx, r.rule_idx) for r in C.waiting_rules(df, ["doc_id"]).collect())
    assert got == [(0, 0, 0), (1, 1, 0), (3, 1, 1), (4, 1, 2)]
    assert len([r for r in C.waiting_rules(df, ["doc_id"], exclude_saf=False).collect() if r.branch == 1]) == 2
    p = C.progressive_rules(df, ["doc_id"]).first()
    assert (p.period, p.percent) == ("A partir de 1 meses", "50%") and p.text.startswith("Para o(s) plano(s) Plano SAF quando")
    assert spark.range(1).select(C.waiting_texts([F.array(F.lit("a")), F.lit(None).cast("array<string>")], F.lit(None).cast("string"))).first()[0] == ["a"]
    assert spark.range(1).select(C.indexer_text(F.lit(" ")), C.account_label(F.lit(1), F.lit("2"))).first()[:] == ("O seu seguro será atualizado pelo  . Para mais informações, consulte as condições gerais.", "1 - 2")


def test_tables_and_namespaces_as_read(spark):
    assert S.table_text([["a", None], None, [], ["b"]]) == "a | \nb"
    cells = spark.createDataFrame([("1", 1, 0, 0, ["", None]), ("1", 1, 1, 0, [" "]), ("1", 1, 2, 0, None)], "doc_id string, page int, table int, row int, cells array<string>")
    assert [r.text for r in S.tables_to_blocks(cells).collect()] == [" | "]
    xsd = '<x:schema xmlns:x="http://www.w3.org/2001/XMLSchema" xmlns:o="other"><x:element name="A"/><o:element name="B"/></x:schema>'
    assert [r.name for r in S.schema_fields(spark.createDataFrame([("1", xsd)], "doc_id string, content string")).collect()] == ["A"]


def test_pdf_blocks_by_a_stub(spark, tmp_path):
    """The reader's calls, by a module that has words and tables as the library returns them."""
    stub = (
        "class P:\n    width, height = 200, 0\n"
        "    def extract_words(self, extra_attrs):\n        return [{'text': 'w', 'x0': 20, 'x1': 60, 'top': 3, 'bottom': 5, 'size': None}]\n"
        "    def extract_tables(self):\n        return [[['a', None], None, ['b', 'c']], [[' ']], [None]]\n"
        "class D:\n    pages = [P(), P()]\n    def __enter__(self): return self\n    def __exit__(self, *a): pass\n"
        "def open(f):\n    assert f.read() == b'%PDF'\n    return D()\n"
    )
    (tmp_path / "pdfplumber.py").write_text(stub)
    spark.sparkContext.addPyFile(str(tmp_path / "pdfplumber.py"))
    rows = S.blocks_from_pdf(spark.createDataFrame([("1", bytearray(b"%PDF"))], "doc_id string, content binary")).orderBy("block_idx").collect()
    assert [(r.block_idx, r.text, r.page, r.block_type) for r in rows] == [(0, "w", 1, "text"), (1, "a | \nb | c", 1, "table"), (2, "w", 2, "text"), (3, "a | \nb | c", 2, "table")]
    assert (rows[0].x, rows[0].y, rows[0].width, rows[0].height, rows[0].font_size, rows[0].font_name) == (0.1, 3.0, 0.2, 2.0, 0.0, "")


def test_empty_lists_have_a_page(spark):
    empty = spark.createDataFrame([], "k int, i int")
    assert [(r.page, r["items"], r.pages, r.first) for r in R.pages(empty, "i", ["i"], extra_pages=3).collect()] == [(0, [], 4, True)]
    some = spark.createDataFrame([(1, i) for i in range(20)], "k int, i int")
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "k int, flag string")
    got = sorted((r.k, r.flag, r.page, len(r["items"]), r.pages) for r in R.pages(some, "i", ["i"], 18, 15, ["k"], parents=parents).collect())
    assert got == [(1, "a", 0, 15, 2), (1, "a", 1, 5, 2), (2, "b", 0, 0, 1)]


def test_footers_and_long_packing(spark):
    h = F.array(*[F.lit(x) for x in (5, 5, 3)])
    p = R.height_pages(h, 11.0, 1.0)
    assert spark.range(1).select(p, R.footer_page(h, p, 11.0, 1.0, 7.0), R.footer_page(h, p, 11.0, 1.0, 8.0), R.height_pages(F.array().cast("array<int>"), 5.0)).first()[:] == ([0, 0, 1], 1, 2, [])
    n = 50_000
    out = spark.range(1).select(R.packed_pages(F.sequence(F.lit(1), F.lit(n))).alias("p")).first().p
    assert len(out) == n and out == sorted(out)


def test_stream_times_out(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FIELDS).parquet(str(tmp_path / "in"))
    seen = {}
    X.fan_out(X.stream_states(stream, event_time=True), [lambda df, _: seen.update({r.job_id: (r.status, r.pct, r.message) for r in df.collect()})], str(tmp_path / "checkpoint")).awaitTermination()
    assert seen == {"a": ("done", 100, None), "b": ("error", 60, "timeout"), "c": ("error", 0, "m")}
    assert [r[0] for r in spark.createDataFrame([("Matching de campos",), ("x",)], "s string").select(X.progress(F.col("s"))).collect()] == [60, None]


def test_stream_orders_events_across_arrow_batches(spark, tmp_path):
    """A job's events reach its state in frames of two rows, the last ones first."""
    rows = [(j, i, 10 * i, "done" if i == 5 else "error" if i == 7 else "step") for j in range(3) for i in range(9)]
    df = spark.createDataFrame([(f"{j}", f"2024-01-01 00:00:{s:02d}" if s < 60 else f"2024-01-01 00:01:{s - 60:02d}", e, "s", i, "m", i) for j, i, s, e in reversed(rows)], "job_id string, ts string, event string, step string, pct int, message string, event_id long")
    late = spark.createDataFrame([("idle", f"2024-01-01 {h:02d}:00:00", "step", "s", h, "m", h) for h in range(6, -1, -1)], df.schema)
    df = df.unionByName(late).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    seen, key = {}, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        X.fan_out(X.stream_states(stream, event_time=True), [lambda df, _: seen.update({r.job_id: (r.status, r.pct, r.message) for r in df.collect()})], str(tmp_path / "checkpoint")).awaitTermination()
    finally:
        spark.conf.set(key, before)
    assert seen == {"0": ("done", 100, None), "1": ("done", 100, None), "2": ("done", 100, None), "idle": ("error", 0, "timeout")}


def test_idle_jobs_end_in_error():
    class State:
        exists, hasTimedOut, get, removed = True, True, ("running", 20, 5), False

        def remove(self):
            self.removed = True

    state = State()
    out = [tuple(df.iloc[0]) for df in X._advance(False)(("a",), iter(()), state)]
    assert out == [("a", "error", 20, "timeout")] and state.removed
    state.get = ("done", 100, 5)
    assert not list(X._advance(False)(("a",), iter(()), state))
