"""Templates compiled to Columns, and computed fields in order of their needs."""

import pytest
from pyspark.sql import functions as F

from lumenfold.operators.computed import CycleError, levels, names_in, with_computed
from lumenfold.operators.template import Template, TemplateError, Value, rendered

SCHEMA = """name string, n int, x double, flag boolean, `odd name` string, tags array<string>, one struct<id: int>, m map<string,string>,
  plans array<struct<title: string, covers: array<struct<what: string, value: double>>>>"""
ROW = ("A<b>", 0, 2.0, True, "q", ["u", None, "v"], (7,), {"k": "w"}, [("P1", [("c1", 1.5), ("c2", 10.0)]), ("P2", []), (None, None)])
BARE = (None,) * 9


def page(spark, text, row=ROW, **more):
    return rendered(spark.createDataFrame([row], SCHEMA), text, **more).first().page


CASES = [
    ("<p data-bind='text: name'>old</p>", "<p>A&lt;b&gt;</p>", "<p></p>"),
    ("<p data-bind=\"html: name + '!'\"></p>", "<p>A<b>!</p>", "<p>!</p>"),
    ("<!-- ko text: n --><!-- /ko -->|<!-- ko text: x --><!-- /ko -->|<!-- note -->&eacute;&#10;", "0|2|<!-- note -->&eacute;&#10;", "||<!-- note -->&eacute;&#10;"),
    ("<!-- ko if: n -->a<!-- /ko --><!-- ko ifnot: n -->b<!-- /ko --><!-- ko if: flag && !n -->c<!-- /ko -->", "bc", "b"),
    ("<!-- ko if: tags && tags.length > 2 -->many<!-- /ko --><!-- ko if: name == null -->none<!-- /ko -->", "many", "none"),
    ("<ul data-bind='foreach: tags'><li data-bind='text: $index() + 1 + \". \" + $data'></li></ul>", "<ul><li>1. u</li><li>2. </li><li>3. v</li></ul>", "<ul></ul>"),
    ("<!-- ko foreach: plans --><b data-bind='text: title'></b><!-- ko foreach: covers --><i data-bind=\"text: $parent.title + $parents[1].n + $root.name + what + '=' + value\"></i><!-- /ko --><!-- /ko -->", "<b>P1</b><i>P10A&lt;b&gt;c1=1.5</i><i>P10A&lt;b&gt;c2=10</i><b>P2</b><b></b>", ""),
    ("<div data-bind='with: one'><!-- ko foreach: $parent.one --><a data-bind='text: id'></a><!-- /ko --><a data-bind='text: id()'></a></div>", "<div><a>7</a><a>7</a></div>", "<div></div>"),
    ("<img src='a.png' style='x:1' data-bind=\"visible: n, attr: { alt: name, 'data-x': null, width: flag }\"/>", "<img src='a.png' style='display: none; x:1' alt=\"A&lt;b&gt;\" width=\"true\"/>", "<img src='a.png' style='display: none; x:1'/>"),
    ("<input type=checkbox data-bind='checked: flag, css: { on: flag, off: !flag }'>", '<input type=checkbox checked class="on">', '<input type=checkbox class="off">'),
    ("<p data-bind=\"text: flag ? x * 2 + 1 : 'no'\"></p><p data-bind=\"text: m.k || 'd'\"></p><p data-bind='text: tags[0]'></p>", "<p>5</p><p>w</p><p>u</p>", "<p>no</p><p>d</p><p></p>"),
    ("<p data-bind=\"text: (n - 1) / n\"></p><p data-bind=\"text: '5' == 5, attr: {t: x >= 2 && x != '3'}\"></p>", '<p></p><p t="true">true</p>', "<p></p><p>true</p>"),
    ("<ul><li>a<li data-bind='text: n'></li></ul><script>if (a < b && c) {}</script><br><P CLASS=x>", "<ul><li>a<li>0</li></ul><script>if (a < b && c) {}</script><br><P CLASS=x>", "<ul><li>a<li></li></ul><script>if (a < b && c) {}</script><br><P CLASS=x>"),
]


@pytest.mark.parametrize("text,want,bare", CASES)
def test_pages(spark, text, want, bare):
    assert page(spark, text) == want and page(spark, text, BARE) == bare


def test_handlers_and_functions(spark):
    from pyspark.sql import types as T

    functions = {"twice": lambda c: F.concat(c, c), "size_of": lambda c: Value(F.length(c), T.IntegerType())}
    text = "<p data-bind='money: x'></p><p data-bind='text: $root.twice(name)'></p><!-- ko if: size_of(name) > 3 -->long<!-- /ko -->"
    assert page(spark, text, handlers={"money": lambda c: F.format_string("R$ %.2f", c)}, functions=functions) == "<p>R$ 2.00</p><p>A&lt;b&gt;A&lt;b&gt;</p>long"


@pytest.mark.parametrize("text", ["<p data-bind='text: nope'></p>", "<p data-bind='shout: name'></p>", "<!-- ko if: n -->", "<b data-bind='if: n'></i></b>", "<p data-bind='text: (n'></p>", "<p data-bind='text: $parent.n'></p>", "<p data-bind='text: f(n)'></p>", "<!-- ko each: n --><!-- /ko -->", "<p data-bind='text: n #'></p>", "<!-- /ko -->"])
def test_refused(spark, text):
    with pytest.raises(TemplateError):
        Template(text).render(spark.createDataFrame([ROW], SCHEMA))


def test_a_page_is_one_projection_without_python(spark):
    df = rendered(spark.createDataFrame([ROW], SCHEMA), CASES[6][0])
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_levels_and_cycles():
    fields = {"a": "b + c", "b": "x * 2", "c": "upper('b') || `b`", "d": "a.b + s.a", "e": "1"}
    assert levels(fields) == [["b", "e"], ["c"], ["a"], ["d"]] and levels(fields, ["c"]) == [["b"], ["c"]] and levels({}) == []
    assert names_in("concat(a, 'b', \"c\") + `d e`.f + max (g)") == {"a", "d e", "g"}
    with pytest.raises(CycleError, match="a -> b -> a"):
        levels({"a": "b", "b": "a", "z": "a"})
    with pytest.raises(CycleError):
        levels({"a": "a + 1"})
    assert levels({"a": "a + 1"}, present={"a"}) == [["a"]]


def test_computed(spark):
    df = with_computed(spark.createDataFrame([(3,)], "x int"), {"z": "y + x", "y": "x * 2", "x": "x + 1"})
    assert df.first().asDict() == {"x": 4, "y": 8, "z": 12}
