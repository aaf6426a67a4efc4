"""Whole template texts compiled to Columns: repetitions, conditions, scopes and values of a page with data-bind attributes and ko comments.

A template is parsed once, against the schema of the rows that it will show. What comes out is one expression of nested transforms and
concatenations, which Spark evaluates for each row without Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.text import escape_html

# Elements without an end.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = ("foreach", "if", "ifnot", "with")
_TOKEN = re.compile(r"""\s*(?:(\d+\.?\d*)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_$][\w$]*)|(===|!==|==|!=|<=|>=|&&|\|\||[-+*/%<>!?:.,()\[\]{}]))""")
_BOUND = re.compile(r"""\s+data-bind\s*=\s*("[^"]*"|'[^']*')""")


class TemplateError(ValueError):
    """What a template says wrong, or names that the rows lack."""


# -- expressions ------------------------------------------------------------------------------------------------------


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"can't read {text[at:]!r} in {text!r}")
        at = m.end()
        kind = ("number", "string", "name", "sign")[m.lastindex - 1]
        value = m[m.lastindex]
        out.append((kind, re.sub(r"\\(.)", r"\1", value[1:-1]) if kind == "string" else value))
    return [*out, ("end", "")]


class _Parser:
    """Expressions as nested tuples."""

    LEVELS = (("||",), ("&&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%"))

    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.at = text, _tokens(text), 0

    def peek(self, *signs: str) -> bool:
        return self.tokens[self.at][0] == "sign" and self.tokens[self.at][1] in signs

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def need(self, sign: str) -> None:
        if not self.peek(sign):
            raise TemplateError(f"{sign!r} is missing in {self.text!r}")
        self.at += 1

    def pairs(self, end: str) -> dict[str, tuple]:
        """name: expression, ... up to the end sign, or to the end of the text."""
        out: dict[str, tuple] = {}
        while self.tokens[self.at][0] != "end" and not self.peek(end):
            kind, name = self.next()
            if kind not in ("name", "string"):
                raise TemplateError(f"a name is missing in {self.text!r}")
            self.need(":")
            if self.peek("{"):
                self.at += 1
                out[name] = ("object", self.pairs("}"))
                self.need("}")
            else:
                out[name] = self.choice()
            if self.peek(","):
                self.at += 1
        return out

    def choice(self) -> tuple:
        test = self.binary(0)
        if not self.peek("?"):
            return test
        self.at += 1
        yes = self.choice()
        self.need(":")
        return "choice", test, yes, self.choice()

    def binary(self, level: int) -> tuple:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek(*self.LEVELS[level]):
            sign = self.next()[1]
            left = "binary", sign.replace("===", "==").replace("!==", "!="), left, self.binary(level + 1)
        return left

    def unary(self) -> tuple:
        if self.peek("!", "-"):
            return "unary", self.next()[1], self.unary()
        return self.member()

    def member(self) -> tuple:
        kind, value = self.next()
        if kind in ("number", "string"):
            out: tuple = (kind, value)
        elif kind == "name":
            out = ("name", value)
        elif value == "(":
            out = self.choice()
            self.need(")")
        else:
            raise TemplateError(f"can't read {self.text!r} at {value!r}")
        while self.peek(".", "[", "("):
            sign = self.next()[1]
            if sign == ".":
                out = "field", out, self.next()[1]
            elif sign == "[":
                out = "item", out, self.choice()
                self.need("]")
            else:
                given = []
                while not self.peek(")"):
                    given.append(self.choice())
                    if self.peek(","):
                        self.at += 1
                self.need(")")
                out = "call", out, given
        return out


@dataclass
class Value:
    """A Column and its type; fields: columns of the row itself, which is no struct."""

    column: Column | None
    kind: T.DataType
    fields: dict[str, Value] | None = None

    def field(self, name: str) -> Value:
        if self.fields is not None:
            if name in self.fields:
                return self.fields[name]
        elif isinstance(self.kind, T.StructType) and name in self.kind.names:
            return Value(self.column.getField(name), self.kind[name].dataType)
        elif isinstance(self.kind, T.MapType):
            return Value(F.try_element_at(self.column, F.lit(name)), self.kind.valueType)
        elif name == "length" and isinstance(self.kind, T.ArrayType):
            return Value(F.coalesce(F.size(self.column), F.lit(0)), T.IntegerType())
        elif name == "length" and isinstance(self.kind, T.StringType):
            return Value(F.coalesce(F.length(self.column), F.lit(0)), T.IntegerType())
        raise TemplateError(f"{name!r} is not among {sorted(self.fields or getattr(self.kind, 'names', []))}")

    def whole(self) -> Value:
        if self.fields is None:
            return self
        columns = [v.column.alias(k) for k, v in self.fields.items()]
        return Value(F.struct(*columns), T.StructType([T.StructField(k, v.kind) for k, v in self.fields.items()]))


def truth(v: Value) -> Column:
    """JavaScript's: null, false, 0, not-a-number and the empty text are false; any array or object is true."""
    v = v.whole()
    if isinstance(v.kind, T.BooleanType):
        return F.coalesce(v.column, F.lit(False))
    if isinstance(v.kind, T.StringType):
        return F.coalesce(v.column != "", F.lit(False))
    if isinstance(v.kind, T.NumericType):
        return F.coalesce((v.column != 0) & ~F.isnan(v.column.cast("double")), F.lit(False))
    return v.column.isNotNull()


def shown(v: Value) -> Column:
    """A value as text: null as none, whole numbers without a point."""
    if isinstance(v.kind, T.StringType):
        return F.coalesce(v.column, F.lit(""))
    if isinstance(v.kind, (T.DoubleType, T.FloatType)):
        whole = (v.column == F.floor(v.column)) & (F.abs(v.column) < 1e15)
        return F.coalesce(F.when(whole, v.column.cast("long").cast("string")).otherwise(v.column.cast("string")), F.lit(""))
    if isinstance(v.kind, T.DecimalType):
        return F.coalesce(F.regexp_replace(v.column.cast("string"), r"(\.\d*?)0+$", "$1").cast("string"), F.lit("")) if v.kind.scale else F.coalesce(v.column.cast("string"), F.lit(""))
    if isinstance(v.kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.coalesce(F.to_json(v.column), F.lit(""))
    return F.coalesce(v.column.cast("string"), F.lit(""))


@dataclass
class Scope:
    """Where an expression stands: its data, what is around it, and the functions that it may call."""

    data: Value
    parents: list[Value]
    index: Column | None
    functions: dict[str, Callable]

    def inside(self, data: Value, index: Column | None = None) -> Scope:
        return Scope(data, [self.data, *self.parents], index, self.functions)

    def beside(self, data: Value) -> Scope:
        return self.inside(data, self.index)

    def value(self, e: tuple) -> Value:
        return getattr(self, "_" + e[0])(*e[1:])

    def _number(self, text: str) -> Value:
        return Value(F.lit(float(text)), T.DoubleType()) if "." in text else Value(F.lit(int(text)), T.LongType())

    def _string(self, text: str) -> Value:
        return Value(F.lit(text), T.StringType())

    def _name(self, name: str) -> Value:
        if name in ("true", "false"):
            return Value(F.lit(name == "true"), T.BooleanType())
        if name in ("null", "undefined"):
            return Value(F.lit(None).cast("string"), T.StringType())
        if name == "$data":
            return self.data
        if name == "$parent" and self.parents:
            return self.parents[0]
        if name == "$root":
            return [self.data, *self.parents][-1]
        if name == "$index" and self.index is not None:
            return Value(self.index, T.IntegerType())
        if name.startswith("$"):
            raise TemplateError(f"{name} has no meaning here")
        return self.data.field(name)

    def _field(self, of: tuple, name: str) -> Value:
        return self.value(of).field(name)

    def _item(self, of: tuple, at: tuple) -> Value:
        if of == ("name", "$parents") and at[0] == "number":
            if int(at[1]) < len(self.parents):
                return self.parents[int(at[1])]
            raise TemplateError(f"there is no $parents[{at[1]}] here")
        v = self.value(of)
        if isinstance(v.kind, T.ArrayType):
            return Value(F.get(v.column, self.value(at).column.cast("int")), v.kind.elementType)
        if at[0] == "string":
            return v.field(at[1])
        raise TemplateError(f"{of} has no items")

    def _call(self, of: tuple, given: list[tuple]) -> Value:
        """A function that was given, under its last name; without arguments, the value itself, as observables are read."""
        name = of[2] if of[0] == "field" else of[1]
        if of[0] in ("name", "field") and name in self.functions:
            made = self.functions[name](*(self.value(g).whole().column for g in given))
            return made if isinstance(made, Value) else Value(made, T.StringType())
        if given:
            raise TemplateError(f"there is no function {name!r}")
        return self.value(of)

    def _unary(self, sign: str, of: tuple) -> Value:
        v = self.value(of)
        return Value(~truth(v), T.BooleanType()) if sign == "!" else Value(-v.column, v.kind)

    def _choice(self, test: tuple, yes: tuple, no: tuple) -> Value:
        a, b = self.value(yes), self.value(no)
        same = a.kind == b.kind
        a, b = (a, b) if same else (Value(shown(a), T.StringType()), Value(shown(b), T.StringType()))
        return Value(F.when(truth(self.value(test)), a.column).otherwise(b.column), a.kind)

    def _binary(self, sign: str, left: tuple, right: tuple) -> Value:
        a, b = self.value(left), self.value(right)
        text = isinstance(a.kind, T.StringType) or isinstance(b.kind, T.StringType)
        if sign == "||":
            return Value(F.when(truth(a), a.column).otherwise(b.column), a.kind) if a.kind == b.kind else Value(truth(a) | truth(b), T.BooleanType())
        if sign == "&&":
            return Value(truth(a) & truth(b), T.BooleanType())
        if sign == "+" and text:
            return Value(F.concat(shown(a), shown(b)), T.StringType())
        if sign in "+-*/%":
            x, y = (v.column.cast("double") for v in (a, b))
            return Value({"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y), "%": F.try_mod(x, y)}[sign], T.DoubleType())
        null = [e == ("name", k) for e in (left, right) for k in ("null", "undefined")]
        if any(null):
            is_null = (b if any(null[:2]) else a).column.isNull()
            return Value(is_null if sign == "==" else ~is_null, T.BooleanType())
        x, y = a.column, b.column
        if text and not (isinstance(a.kind, T.StringType) and isinstance(b.kind, T.StringType)):
            x, y = (v.column.try_cast("double") for v in (a, b))
        if sign in ("==", "!="):
            equal = x.eqNullSafe(y)
            return Value(equal if sign == "==" else ~equal, T.BooleanType())
        return Value(F.coalesce({"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[sign], F.lit(False)), T.BooleanType())


# -- the tree of a template -------------------------------------------------------------------------------------------


class _Tree(HTMLParser):
    """Nodes (kind, ...): ("text", text), ("element", start, bindings, children, end), ("block", binding, expression, children)."""

    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=False)
        self.root: list = []
        self.open: list[tuple[str, list]] = [("", self.root)]
        self.feed(text)
        self.close()
        for name, _ in self.open[1:]:
            if name == "ko" or name.endswith(" data-bind"):
                raise TemplateError(f"{name!r} is not closed")

    def _add(self, node: tuple) -> None:
        self.open[-1][1].append(node)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        bound = dict(attrs).get("data-bind")
        start = _BOUND.sub("", self.get_starttag_text())
        if bound is None and tag not in ("script", "style"):
            self._add(("text", start))  # an element without bindings is text with what follows
            self.open += [] if tag in VOID else [(tag, self.open[-1][1])]
            return
        element = ("element", start, _Parser(bound or "").pairs(""), children := [], f"</{tag}>" if tag not in VOID else "")
        self._add(element)
        self.open += [] if tag in VOID else [(f"{tag} data-bind", children)]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        bound = dict(attrs).get("data-bind")
        self._add(("text", _BOUND.sub("", self.get_starttag_text())) if bound is None else ("element", _BOUND.sub("", self.get_starttag_text()), _Parser(bound).pairs(""), [], ""))

    def handle_endtag(self, tag: str) -> None:
        name = self._leave(tag)
        if not name.endswith(" data-bind"):
            self._add(("text", f"</{tag}>"))

    def _leave(self, tag: str) -> str:
        """Ends an element, and those without bindings inside it whose own end was left out."""
        while True:
            name = self.open.pop()[0] if len(self.open) > 1 else ""
            if name and name.split(" ")[0] == tag:
                return name
            if not name or name == "ko" or name.endswith(" data-bind"):
                raise TemplateError(f"</{tag}> closes {name!r}")

    def handle_comment(self, data: str) -> None:
        m = re.fullmatch(r"\s*ko\s+(\w+)\s*:(.*)", data, re.S)
        if m:
            if m[1] not in (*BLOCKS, "text", "html"):
                raise TemplateError(f"ko {m[1]} is unknown")
            children: list = []
            self._add(("block", m[1], _Parser(m[2]).choice(), children))
            self.open.append(("ko", children))
        elif data.strip() == "/ko":
            self._leave("ko")
        else:
            self._add(("text", f"<!--{data}-->"))

    def handle_data(self, data: str) -> None:
        self._add(("text", data))

    def handle_entityref(self, name: str) -> None:
        self._add(("text", f"&{name};"))

    def handle_charref(self, name: str) -> None:
        self._add(("text", f"&#{name};"))

    def handle_decl(self, decl: str) -> None:
        self._add(("text", f"<!{decl}>"))


class Template:
    """A template with its handlers (binding name -> function of a Column that gives the text shown) and functions that expressions may call."""

    def __init__(self, text: str, handlers: dict[str, Callable[[Column], Column]] | None = None, functions: dict[str, Callable] | None = None) -> None:
        self.nodes, self.handlers, self.functions = _Tree(text).root, handlers or {}, functions or {}

    def render(self, df: DataFrame) -> Column:
        """The page of a row of df, whose columns are the names of its root."""
        row = Value(None, df.schema, {f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema})
        return self._all(self.nodes, Scope(row, [], None, self.functions))

    def _all(self, nodes: list, scope: Scope) -> Column:
        """Texts that stand side by side are one literal."""
        parts: list[Column | str] = []
        for node in nodes:
            made = node[1] if node[0] == "text" else self._block(node[1], node[2], node[3], scope) if node[0] == "block" else self._element(*node[1:], scope)
            for x in made if isinstance(made, list) else [made]:
                if isinstance(x, str) and parts and isinstance(parts[-1], str):
                    parts[-1] += x
                else:
                    parts.append(x)
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)) if parts else F.lit("")

    def _block(self, kind: str, e: tuple, children: list, scope: Scope) -> Column:
        v = scope.value(e)
        if kind in ("text", "html"):
            return escape_html(shown(v)) if kind == "text" else shown(v)
        if kind in ("if", "ifnot"):
            yes = truth(v) if kind == "if" else ~truth(v)
            return F.when(yes, self._all(children, scope)).otherwise("")
        if kind == "with":
            return F.when(truth(v), self._all(children, scope.beside(v))).otherwise("")
        if not isinstance(v.kind, T.ArrayType):  # a single object stands for a list of one
            return F.when(truth(v), self._all(children, scope.inside(v, F.lit(0)))).otherwise("")
        item = v.kind.elementType
        each = F.transform(v.column, lambda x, i: self._all(children, scope.inside(Value(x, item), i)))
        return F.coalesce(F.array_join(each, ""), F.lit(""))

    def _element(self, start: str, bindings: dict, children: list, end: str, scope: Scope) -> list:
        cut = start.rindex("/>") if start.endswith("/>") else start.rindex(">")
        head: list[Column | str] = [start[:cut]]
        inner: Column | None = None

        def into(attribute: str, value: Column) -> None:
            """The value in front of what an attribute of the element has, or as one of its own."""
            m = re.search(rf"""\s{attribute}\s*=\s*["']""", head[0])
            if m:
                head[:1] = [head[0][: m.end()], F.when(value == "", "").otherwise(F.concat(value, F.lit(" "))), head[0][m.end() :]]
            else:
                head.append(F.when(value == "", "").otherwise(F.concat(F.lit(f' {attribute}="'), value, F.lit('"'))))

        for name, e in bindings.items():
            if name in BLOCKS:
                inner = self._block(name, e, children, scope)
            elif name in ("text", "html"):
                inner = self._block(name, e, [], scope)
            elif name in self.handlers:
                inner = escape_html(F.coalesce(self.handlers[name](scope.value(e).whole().column), F.lit("")))
            elif name == "visible":
                into("style", F.when(truth(scope.value(e)), "").otherwise("display: none;"))
            elif name == "checked":
                head.append(F.when(truth(scope.value(e)), " checked").otherwise(""))
            elif name == "attr" and e[0] == "object":
                for attribute, x in e[1].items():
                    v = scope.value(x)
                    absent = v.column.isNull() if not isinstance(v.kind, T.BooleanType) else ~truth(v)
                    head.append(F.when(absent, "").otherwise(F.concat(F.lit(f' {attribute}="'), escape_html(shown(v)), F.lit('"'))))
            elif name == "css" and e[0] == "object":
                into("class", F.concat_ws(" ", *(F.when(truth(scope.value(x)), k) for k, x in e[1].items())))
            else:
                raise TemplateError(f"the binding {name!r} is unknown")
        return [*head, start[cut:], self._all(children, scope) if inner is None else inner, end]


def rendered(df: DataFrame, template: str, name: str = "page", handlers: dict | None = None, functions: dict | None = None) -> DataFrame:
    """df with the page of each row."""
    return df.withColumn(name, Template(template, handlers, functions).render(df))
