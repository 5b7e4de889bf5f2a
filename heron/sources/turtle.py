"""Turtle files as tables of triples, and tables of triples as N-Triples files, which are Turtle too."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: kind is iri, blank or literal; datatype is that of a literal, or @ and its language, and null for plain text.
TRIPLE = "subject string, predicate string, object string, kind string, datatype string"
RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
_PART = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^\x00-\x20<>"{}|^`\\]*>)
    |(?P<string>\"{3}(?:\"{0,2}(?:[^"\\]|\\.))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\.))*'{3}|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix\b|@base\b)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<blank>_:\w(?:[\w.-]*[\w-])?)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[^\s\w])(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\[^\s\w])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[^\s\w]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>\^\^|[.;,()\[\]])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
_SHORT = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class TurtleError(ValueError):
    """The text is no Turtle."""


def _parts(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _PART.match(text, at)
        if m is None:
            raise TurtleError(f"line {text.count(chr(10), 0, at) + 1}: {text[at : at + 20]!r}")
        if m.lastgroup != "skip":
            yield m.lastgroup, m[0]
        at = m.end()
    yield "end", ""


def _plain(text: str) -> str:
    def one(m):
        x = m[1]
        if len(x) > 1:
            return chr(int(x[1:], 16))
        if x not in _SHORT:
            raise TurtleError(f"escape {m[0]!r}")
        return _SHORT[x]

    return _ESCAPE.sub(one, text)


def triples(text: str, file: str = "") -> list[tuple]:
    """The rows of TRIPLE of one Turtle text, each once, in the order of the text; blank nodes bear the file's name."""
    parts, out, prefixes, base, made = _parts(text), {}, {}, "", 0
    kind, token = next(parts)

    def step():
        nonlocal kind, token
        last = token
        kind, token = next(parts, ("end", ""))
        return last

    def expect(mark):
        if token != mark:
            raise TurtleError(f"{token!r} where {mark!r} is due")
        step()

    def fresh():
        nonlocal made
        made += 1
        return f"_:{file}##{made}", "blank", None

    def iri(value):
        return (urljoin(base, _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)), value[1:-1])) if base else value[1:-1]), "iri", None

    def add(s, p, o):
        out[(s[0], p[0], *o)] = None

    def address():
        """An address, in full or by its prefix."""
        if kind == "iri":
            return iri(step())
        if kind != "name":
            raise TurtleError(f"{token!r} where an address is due")
        prefix, _, local = step().partition(":")
        if prefix not in prefixes:
            raise TurtleError(f"prefix {prefix!r}")
        return prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri", None

    def term(subject=False):
        """A subject or object; what stands in brackets is added on the way."""
        if kind in ("iri", "name"):
            return address()
        if kind == "blank":
            return f"_:{file}#{step()[2:]}", "blank", None
        if token == "[":
            step()
            node = fresh()
            if token != "]":
                statements(node)
            expect("]")
            return node
        if token == "(":
            step()
            items = []
            while token != ")":
                items.append(term())
            step()
            nodes = [fresh() for _ in items] + [(f"{RDF}nil", "iri", None)]
            for node, item, rest in zip(nodes, items, nodes[1:], strict=False):
                add(node, (f"{RDF}first",), item)
                add(node, (f"{RDF}rest",), rest)
            return nodes[0]
        if subject:
            raise TurtleError(f"{token!r} as a subject")
        if kind == "string":
            quoted = step()
            cut = 3 if quoted[:3] in ('"""', "'''") else 1
            value = _plain(quoted[cut:-cut])
            if kind == "lang":
                return value, "literal", step().lower()
            if token == "^^":
                step()
                return value, "literal", address()[0]
            return value, "literal", None
        if kind == "number":
            value = step()
            return value, "literal", XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer")
        if token in ("true", "false"):
            return step(), "literal", f"{XSD}boolean"
        raise TurtleError(f"{token!r} as a term")

    def statements(s):
        while True:
            if token == "a":
                step()
                p = (f"{RDF}type", "iri", None)
            else:
                p = address()
            add(s, p, term())
            while token == ",":
                step()
                add(s, p, term())
            if token != ";":
                return
            while token == ";":
                step()
            if token in (".", "]"):
                return

    while kind != "end":
        word = token.lower()
        if kind == "directive" or (kind == "word" and word in ("prefix", "base")):
            dotted = step().startswith("@")
            name = step().rpartition(":")[0] if word.endswith("prefix") else None
            if kind != "iri":
                raise TurtleError(f"{token!r} where an address is due")
            value = iri(step())[0]
            if name is None:
                base = value
            else:
                prefixes[name] = value
            if dotted:
                expect(".")
            continue
        closed = token == "["
        s = term(True)
        if not (closed and token == "."):
            statements(s)
        expect(".")
    return list(out)


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """The triples of all Turtle files under path, each once; a file is read by one task. Text that is no Turtle fails the job that reads it."""

    def run(batches):
        for b in batches:
            for text, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = triples(text, file)
                yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in found], pa.string()) for k in range(5)], [c.split()[0] for c in TRIPLE.split(", ")])

    files = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"[^/]*$", 0))
    return files.mapInArrow(run, TRIPLE).distinct()


def write_turtle(rows: DataFrame, path: str) -> None:
    """Rows of TRIPLE as N-Triples lines under path."""
    object_, datatype = F.col("object"), F.col("datatype")

    def node(c):
        return F.when(c.startswith("_:"), F.concat(F.lit("_:x"), F.sha2(c, 224))).otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    text = object_
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    mark = F.when(datatype.startswith("@"), datatype).when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise(F.lit(""))
    value = F.when(F.col("kind") == "literal", F.concat(F.lit('"'), text, F.lit('"'), mark)).otherwise(node(object_))
    rows.select(F.concat_ws(" ", node(F.col("subject")), F.concat(F.lit("<"), F.col("predicate"), F.lit(">")), value, F.lit("."))).write.text(path)
