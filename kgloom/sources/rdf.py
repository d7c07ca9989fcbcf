"""RDF text as a source: N-Triples read line by line, and small Turtle files parsed whole."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TERM_COLUMNS = "s string, p string, o string, o_kind string, o_datatype string, o_lang string"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

_LINE = r'^\s*<([^>]*)>\s*<([^>]*)>\s*(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z][\w-]*))?)\s*\.\s*$'


def _unescape(text: Column) -> Column:
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files, by built-in functions; comments, blank nodes and other lines are skipped.

    A literal's ``o_kind`` is ``literal``; datatype and language are null where there are none.
    """
    part = lambda i: F.regexp_extract("value", _LINE, i)
    some = lambda i: F.nullif(part(i), F.lit(""))
    lines = spark.read.text(path).where(F.col("value").rlike(_LINE))
    iri = some(3)
    return lines.select(
        part(1).alias("s"), part(2).alias("p"), F.coalesce(iri, _unescape(part(4))).alias("o"), F.when(iri.isNotNull(), "iri").otherwise("literal").alias("o_kind"),
        some(5).alias("o_datatype"), some(6).alias("o_lang"),
    )


# ---- Turtle ---------------------------------------------------------------------------------------------------

_TOKEN = re.compile(
    r'''\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<prefix>@prefix|@base|PREFIX\b|BASE\b)
    |(?P<lang>@[A-Za-z]+(?:-\w+)*)|(?P<num>[+-]?(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<op>\^\^|[.;,()\[\]])|(?P<name>[\w-]*:[\w.%-]*[\w%-]|[\w-]*:|\w+)''',
    re.X,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))")
_CONTROL = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


class TurtleError(ValueError):
    """The text isn't in the subset of Turtle that is read: no collections."""


def _text(quoted: str) -> str:
    inner = quoted[3:-3] if quoted.startswith('"""') else quoted[1:-1]
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _CONTROL.get(m[3], m[3]), inner)


def parse_turtle(text: str) -> Iterator[tuple]:
    """(s, p, o, o_kind, o_datatype, o_lang) of a Turtle text; triples with blank nodes are skipped."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    prefixes: dict[str, str] = {}
    i, depth = 0, 0
    subject = predicate = None
    while i < len(tokens):
        kind, word = tokens[i]
        if kind == "prefix":
            if word.lower().endswith("prefix"):
                prefixes[tokens[i + 1][1].rstrip(":")] = tokens[i + 2][1][1:-1]
                i += 3
            else:
                i += 2
            if i < len(tokens) and tokens[i][1] == "." and word.startswith("@"):
                i += 1
            continue
        if word in "()":
            raise TurtleError("collections are not read")
        if word in "[]":
            depth += 1 if word == "[" else -1
        elif depth:
            pass
        elif word == ".":
            subject = predicate = None
        elif word == ";":
            predicate = None
        elif word != ",":
            term: tuple | None = None
            if kind == "iri":
                term = (word[1:-1], "iri", None, None)
            elif kind in ("str", "long"):
                datatype = lang = None
                if i + 1 < len(tokens) and tokens[i + 1][0] == "lang":
                    lang, i = tokens[i + 1][1][1:], i + 1
                elif i + 2 < len(tokens) and tokens[i + 1][1] == "^^":
                    datatype, i = _name(tokens[i + 2], prefixes), i + 2
                term = (_text(word), "literal", datatype, lang)
            elif kind == "num":
                term = (word, "literal", XSD + ("double" if "e" in word.lower() else "decimal" if "." in word else "integer"), None)
            elif word in ("true", "false"):
                term = (word, "literal", XSD + "boolean", None)
            elif word == "a" and subject is not None and predicate is None:
                term = (RDF + "type", "iri", None, None)
            elif word.startswith("_:"):
                term = (word, "blank", None, None)
            else:
                term = (_name((kind, word), prefixes), "iri", None, None)
            if subject is None:
                subject = term
            elif predicate is None:
                predicate = term
            elif "blank" not in (subject[1], term[1]):
                yield (subject[0], predicate[0], *term)
        i += 1


def _name(token: tuple[str, str], prefixes: dict[str, str]) -> str:
    kind, word = token
    if kind == "iri":
        return word[1:-1]
    prefix, _, local = word.partition(":")
    if prefix not in prefixes:
        raise TurtleError(f"unknown prefix {prefix}:")
    return prefixes[prefix] + local


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files, one file a row: a file must fit into a task, as extractions of one document do."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TERM_COLUMNS.split(", ")]
        for frame in frames:
            yield pd.DataFrame([t for text in frame["value"] for t in parse_turtle(text)], columns=names)

    return spark.read.text(path, wholetext=True).mapInPandas(run, TERM_COLUMNS)


def write_ntriples(triples: DataFrame, path: str) -> None:
    from ..operators.export import ntriples

    ntriples(triples).select(F.col("line").alias("value")).write.text(path)
