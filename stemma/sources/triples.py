"""Triples as N-Triples and Turtle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import RDF_TYPE, TRIPLE, ntriples

_XSD = "http://www.w3.org/2001/XMLSchema#"
_LINE = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*+)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*$'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Line by line, in built-in functions; comments and blank lines are left out."""
    part = lambda i: F.regexp_extract("value", _LINE, i)
    some = lambda i: F.when(part(i) != "", part(i))
    text = part(4)
    for mark, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"')):
        text = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)" + re.escape(mark), "$1" + char)
    text = F.replace(text, F.lit("\\\\"), F.lit("\\"))
    rows = spark.read.text(path).where(F.col("value").rlike(_LINE))
    is_iri = F.col("value").rlike(r"^\s*<[^>]*>\s+<[^>]*>\s+<")
    return rows.select(
        part(1).alias("s"), part(2).alias("p"), F.when(is_iri, part(3)).otherwise(text).alias("o"), F.when(is_iri, "iri").otherwise("literal").alias("o_kind"), some(5).alias("o_datatype"), some(6).alias("o_lang")
    ).distinct()


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples(triples).write.mode("overwrite").text(path)


_TOKEN = re.compile(
    r'(?P<space>\s+|#[^\n]*)|<(?P<iri>[^>]*)>|"""(?P<long>(?:[^"\\]|\\.|"(?!""))*)"""|"(?P<text>(?:[^"\\\n]|\\.)*)"|@(?P<lang>[A-Za-z][A-Za-z0-9-]*)|(?P<type>\^\^)|'
    r"(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)(?![\w:])|(?P<mark>[.;,\[\]])|(?P<name>[\w.-]*:(?:[\w%/-]|\.(?=[\w%/-]))*|[A-Za-z]\w*)"
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))")


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else {"t": "\t", "n": "\n", "r": "\r"}.get(m[3], m[3]), text)


def turtle_triples(text: str) -> Iterator[tuple]:
    """Triples of a Turtle document without blank nodes and collections."""
    tokens = [(m.lastgroup, m[m.lastgroup]) for m in _TOKEN.finditer(text) if m.lastgroup != "space"]
    prefixes: dict[str, str] = {}
    at = 0

    def expand(name: str) -> str:
        head, _, tail = name.partition(":")
        return prefixes[head] + tail

    def resource() -> str:
        nonlocal at
        kind, value = tokens[at]
        at += 1
        return value if kind == "iri" else RDF_TYPE if value == "a" else expand(value)

    def node() -> tuple:
        nonlocal at
        kind, value = tokens[at]
        if kind in ("text", "long"):
            at += 1
            datatype = lang = None
            if at < len(tokens) and tokens[at][0] == "lang":
                lang = tokens[at][1]
                at += 1
            elif at < len(tokens) and tokens[at][0] == "type":
                at += 1
                datatype = resource()
            return _plain(value), "literal", datatype, lang
        if kind == "number":
            at += 1
            return value, "literal", _XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None
        if kind == "name" and value in ("true", "false"):
            at += 1
            return value, "literal", _XSD + "boolean", None
        return resource(), "iri", None, None

    while at < len(tokens):
        kind, value = tokens[at]
        if (kind == "lang" and value == "prefix") or (kind == "name" and value.upper() == "PREFIX"):
            prefixes[tokens[at + 1][1].rstrip(":")] = tokens[at + 2][1]
            at += 3 + (kind == "lang")
            continue
        s = resource()
        while tokens[at][1] != "." or tokens[at][0] != "mark":
            p = resource()
            while True:
                yield (s, p, *node())
                if tokens[at] != ("mark", ","):
                    break
                at += 1
            while tokens[at] == ("mark", ";"):
                at += 1
        at += 1


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Turtle files, each a row and a task's work, as prefixes and subjects reach over lines: a file must fit into a worker's memory, many files scale.

    Larger dumps should be N-Triples, which read_ntriples() reads line by line.
    """

    def run(batches):
        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame(list(turtle_triples(text)), columns=["s", "p", "o", "o_kind", "o_datatype", "o_lang"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, TRIPLE).distinct()
