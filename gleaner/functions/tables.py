"""The extractors as functions of SQL.

Extractors that are column expressions become SQL functions that return an array of structs; Catalyst puts their body in place of the call, so a
query runs the plan of the operator: ``FROM (SELECT doc_id, extract_emails(text) AS found FROM documents) d, LATERAL inline(d.found) e``. (As table
functions they would be joined back to the table by the text, which shuffles it; and Spark takes no SQL function directly inside ``inline``.)

Extractors of pages need a parser; they are table functions, ``FROM pages p, LATERAL html_links(p.url, p.html, 'a') l``, run on the rows as they
come. Their columns follow from their arguments.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from gleaner.operators import contacts, html, patterns

#: A literal, or a function whose name is a sign or a word of the grammar and has to be quoted.
_PIECE = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])(and|or|[-+*/%=<>!&|]+)(?=\()", re.S)


def sql_text(column: Column) -> str:
    """A column expression in SQL. Its printed form is SQL but for operators, which are printed as calls: ``=(a, b)``."""
    printed = str(column)[len("Column<'") : -len("'>")]
    if "columnnodeexpression(" in printed:
        raise ValueError("functions in Python have no SQL text")
    return _PIECE.sub(lambda m: f"`{m[1]}`" if m[1] else m[0], printed)


def register_expression(spark: SparkSession, name: str, argument: str, body: Column) -> None:
    """``name(argument)`` is ``body``, an expression of the text column ``argument``, with the type that this has."""
    kind = spark.range(0).select(F.lit("").alias(argument)).select(body.alias("x")).schema["x"].dataType
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument} STRING) RETURNS {kind.simpleString()} RETURN {sql_text(body)}")


def _numbered(hits: Column, name: str) -> Column:
    return F.transform(hits, lambda hit, i: F.struct(i.cast("int").alias("pos"), hit["value"].alias(name)))


def _constant(argument: AnalyzeArgument, name: str) -> str:
    """An argument that decides the columns has to be known before rows are read."""
    if argument.value is None:
        raise ValueError(f"{name} has to be a constant")
    return argument.value


class HtmlSelect:
    """``html_select(html, 'title: title; links: nav a')``: a row per page with an array of texts for each field."""

    @staticmethod
    def fields(text: str) -> dict[str, str]:
        pairs = [part.partition(":") for part in text.split(";") if part.strip()]
        if not pairs or not all(name.strip() and selector.strip() for name, _, selector in pairs):
            raise ValueError("fields are written as 'name: selector; name: selector'")
        return {name.strip(): selector.strip() for name, _, selector in pairs}

    @staticmethod
    def analyze(page: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        found = HtmlSelect.fields(_constant(fields, "fields"))
        for selector in found.values():
            html.parse_selector(selector)
        return AnalyzeResult(T.StructType([T.StructField(name, T.ArrayType(T.StringType())) for name in found]))

    def __init__(self):
        self.parsed = None

    def eval(self, page: str, fields: str):
        if self.parsed is None:
            self.parsed = [html.parse_selector(s) for s in self.fields(fields).values()]
        root = html.parse_page(page)
        yield tuple([node.text() for node in html.select(root, selector)] for selector in self.parsed)


class HtmlLinks:
    """``html_links(url, html, selector)``: ``pos, href, target`` of the elements the selector finds."""

    @staticmethod
    def analyze(url: AnalyzeArgument, page: AnalyzeArgument, selector: AnalyzeArgument) -> AnalyzeResult:
        html.parse_selector(_constant(selector, "selector"))
        return AnalyzeResult(T.StructType().add("pos", T.IntegerType()).add("href", T.StringType()).add("target", T.StringType()))

    def eval(self, url: str, page: str, selector: str):
        for pos, href in html.hrefs(html.parse_page(page), selector):
            # A link from the root goes to the scheme and host of its page.
            origin = "" if not href.startswith("/") else None if url is None else "/".join(url.split("/")[:3])
            yield pos, href, None if origin is None else origin + href


def register(spark: SparkSession, registry: patterns.Registry = patterns.DEFAULT) -> None:
    """Registers the functions of the library in a session.

    Arrays: ``extract_emails(text)`` and ``extract_emails_strict(text)`` of ``pos, email``; ``extract_phones(text)`` of ``pos, phone``;
    ``extract_addresses(text)`` of ``pos, address``; ``recognize(text)`` of ``pattern, ord, match, confidence``. Tables: ``html_select(html, fields)``,
    an array per field; ``html_links(url, html, selector)``: ``pos, href, target``.
    """
    text = F.col("text")
    register_expression(spark, "extract_emails", "text", _numbered(contacts.email_array(text), "email"))
    register_expression(spark, "extract_emails_strict", "text", _numbered(contacts.email_array(text, strict=True), "email"))
    register_expression(spark, "extract_phones", "text", _numbered(contacts.phone_array(text), "phone"))
    register_expression(spark, "extract_addresses", "text", _numbered(contacts.address_array(text), "address"))
    register_expression(spark, "recognize", "text", patterns.recognized(text, registry.select()))
    for name, function in (("html_select", HtmlSelect), ("html_links", HtmlLinks)):
        spark.udtf.register(name, F.udtf(function))
