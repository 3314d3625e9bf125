"""Bulletin pages: HTML tables to price rows.

Pages go through Python in Arrow batches. A plain table is cut at its row and
cell tags, after comments, scripts, styles and titles (a page's head, say) are
taken out; cells that are not closed end where HTML's rules end them. Pages that
are not plain (nested tables, regions that do not end, odd quotes) go through the
standard library's HTML parser, tag by tag. Pages without the table's class are
passed as null, so they cost Python nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketclime.functions.text import WHITE_SPACE, clean_cell, date_of_text, number_of
from marketclime.operators.quality import with_order_ok

# The table's class, and the order the cells are rendered in
# (the printed header names them in another order).
TABLE_CLASS = "table-bordered"
ITEM, UNIT, HIGH, MODE, LOW, QUANTITY, DATE = range(7)
MIN_CELLS = 7

_TABLE_TAG = re.compile(r"(?i)<table(?=[\t\n\r\f />])[^<>]*>")
_PLAIN_TABLE_TAG = re.compile(r"(?ia)<table(?:[\t\n\r\f ]+[a-z][\w:.-]*=(?:\"[^\"&]*\"|'[^'&]*'))*[\t\n\r\f ]*>")
_CLASS = re.compile(r"(?i)[\t\n\r\f ]class=(?:\"([^\"]*)\"|'([^']*)')")
_TABLE_END = re.compile(r"(?i)</table[\t\n\r\f ]*>")
_CELL_TAG = re.compile(r"(?i)<(/?t[rdh])(?=[\t\n\r\f />])[^<>]*>")
_NODE, _ROW, _ROW_END, _CELL, _CELL_END = "\x01", "\x02", "\x03", "\x04", "\x05"
_OWN_MARKS = re.compile("[\x01-\x05]")
# tags and the marks put in their place, one pass over the table each
_MARKS = [
    (re.compile(r"(?i)</tr(?=[\t\n\r\f />])[^<>]*>"), _ROW_END),
    (re.compile(r"(?i)</t[dh](?=[\t\n\r\f />])[^<>]*>"), _CELL_END),
    (re.compile(r"(?i)<t[dh](?=[\t\n\r\f />])[^<>]*>"), _CELL),
    (re.compile(r"(?i)<tr(?=[\t\n\r\f />])[^<>]*>"), _ROW),
    (re.compile(r"<[^<>]*>"), _NODE),
]
_EDGE = WHITE_SPACE + _NODE + _ROW_END  # around a cell's text
_TIDY = re.compile(r"(?:tr(?:td/td|th/th)*/tr)*")  # the names of the row and cell tags of a well nested table
# Patterns begin with one fixed character, to which the search jumps.
# markup inside the table that needs a real parser
_STRAY = re.compile(r"(?ia)<(?:(?:table|script|style|textarea|title)\b|[!?]|(?![a-z/])|/(?![a-z])|t[rdh]\b[^<>]*/>)")
_STRAY_VALUE = re.compile(r"(?ia)=\s*(?:\"[^\"]*[<>][^\"]*\"|'[^']*[<>][^']*')")
_REGION = re.compile(r"(?i)<(?:!--|script|style|textarea|title|iframe)")
# regions whose insides are no markup: found from left to right in one pass, so that one inside another is part of it
_BARE = re.compile(
    r"(?isa)<!--.*?-->"
    r"|<(script|style)(?=[\s>])[^<>]*>.*?</\1\s*>"
    r"|<(title|textarea|iframe)(?=[\s>])[^<>]*>([^<]*)</\2\s*>"
)
# what is read in more than one way, or was not closed: a real parser decides
_DOUBTFUL = re.compile(
    r"(?ia)<(?:!---?>|!\[|(?:script|style|title|textarea|iframe)\b[^>]*/>|/(?:script|style|title|textarea|iframe)(?!\s*>))"
)
_DOUBTFUL_END = re.compile(r"(?a)--(?:!>|\s+>)")
_LEFT = re.compile(
    r"(?ia)<(?:(?:script|style|textarea|title|iframe|template|noembed|noframes|xmp|plaintext)\b|!--"
    r"|[a-z][^<>]*=\s*(?:\"[^\"<>]*>|'[^'<>]*>)"  # a tag that ends within a quoted value
    r"|[a-z/][^<>]*+(?!>))"  # a tag that does not end
)
_BROKEN = re.compile(r"(?i)<[a-z/!?][^<>]*\x01")  # a region that began inside a tag


def _without_regions(html: str) -> str:
    """The page without comments, scripts and styles; titles and the like leave their text. Each leaves node breaks.

    A page with doubtful regions is given back as it is.
    """
    if not _REGION.search(html) or _DOUBTFUL.search(html) or _DOUBTFUL_END.search(html):
        return html
    return _BARE.sub(f"{_NODE}\\g<3>{_NODE}", html)


def _plain_table(html: str) -> str | None:
    """The inside of the first table of the class, if cutting it at its tags and parsing the page properly give the same cells."""
    if _OWN_MARKS.search(html):
        return None
    bare = _without_regions(html)
    if _LEFT.search(bare) or (_NODE in bare and _BROKEN.search(bare)):
        return None
    for tag in _TABLE_TAG.finditer(bare):
        if TABLE_CLASS in tag[0]:
            break
    else:
        return None
    named = _CLASS.findall(tag[0])
    if not _PLAIN_TABLE_TAG.fullmatch(tag[0]) or len(named) != 1 or TABLE_CLASS not in "".join(named[0]).split():
        return None
    end = _TABLE_END.search(bare, tag.end())
    table = bare[tag.end() : end.start()] if end else None
    return None if table is None or _STRAY.search(table) or _STRAY_VALUE.search(table) else table


def _is_tidy(table: str) -> bool:
    """Whether all rows and cells are closed."""
    return _TIDY.fullmatch("".join(_CELL_TAG.findall(table)).lower()) is not None


def _cut_rows(table: str) -> list[list[str]]:
    """Rows of cell texts of a plain table. A cell that is not closed ends where the next cell or row begins.

    A cell is its text nodes, each stripped, empty ones dropped, joined by a blank.
    """
    for tag, mark in _MARKS:
        table = tag.sub(mark, table)
    table = table.replace("&nbsp;", "\u00a0")
    if "&" in table:
        table = unescape(table)  # gives no marks: references to control characters are dropped

    def cell(piece: str) -> str:
        text = piece.partition(_CELL_END)[0].strip(_EDGE)
        if _NODE in text or _ROW_END in text:  # the end of a row closes no cell
            text = " ".join(t for node in text.replace(_ROW_END, _NODE).split(_NODE) if (t := node.strip()))
        return text

    return [[cell(piece) for piece in line.split(_CELL)[1:]] for line in table.split(_ROW)[1:]]


def _parser_rows(html: str) -> list[list[str]]:
    """Rows of cell texts of the first table of the class, by the standard library's parser."""
    table_class = TABLE_CLASS

    class Table(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.done, self.skip = 0, False, 0
            self.rows, self.cell = [], None

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.skip += 1
            classes = (dict(attrs).get("class") or "").split()
            if tag == "table":
                if self.depth or (not self.done and table_class in classes):
                    self.depth += 1
            elif self.depth and tag == "tr":
                self.cell = None
                self.rows.append([])
            elif self.depth and tag in ("td", "th") and self.rows:
                self.cell = []
                self.rows[-1].append(self.cell)

        def handle_endtag(self, tag):
            if tag in ("script", "style") and self.skip:
                self.skip -= 1
            elif self.depth and tag in ("td", "th"):
                self.cell = None
            elif self.depth and tag == "table":
                self.depth -= 1
                self.done = self.depth == 0

        def handle_data(self, data):
            text = data.strip()
            if self.depth and self.cell is not None and text and not self.skip:
                self.cell.append(text)

    parser = Table()
    parser.feed(html)
    parser.close()
    return [[" ".join(cell) for cell in row] for row in parser.rows]


def _per_text(function: Callable, kind: T.DataType):
    """``function`` over texts, in Arrow batches; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return F.pandas_udf(run, kind)


_CELLS = T.ArrayType(T.ArrayType(T.StringType()))


def _page_rows(html: str) -> list[list[str]]:
    """Rows of cell texts of the first table of the class: cut if it is plain, else by the parser."""
    table = _plain_table(html)
    return _parser_rows(html) if table is None else _cut_rows(table)


def _rows_of_pages():
    """html -> ``_page_rows``, null for null. The cells leave as one Arrow array with offsets, not as Python lists."""

    def run(htmls: pa.Array) -> pa.Array:
        cells, row_ends, page_ends, missing = [], [0], [0], []
        for html in htmls.to_pylist():
            missing.append(html is None)
            for row in _page_rows(html) if html is not None else ():
                cells += row
                row_ends.append(len(cells))
            page_ends.append(len(row_ends) - 1)
        rows = pa.ListArray.from_arrays(pa.array(row_ends, pa.int32()), pa.array(cells, pa.string()))
        return pa.ListArray.from_arrays(pa.array(page_ends, pa.int32()), rows, mask=pa.array(missing, pa.bool_()))

    return F.arrow_udf(run, _CELLS)


def _is_native(html: str) -> bool:
    """Whether the page's table is plain, not empty and well nested."""
    table = _plain_table(html)
    return bool(table) and _is_tidy(table)


def _native_rows(table: Column) -> Column:
    """Cells of a plain table."""
    return _per_text(_cut_rows, _CELLS)(table)


def _parsed_rows():
    """html -> rows of cell texts of the first table of the class, by a real HTML parser."""
    return _per_text(_parser_rows, _CELLS)


def _named(pages: DataFrame, html: str) -> DataFrame:
    """Add whether the page names the class."""
    return pages.withColumn("_named", F.coalesce(F.col(html).contains(TABLE_CLASS), F.lit(False)))


def _marked(pages: DataFrame, html: str) -> DataFrame:
    """Add the inside of the page's table if it is plain, whether it is also well nested, and whether the page names the class."""
    named = _named(pages, html)
    # a page without the class costs Python nothing
    cut = named.withColumn("_table", _per_text(_plain_table, T.StringType())(F.when(F.col("_named"), F.col(html))))
    tidy = (F.col("_table") != "") & _per_text(_is_tidy, T.BooleanType())(F.col("_table"))
    return cut.withColumn("_tidy", F.coalesce(tidy, F.lit(False)))


def parser_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row: pages without the table's class, pages with a well nested table, and pages where HTML's rules for unclosed or odd markup decide."""
    named = _named(pages, html)
    tidy = _per_text(_is_native, T.BooleanType())(F.when(F.col("_named"), F.col(html)))
    return named.select("_named", F.coalesce(tidy, F.lit(False)).alias("_tidy")).agg(
        F.count_if(~F.col("_named")).alias("empty"),
        F.count_if("_tidy").alias("native"),
        F.count_if(F.col("_named") & ~F.col("_tidy")).alias("parsed"),
    )


def table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``rows``: the cleaned cells of every data row (the first row is a header); empty without a table or page."""
    cells = _rows_of_pages()(F.when(F.col("_named"), F.col(html)))
    # one step per reuse: Spark keeps a costly column that a later step reads twice
    cut = _named(pages, html).withColumn("_cells", F.coalesce(cells, F.array().cast(_CELLS)))
    body = F.slice("_cells", F.lit(2), F.greatest(F.size("_cells"), F.lit(1)))
    cleaned = cut.withColumn("_body", F.transform(body, lambda row: F.transform(row, lambda c: clean_cell(c))))
    kept = F.filter("_body", lambda row: (F.size(row) >= MIN_CELLS) & (F.get(row, F.lit(ITEM)) != ""))
    return cleaned.withColumn("rows", kept).drop("_named", "_cells", "_body")


def _spread(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per table row. The outer form keeps Spark from cutting the tables again for a size filter."""
    return pages.select(*keep, F.posexplode_outer("rows").alias("row", "cells")).filter(F.col("cells").isNotNull())


def _cell(position: int) -> Column:
    return F.col("cells")[position]


def bulletin_rows(pages: DataFrame, kind: str = "local") -> DataFrame:
    """Price rows of saved pages (``path``, ``html``).

    The date comes from the row, else from the file name. A missing table or a
    short row yields nothing. ``row`` counts from 0 within the page.
    """
    file = F.substring_index("path", "/", -1)
    named = table_rows(pages).select(
        "path", "rows", file.alias("source_file"), F.try_to_date(F.regexp_replace(file, r"\.[^.]*$", ""), "yyyy-MM-dd").alias("_stem")
    )
    rows = _spread(named, "path", "source_file", "_stem")
    parsed = rows.select(
        F.coalesce(date_of_text(_cell(DATE)), "_stem").alias("date"),
        _cell(ITEM).alias("item"),
        _cell(UNIT).alias("unit"),
        number_of(_cell(LOW)).alias("price_low"),
        number_of(_cell(MODE)).alias("price_mode"),
        number_of(_cell(HIGH)).alias("price_high"),
        number_of(_cell(QUANTITY)).alias("quantity"),
        F.lit(kind).alias("kind"),
        "source_file",
        "path",
        "row",
    )
    return with_order_ok(parsed)


def requested_rows(pages: DataFrame) -> DataFrame:
    """Price rows of pages fetched for one date (``path``, ``html``, ``expected``).

    If any row shows another date the server ignored the request, and the
    whole page yields nothing. The check runs inside the page, before its rows
    are spread out.
    """
    wanted = F.date_format("expected", "dd-MM-yyyy")
    elsewhere = F.exists(
        "rows", lambda row: (F.get(row, F.lit(DATE)) != "") & (F.get(row, F.lit(DATE)) != wanted)
    )
    # no filter: Spark would move it below the parse and run the parse twice
    served = table_rows(pages).withColumn("rows", F.when(~elsewhere, F.col("rows")))
    rows = _spread(served, "path", "expected")
    return rows.select(
        F.col("expected").alias("date"),
        _cell(ITEM).alias("item"),
        _cell(UNIT).alias("unit"),
        number_of(_cell(LOW)).alias("price_low"),
        number_of(_cell(MODE)).alias("price_mode"),
        number_of(_cell(HIGH)).alias("price_high"),
        number_of(_cell(QUANTITY)).alias("quantity"),
        "path",
        "row",
    )


def page_counts(pages: DataFrame) -> DataFrame:
    """Rows per page, for the parse report."""
    return table_rows(pages).select("path", F.size("rows").alias("row_count"))


def read_pages(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """Saved pages, one row each: path and whole text."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return files.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("html")
    )
