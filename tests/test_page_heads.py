import random

from pyspark.sql import functions as F

from marketclime.sources import pages

ROW = "<tr><td>{}</td>" + "<td>1</td>" * 6 + "</tr>"
PIECES = [
    "<!-- a -->", "<!-- <td> -->", "<script>x = '<td>' + \"<!--\";</script>", "<SCRIPT src=a>--></SCRIPT >", "<style>b > c {}</style>",
    "<title>t &amp; u</title>", "<title>t <b>u</b></title>", "<script/>", "<!-- open", "<!-->", "<!-- a --!> b -->", "<script>var a", "<style></style x>",
    "<a title='<!-- x -->'>y</a>", "<a title='x > <!-- y'>z</a>", "<b>bold</b>", "text", "&lt;", "<textarea><td></textarea>", "<iframe src='x'></iframe>",
    "<!DOCTYPE html>", "<![CDATA[ x ]]>", "<? y ?>", "</script>", "-->", "\x01", "<template></template>", "<br/>", "a < b", "<!-- a --><!-- b -->",
]


def both_ways(spark, htmls):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "i long, html string")
    marked = pages._marked(df, "html")
    cells = F.when(F.col("_tidy"), pages._native_rows(F.col("_table")))
    marked = marked.withColumn("parsed", pages._parsed_rows()(F.col("html")))
    return marked.select("i", "_tidy", cells.alias("native"), "parsed").collect()


def test_native_cuts_equal_the_parser(spark):
    rng = random.Random(11)

    def some(least, most):
        return "".join(rng.choice(PIECES) for _ in range(rng.randint(least, most)))

    htmls = []
    for _ in range(700):
        rows = "".join(ROW.format("i" + some(0, 2) + "j") for _ in range(rng.randint(0, 2)))
        htmls.append(f"<html>{some(0, 2)}<table class='table-bordered'><tr><th>h</th></tr>{rows}</table>{some(0, 1)}</html>")
    rows = both_ways(spark, htmls)
    tidy = [r for r in rows if r._tidy]
    assert len(tidy) > 150
    # what is left to the parser needs no comparison: it is the parser's result
    assert [(htmls[r.i], r.native, r.parsed) for r in tidy if r.native != r.parsed] == []


def test_a_full_page_needs_no_parser(spark):
    head = "<!DOCTYPE html><head><title>a</title><style>td > b {}</style><script>if (1 < 2) x = \"<table class='table-bordered'>\"</script></head>"
    page = f"{head}<!-- top --><table class='table-bordered'><tr><th>h</th></tr>{ROW.format('a<!-- x -->b')}</table><script>y</script>"
    df = spark.createDataFrame([(page,), ("<html>none</html>",), (None,), ("",), (page + "<!-- open",)], "html string")
    assert pages.parser_counts(df).collect()[0].asDict() == {"empty": 3, "native": 1, "parsed": 1}
    assert pages.parser_counts(df.limit(0)).collect()[0].asDict() == {"empty": 0, "native": 0, "parsed": 0}
    assert [len(r.rows) for r in pages.table_rows(df).collect()] == [1, 0, 0, 0, 1]
    assert both_ways(spark, [page])[0].native[1][0] == "a b"


def test_a_very_long_table_and_script(spark):
    rows = "".join(ROW.format(f"i{i}") for i in range(30000))
    page = f"<script>{'<td> ' * 200000}</script><table class='table-bordered'><tr><th>h</th></tr>{rows}</table>"
    df = spark.createDataFrame([(page,)], "html string")
    assert pages.parser_counts(df).collect()[0].native == 1
    assert pages.table_rows(df).select(F.size("rows").alias("n")).collect()[0].n == 30000


def test_unclosed_cells_are_cut_as_the_parser_reads_them():
    rng = random.Random(7)
    bits = [
        "<tr>", "</tr>", "<td>", "</td>", "<TH class='x'>", "</TD >", "<b>", "</b>", "<br/>", "&amp;", "&nbsp;", "&#65;", "&copy", "<!-- c -->",
        "a", "1,5", " ", "\n", "‏", "<td/>", "<td-x>", "</ td>", "<td title='a>b'>", "<td x", "<", '"', "<table>", "</table>", "<style>q</style>", "\x04",
    ]
    weights = [6] * 19 + [1] * (len(bits) - 19)
    tables = ["<table class='table-bordered'>", '<table id="t" class="x table-bordered">', "<table class=table-bordered>", "<table class='table-bordered' class='x'>"]
    cut = unclosed = 0
    for _ in range(20000):
        inside = "".join(rng.choices(bits, weights, k=rng.randint(1, 16)))
        page = "".join(rng.choices(bits, weights, k=2)) + rng.choice(tables) + inside + "</table>" + "".join(rng.choices(bits, weights, k=2))
        table = pages._plain_table(page)
        if table is not None:
            cut += 1
            unclosed += not pages._is_tidy(table)
            assert pages._cut_rows(table) == pages._parser_rows(page), page
    assert cut > 2000 and unclosed > 1000  # the parser alone read these before


def test_the_parse_is_planned_once(spark):
    df = spark.createDataFrame([("p/2000-01-01.html", "<html></html>", None)], "path string, html string, expected date")
    plan = pages.requested_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    # a filter over the parsed rows was moved below the parse and ran it twice
    assert plan.count("regexp_replace") == 1


def test_a_page_meets_python_once_and_its_cells_keep_their_places(spark):
    odd = "<table class='table-bordered'><tr><th>h</th></tr><tr></tr><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>"
    plain = f"<table class='table-bordered'><tr><th>h</th></tr>{ROW.format('x &amp; y')}<tr><td>short</td></tr>{ROW.format('z')}</table>"
    df = spark.createDataFrame([("p", plain), ("o", odd), ("n", None), ("e", ""), ("q", plain)], "path string, html string")
    got = pages.table_rows(df)
    # two steps before: cuts, then the parser for the rest, each sent the page
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = [["x & y", *["1"] * 6], ["z", *["1"] * 6]]
    assert {r.path: r.rows for r in got.collect()} == {"p": rows, "o": [], "n": [], "e": [], "q": rows}
    cells = df.select("path", pages._rows_of_pages()("html").alias("cells"))
    assert {r.path: r.cells for r in cells.collect()}["o"] == pages._parser_rows(odd)
