"""Price, mapping, weather, page and stream views derived from the given tables.

Weather uses integer arithmetic only, so two engines agree on it exactly.
Every 50 suppliers form one weather site, so sites grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketclime.functions.text import ARABIC_INDIC_DIGITS
from marketclime.operators.quality import with_order_ok
from marketclime.sources.state import checkpoint_rows
from marketclime.sources.tables import with_ordinal

PRELIMINARY_FROM = "2001-10-06"


SCHEMAS = {
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "embedding array<float>",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows: one per line item, named by its part, in file order."""
    lines = with_ordinal(table(spark, sf_dir, "lineitem"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("item"))
    price, discount, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    below = F.when(discount != 0, price * (1 - discount))
    above = price * (1 + tax)
    swapped = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 3)
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.col("l_shipdate").cast("date").alias("date"),
        "item",
        F.when(F.col("l_linestatus") == "F", "box").otherwise("kg").alias("unit"),
        F.when(swapped, above).otherwise(below).alias("price_low"),
        price.alias("price_mode"),
        F.when(swapped, below).otherwise(above).alias("price_high"),
        F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_quantity")).alias("quantity"),
        "ordinal",
    )
    return with_order_ok(rows)


def spelled_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows where listings spell their names in three ways.

    Plain, with two blanks, or with a stretched blank, a zero-width mark and a
    full-width o.
    """
    rows = observations(spark, sf_dir)
    name = F.col("item")
    wide = F.replace(name, F.lit(" "), F.lit("  "))
    odd = F.replace(F.replace(name, F.lit(" "), F.lit(" \u0640\u200b")), F.lit("o"), F.lit("\uff4f"))
    way = F.col("ordinal") % 3
    return rows.withColumn("item", F.when(way == 0, wide).when(way == 1, odd).otherwise(name))


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item to crop: the second word of the name, with some blank and some parked."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("item")).distinct()
    word = F.split_part("item", F.lit(" "), F.lit(2))
    crop = F.when(word == "rod", "").when(word == "ring", "ignore").otherwise(word)
    return names.select("item", crop.alias("crop_id"), F.lit("").alias("notes"))


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed renames: every "new ..." item becomes its "old ..." twin."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("from_item")).distinct()
    new = names.filter(F.col("from_item").startswith("new "))
    return new.withColumn("to_item", F.regexp_replace("from_item", "^new ", "old "))


def _site_days(frame: DataFrame, day: str, key: str) -> DataFrame:
    return frame.select(F.floor(F.col(key) / 50).cast("long").alias("site_id"), F.col(day).cast("date").alias("date"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weather row per site and ship date."""
    lines = table(spark, sf_dir, "lineitem")
    sums = lines.groupBy(
        F.floor(F.col("l_suppkey") / 50).cast("long").alias("site_id"), F.col("l_shipdate").cast("date").alias("date")
    ).agg(F.sum("l_orderkey").alias("o"), F.sum("l_partkey").alias("p"))
    coded = sums.select(
        "site_id",
        "date",
        (F.col("o") % 60).cast("int").alias("n1"),
        (F.col("p") % 50).cast("int").alias("n2"),
        F.abs(F.dayofyear("date") - 200).alias("b"),
    )
    n1, n2, b = F.col("n1"), F.col("n2"), F.col("b")
    warm = 3400 - 11 * b + 10 * (n1 - 30)
    return coded.select(
        "site_id",
        "date",
        (warm / 100).alias("tmax"),
        ((warm - 700 - 10 * n2) / 100).alias("tmin"),
        ((100 + 3 * (200 - b)) / 100).alias("et0"),
        F.when((b > 100) & (n1 < 12), n1.cast("double")).otherwise(0.0).alias("precip"),
        F.lit(None).cast("double").alias("wind_mean"),
        ((100 + 3 * n1) / 10).alias("wind_max"),
        F.when(F.col("date") >= F.lit(PRELIMINARY_FROM).cast("date"), "preliminary")
        .otherwise("era5_archive")
        .alias("source"),
    )


WEATHER_SQL = f"""k as (
  select l_suppkey // 50 as site_id, cast(l_shipdate as date) as date,
         cast(sum(l_orderkey) % 60 as int) as n1, cast(sum(l_partkey) % 50 as int) as n2,
         abs(dayofyear(cast(l_shipdate as date)) - 200) as b
  from lineitem group by 1, 2, 5),
weather as (
  select site_id, date,
    (3400 - 11*b + 10*(n1-30))/100 as tmax,
    (3400 - 11*b + 10*(n1-30) - 700 - 10*n2)/100 as tmin,
    (100 + 3*(200-b))/100 as et0,
    case when b > 100 and n1 < 12 then n1*1.0e0 else 0e0 end as precip,
    (100 + 3*n1)/10 as wind_max,
    case when date >= date '{PRELIMINARY_FROM}' then 'preliminary' else 'era5_archive' end as source
  from k)"""

OBS_SQL = """li as (select *, row_number() over () - 1 as ordinal from lineitem),
obs0 as (
  select cast(l_shipdate as date) as date, p_name as item,
    case when l_linestatus = 'F' then 'box' else 'kg' end as unit,
    l_extendedprice as price_mode,
    case when l_discount = 0 then null else l_extendedprice*(1-l_discount) end as below,
    l_extendedprice*(1+l_tax) as above,
    (l_returnflag = 'R' and l_linenumber = 3) as swapped,
    case when l_linenumber = 7 then 0e0 else l_quantity end as quantity, ordinal
  from li join part on l_partkey = p_partkey),
obs1 as (
  select date, item, unit, price_mode, quantity, ordinal,
    case when swapped then above else below end as price_low,
    case when swapped then below else above end as price_high
  from obs0),
obs as (
  select *, case when price_low is null or price_high is null then null
                 when price_low <= price_mode and price_mode <= price_high then 1 else 0 end as order_ok
  from obs1)"""

CLEAN_SQL = (
    OBS_SQL
    + """,
med as (
  select item, median(price_mode) as med, count(*) as n from obs where price_mode > 0 group by item),
dev as (
  select o.item, any_value(med) as med, any_value(n) as n, 1.4826*median(abs(price_mode - med)) as scale
  from obs o join med using (item) where price_mode > 0 group by o.item),
thr as (select item, med, n, scale from dev where n >= 3 and scale > 0),
flagged as (
  select o.*,
    case when row_number() over (partition by date, o.item order by ordinal) > 1 then 1 else 0 end as duplicate,
    case when thr.med is not null and abs(price_mode - thr.med) > 6*thr.scale then 1 else 0 end as outlier
  from obs o left join thr using (item)),
clean as (
  select *, case when order_ok = 1 and outlier = 0 and duplicate = 0 and price_mode > 0 then 1 else 0 end as usable
  from flagged),
u as (
  select date, item, price_mode, price_low, price_high, quantity as quantity_listed,
         nullif(quantity, 0) as quantity, ordinal,
         cast(floor((epoch_days + 5) / 7.0) as int) as week
  from (select *, date - date '1970-01-01' as epoch_days from clean where usable = 1)),
us as (
  select *, least(52, (dayofyear(week_start) - 1) // 7) as week_of_year
  from (select *, date '1970-01-01' + cast(week*7 - 5 as int) as week_start from u)),
mapping as (
  select distinct p_name as item,
    case split_part(p_name, ' ', 2) when 'rod' then '' when 'ring' then 'ignore'
         else split_part(p_name, ' ', 2) end as crop_id
  from part),
crops_of as (select item, crop_id from mapping where crop_id not in ('', 'ignore'))"""
)

# crop, variant, ini, dev, mid, late, months, kc_ini, kc_mid, kc_end, height, frost_tolerant, heat_threshold
CROP_ROWS = [
    ("alpha", 0, 25, 35, 40, 20, [4, 6], 0.6, 1.05, 0.90, 0.7, False, 34.0),
    ("alpha", 1, 30, 40, 50, 30, [10], 0.6, 1.05, 0.90, 0.7, False, 34.0),
    ("beta", 0, 35, 50, 40, 15, [9], 0.7, 1.05, 0.40, 0.4, True, None),
    ("gamma", 0, 20, 30, 30, 30, [5], 0.5, 1.00, 0.75, 0.3, False, None),
    ("gamma", 1, 25, 35, 45, 10, [3, 8], 0.5, 1.00, 0.75, 0.3, False, None),
]
CROP_DDL = (
    "crop_id string, variant int, ini int, dev int, mid int, late int, months array<int>, kc_ini double, "
    "kc_mid double, kc_end double, height double, frost_tolerant boolean, heat_threshold double"
)


def crops(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CROP_ROWS, CROP_DDL)


def _sql_value(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    return f"'{v}'" if isinstance(v, str) else str(v)


CROP_SQL = (
    "crops(crop_id, variant, ini, dev, mid, late, months, kc_ini, kc_mid, kc_end, height, frost_tolerant, "
    "heat_threshold) as (values "
    + ", ".join("(" + ", ".join(_sql_value(v) for v in row) + ")" for row in CROP_ROWS)
    + ")"
)


def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled source: the weather view, with tmax missing on the 7th of each month."""
    return (
        weather(spark, sf_dir)
        .select("site_id", "date", "tmax", "tmin", "precip")
        .withColumn("tmax", F.when(F.dayofmonth("date") != 7, F.col("tmax")))
        .withColumn("ordinal", F.lit(0).cast("long"))
    )


def recent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preliminary source: order dates at site 0; several orders a day, the last one wins."""
    orders = with_ordinal(table(spark, sf_dir, "orders"))
    return orders.select(
        F.lit(0).cast("long").alias("site_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        (F.col("o_totalprice") % 40).alias("tmax"),
        (F.col("o_totalprice") % 10).alias("tmin"),
        F.lit(None).cast("double").alias("precip"),
        "ordinal",
    )


def no_bulletin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates taken as confirmed to have no bulletin: the first of March and the 13th of May."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return days.filter(F.date_format("date", "MM-dd").isin("03-01", "05-13"))


def checkpoint_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint rows read back from JSON objects of order date to status."""
    orders = table(spark, sf_dir, "orders")
    status = (
        F.when(F.col("o_orderstatus") == "F", "ok")
        .when(F.col("o_orderstatus") == "O", "empty")
        .otherwise("empty_confirmed")
    )
    rows = orders.select(F.col("o_orderdate").cast("date").cast("string").alias("day"), status.alias("status"))
    per_day = rows.groupBy("day").agg(F.max("status").alias("status"))
    documents = per_day.select(
        F.to_json(F.create_map("day", F.struct("status", F.lit(1).alias("rows")))).alias("value")
    )
    return checkpoint_rows(documents)


def yield_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yield rows: one per line item, item by part, year by ship date, four units and an unknown one."""
    lines = table(spark, sf_dir, "lineitem")
    unit = F.array(*[F.lit(u) for u in YIELD_UNITS])
    return lines.select(
        (F.col("l_partkey") % 7).cast("string").alias("item_code"),
        F.year("l_shipdate").alias("year"),
        F.col("l_quantity").alias("value"),
        F.when(F.col("l_partkey") % 7 == 6, "bushels").otherwise(
            F.get(unit, (F.col("l_linenumber") % 4).cast("int"))
        ).alias("unit"),
    )


YIELD_UNITS = ["hg/ha", "kg/ha", "t / ha", "100 g/ha"]


def yield_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop list by part size; crops share items, and items 7 and up have no rows."""
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    return sizes.select(
        F.concat(F.lit("crop"), F.col("p_size").cast("string")).alias("crop"),
        (F.col("p_size") % 9).cast("string").alias("item_code"),
        F.concat(F.lit("item "), (F.col("p_size") % 9).cast("string")).alias("label"),
        F.lit(None).cast("string").alias("caveat"),
    )


def _arabic(text: Column) -> Column:
    return F.translate(text, "0123456789", ARABIC_INDIC_DIGITS)


BLOCK_ROWS = 20000  # a page holds the rows of one date within one block of the file


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML bulletins written from the price rows: one page per date and block of rows.

    Odd rows use Arabic-Indic digits, every third block leaves cells unclosed
    and carries comments, and rows of one kind show the following day.
    """
    rows = shown_rows(spark, sf_dir).withColumn("block", F.floor(F.col("ordinal") / BLOCK_ROWS))
    messy = F.col("block") % 3 == 0

    def line(r: Column) -> Column:
        def cell(text: Column) -> Column:
            shown = F.when(r["ordinal"] % 2 == 1, _arabic(text)).otherwise(text)
            close = F.when(messy, "").otherwise("</td>")
            return F.concat(F.lit("<td> <span>"), F.coalesce(shown, F.lit("")), F.lit("</span>‏&nbsp;"), close)

        cells = [
            F.concat(F.lit("<td>"), F.replace(r["item"], F.lit(" "), F.lit(" <b>")), F.lit("</b></td>")),
            cell(r["unit"]),
            cell(r["price_high"].cast("string")),
            cell(F.format_number(r["price_mode"], 2)),
            cell(r["price_low"].cast("string")),
            cell(r["quantity"].cast("string")),
            cell(F.date_format(r["shown"], "dd-MM-yyyy")),
        ]
        return F.concat(F.lit("<tr class='r'>"), *cells, F.lit("</tr>"))

    # lines are written from the listed rows: the rows alone are shuffled, and the work is dealt as the pages are
    row = F.struct("ordinal", "item", "unit", "price_high", "price_mode", "price_low", "quantity", "shown")
    listed = rows.groupBy("date", "block").agg(F.sort_array(F.collect_list(row)).alias("listed"))
    listed = listed.withColumn("body", F.array_join(F.transform("listed", line), "\n"))
    head = "<html><body><table class='menu'><tr><td>x</td></tr></table><table class=\"table table-bordered\">"
    return listed.select(
        F.concat_ws("/", F.lit("raw"), F.col("block").cast("string"), F.concat("date", F.lit(".html"))).alias("path"),
        F.concat(
            F.lit(head + "<tr><th>item</th><th>unit</th></tr>"),
            F.when(messy, "<!-- served late -->").otherwise(""),
            "body",
            F.lit("<tr><td colspan='7'>end</td></tr></table></body></html>"),
        ).alias("html"),
        F.col("date").alias("expected"),
    )


HEAD = (
    "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Prices of the day &amp; more</title><!-- <table class='table-bordered'> -->"
    "<style>td > b { margin: 0 }</style><script>var t = \"<table class='table-bordered'><tr><td>no</td></tr>\"; if (1 < 2) t += '</td>';</script></head>"
)


def headed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bulletins as full pages: with a head, a script and a comment in the body, and a comment in each item's cell."""
    body = F.replace(F.replace("html", F.lit("<html>"), F.lit(HEAD)), F.lit("</b></td>"), F.lit("</b><!-- item --></td>"))
    late = F.lit("<script type='text/javascript'>document.write('<tr><td>x');</script></body>")
    return pages(spark, sf_dir).withColumn("html", F.replace(body, F.lit("</body>"), late))


def shown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows with the date a page shows: some "box" rows show the following day."""
    late = (F.col("unit") == "box") & (F.col("ordinal") % 7 == 0)
    rows = observations(spark, sf_dir)
    return rows.withColumn("shown", F.when(late, F.date_add("date", 1)).otherwise(F.col("date")))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column-oriented payloads from the vectors: full, short and absent variables."""
    vectors = spark.read.schema("vec_id bigint, embedding array<float>").parquet(f"{sf_dir}/embeddings.parquet")
    time = F.transform(
        F.sequence(F.lit(0), F.size("embedding") - 1),
        lambda i: F.date_add(F.lit("2020-01-01").cast("date"), i).cast("string"),
    )
    doubles = F.col("embedding").cast("array<double>")
    return vectors.select(
        "vec_id",
        F.struct(
            time.alias("time"),
            doubles.alias("temperature_2m_max"),
            F.slice(doubles, 1, 10).alias("precipitation_sum"),
        ).alias("daily"),
    )


def crop_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested crop parameters from the parts: sizes give stage lengths, months and gaps."""
    parts = table(spark, sf_dir, "part")
    size = F.col("p_size")

    def sourced(value: Column) -> Column:
        return F.struct(value.cast("double").alias("value"), F.lit("table").alias("src"))

    def stage(variant: int) -> Column:
        months = F.array(*[F.lit(m) for m in PLANT_DATES])
        return F.struct(
            (size + variant).alias("ini"),
            (size + 10).alias("dev"),
            (size + 20).alias("mid"),
            F.lit(15 + variant).alias("late"),
            F.lit(0).alias("total"),
            F.get(months, (size + variant) % len(PLANT_DATES)).alias("plant_date"),
            F.lit("here").alias("region"),
            F.lit("table").alias("src"),
        )

    variants = F.slice(F.array(stage(0), stage(1)), F.lit(1), size % 3)
    return parts.select(
        F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("name_en"),
        F.struct(
            sourced(F.lit(0.5)).alias("ini"),
            sourced(F.when(size % 5 != 0, size / 40)).alias("mid"),
            sourced(size / 50).alias("end"),
        ).alias("kc"),
        sourced(size / 10).alias("height_m"),
        variants.alias("stage_lengths_days"),
        (F.col("p_type") == "PROMO").alias("frost_tolerant"),
        F.when(size % 2 == 0, 34.0).alias("heat_threshold_c"),
        F.concat_ws(" ", F.lit("no figures published for"), "p_name", "p_brand", "p_type").alias("GAP"),
    )


PLANT_DATES = ["October", "May/June", "Oct/Nov", "April; December, Apr", "foo, Mar"]


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published-looking texts of line items: numbers, dates in three forms, yields with units."""
    lines = with_ordinal(table(spark, sf_dir, "lineitem"))
    day = F.col("l_shipdate").cast("date")
    form = F.col("l_linenumber") % 4
    text = (
        F.when(form == 0, F.date_format(day, "dd-MM-yyyy"))
        .when(form == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(form == 2, F.date_format(day, "d/M/yyyy"))
        .otherwise("n/a")
    )
    mark = F.lit("‎")
    return lines.select(
        "ordinal",
        F.concat(F.lit(" "), mark, _arabic(F.format_number("l_extendedprice", 2)), mark, F.lit(" ")).alias("number"),
        F.concat(mark, _arabic(text)).alias("day"),
    )


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of price-like rows."""
    files = spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return files.select(
        F.col("event_id").alias("ordinal"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("ts").cast("date").alias("date"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("item"),
        "event_type",
        F.col("value").alias("price_mode"),
    )
