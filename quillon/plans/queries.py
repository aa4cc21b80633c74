"""The library's operators applied to the supplied tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import color, dates, text
from quillon.operators import lookup, ordered, predicates, templates, validate
from quillon.plans import flows
from quillon.sources import html, places, readers, sinks
from quillon.streaming import builds, requests, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def named(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return named


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT p_partkey, CASE WHEN lower(substr(p_name, 1, 1)) = 'b' THEN 'Good Bye ' ELSE 'Hello ' END || p_name AS line FROM part")
def greet_by_initial(spark, d):
    return read(spark, d, "part").select("p_partkey", text.greeting(F.col("p_name"), "b").alias("line"))


@query(
    """SELECT c_custkey, line FROM customer JOIN (VALUES (0, 'Hello Yaakov'), (1, 'Good Bye John'), (2, 'Good Bye Jen'), (3, 'Good Bye Jason'), (4, 'Hello Paul'),
    (5, 'Hello Frank'), (6, 'Hello Larry'), (7, 'Hello Paula'), (8, 'Hello Laura'), (9, 'Good Bye Jim')) AS t(pos, line) ON c_custkey % 10 = pos"""
)
def greet_names(spark, d):
    """Rows that are given inline, one for each customer."""
    names = F.broadcast(readers.names(spark))  # ten rows
    customers = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 10).alias("pos"))
    return customers.join(names, "pos").select("c_custkey", text.greeting(F.col("name")).alias("line"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_type = 'ECONOMY'")
def category_filter(spark, d):
    return read(spark, d, "part").where(F.col("p_type") == "ECONOMY").select("p_partkey", "p_name", "p_type")


TILE_SQL = templates.CATEGORY_TILE.replace("'", "''")


@query(f"SELECT n_nationkey, replace(replace('{TILE_SQL}', '{{{{name}}}}', n_name), '{{{{short_name}}}}', lower(substr(n_name, 1, 3)) || CAST(n_nationkey AS VARCHAR)) AS html FROM nation")
def category_tile(spark, d):
    short = F.concat(F.lower(F.substring("n_name", 1, 3)), F.col("n_nationkey").cast("string"))
    return read(spark, d, "nation").select("n_nationkey", templates.category_tile(F.col("n_name"), short).alias("html"))


#: Two decimals on the exact binary value of x, as text.fixed2 has them.
FIXED2_SQL = """CASE WHEN x < 0 THEN '-' ELSE '' END || CAST(CAST(floor(c / 100.0) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(CAST(c % 100 AS BIGINT) AS VARCHAR), 2, '0')"""
CENTS_SQL = """SELECT *, floor(hi * 100.0) + floor((hi * 100.0 - floor(hi * 100.0)) + (abs(x) - hi) * 100.0 + 0.5) AS c
  FROM (SELECT *, CAST(abs(x) AS DOUBLE) * 134217729.0::DOUBLE - (CAST(abs(x) AS DOUBLE) * 134217729.0::DOUBLE - abs(x)) AS hi FROM {})"""


@query(
    f"""WITH p AS (SELECT p_partkey AS k, p_retailprice AS x FROM part UNION ALL SELECT -1, NULL UNION ALL SELECT -2, 0.0 UNION ALL SELECT -3, 12.5
      UNION ALL SELECT -4, 1.005::DOUBLE UNION ALL SELECT -5, 0.125 UNION ALL SELECT -6, -2.675::DOUBLE UNION ALL SELECT p_partkey + 1000000, p_retailprice / 7.0 FROM part),
    c AS ({CENTS_SQL.format("p")})
    SELECT CAST(k AS BIGINT) AS k, CASE WHEN x IS NULL OR x = 0 THEN '' ELSE '$' || {FIXED2_SQL} END AS price FROM c"""
)
def price_format(spark, d):
    part = read(spark, d, "part")
    extra = spark.createDataFrame([(-1, None), (-2, 0.0), (-3, 12.5), (-4, 1.005), (-5, 0.125), (-6, -2.675)], "k long, x double")
    rows = part.select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("x")).unionByName(extra)
    rows = rows.unionByName(part.select((F.col("p_partkey") + 1000000).alias("k"), (F.col("p_retailprice") / 7.0).alias("x")))
    return rows.select("k", text.price(F.col("x")).alias("price"))


@query(
    """SELECT k, CASE WHEN x IS NULL OR x = '' THEN '' ELSE '(' || x || ')' END AS portion FROM (
      SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 7 = 0 THEN '' ELSE p_brand END AS x FROM part)"""
)
def portion_format(spark, d):
    name = F.when(F.col("p_size") % 5 == 0, F.lit(None)).when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.col("p_brand"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("k"), text.portion(name).alias("portion"))


ITEM_SQL = f"'{templates.ITEM_TILE}'"
for _hole, _value in (
    ("short_name", "CAST(p_partkey AS VARCHAR)"), ("name", "p_name"), ("description", "p_type"),
    ("price_small", f"'$' || {FIXED2_SQL}"), ("price_large", "''"), ("small_portion", "'(' || p_brand || ')'"), ("large_portion", "''"),
):
    ITEM_SQL = f"replace({ITEM_SQL}, '{{{{{_hole}}}}}', {_value})"


@query(
    f"""WITH p AS (SELECT *, p_retailprice AS x, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS i FROM part), c AS ({CENTS_SQL.format("p")})
    SELECT p_type, '<section>' || string_agg({ITEM_SQL} || CASE WHEN i % 2 <> 0 THEN '{templates.ROW_END}' ELSE '' END, '' ORDER BY i) || '</section>' AS html
    FROM c GROUP BY p_type"""
)
def view_fold(spark, d):
    items = read(spark, d, "part").select(
        "p_type",
        F.col("p_partkey").alias("at"),
        F.col("p_partkey").cast("string").alias("short_name"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        F.col("p_retailprice").alias("price_small"),
        F.lit(None).cast("double").alias("price_large"),
        F.col("p_brand").alias("small_portion"),
        F.lit(None).cast("string").alias("large_portion"),
    )
    return flows.menu_page(items, ["p_type"], "at")


@query(
    """SELECT r_name AS category, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, n_name AS name
    FROM region JOIN nation ON n_regionkey = r_regionkey"""
)
def parent_attrs(spark, d):
    nested = (
        read(spark, d, "nation")
        .groupBy(F.col("n_regionkey").alias("r_regionkey"))
        .agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("items"))
        .join(read(spark, d, "region"), "r_regionkey")
    )
    return lookup.with_parent(nested, "items", {"category": "r_name"}).select("category", "pos", F.col("item.n_name").alias("name"))


@query("SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events")
def json_props(spark, d):
    answers = read(spark, d, "events").select(F.col("event_id").cast("string").alias("url"), F.lit(200).alias("status"), F.col("props").alias("body"))
    return readers.decoded(answers, "k int").select(F.col("url").cast("long").alias("event_id"), "data.k")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'signup')")
def accepted_answers(spark, d):
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 302).otherwise(200)
    return readers.accepted(read(spark, d, "events").withColumn("status", status)).select("event_id", "event_type")


@query("SELECT r_regionkey, 'menu_items.json?category=' || lower(r_name) AS url FROM region")
def menu_urls(spark, d):
    return read(spark, d, "region").select("r_regionkey", readers.menu_url("menu_items.json", F.lower("r_name")).alias("url"))


ADDRESS_SQL = """CASE c_custkey % 3 WHEN 0 THEN replace(lower(c_name), '#', '.') || '@example.com'
  WHEN 1 THEN replace(lower(c_name), '#', '') || '@mail.example.info' ELSE replace(lower(c_name), '#', ' at ') || CASE WHEN c_custkey % 2 = 0 THEN '@example.museum' ELSE chr(10) END END"""


def _address():
    k, name = F.col("c_custkey"), F.lower("c_name")
    other = F.concat(F.replace(name, F.lit("#"), F.lit(" at ")), F.when(k % 2 == 0, F.lit("@example.museum")).otherwise(F.lit("\n")))
    return (
        F.when(k % 3 == 0, F.concat(F.replace(name, F.lit("#"), F.lit(".")), F.lit("@example.com")))
        .when(k % 3 == 1, F.concat(F.replace(name, F.lit("#"), F.lit("")), F.lit("@mail.example.info")))
        .otherwise(other)
    )


@query(f"SELECT c_custkey, regexp_matches(a, '^{predicates.EMAIL}$') AS valid FROM (SELECT c_custkey, {ADDRESS_SQL} AS a FROM customer)")
def email_valid(spark, d):
    rule = predicates.BUILT_IN["validemail"]
    return read(spark, d, "customer").select("c_custkey", (~predicates.in_error(rule, _address())).alias("valid"))


@query(
    f"""WITH t AS (SELECT event_id AS k, CAST(value AS VARCHAR) AS v FROM events UNION ALL
      SELECT * FROM (VALUES (-1, ''), (-2, '5.'), (-3, '.5'), (-4, '+12'), (-5, '12abc'), (-6, '1e5'), (-7, '1e'), (-8, '-7')))
    SELECT CAST(k AS BIGINT) AS k, regexp_matches(v, '^{predicates.NUMBER}$') AS is_number, regexp_matches(v, '^{predicates.INTEGER}$') AS is_integer FROM t"""
)
def number_valid(spark, d):
    extra = [(-1, ""), (-2, "5."), (-3, ".5"), (-4, "+12"), (-5, "12abc"), (-6, "1e5"), (-7, "1e"), (-8, "-7")]
    rows = read(spark, d, "events").select(F.col("event_id").alias("k"), F.col("value").cast("string").alias("v"))
    rows = rows.unionByName(spark.createDataFrame(extra, "k long, v string"))
    ok = lambda name: ~predicates.in_error(predicates.BUILT_IN[name], F.col("v"))
    return rows.select("k", ok("number").alias("is_number"), ok("integer").alias("is_integer"))


@query(
    """SELECT p_partkey, p_size > 40 AS above, p_size < 5 AS below, p_partkey % 2 = 0 AND p_size > 40 AS name_above,
      coalesce(TRY_CAST(nullif(regexp_extract(p_size || 'cm', '^[+-]?[0-9]+'), '') AS DOUBLE) > 25, FALSE) AS unit_above FROM part"""
)
def minmax_valid(spark, d):
    size, rule = F.col("p_size").cast("string"), predicates.Rule
    return read(spark, d, "part").select(
        "p_partkey",
        predicates.in_error(rule("Max", "max", 40), size).alias("above"),
        predicates.in_error(rule("Min", "min", 5), size).alias("below"),
        predicates.in_error(rule("Max", "max", 40), F.concat(F.when(F.col("p_partkey") % 2 == 0, size).otherwise(F.lit("")), F.col("p_name"))).alias("name_above"),
        predicates.in_error(rule("Max", "max", 25), F.concat(size, F.lit("cm"))).alias("unit_above"),
    )


@query(
    """SELECT doc_id, length(t) > 500 AS too_long, length(t) < 150 AS too_short, length(t) = 0 AS missing, NOT (length(t) > 500) AS not_long FROM (
      SELECT doc_id, text AS t FROM documents UNION ALL SELECT -1, '' UNION ALL SELECT -2, 'x')"""
)
def len_valid(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, ""), (-2, "x")], "doc_id long, text string"))
    t, rule = F.col("text"), predicates.Rule
    return rows.select(
        "doc_id",
        predicates.in_error(rule("Maxlength", "maxlength", 500), t).alias("too_long"),
        predicates.in_error(rule("Minlength", "minlength", 150), t).alias("too_short"),
        predicates.in_error(rule("Required", "required"), t).alias("missing"),
        predicates.in_error(rule("Maxlength", "maxlength", 500, negative=True), t).alias("not_long"),
    )


@query(
    """SELECT e.event_id, e.event_type IS NOT DISTINCT FROM f.event_type AS matches FROM events e
    JOIN (SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id) f USING (user_id)"""
)
def match_field(spark, d):
    return lookup.match_first(read(spark, d, "events"), "user_id", "event_id", "event_type").select("event_id", "matches")


@query(
    """SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_checked, count(*) FILTER (WHERE role = 'user') < 2 AS too_few,
      count(*) FILTER (WHERE role = 'user') > 3 AS too_many FROM conversations GROUP BY conv_id"""
)
def checked_count(spark, d):
    return validate.checked_counts(read(spark, d, "conversations"), ["conv_id"], F.col("role") == "user", 2, 3)


@query("SELECT event_id % 4000 AS field, array_to_string(list_sort(list_distinct(list(event_type))), '</li><li>') AS messages FROM events GROUP BY event_id % 4000")
def error_list(spark, d):
    found = read(spark, d, "events").groupBy((F.col("event_id") % 4000).alias("field")).agg(F.collect_list("event_type").alias("m"))
    return found.select("field", validate.error_text(F.col("m")).alias("messages"))


FIELDS_SQL = """SELECT event_id % 5000 AS form, event_id AS pos, event_type AS name, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'x' || CAST(event_id AS VARCHAR)
  ELSE CAST(event_id % 100 AS VARCHAR) END AS value FROM events"""


def _fields(spark, d):
    k = F.col("event_id")
    value = F.when(k % 11 == 0, F.lit("")).when(k % 7 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise((k % 100).cast("string"))
    return read(spark, d, "events").select((k % 5000).alias("form"), k.alias("pos"), F.col("event_type").alias("name"), value.alias("value"))


RULES = {
    "click": [predicates.BUILT_IN["number"], predicates.Rule("Max", "max", 50, "Too large")],
    "signup": [predicates.BUILT_IN["required"], predicates.BUILT_IN["number"]],
    "view": [predicates.Rule("Maxlength", "maxlength", 99, "Too long")],
}
ERRORS_SQL = f"""SELECT *, list_filter([
    CASE WHEN name = 'click' AND value LIKE 'x%' THEN 'Must be a number' END,
    CASE WHEN name = 'click' AND coalesce(TRY_CAST(value AS DOUBLE) > 50, FALSE) THEN 'Too large' END,
    CASE WHEN name = 'signup' AND value = '' THEN 'This is required' END,
    CASE WHEN name = 'signup' AND value LIKE 'x%' THEN 'Must be a number' END], lambda m: m IS NOT NULL) AS errors FROM ({FIELDS_SQL})"""


@query(
    f"""WITH e AS ({ERRORS_SQL}), entries AS (SELECT name, pos, unnest(errors) AS message, generate_subscripts(errors, 1) AS i FROM e),
    m AS (SELECT name, i, arg_min(message, pos) AS message FROM entries GROUP BY name, i)
    SELECT name, array_to_string(list(message ORDER BY i), ';') AS errors FROM m GROUP BY name"""
)
def collect_errors(spark, d):
    checked = validate.check_fields(_fields(spark, d), RULES, submitting=True, include_empty=True)
    return validate.collect_errors(checked).select("name", F.array_join("errors", ";").alias("errors"))


@query(f"WITH e AS ({ERRORS_SQL}) SELECT form, bool_or(len(errors) > 0) AS has_errors FROM e GROUP BY form")
def has_errors(spark, d):
    return validate.has_errors(validate.check_fields(_fields(spark, d), RULES, submitting=True))


@query(
    """SELECT k, CASE WHEN position(' ' IN n) > 0 THEN array_to_string(list_slice(string_split(n, ' '), 1, -2), ' ') ELSE n END AS first_name FROM (
      SELECT p_partkey AS k, p_name AS n FROM part UNION ALL SELECT -1, 'Cher' UNION ALL SELECT -2, 'Ann Lee Roe' UNION ALL SELECT -3, '' UNION ALL SELECT -4, 'Ann ')"""
)
def first_name(spark, d):
    extra = spark.createDataFrame([(-1, "Cher"), (-2, "Ann Lee Roe"), (-3, ""), (-4, "Ann ")], "k long, n string")
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n")).unionByName(extra)
    return rows.select("k", text.first_name(F.col("n")).alias("first_name"))


@query("SELECT event_id, CAST(dayofweek(ts) AS INTEGER) AS day, ['Closed', '7:00 AM to 8:00 PM', '7:00 AM to 8:00 PM', '7:00 AM to 8:00 PM', '7:00 AM to 8:00 PM', '7:00 AM to 8:00 PM', '9:00 AM to 5:00 PM'][dayofweek(ts) + 1] AS hours FROM events")
def day_slot(spark, d):
    return read(spark, d, "events").select("event_id", dates.day_index(F.col("ts")).alias("day"), dates.hours_of(F.col("ts")).alias("hours"))


@query(
    """SELECT doc_id, CASE WHEN n_chars >= 992 THEN 'desktop' WHEN n_chars >= 768 THEN 'tablet' ELSE 'mobile' END AS width,
      CASE WHEN n_chars >= 1200 THEN 'lg' WHEN n_chars >= 992 THEN 'md' WHEN n_chars >= 768 THEN 'sm' WHEN n_chars >= 480 THEN 'xs' ELSE 'xxs' END AS grid FROM documents"""
)
def breakpoint(spark, d):
    n = F.col("n_chars")
    return read(spark, d, "documents").select("doc_id", predicates.width_class(n).alias("width"), predicates.grid_class(n).alias("grid"))


@query(
    """SELECT e.event_id, CASE WHEN e.value >= 60 THEN (SELECT 's' || max(p_size) FROM part WHERE p_size >= 5) ELSE o.target END AS target FROM events e ASOF LEFT JOIN (SELECT DISTINCT CAST(p_size AS DOUBLE) * 2 AS "offset", 's' || p_size AS target FROM part WHERE p_size >= 5) o
    ON e.value >= o."offset\""""
)
def scroll_asof(spark, d):
    offsets = read(spark, d, "part").where("p_size >= 5").select((F.col("p_size").cast("double") * 2).alias("offset"), F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("target")).distinct()
    return ordered.as_of(read(spark, d, "events").select("event_id", "value"), "value", offsets, bottom=60.0).select("event_id", "target")


@query(
    """SELECT o_orderkey, o.customer FROM orders ASOF LEFT JOIN (
      SELECT c_acctbal * 50 AS "offset", min(c_custkey) AS customer FROM customer GROUP BY c_acctbal) o ON o_totalprice >= o."offset\""""
)
def merged_asof(spark, d):
    """As many offsets as there are customers, merged with the orders in one sorted stream."""
    offsets = read(spark, d, "customer").groupBy((F.col("c_acctbal") * 50).alias("offset")).agg(F.min("c_custkey").alias("customer"))
    return ordered.as_of(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", offsets, ("customer",), sent=0).select("o_orderkey", "customer")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anchor_dangling(spark, d):
    orders = read(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey")
    return lookup.dangling(read(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "o_custkey")


@query(
    """SELECT k, array_to_string(string_split(regexp_replace(n, '([A-Z])', ',\\1', 'g'), ','), '|') AS parts FROM (
      SELECT event_id AS k, 'validation' || upper(substr(event_type, 1, 1)) || substr(event_type, 2) || 'Message' AS n FROM events)"""
)
def camel_split(spark, d):
    name = F.concat(F.lit("validation"), F.initcap("event_type"), F.lit("Message"))
    return read(spark, d, "events").select(F.col("event_id").alias("k"), F.array_join(text.camel_parts(name), "|").alias("parts"))


@query(
    """WITH c AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS v, p_size / 50.0::DOUBLE AS e FROM part),
    r AS (SELECT p_partkey, e, v // 65536 AS r, (v // 256) % 256 AS g, v % 256 AS b FROM c)
    SELECT p_partkey, CAST(trunc(r + e * (255 - r)) AS INTEGER) AS red, CAST(trunc(g + e * (165 - g)) AS INTEGER) AS green,
      CAST(trunc(b + e * (0 - b)) AS INTEGER) AS blue FROM r"""
)
def color_lerp(spark, d):
    code = F.concat(F.lit("#"), F.lpad(F.hex((F.col("p_partkey") * 7919) % 16777216), 6, "0"))
    mixed = color.mix_colors(color.parse_color(code), color.parse_color(F.lit("orange")), F.col("p_size") / F.lit(50.0))
    rows = read(spark, d, "part").select("p_partkey", mixed.alias("c"))
    return rows.select("p_partkey", *[F.col("c")[k].cast("int").alias(n) for k, n in enumerate(("red", "green", "blue"))])


@query("SELECT s_name AS name, 'supplier' AS origin FROM supplier UNION ALL SELECT c_name, 'customer' FROM customer")
def stream_merge(spark, d):
    a = read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("origin"))
    return a.unionByName(read(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("origin")))


@query(
    """WITH RECURSIVE links AS (
      SELECT p_partkey AS of, unnest([p_partkey // 2, p_partkey // 3, CASE WHEN p_partkey % 7 = 0 THEN p_partkey + 1 END]) AS "to" FROM part WHERE p_size % 10 <> 0
    ), reach AS (
      SELECT p_partkey AS start, p_partkey AS k FROM part WHERE p_type = 'ECONOMY' UNION SELECT start, "to" FROM reach JOIN links ON k = of WHERE "to" IS NOT NULL
    )
    SELECT 'Rule' || start AS start, 'rule' || k AS name FROM reach"""
)
def shortcut_closure(spark, d):
    """A registry with a rule for each part; a rule may lead back to itself through others."""
    part, k = read(spark, d, "part"), F.col("p_partkey")
    more = F.when(k % 7 == 0, F.concat(F.lit(", RULE"), (k + 1).cast("string"))).otherwise(F.lit(""))
    value = F.concat(F.lit("rule"), F.expr("CAST(p_partkey div 2 AS STRING)"), F.lit(",Rule"), F.expr("CAST(p_partkey div 3 AS STRING)"), more)
    rules = part.select(F.concat(F.lit("Rule"), k.cast("string")).alias("name"), F.when(F.col("p_size") % 10 != 0, "shortcut").otherwise("regex").alias("type"), value.alias("value"))
    start = part.where("p_type = 'ECONOMY'").select(F.concat(F.lit("Rule"), k.cast("string")).alias("name"))
    return validate.closure(start, rules)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_wins(spark, d):
    rows = streams.latest_by_key(read(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")
    return rows.select("user_id", "event_type")


@query(
    """SELECT p_type, p_partkey, (list(p_partkey) OVER w)[CAST((row_number() OVER (PARTITION BY p_type ORDER BY p_partkey)) % count(*) OVER (PARTITION BY p_type) AS BIGINT) + 1] AS neighbour
    FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def carousel_next(spark, d):
    return lookup.neighbour(read(spark, d, "part").select("p_type", "p_partkey"), ["p_type"], "p_partkey", "p_partkey")


@query(
    """SELECT p_type, p_partkey, lag(p_partkey) OVER (PARTITION BY p_type ORDER BY p_partkey) AS neighbour FROM part"""
)
def carousel_previous(spark, d):
    return lookup.neighbour(read(spark, d, "part").select("p_type", "p_partkey"), ["p_type"], "p_partkey", "p_partkey", -1, wrap=False)


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS escaped FROM pages""")
def escape_strip(spark, d):
    return read(spark, d, "pages").select("page_id", text.strip_tags(text.escape_html(F.col("html"))).alias("escaped"))


@query(
    """SELECT k, NOT (coalesce(v, '') IN ('', '0')) AS present FROM (SELECT event_id AS k, CAST(event_id % 5 AS VARCHAR) AS v FROM events
      UNION ALL SELECT -1, NULL UNION ALL SELECT -2, '' UNION ALL SELECT -3, ' ')"""
)
def required_server(spark, d):
    rows = read(spark, d, "events").select(F.col("event_id").alias("k"), (F.col("event_id") % 5).cast("string").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " ")], "k long, v string"))
    return rows.select("k", predicates.present(F.col("v")).alias("present"))


@query(
    """SELECT event_id, CASE WHEN k IN (2, 5) THEN NULL ELSE CAST(regexp_extract(t, '^([+-]=)?(-?[0-9]+([.][0-9]+)?)', 2) AS DOUBLE) END AS number,
      CASE WHEN k IN (2, 5) THEN NULL ELSE nullif(regexp_extract(t, '^([+-]=)?(-?[0-9]+([.][0-9]+)?)(.+)?$', 4), '') END AS unit, CASE WHEN k = 3 THEN CASE event_id % 4 WHEN 1 THEN '+=' ELSE '-=' END END AS relative FROM (
      SELECT event_id, event_id % 6 AS k, CASE event_id % 6 WHEN 0 THEN event_id || 'deg' WHEN 1 THEN '-' || event_id || '.5rad' WHEN 2 THEN 'deg' WHEN 3 THEN CASE event_id % 4 WHEN 1 THEN '+=' ELSE '-=' END || event_id || 'turn'
      WHEN 4 THEN CAST(event_id AS VARCHAR) ELSE '' END AS t FROM events)"""
)
def number_units(spark, d):
    k = F.col("event_id")
    n = k.cast("string")
    t = (
        F.when(k % 6 == 0, F.concat(n, F.lit("deg"))).when(k % 6 == 1, F.concat(F.lit("-"), n, F.lit(".5rad"))).when(k % 6 == 2, F.lit("deg"))
        .when(k % 6 == 3, F.concat(F.when(k % 4 == 1, "+=").otherwise("-="), n, F.lit("turn"))).when(k % 6 == 4, n).otherwise(F.lit(""))
    )
    return read(spark, d, "events").select("event_id", text.number_and_unit(t).alias("r")).select("event_id", "r.number", "r.unit", "r.relative")


@query("SELECT page_id, page_id % 3 <> 0 AS same FROM pages")
def same_page(spark, d):
    """Each page against itself without and with the first slash, and against another one."""
    path, k = F.regexp_replace("url", "^[a-z]+://[^/]*", ""), F.col("page_id") % 3
    here = F.when(k == 0, F.concat(path, F.lit("/x"))).when(k == 1, F.regexp_replace(path, "^/", "")).otherwise(path)
    return read(spark, d, "pages").select("page_id", text.same_page(path, here).alias("same"))


@query("SELECT page_id, href, label, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"[^>]*>[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a [^>]*href=\"[^\"]*\"[^>]*>([^<]*)</a>', 1)) AS label, generate_subscripts(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"[^>]*>[^<]*</a>', 1), 1) AS i FROM pages)")
def page_links(spark, d):
    return html.links(read(spark, d, "pages"))


@query("SELECT user_id, event_type, max(value) AS top FROM events GROUP BY user_id, event_type HAVING max(value) > 95")
def ext_top_values(spark, d):
    """An extra beside the library's own inventory."""
    best = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("top"))
    return best.where("top > 95")


@query(
    """SELECT event_id, replace(c, 'active', '') AS off, CASE WHEN contains(c, 'active') THEN c ELSE c || ' active' END AS turned_on FROM (
      SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'btn active' WHEN 1 THEN 'btn inactive big' ELSE 'btn ' || event_type END AS c FROM events)"""
)
def class_lists(spark, d):
    k = F.col("event_id") % 3
    c = F.when(k == 0, F.lit("btn active")).when(k == 1, F.lit("btn inactive big")).otherwise(F.concat(F.lit("btn "), F.col("event_type")))
    return read(spark, d, "events").select("event_id", text.without_class(c, "active").alias("off"), text.with_class(c, "active").alias("turned_on"))


@query("SELECT p_partkey, 'css/' || replace(p_name, ' ', '.') || '.min.css' AS small FROM part")
def min_names(spark, d):
    path = F.concat(F.lit("css/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".css"))
    return read(spark, d, "part").select("p_partkey", text.with_suffix(path, ".min").alias("small"))


@query("SELECT conv_id, CAST(i - 1 AS INTEGER) AS pos, a, b FROM (SELECT conv_id, unnest(range(1, greatest(len(x), len(y)) + 1)) AS i, x[unnest(range(1, greatest(len(x), len(y)) + 1))] AS a, y[unnest(range(1, greatest(len(x), len(y)) + 1))] AS b FROM (SELECT conv_id, coalesce(list(turn ORDER BY turn) FILTER (WHERE role = 'user'), []) AS x, coalesce(list(turn ORDER BY turn) FILTER (WHERE role <> 'user'), []) AS y FROM conversations GROUP BY conv_id))")
def padded_zip(spark, d):
    of = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("turn"))))
    lists = read(spark, d, "conversations").groupBy("conv_id").agg(of(F.col("role") == "user").alias("x"), of(F.col("role") != "user").alias("y"))
    return lists.select("conv_id", F.posexplode(color.padded_pairs(F.col("x"), F.col("y"))).alias("pos", "p")).select("conv_id", "pos", "p.a", "p.b")


@query("SELECT p_partkey, p_brand AS color, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'M' END AS size, p_type AS kind FROM part")
def merged_options(spark, d):
    base = F.create_map(F.lit("color"), F.lit("none"), F.lit("size"), F.lit("M"))
    own = F.create_map(F.lit("color"), F.col("p_brand"), F.lit("kind"), F.col("p_type"))
    sized = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("size"), F.col("p_size").cast("string")))
    rows = read(spark, d, "part").select("p_partkey", lookup.merged_options(base, sized, own).alias("m"))
    return rows.select("p_partkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("color", "size", "kind")])


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '1' END AS width, CASE WHEN p_size % 3 = 2 THEN NULL ELSE '2' END AS height,
      CASE WHEN p_size % 3 = 2 THEN p_type END AS size, CASE WHEN p_size % 3 = 1 THEN NULL ELSE 'red' END AS color, CASE WHEN p_size % 3 = 1 THEN p_name END AS color_text
    FROM (SELECT * FROM part) WHERE p_size % 3 <> 2 UNION ALL SELECT p_partkey, NULL, NULL, p_type, 'red', NULL FROM part WHERE p_size % 3 = 2"""
)
def deep_options(spark, d):
    """An option of a group, a value in the place of a group, and a group in the place of a value."""
    of = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k.replace("__", ".")), v)])
    base, k = of(size__width=F.lit("1"), size__height=F.lit("2"), color=F.lit("red")), F.col("p_size") % 3
    own = F.when(k == 0, of(size__width=F.col("p_brand"))).when(k == 1, of(color__text=F.col("p_name"))).otherwise(of(size=F.col("p_type")))
    rows = read(spark, d, "part").select("p_partkey", lookup.deep_merged(base, F.lit(None).cast("map<string,string>"), own).alias("m"))
    names = {"width": "size.width", "height": "size.height", "size": "size", "color": "color", "color_text": "color.text"}
    return rows.select("p_partkey", *[F.try_element_at("m", F.lit(path)).alias(name) for name, path in names.items()])


ATTRIBUTES_SQL = "".join(
    f" UNION ALL SELECT p_partkey, p_name, '{rule}', {param} FROM part WHERE {given}"
    for rule, param, given in (
        ("min", "CAST(CASE WHEN p_size > 40 THEN p_size - 40 ELSE 1 END AS VARCHAR)", "TRUE"),
        ("pattern", "'[a-z ]+'", "p_size % 5 = 0"), ("maxlength", "CAST(p_size AS VARCHAR)", "p_size % 7 = 0"), ("minlength", "'2'", "p_size % 7 = 1"),
        ("maxchecked", "'3'", "p_size % 11 = 0"), ("minchecked", "'1'", "p_size % 11 = 1"), ("required", "'true'", "p_size % 2 = 0 OR p_size % 9 = 0"),
        ("email", "'true'", "p_type = 'PROMO'"), ("number", "'true'", "p_type = 'SMALL'"),
    )
)


@query(
    f"""SELECT form, name, rule, param FROM (
      SELECT p_partkey AS form, p_name AS name, 'max' AS rule, CAST(CASE WHEN p_size > 25 THEN p_size ELSE 99 END AS VARCHAR) AS param FROM part{ATTRIBUTES_SQL})"""
)
def attribute_rules(spark, d):
    size = F.col("p_size")
    kind = F.when(F.col("p_type") == "PROMO", "email").when(F.col("p_type") == "SMALL", "number").otherwise("text")
    fields = read(spark, d, "part").select(
        F.col("p_partkey").alias("form"), F.col("p_name").alias("name"), F.when(size > 25, size).alias("max"), F.lit(99).alias("aria_valuemax"),
        F.when(size > 40, size - 40).alias("min"), F.lit(1).alias("aria_valuemin"), F.when(size % 5 == 0, F.lit("[a-z ]+")).alias("pattern"),
        F.when(size % 7 == 0, size).alias("maxlength"), F.when(size % 7 == 1, F.lit(2)).alias("minlength"), F.when(size % 11 == 0, F.lit(3)).alias("maxchecked"),
        F.when(size % 11 == 1, F.lit(1)).alias("minchecked"), (size % 2 == 0).alias("required"), (size % 9 == 0).alias("aria_required"), kind.alias("type"),
    )
    return validate.attribute_rules(fields)


@query(
    """SELECT event_id, v <> '' AND (NOT regexp_matches(v, '^([+-]?[0-9]+([.][0-9]*)?([eE][+-]?[0-9]+)?)?$') OR coalesce(TRY_CAST(regexp_extract(v, '^-?[0-9]+') AS INTEGER) < 0, FALSE)) AS not_positive,
      v <> '' AND (NOT regexp_matches(v, '^([+-]?[0-9]+([.][0-9]*)?([eE][+-]?[0-9]+)?)?$') OR coalesce(TRY_CAST(regexp_extract(v, '^-?[0-9]+') AS INTEGER) > 0, FALSE)) AS not_negative,
      v <> CAST(event_id % 9 - 4 AS VARCHAR) AS not_again, event_id % 4 < 1 AS none_checked FROM (
      SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' || event_id ELSE CAST(event_id % 7 - 3 AS VARCHAR) END AS v FROM events)"""
)
def registry_rules(spark, d):
    """The built-in rules that are shortcuts, matches and counts of checks."""
    k = F.col("event_id")
    v = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.concat(F.lit("x"), k.cast("string"))).otherwise((k % 7 - 3).cast("string"))

    def broken(name):
        wrong = F.lit(False)
        for rule in validate.closed_rules(name):
            wrong = wrong | (predicates.looked_at(rule, v) & predicates.in_error(rule, v))
        return wrong

    again = predicates.in_error(predicates.BUILT_IN["passwordagain"], v, (k % 9 - 4).cast("string"))
    few = predicates.in_error(predicates.BUILT_IN["checkone"], k % 4)
    return read(spark, d, "events").select(
        "event_id", broken("positive").alias("not_positive"), broken("negative").alias("not_negative"), again.alias("not_again"), few.alias("none_checked")
    )


@query(
    """SELECT event_id, CASE WHEN event_type = 'click' AND event_id % 2 = 1 THEN '' WHEN event_type = 'view' AND NOT bool_or(event_type = 'view' AND event_id % 2 = 0) OVER (PARTITION BY user_id, event_type)
      THEN '' ELSE 'v' || CAST(event_id AS VARCHAR) END AS value FROM events"""
)
def field_values(spark, d):
    kind = F.when(F.col("event_type") == "click", "checkbox").when(F.col("event_type") == "view", "radio").otherwise("text")
    k = F.col("event_id")
    fields = read(spark, d, "events").select(
        k, F.col("user_id").alias("form"), F.col("event_type").alias("name"), kind.alias("type"), F.concat(F.lit("v"), k.cast("string")).alias("value"), (k % 2 == 0).alias("checked")
    )
    return validate.field_values(fields).select("event_id", "value")


@query(
    """SELECT event_id, event_type FROM events e WHERE event_type = (SELECT arg_max(event_type, (ts, event_id)) FROM events l WHERE l.user_id = e.user_id)"""
)
def late_answers(spark, d):
    events = read(spark, d, "events")
    current = streams.latest_by_key(events.select("user_id", "event_type", "ts", "event_id"), "user_id", "ts", "event_id")
    return streams.in_time(events, current, "user_id", "event_type").select("event_id", "event_type")


@query(
    """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS nth FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE nth = 1 OR before IS DISTINCT FROM event_type"""
)
def changed_only(spark, d):
    return streams.changed_only(read(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", "event_type", "ts", "event_id").select("event_id", "user_id", "event_type")


#: A state from the one before, as the pages have it: s (NULL at first), v (scroll), p (position); o: the upper offset.
AFFIX_SQL = """CASE WHEN {o} IS NOT NULL AND {s} = 'top' THEN CASE WHEN {v} < {o} THEN 'top' ELSE '' END
  WHEN {s} = 'bottom' THEN CASE WHEN {o} IS NOT NULL THEN CASE WHEN {v} + 15 <= {p} THEN '' ELSE 'bottom' END
    ELSE CASE WHEN {v} + 100 <= 600 - 150 THEN '' ELSE 'bottom' END END
  WHEN {o} IS NOT NULL AND {v} <= {o} THEN 'top'
  WHEN CASE WHEN {s} IS NULL THEN {v} + 100 ELSE {p} + 40 END >= 600 - 150 THEN 'bottom' ELSE '' END"""


@query(
    f"""SELECT event_id, {AFFIX_SQL.format(s="s", v="v", p="p", o="o")} AS state FROM (SELECT event_id, value AS v, value + event_id % 60 AS p,
      CASE event_id % 4 WHEN 1 THEN '' WHEN 2 THEN 'top' WHEN 3 THEN 'bottom' END AS s, CASE WHEN event_id % 3 > 0 THEN 120.0 END AS o FROM events)"""
)
def affix_states(spark, d):
    k, v = F.col("event_id"), F.col("value")
    before = F.when(k % 4 == 1, F.lit("")).when(k % 4 == 2, F.lit("top")).when(k % 4 == 3, F.lit("bottom"))
    state = predicates.affix_state(before, v, v + k % 60, F.lit(15), F.lit(40), F.lit(100), F.lit(600), F.when(k % 3 > 0, F.lit(120.0)), F.lit(150))
    return read(spark, d, "events").select("event_id", state.alias("state"))


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, value AS v, value + event_id % 60 AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
    f AS (SELECT user_id, event_id, nth, {AFFIX_SQL.format(s="CAST(NULL AS VARCHAR)", v="v", p="p", o="120.0")} AS state FROM e WHERE nth = 1
      UNION ALL SELECT e.user_id, e.event_id, e.nth, {AFFIX_SQL.format(s="f.state", v="e.v", p="e.p", o="120.0")} FROM f JOIN e ON e.user_id = f.user_id AND e.nth = f.nth + 1)
    SELECT user_id, event_id, state FROM f"""
)
def affix_fold(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_id", F.col("value").alias("scroll"), (F.col("value") + F.col("event_id") % 60).alias("position"))
    return predicates.affix_states(rows, "user_id", "event_id", 15, 40, 100, 600, 120, 150)


@query("SELECT form, 'Ann' || CASE WHEN form % 4 = 1 THEN '' ELSE ' B' END AS first_name, 'u' || CAST(form AS VARCHAR) || '@example.com' AS email FROM (SELECT p_partkey AS form FROM part) WHERE form % 3 <> 0 AND form % 4 <> 0")
def contact_forms(spark, d):
    k = F.col("p_partkey")
    values = {
        "name": F.when(k % 4 == 0, F.lit("0")).when(k % 4 == 1, F.lit("Ann Lee")).otherwise(F.lit("Ann B Lee")),
        "email": F.concat(F.lit("u"), k.cast("string"), F.when(k % 3 == 0, F.lit("@example")).otherwise(F.lit("@example.com"))),
        "phone": F.lit("555"), "message": F.col("p_name"),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), v.alias("value")) for i, (n, v) in enumerate(values.items())])
    fields = read(spark, d, "part").select(k.alias("form"), F.explode(rows).alias("f")).select("form", "f.pos", "f.name", "f.value")
    return flows.submitted(fields).select("form", "first_name", "email")


@query("SELECT 'css/' || n || e AS path, CASE WHEN e = '.css' THEN '/* v1.0 2024 */ a  {' || n || ' }' ELSE '/* v1.0 2024 */ a {' || n || ' }' END AS content FROM (SELECT replace(n_name, '_', '') AS n, unnest(['.css', '.min.css']) AS e FROM nation)")
def site_build(spark, d):
    name = F.replace("n_name", F.lit("_"), F.lit(""))
    files = read(spark, d, "nation").select(F.concat(F.lit("css/"), name, F.lit(".css")).alias("path"), F.concat(F.lit("a  {"), name, F.lit(" }")).alias("content"))
    return flows.built(files, "/* v{{version}} {{year}} */ ", "1.0", 2024)


@query("SELECT event_id, CAST(CASE event_id % 4 WHEN 1 THEN 10 WHEN 3 THEN 20 END AS BIGINT) AS item FROM events")
def at_position(spark, d):
    items, k = F.array(*[F.lit(x).cast("long") for x in (10, 20)]), F.col("event_id") % 4
    place = F.when(k == 0, F.lit(2)).when(k == 1, F.lit(0)).when(k == 2, F.lit(-1)).otherwise(F.lit(1))
    return read(spark, d, "events").select("event_id", lookup.at_position(items, place).alias("item"))


@query("SELECT p_partkey, upper(substr(b, 1, 1)) || substr(b, 2) AS title, floor(p_retailprice + 0.5)::BIGINT AS whole, greatest(p_size, 25) AS larger FROM (SELECT *, lower(p_brand) AS b FROM part)")
def small_scalars(spark, d):
    return read(spark, d, "part").select(
        "p_partkey", text.title_words(F.col("p_brand")).alias("title"), text.rounded(F.col("p_retailprice")).alias("whole"), F.greatest(F.col("p_size"), F.lit(25)).alias("larger")
    )


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'purchase') AND event_id % 3 <> 0")
def visible_inputs(spark, d):
    fields = read(spark, d, "events").withColumns({"type": F.col("event_type"), "visible": F.col("event_id") % 3 != 0})
    return validate.visible_inputs(fields, ("error", "purchase")).select("event_id", "event_type")


@query("SELECT DISTINCT event_type AS value, length(event_type) > 4 AS valid, CASE WHEN length(event_type) > 4 THEN '' ELSE event_type || ' is short' END AS message FROM events")
def remote_checks(spark, d):
    values = read(spark, d, "events").select(F.col("event_type").alias("value"))
    return validate.remote_checks(values, lambda v: (len(v) > 4, "" if len(v) > 4 else f"{v} is short"))


@query("SELECT DISTINCT user_id AS form FROM events")
def distinct_forms(spark, d):
    return validate.distinct_forms(read(spark, d, "events").withColumnRenamed("user_id", "form"))


@query("SELECT event_id, value >= 75 AS shouted FROM events")
def callback_rules(spark, d):
    predicates.register_callback(spark, "checks.loud", "CAST(value AS DOUBLE) >= 75")
    rule = predicates.Rule("Loud", "callback", "checks.loud")
    return read(spark, d, "events").select("event_id", predicates.in_error(rule, F.col("value").cast("string")).alias("shouted"))


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN value >= 75 WHEN 1 THEN length(event_type) > 4 ELSE length(event_type) % 2 = 1 END AS wrong FROM events"""
)
def named_callbacks(spark, d):
    """A column names the callback of each row: two in SQL, one in Python over whole columns."""
    predicates.register_callback(spark, "checks.loud", "CAST(value AS DOUBLE) >= 75")
    predicates.register_callback(spark, "checks.text.long", "length(value) > 4")
    predicates.register_callback(spark, "odd", lambda v: v.str.len() % 2 == 1)
    k, names = F.col("event_id"), ["checks.loud", "checks.text.long", "odd"]
    rows = read(spark, d, "events").select(
        k, F.get(F.array(*map(F.lit, names)), (k % 3).cast("int")).alias("callback"), F.when(k % 3 == 0, F.col("value").cast("string")).otherwise(F.col("event_type")).alias("v")
    )
    return rows.select("event_id", predicates.called(names, F.col("callback"), F.col("v")).alias("wrong"))


@query("SELECT user_id, sum(CAST(props ->> '$.k' AS INTEGER))::BIGINT AS total, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY user_id")
def handled_answers(spark, d):
    """A handler that is given the decoded answers; those with another status never reach it."""
    url, status = F.concat_ws("/", "user_id", "event_id"), F.when(F.col("event_type") == "error", 500).otherwise(200)
    answers = read(spark, d, "events").select(url.alias("url"), status.alias("status"), F.col("props").alias("body"))
    user = F.get(F.split("url", "/"), F.lit(0)).cast("long")
    return readers.handled(answers, lambda data: data.groupBy(user.alias("user_id")).agg(F.sum("data.k").alias("total"), F.count("*").alias("n")), "k int")


@query(
    f"""WITH e AS ({ERRORS_SQL.replace("SELECT *, list_filter", "SELECT *, form % 7 AS grp, list_filter")}), touched AS (SELECT DISTINCT form, grp FROM e WHERE pos % 6 = 0 AND name = 'view'),
    again AS (SELECT form, grp, flatten(list(list_filter(errors, lambda m: value <> ''))) AS found, count(*) AS n_fields FROM e JOIN touched USING (form, grp) GROUP BY form, grp)
    SELECT form, grp, CASE WHEN len(found) > 0 THEN array_to_string(list_sort(list_distinct(found)), '</li><li>') END AS messages, n_fields FROM again"""
)
def revalidated_groups(spark, d):
    """An event of one field looks at all fields of its group again; groups without an event are left alone."""
    fields = _fields(spark, d).withColumn("grp", F.col("form") % 7)
    return validate.revalidated(fields.where("pos % 6 = 0 AND name = 'view'"), fields, RULES, "grp")


#: What the six texts of shadow_lists say, read by hand; -1000 stands for the number that a row puts in.
SHADOWS_SQL = """(VALUES
  (0, 0, TRUE, 1, -1000, 3, 0, 0, 255, 0, 1.0), (0, 1, FALSE, 0, 0, 4, 0, 1, 2, 3, 0.5),
  (1, 0, TRUE, -1000, -2, 0, 0, 16, 32, 48, 1.0), (1, 1, FALSE, 4, 5, 6, 7, NULL, NULL, NULL, NULL),
  (2, 0, FALSE, -1000, 2, 0, 0, 1, 2, 300, 1.0), (3, 0, FALSE, 0, 0, 0, 0, NULL, NULL, NULL, NULL),
  (4, 0, FALSE, 1, NULL, -1000, 0, 170, 187, 204, 1.0), (4, 1, FALSE, 3, 4, 0, 0, 10, 20, 30, 0.25),
  (5, 0, FALSE, 0, 0, 0, 0, NULL, NULL, NULL, NULL)) AS s(k, shadow, inset, "left", top, blur, spread, red, green, blue, alpha)"""
PUT_IN = "CAST(CASE WHEN {c} = -1000 THEN p_size ELSE {c} END AS INTEGER) AS {c}"


@query(
    f"""SELECT p_partkey, shadow, inset, {PUT_IN.format(c='"left"')}, {PUT_IN.format(c="top")}, {PUT_IN.format(c="blur")}, spread, red, green, blue,
      CAST(alpha AS DOUBLE) AS alpha FROM part JOIN {SHADOWS_SQL} ON p_partkey % 6 = k"""
)
def shadow_lists(spark, d):
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    shadow = (
        F.when(k == 0, F.concat(F.lit("inset 1px "), n, F.lit("px 3px #0f0, 0 0 4px rgba(1,2,3,.5)"))).when(k == 1, F.concat(n, F.lit("px -2px #102030 inset , 4 5 6 7")))
        .when(k == 2, F.concat(n, F.lit(" 2 rgb(1.7, 2, 300) bad 9 9, 1 2"))).when(k == 3, F.lit(" 1 2"))
        .when(k == 4, F.concat(F.lit("#abc 1.5px .5 "), n, F.lit(".9.1px, rgba(10,20,30,0.25) 3px 4px"))).otherwise(F.lit(""))
    )
    rows = read(spark, d, "part").select("p_partkey", F.posexplode(color.parse_shadows(shadow)).alias("shadow", "s"))
    channels = [F.col("s.color")[i].cast("int").alias(c) for i, c in enumerate(("red", "green", "blue"))]
    return rows.select("p_partkey", "shadow", *[f"s.{c}" for c in ("inset", "left", "top", "blur", "spread")], *channels, F.col("s.color")[3].alias("alpha"))


@query()
def random_category(spark, d):
    return lookup.pick_random(read(spark, d, "nation").select("n_nationkey", "n_name"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_files(spark, d):
    """All rows that the stream of event files has, by type."""
    events, folder = read(spark, d, "events"), places.shared_folder(spark)
    stream = streams.arriving(spark, d, events, "events.parquet")
    return streams.drained(stream, f"{folder}/rows", f"{folder}/checkpoint").groupBy("event_type").agg(F.count("*").alias("n"))


REQUEST_ROWS = """SELECT user_id, event_id, ts, event_id % 3 = 0 AS answer, CAST(event_id // 3 % 2 AS VARCHAR) AS value, event_id % 5 <> 0 AS valid,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events"""


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED ({REQUEST_ROWS}), f AS (
      SELECT user_id, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS event_id, '' AS outcome, CAST(NULL AS VARCHAR) AS given, FALSE AS in_error, FALSE AS again,
        CAST(NULL AS VARCHAR) AS value, TRUE AS valid, TRUE AS finished, CAST(NULL AS TIMESTAMP) AS sent, CAST(NULL AS VARCHAR) AS wanted, FALSE AS known
      FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT user_id, nth, event_id, outcome, given, CASE outcome WHEN 'answered' THEN NOT fits WHEN 'known' THEN NOT valid ELSE FALSE END, outcome = 'answered' AND wanted <> value,
        CASE WHEN outcome = 'sent' THEN given WHEN outcome = 'answered' AND wanted <> value THEN wanted ELSE value END,
        CASE WHEN outcome = 'sent' OR outcome = 'answered' AND wanted <> value THEN TRUE WHEN outcome = 'answered' THEN fits ELSE valid END,
        CASE WHEN outcome = 'sent' OR outcome = 'answered' AND wanted <> value THEN FALSE WHEN outcome = 'answered' THEN TRUE ELSE finished END,
        CASE WHEN outcome = 'sent' OR outcome = 'answered' AND wanted <> value THEN ts ELSE sent END,
        CASE WHEN outcome IN ('sent', 'waiting', 'known') THEN given ELSE wanted END, known OR outcome IN ('sent', 'waiting', 'known')
      FROM (SELECT *, CASE WHEN answer AND (finished OR value <> given) THEN 'late' WHEN answer THEN 'answered' WHEN NOT finished THEN 'waiting'
          WHEN known AND value = given THEN 'known' ELSE 'sent' END AS outcome
        FROM (SELECT f.user_id, e.nth, e.event_id, e.ts, e.answer, e.value AS given, e.valid AS fits, f.value, f.sent, f.wanted, f.known,
            f.valid OR NOT f.finished AND e.ts - f.sent > INTERVAL 6 HOUR AS valid, f.finished OR e.ts - f.sent > INTERVAL 6 HOUR AS finished
          FROM f JOIN e ON e.user_id = f.user_id AND e.nth = f.nth + 1))
    )
    SELECT user_id, event_id, outcome, given AS value, in_error FROM f WHERE nth > 0 UNION ALL SELECT user_id, event_id, 'sent', value, FALSE FROM f WHERE again"""
)
def request_states(spark, d):
    """Values that are wanted and answers to requests, as a stream in three arrivals with one state for each user."""
    k = F.col("event_id")
    rows = read(spark, d, "events").select(
        "user_id", k.alias("nth"), F.col("ts").alias("at"), (k % 3 == 0).alias("answer"), F.expr("CAST(event_id div 3 % 2 AS STRING)").alias("value"), (k % 5 != 0).alias("valid")
    )
    folder, ends = places.shared_folder(spark), read(spark, d, "events").agg(F.expr("percentile_approx(unix_micros(CAST(ts AS TIMESTAMP)), array(0.33, 0.66))").alias("p")).first()["p"]
    arrival, found = F.unix_micros(F.col("at").cast("timestamp")), None
    for part in (arrival <= ends[0], (arrival > ends[0]) & (arrival <= ends[1]), arrival > ends[1]):
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        states = requests.requests(streams.arriving(spark, f"{folder}/in", rows), "user_id", timedelta(hours=6))
        found = streams.drained(states, f"{folder}/out", f"{folder}/checkpoint")
    return found.select(F.col("key").alias("user_id"), F.col("nth").alias("event_id"), "outcome", "value", "in_error")


@query(
    """SELECT event_id, event_type FROM events e WHERE event_type = (SELECT arg_max(event_type, (ts, event_id)) FROM events l WHERE l.user_id = e.user_id)"""
)
def late_answers_stream(spark, d):
    """late_answers as two streams, with a watermark as far behind as the table is long, moved on by a last row."""
    events = read(spark, d, "events").select("user_id", F.col("event_id").alias("nth"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("value"))
    folder, ends = places.shared_folder(spark), events.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    late = ends["last"] - ends["first"] + timedelta(seconds=1)
    end = spark.createDataFrame([(-1, -1, ends["last"] + 2 * late, "")], events.schema)
    for rows in (events, end):
        rows.write.mode("append").parquet(f"{folder}/in")
        two = [streams.arriving(spark, f"{folder}/in", events) for _ in range(2)]
        found = streams.drained(requests.in_time_stream(*two, "user_id", f"{int(late.total_seconds())} seconds"), f"{folder}/out", f"{folder}/checkpoint")
    return found.where("key >= 0").select(F.col("nth").alias("event_id"), F.col("value").alias("event_type"))


@query(
    """WITH now AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_partkey % 401 = 7 THEN 'new ' ELSE '' END || p_name AS content, p_partkey % 401 = 7 AS changed,
      p_type || '/' || p_brand || '/' || printf('p%012d', p_partkey) AS path FROM part),
    built AS (SELECT 'brand' AS rule, p_brand AS target, content, changed, path FROM now UNION ALL SELECT 'type', p_type, content, changed, path FROM now WHERE p_type <> 'ECONOMY')
    SELECT rule, target, sha256(string_agg(content, chr(10) ORDER BY path)) AS sha256, CAST(bool_or(changed) AS BIGINT) AS batch FROM built GROUP BY rule, target"""
)
def incremental_builds(spark, d):
    """Sources come, then some of them change: both rules rebuild the targets of those only, and a repeated batch changes nothing."""
    part, folder = read(spark, d, "part"), places.shared_folder(spark)
    path = F.concat_ws("/", F.col("p_type"), F.col("p_brand"), F.format_string("p%012d", "p_partkey"))
    sources = part.select(path.alias("path"), F.col("p_name").alias("content"))
    again = part.where("p_partkey % 401 = 7").select(path.alias("path"), F.concat(F.lit("new "), F.col("p_name")).alias("content"))
    at = lambda k: F.get(F.split("path", "/"), F.lit(k))
    rules = [builds.Build("brand", at(1), builds.bundled()), builds.Build("type", F.when(at(0) != "ECONOMY", at(0)), builds.bundled())]
    for rows in (sources, again):
        rows.write.mode("append").parquet(f"{folder}/in")
        builds.rebuild_on_change(streams.arriving(spark, f"{folder}/in", sources), folder, rules)
    builds.rebuild(again, 1, folder, rules)
    every = [builds.built(spark, folder, r.name).select(F.lit(r.name).alias("rule"), "target", F.sha2("content", 256).alias("sha256"), "batch") for r in rules]
    return every[0].unionByName(every[1])


# Sources and sinks: what is written is read back.


@query("SELECT r_regionkey AS key, r_name || ' {{name}}' || chr(10) AS body FROM region")
def template_files(spark, d):
    """Texts of files, to their last line feed. The tasks write them."""
    rows = read(spark, d, "region").select(F.concat(F.lit("t"), F.col("r_regionkey").cast("string"), F.lit(".html")).alias("name"), F.concat("r_name", F.lit(" {{name}}\n")).alias("text"))
    texts = readers.templates(spark, places.put_texts(rows, places.shared_folder(spark)))
    return texts.select(F.substring("name", 2, 9).cast("int").alias("key"), "body")


@query("SELECT 'a' || n_nationkey || '.css' AS name, n_name AS content FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey <> 4")
def file_tree(spark, d):
    """Files by a pattern, but for one that is named."""
    k = F.col("n_nationkey")
    name = F.concat(F.lit("x"), (k % 3).cast("string"), F.lit("/a"), k.cast("string"), F.when(k % 2 == 1, ".js").otherwise(".css"))
    folder = places.put_texts(read(spark, d, "nation").select(name.alias("name"), F.col("n_name").alias("text")), places.shared_folder(spark))
    return readers.files(spark, folder, "*.css", ("a4.css",)).select("name", F.decode("content", "UTF-8").alias("content"))


@query("SELECT n_nationkey AS id, n_name AS name, '2.' || n_regionkey AS version, n_nationkey % 2 = 0 AS minify FROM nation")
def json_settings(spark, d):
    """A settings file for each nation, over several lines."""
    k = F.col("n_nationkey")
    line = '{\n  "version": "2.%s",\n  "id": %s,\n  "pkg": {"name": "%s",\n "minify": %s}\n}\n'
    body = F.format_string(line, F.col("n_regionkey"), k, F.col("n_name"), F.when(k % 2 == 0, "true").otherwise("false"))
    files = read(spark, d, "nation").select(F.concat(F.lit("p"), k.cast("string"), F.lit("/package.json")).alias("name"), body.alias("text"))
    found = readers.settings(spark, places.put_texts(files, places.shared_folder(spark)) + "/*")
    return found.select(F.col("id").cast("int"), "pkg.name", "version", "pkg.minify")


@query("SELECT c_custkey, c_name || ' & co' AS name, CASE WHEN c_custkey % 2 = 0 THEN 'a b+c' END AS message, CASE c_custkey % 3 WHEN 0 THEN '+1 (2)' WHEN 1 THEN '' END AS phone FROM customer")
def form_posts(spark, d):
    sent = F.concat(F.lit("id="), F.col("c_custkey").cast("string"), F.lit("&name="), F.url_encode(F.concat("c_name", F.lit(" & co"))), F.when(F.col("c_custkey") % 2 == 0, F.lit("&message=a+b%2Bc")).otherwise(F.lit("")))
    phone = F.when(F.col("c_custkey") % 3 == 0, F.lit("&phone=%2B1%20(2)")).when(F.col("c_custkey") % 3 == 1, F.lit("&phone=")).otherwise(F.lit(""))
    sent = F.concat(sent, phone)
    found = readers.posts(read(spark, d, "customer").select(sent.alias("body")), "id", "name", "message", "phone")
    return found.select(F.col("id").cast("long").alias("c_custkey"), "name", "message", "phone")


@query(
    """SELECT r_regionkey, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, 'n' || n_nationkey AS id, n_name || ' fine' AS title,
      'img/' || n_nationkey || '.jpg' AS image, 'All of ' || n_name AS description FROM region JOIN nation ON n_regionkey = r_regionkey"""
)
def page_sections(spark, d):
    k = F.col("n_nationkey").cast("string")
    part = F.concat(
        F.lit('<section class="c" id="n'), k, F.lit('"><!-- <h2>old</h2> --><img alt="" src="img/'), k, F.lit('.jpg">\n<h2 class="t">'), F.col("n_name"),
        F.lit(" <b>fine</b></h2><p>All\n of <i>"), F.col("n_name"), F.lit("</i></p></section>"),
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", part.alias("part")))), lambda x: x["part"])
    pages = read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(parts, "\n").alias("html"))
    return html.sections(pages, "r_regionkey")


@query(
    """SELECT c_custkey, 'Website Contact Form:  ' || c_name AS subject, 'You have received a new message from your website contact form.' || chr(10) || chr(10) || 'Here are the details:' || chr(10) || chr(10)
      || 'Name: ' || c_name || chr(10) || chr(10) || 'Email: a@b.c' || chr(10) || 'Bcc: x' || chr(10) || chr(10) || 'Phone: 5&amp;5' || chr(10) || chr(10) || 'Message:' || chr(10) || '&lt;b&gt;hi&lt;/b&gt;' AS body,
      'From: me@example.com' || chr(10) || 'Reply-To: a@b.c Bcc: x' AS headers FROM customer"""
)
def mail_text(spark, d):
    """Texts of messages; tags are escaped, and a line feed in an address cannot begin a header."""
    record = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.lit("a@b.c\nBcc: x").alias("email"), F.lit("5&5").alias("phone"), F.lit("<b>hi</b>").alias("message"))
    return sinks.mail(record, "me@example.com", "c_custkey")


@query("SELECT p_partkey, chr(39) || p_name || chr(39) AS quoted, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n_names, [p_brand, p_type] || CASE WHEN p_size % 2 = 0 THEN [p_name] ELSE [] END AS joined, CAST(year(current_date) AS INTEGER) AS year FROM part")
def list_scalars(spark, d):
    names = text.listed(F.replace("p_name", F.lit(" "), F.lit(",")))
    joined = lookup.joined_lists(F.array("p_brand", "p_type"), F.when(F.col("p_size") % 2 == 0, F.array("p_name")))
    return read(spark, d, "part").select("p_partkey", text.quoted(F.col("p_name")).alias("quoted"), F.size(names).alias("n_names"), joined.alias("joined"), dates.this_year().alias("year"))


@query("SELECT count(*) AS n, count(*) AS n_different, TRUE AS prefixed FROM part")
def unique_ids(spark, d):
    ids = read(spark, d, "part").select(text.unique_id("id-").alias("id"))
    return ids.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_different"), F.bool_and(F.startswith("id", F.lit("id-"))).alias("prefixed"))


@query("SELECT n_nationkey, n_name FROM nation")
def overwritten(spark, d):
    """A target that is written twice has what was written last."""
    folder = places.shared_folder(spark)
    sinks.overwrite(read(spark, d, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")), folder)
    sinks.overwrite(read(spark, d, "nation").select("n_nationkey", "n_name"), folder)
    return spark.read.parquet(folder)


@query("SELECT 'Hello ' || r_name AS line FROM region UNION ALL SELECT 'Good Bye ' || n_name FROM nation")
def appended_lines(spark, d):
    folder = places.shared_folder(spark)
    sinks.append_lines(F.concat(F.lit("Hello "), F.col("r_name")), read(spark, d, "region"), folder)
    sinks.append_lines(F.concat(F.lit("Good Bye "), F.col("n_name")), read(spark, d, "nation"), folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query("SELECT n_name AS name, 'plain' AS kind FROM nation UNION ALL SELECT lower(n_name), 'small' FROM nation")
def teed(spark, d):
    folder = places.shared_folder(spark)
    sinks.tee(read(spark, d, "nation").select(F.col("n_name").alias("name")), f"{folder}/plain", f"{folder}/small", lambda rows: rows.select(F.lower("name").alias("name")))
    return spark.read.parquet(f"{folder}/plain").withColumn("kind", F.lit("plain")).unionByName(spark.read.parquet(f"{folder}/small").withColumn("kind", F.lit("small")))
