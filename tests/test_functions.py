from __future__ import annotations

import datetime as dt
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillon.functions import color, dates, text
from quillon.operators import lookup, ordered, predicates, templates, validate
from quillon.plans import flows
from quillon.sources import html as html_source
from quillon.sources import http, places, readers, sinks
from quillon.streaming import builds, requests, streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


def test_greeting_of_the_names(spark):
    wanted = ["Hello Yaakov", "Good Bye John", "Good Bye Jen", "Good Bye Jason", "Hello Paul", "Hello Frank", "Hello Larry", "Hello Paula", "Hello Laura", "Good Bye Jim"]
    rows = readers.names(spark).orderBy("pos").select(text.greeting(F.col("name")).alias("x")).collect()
    assert [r["x"] for r in rows] == wanted
    assert one(spark, text.greeting(lit(""))) == "Hello "


@pytest.mark.parametrize(
    ("x", "wanted"),
    [(None, ""), (0.0, ""), (float("nan"), ""), (12.5, "$12.50"), (1.005, "$1.00"), (0.125, "$0.13"), (2.675, "$2.67"), (-1.5, "$-1.50"), (0.005, "$0.01"), (1e9 + 0.25, "$1000000000.25"), (99.995, "$100.00")],
)
def test_price(spark, x, wanted):
    assert one(spark, text.price(lit(x).cast("double"))) == wanted


def test_fill_is_literal_and_in_order(spark):
    assert one(spark, text.fill("{{a}}-{{b}}", a=lit("$12 {{b}} $&"), b=lit("x"))) == "$12 x $&-x"
    assert one(spark, text.fill("{{a}}", a=lit(None))) == "null"


def test_small_text_functions(spark):
    assert one(spark, text.portion(lit("pint"))) == "(pint)"
    assert one(spark, text.portion(lit(None).cast("string"))) == ""
    assert one(spark, text.first_name(lit("Ann Lee Roe"))) == "Ann Lee"
    assert one(spark, text.first_name(lit("Ann "))) == "Ann"
    assert one(spark, text.camel_parts(lit("validationMaxMessage"))) == ["validation", "Max", "Message"]
    assert one(spark, text.escape_html(lit("<a href='x'>&\"</a>"))) == "&lt;a href=&#039;x&#039;&gt;&amp;&quot;&lt;/a&gt;"
    assert one(spark, text.with_suffix(lit("css/a.b.css"), ".min")) == "css/a.b.min.css"
    assert one(spark, text.with_class(lit("a b"), "active")) == "a b active"
    assert one(spark, text.with_class(lit("a inactive"), "active")) == "a inactive"
    assert one(spark, text.without_class(lit("a inactive b"), "active")) == "a in b"
    assert one(spark, text.title_words(lit("mAX chECKED"))) == "Max Checked"
    assert one(spark, text.quoted(lit("a"))) == "'a'"
    for given, wanted in (("12abc", 12.0), (" .5", 0.5), ("5.", 5.0), ("-1e3x", -1000.0), ("abc", None), ("", None)):
        assert one(spark, text.number_at_start(lit(given))) == wanted
    assert one(spark, text.number_and_unit(lit("-=4.5deg"))).asDict() == {"relative": "-=", "number": 4.5, "unit": "deg"}


def test_colors(spark):
    for given, wanted in (("#0f0", [0, 255, 0, 1]), ("#102030", [16, 32, 48, 1]), ("rgb( 1, 2 ,3)", [1, 2, 3, 1]), ("rgba(1,2,3,.5)", [1, 2, 3, 0.5]), ("navy", [0, 0, 128, 1]), ("nope", None)):
        assert one(spark, color.parse_color(lit(given))) == wanted
    mixed = color.mix_colors(color.parse_color(lit("black")), color.parse_color(lit("transparent")), lit(0.5))
    assert one(spark, color.color_text(mixed)) == "rgba(127,127,127,0.5)"
    shadows = one(spark, color.parse_shadows(lit("inset 1px -2px 3px #0f0, 4 5 rgba(1,2,3,.5)")))
    assert [(s["inset"], s["left"], s["top"], s["blur"], s["spread"], s["color"]) for s in shadows] == [
        (True, 1, -2, 3, 0, [0.0, 255.0, 0.0, 1.0]),
        (False, 4, 5, 0, 0, [1.0, 2.0, 3.0, 0.5]),
    ]


def test_hours(spark):
    assert one(spark, dates.hours_of(lit(dt.date(2024, 1, 7)))) == "Closed"
    assert one(spark, dates.day_index(lit(dt.date(2024, 1, 6)))) == 6


def test_patterns_hold_for_the_whole_text(spark):
    assert one(spark, predicates.matches(lit("a@b.com"), predicates.EMAIL))
    assert not one(spark, predicates.matches(lit("a@b.com\n"), predicates.EMAIL))
    assert not one(spark, predicates.matches(lit("a@b.museum"), predicates.EMAIL))
    assert one(spark, predicates.matches(lit("abc"), "a|c"))  # ^a or c at the end
    for given, wanted in (("", True), ("5.", True), (".5", False), ("+1e5", True)):
        assert one(spark, predicates.matches(lit(given), predicates.NUMBER)) == wanted


def test_bounds_never_fail_on_text(spark):
    above = predicates.Rule("Max", "max", 5)
    assert one(spark, predicates.in_error(above, lit("6cm")))
    assert not one(spark, predicates.in_error(above, lit("cm")))
    predicates.register_callback(spark, "my.shout", "value = upper(value)")
    predicates.register_callback(spark, "my.whisper", lambda v: v == v.str.lower())
    rows = spark.createDataFrame([("my.shout", "AB"), ("my.shout", "Ab"), ("my.whisper", "ab"), ("my.whisper", "AB")], "name string, v string")
    assert [r[0] for r in rows.select(predicates.in_error(predicates.Rule("Shout", "callback", "my.shout"), F.col("v"))).collect()] == [True, False, False, True]
    found = rows.select(predicates.called(["my.shout", "my.whisper"], F.col("name"), F.col("v")).alias("wrong")).collect()
    assert [r["wrong"] for r in found] == [True, False, True, False]
    with pytest.raises(Exception, match="no callback named nope"):
        rows.select(predicates.called(["my.shout"], lit("nope"), F.col("v"))).collect()


def test_errors_of_fields(spark):
    rows = [("f", 0, "password", "x1"), ("f", 1, "again", "x2"), ("g", 0, "password", "y"), ("g", 1, "again", "y"), ("g", 2, "again", "")]
    fields = spark.createDataFrame(rows, "form string, pos int, name string, value string")
    rules = {"again": [predicates.BUILT_IN["passwordagain"], predicates.BUILT_IN["required"]]}
    checked = validate.check_fields(fields, rules, submitting=True)
    got = {(r["form"], r["pos"]): r["errors"] for r in checked.collect()}
    assert got == {("f", 0): [], ("f", 1): ["Does not match the given password"], ("g", 0): [], ("g", 1): [], ("g", 2): ["Does not match the given password", "This is required"]}
    assert {r["form"]: r["has_errors"] for r in validate.has_errors(checked).collect()} == {"f": True, "g": True}
    assert [tuple(r["errors"]) for r in validate.collect_errors(checked).collect()] == [("Does not match the given password", "This is required")]
    quiet = validate.check_fields(fields, rules)
    assert not quiet.where("pos = 2").first()["errors"]


def test_shortcuts_with_a_cycle_end(spark):
    registry = predicates.override(predicates.BUILT_IN, a={"type": "shortcut", "value": "b, email"}, b={"type": "shortcut", "value": "A"})
    rules = spark.createDataFrame([(k, r.type, None if r.value is None else str(r.value)) for k, r in registry.items()], "name string, type string, value string")
    start = spark.createDataFrame([("a",), ("Positive",), ("unknown",), (None,), ("a",)], "name string")
    found = {(r["start"], r["name"]) for r in validate.closure(start, rules).collect()}
    assert found == {("a", n) for n in ("a", "b", "email", "validemail")} | {("Positive", n) for n in ("positive", "number", "positivenumber")} | {("unknown", "unknown")}
    assert {n for s, n in found if s == "a"} == set(validate.reached("a", registry))
    assert validate.closure(start.limit(0), rules).count() == 0 and validate.closure(start, rules.limit(0)).count() == 3


def test_as_of_before_between_and_after(spark):
    offsets = spark.createDataFrame([(10.0, "a"), (20.0, "b"), (20.5, "c")], "offset double, target string")
    rows = spark.createDataFrame([(x,) for x in (-5.0, 9.99, 10.0, 19.0, 20.0, 20.4, 20.5, 1e6)], "y double")
    got = {r["y"]: r["target"] for r in ordered.as_of(rows, "y", offsets).collect()}
    assert got == {-5.0: None, 9.99: None, 10.0: "a", 19.0: "a", 20.0: "b", 20.4: "b", 20.5: "c", 1e6: "c"}


def test_positions(spark):
    items = F.array(lit("a"), lit("b"))
    assert [one(spark, lookup.at_position(items, lit(k))) for k in (0, 1, 2, -1, -3)] == ["a", "b", None, None, None]
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3)], "k string, v int")
    for step, wanted in ((-1, {1: 3, 2: 1, 3: 2}), (1, {1: 2, 2: 3, 3: 1}), (5, {1: 3, 2: 1, 3: 2})):
        assert {r["v"]: r["neighbour"] for r in lookup.neighbour(rows, ["k"], "v", "v", step).collect()} == wanted
    assert {r["v"]: r["neighbour"] for r in lookup.neighbour(rows, ["k"], "v", "v", -1, wrap=False).collect()} == {1: None, 2: 1, 3: 2}


def test_sections_and_links(spark):
    html = '<a class="i" href="#A">A</a><section class="p" id="A"><h2><!-- x --><span> Ti </span></h2><img src="i.jpg"><p>One\n two</p></section>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    r = html_source.sections(pages).first()
    assert (r["id"], r["title"], r["image"], r["description"]) == ("A", "Ti", "i.jpg", "One two")
    assert html_source.links(pages).first()["href"] == "#A"


def test_posts_and_mail(spark):
    sent = spark.createDataFrame([("name=Ann+Lee&email=a%40b.com&message=%3Cb%3E",)], "body string")
    record = readers.posts(sent, "name", "email", "phone", "message").na.fill("")
    assert record.first().asDict() == {"name": "Ann Lee", "email": "a@b.com", "phone": "", "message": "<b>"}
    mail = sinks.mail(record, "x@y.com").first()
    assert mail["subject"].endswith("Ann Lee") and "&lt;b&gt;" in mail["body"]


def test_files_and_two_outputs(spark, tmp_path):
    for name in ("a.js", "core.js", "deep/b.js"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(f"// {name}\n")
    found = readers.files(spark, str(tmp_path / "in"), "*.js", ("core.js",))
    assert sorted(r["name"] for r in found.collect()) == ["a.js", "b.js"]
    sinks.tee(found.select("name"), str(tmp_path / "one"), str(tmp_path / "two"), lambda df: df.select(text.with_suffix(F.col("name"), ".min").alias("name")))
    assert sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "two")).collect()) == ["a.min.js", "b.min.js"]
    assert {r["name"]: r["body"] for r in readers.templates(spark, str(tmp_path / "in")).collect()}["a"] == "// a.js\n"


def test_bad_answers_and_bad_json(spark):
    answers = spark.createDataFrame([("u", 404, "x"), ("v", 200, '{"k": 1}')], "url string, status int, body string")
    assert [r["data"]["k"] for r in readers.decoded(answers, "k int").collect()] == [1]
    bad = spark.createDataFrame([("v", 200, "{")], "url string, status int, body string")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        readers.decoded(bad, "k int").collect()


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "k int, v string")
    rows.write.parquet(str(tmp_path / "in"))
    out = streams.drained(streams.arriving(spark, str(tmp_path / "in"), rows), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.collect()))


def test_the_end_of_a_page_has_the_last_part(spark):
    offsets = spark.createDataFrame([(10.0, "a"), (20.0, "b"), (90.0, "c")], "offset double, target string")
    rows = spark.createDataFrame([(x,) for x in (5.0, 10.0, 49.0, 50.0, 95.0)], "y double")
    got = {r["y"]: r["target"] for r in ordered.as_of(rows, "y", offsets, bottom=50.0).collect()}
    assert got == {5.0: None, 10.0: "a", 49.0: "b", 50.0: "c", 95.0: "c"}


def test_requests_that_come_back_are_asked_again(spark, tmp_path):
    rows = [("u", v, k) for k, v in enumerate(["a", "a", "b", "a", None, None, "a"])] + [("w", "a", 3), ("w", "a", 9)]
    batch = spark.createDataFrame(rows, "k string, v string, at int").withColumn("ts", F.timestamp_seconds("at"))
    wanted = [("u", 0), ("u", 2), ("u", 3), ("u", 4), ("u", 6), ("w", 3)]
    assert sorted((r["k"], r["at"]) for r in streams.changed_only(batch, "k", "v", "at").collect()) == wanted
    for part in (batch.where("at < 4"), batch.where("at >= 4")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changed = streams.changed_in_stream(streams.arriving(spark, str(tmp_path / "in"), batch), "k", "v", "ts")
        found = streams.drained(changed, str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted((r["k"], int(r["ts"].timestamp())) for r in found.collect()) == wanted


def test_windows_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 61), ("a", 400)], "k string, at int").withColumn("ts", F.timestamp_seconds("at"))
    rows.write.parquet(str(tmp_path / "in"))
    counts = streams.windowed_counts(streams.arriving(spark, str(tmp_path / "in"), rows), "ts", "1 minute", "1 minute", "k")
    got = streams.drained(counts, str(tmp_path / "out"), str(tmp_path / "check")).collect()
    assert sorted((r["k"], r["n"]) for r in got)[:2] == [("a", 2), ("b", 1)]


def test_affix_goes_from_state_to_state(spark):
    rows = spark.createDataFrame([("s", k, float(v), float(v + 20)) for k, v in enumerate([0, 150, 500, 480, 430, 100])], "key string, at int, scroll double, position double")
    bottom = predicates.affix_states(rows, "key", "at", 30, 40, 100, 600, 120, 150).orderBy("at")
    assert [r["state"] for r in bottom.collect()] == ["top", "", "bottom", "bottom", "bottom", "bottom"]
    free = predicates.affix_states(rows, "key", "at", 10, 40, 100, 600, None, 150).orderBy("at")
    assert [r["state"] for r in free.collect()] == ["", "", "bottom", "bottom", "bottom", ""]


@pytest.fixture
def server():
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            code = 404 if "missing" in self.path else 200
            self.send_response(code)
            self.end_headers()
            if self.path == "/last":
                self.wfile.write(str(got[0]).encode())
                return
            self.wfile.write(b'{"category": {"name": "Soup", "short_name": "S"}, "menu_items": [{"short_name": "S1", "price_small": 2.5}]}')

        def do_POST(self):
            got.append(self.rfile.read(int(self.headers["Content-Length"])).decode())
            self.send_response(500 if "fail" in got[-1] else 200)
            self.end_headers()

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", got
    http.shutdown()


def test_answers_over_http(spark, server):
    base, _ = server
    urls = spark.createDataFrame([(f"{base}/menu",), (f"{base}/missing",), ("http://127.0.0.1:9/none",)], "url string")
    answers = readers.fetch(urls)
    assert {r["url"].rsplit("/", 1)[1]: r["status"] for r in answers.collect()} == {"menu": 200, "missing": 404, "none": 0}
    r = readers.menu_items(answers).first()
    assert (r["category"], r["pos"], r["short_name"], r["price_small"]) == ("S", 0, "S1", 2.5)
    assert readers.decoded(answers, "", is_json=False).count() == 1


def test_records_are_posted(spark, server, tmp_path):
    base, got = server
    rows = spark.createDataFrame([("Ann Lee", None), ("Bo", "5&5")], "name string, phone string")
    rows.foreachPartition(sinks.post_each(base))
    assert sorted(got) == ["name=Ann+Lee&phone=", "name=Bo&phone=5%265"]
    with pytest.raises(Exception, match="500"):
        spark.createDataFrame([("fail",)], "name string").foreachPartition(sinks.post_each(base))
    rows.write.parquet(str(tmp_path / "in"))
    got.clear()
    stream = streams.arriving(spark, str(tmp_path / "in"), rows)
    stream.writeStream.foreachBatch(sinks.post_batches(base)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert len(got) == 2


def test_settings_and_lines(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"a": {"b": 1},\n "c": [1, 2]}')
    r = readers.settings(spark, str(tmp_path / "s.json")).first()
    assert r["a"]["b"] == 1 and r["c"] == [1, 2]
    rows = spark.createDataFrame([("x",), ("y",)], "v string")
    for _ in range(2):
        sinks.append_lines(F.col("v"), rows, str(tmp_path / "lines"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["x", "x", "y", "y"]


def test_shadows_end_at_what_they_cannot_read(spark):
    for given, wanted in (
        ("1px 2px bad, 3 4", [(False, 1, 2, 0, 0, None)]), ("", [(False, 0, 0, 0, 0, None)]), (" 1 2", [(False, 0, 0, 0, 0, None)]),
        ("1.5px -.5 1.2.3px rgb(1.5,2,300)", [(False, 1, None, 1, 0, [1.0, 2.0, 300.0, 1.0])]), (",1 2", [(False, 0, 0, 0, 0, None), (False, 1, 2, 0, 0, None)]),
        ("1 2 rgba(1,2,3,1.2.3) #000 inset 7 8", [(True, 7, 8, 0, 0, [0.0, 0.0, 0.0, 1.0])]), ("rgba(a,b) 1 2", [(False, 0, 0, 0, 0, None)]),
    ):
        assert [tuple(s) for s in one(spark, color.parse_shadows(lit(given)))] == wanted
    assert one(spark, color.parse_shadows(lit(None).cast("string"))) is None


# --- HTML


def test_tokens_of_odd_pages():
    page = """<!doctype html><P class='a > b' ID=x data-e="1>2" hidden/>T<br>u<!-- <p>no</p> --><script>if (a<b) "</p>"</script>v</b></p>< 3 <4 <a href=one>l<i>m</a><p unclosed="q r>"""
    got = list(html_source.tokens(page))
    assert got[0] == ("start", "p", {"class": "a > b", "id": "x", "data-e": "1>2", "hidden": ""})
    assert [t[:2] for t in got if t[0] == "text"] == [("text", x) for x in ("T", "u", "v", "<", " 3 ", "<", "4 ", "l", "m")]
    assert [t[1] for t in got if t[0] == "end"] == ["script", "b", "p", "a"] and got[-1] == ("start", "p", {"unclosed": '"q', "r": ""})
    assert list(html_source.tokens("")) == [] and list(html_source.tokens("<")) == [("text", "<", {})] and list(html_source.tokens("a<!-- b")) == [("text", "a", {})]


def test_nested_and_unclosed_sections(spark):
    page = (
        "<section id='a'><h2>One <b>two</h2><section><p>inner p</p></section><section id=\"b\"><h2>B</h2><img src='b>.png'><p>text</section>"
        "<img alt='x' src=a.png><p>not the first</p></section><section id=c><p>open<section id=d><h2>D<p>d</section></section></section><section id='e'>"
    )
    wanted = [("a", "One two", "a.png", "inner p"), ("b", "B", "b>.png", "text"), ("c", "", "", "open"), ("d", "D", "", "d"), ("e", "", "", "")]
    assert html_source.sections_of(page) == wanted
    pages = spark.createDataFrame([(1, page, 5), (2, None, 5), (3, "", 5), (None, page, 5), (4, "no tags < at all", 5)], "page_id long, html string, pos int")
    got = [(r["page_id"], r["pos"], r["id"]) for r in html_source.sections(pages).collect()]
    assert sorted(got, key=repr) == sorted([(p, k, w[0]) for p in (1, None) for k, w in enumerate(wanted)], key=repr)
    assert html_source.links_of("<a href='x>y'>A<a href=\"z\">B<img></a>C<a>D") == [("x>y", "A"), ("z", "B"), ("", "D")]


def test_pages_are_read_in_linear_time():
    import time

    for page in ("<b>" * 100_000 + "</i>" * 100_000, "<a x='" * 60_000, '<p "=' * 60_000, "<!--" * 100_000, "<section id=a>" * 30_000 + "</p>" * 30_000, "<p " + "x " * 200_000, "<script>" * 40_000):
        began = time.time()
        html_source.sections_of(page)
        assert time.time() - began < 5


# --- HTTP


def test_pages_are_a_data_source(spark, server, tmp_path):
    base, _ = server
    spark.dataSource.register(http.HttpPages)
    pages = spark.read.format("quillon_pages").option("url", f"{base}/page/{{page}}").option("last", 25).option("per_partition", 10).load()
    assert pages.rdd.getNumPartitions() == 3
    found = pages.where("status = 200").select("page", F.get_json_object("body", "$.category.short_name").alias("s")).collect()
    assert sorted(r["page"] for r in found) == list(range(1, 26)) and {r["s"] for r in found} == {"S"}
    assert spark.read.format("quillon_pages").option("url", base).load().count() == 0
    missing = spark.read.format("quillon_pages").option("url", f"{base}/missing/{{page}}").option("last", 2).load()
    assert {(r["page"], r["status"], r["body"]) for r in missing.collect()} == {(1, 404, ""), (2, 404, "")}


def test_pages_are_a_stream(spark, server, tmp_path):
    base, got = server
    spark.dataSource.register(http.HttpPages)
    for last in (3, 3, 7):
        got[:] = [last]
        stream = spark.readStream.format("quillon_pages").option("url", f"{base}/page/{{page}}").option("latest", f"{base}/last").option("per_partition", 2).load()
        out = streams.drained(stream, str(tmp_path / "out"), str(tmp_path / "check"))
        assert sorted(r["page"] for r in out.collect()) == list(range(1, last + 1))


def test_outcomes_of_posts_and_batches_that_are_run_again(spark, server, tmp_path):
    base, got = server
    done = []
    sink = http.PostedBatches(base, "id", str(tmp_path / "outcomes"), lambda batch, outcomes: done.append((batch, outcomes.where("outcome = 'success'").select("key").distinct().count())))
    rows = spark.createDataFrame([(1, "a"), (2, "fail"), (3, None), (4, "fail too")], "id long, text string")
    sink(rows, 0)
    assert sorted(got) == ["id=1&text=a", "id=2&text=fail", "id=3&text=", "id=4&text=fail+too"] and done == [(0, 2)]
    got.clear()
    sink(rows.withColumn("text", F.replace("text", lit("fail too"), lit("good"))), 0)
    assert sorted(got) == ["id=2&text=fail", "id=4&text=good"] and done[-1] == (0, 3)
    got.clear()
    sink(rows.where("id = 1"), 1)
    assert got == ["id=1&text=a"]
    kept = {(r["batch"], r["attempt"], r["key"], r["outcome"], r["status"]) for r in sink.outcomes(spark).collect()}
    assert kept == {(0, 0, "1", "success", 200), (0, 0, "2", "error", 500), (0, 0, "3", "success", 200), (0, 0, "4", "error", 500), (0, 1, "2", "error", 500), (0, 1, "4", "success", 200), (1, 0, "1", "success", 200)}
    nowhere = http.posted(rows.limit(1), "http://127.0.0.1:9/", "id").first()
    assert nowhere["outcome"] == "error" and nowhere["status"] == 0 and nowhere["message"]


def test_posts_of_a_stream_are_recorded(spark, server, tmp_path):
    base, got = server
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    for k in range(2):
        rows.where(f"id = {k + 1}").write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.arriving(spark, str(tmp_path / "in"), rows)
        sink = http.PostedBatches(base, "id", str(tmp_path / "outcomes"))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == ["id=1&text=a", "id=2&text=b"]
    assert {(r["batch"], r["key"]) for r in sink.outcomes(spark).collect()} == {(0, "1"), (1, "2")}


# --- streams with state


def test_requests_that_never_end_and_late_answers(spark, tmp_path):
    rows = [
        ("u", 1, 100, False, "a", None), ("u", 2, 101, False, "b", None), ("u", 3, 102, True, "b", True), ("u", 4, 103, True, "a", False), ("u", 5, 104, True, "b", True),
        ("u", 6, 105, False, "b", None), ("u", 7, 106, False, None, None), ("u", 8, 107, True, None, True), ("w", 9, 110, False, "x", None), ("w", 10, 115, False, "y", None),
        ("z", 11, 107, True, "q", True), (None, 12, 109, False, "n", None), ("end", 13, 1000, True, "", None), ("end", 14, 5000, True, "", None),
    ]
    table = spark.createDataFrame(rows, "k string, nth long, s int, answer boolean, value string, valid boolean").withColumn("at", F.timestamp_seconds("s")).drop("s")
    for part in ("nth < 4", "nth BETWEEN 4 AND 12", "nth = 13", "nth = 14"):
        table.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        states = requests.requests(streams.arriving(spark, str(tmp_path / "in"), table), "k", dt.timedelta(seconds=50), "10 seconds")
        found = streams.drained(states, str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted(((r["key"], r["nth"], int(r["at"].timestamp()) if r["nth"] is None else None, r["outcome"], r["value"], r["in_error"]) for r in found.collect()), key=repr)
    wanted = [
        ("u", 1, None, "sent", "a", False), ("u", 2, None, "waiting", "b", False), ("u", 3, None, "late", "b", False), ("u", 4, None, "answered", "a", True), ("u", 4, None, "sent", "b", False),
        ("u", 5, None, "answered", "b", False), ("u", 6, None, "known", "b", False), ("u", 7, None, "sent", None, False), ("u", 8, None, "answered", None, False),
        ("w", 9, None, "sent", "x", False), ("w", 10, None, "waiting", "y", False), ("w", None, 160, "expired", "x", False), ("w", None, 160, "sent", "y", False), ("w", None, 210, "expired", "y", False),
        ("z", 11, None, "late", "q", False), (None, 12, None, "sent", "n", False), (None, None, 159, "expired", "n", False), ("end", 13, None, "late", "", False), ("end", 14, None, "late", "", False),
    ]
    assert got == sorted(wanted, key=repr)


def test_answers_wait_for_the_watermark(spark, tmp_path):
    schema = "k string, nth long, s int, value string"
    asked = spark.createDataFrame([("u", 1, 100, "a"), ("u", 2, 105, "b"), ("w", 3, 101, None), ("end", 4, 9000, "")], schema)
    given = spark.createDataFrame([("u", 11, 101, "a"), ("u", 12, 106, "b"), ("u", 13, 104, "b"), ("w", 14, 102, None), ("none", 15, 103, "c")], schema)
    for name, rows in (("asked", asked), ("given", given)):
        rows.withColumn("at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(str(tmp_path / name))
    like = spark.read.parquet(str(tmp_path / "asked"))
    two = [streams.arriving(spark, str(tmp_path / name), like) for name in ("given", "asked")]
    found = streams.drained(requests.in_time_stream(*two, "k", "1 hour"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert {(r["key"], r["nth"], r["value"]) for r in found.collect()} == {("u", 12, "b"), ("u", 13, "b"), ("w", 14, None)}


def test_only_what_changed_is_rebuilt(spark, tmp_path):
    folder = str(tmp_path / "site")
    at = lambda k: F.get(F.split("path", "/"), lit(k))
    rules = [builds.Build("css", F.when(F.endswith("path", lit(".css")), at(0)), builds.bundled("|")), builds.Build("all", lit("all"), builds.bundled(","))]
    sources = lambda rows: spark.createDataFrame(rows, "path string, content string")
    built = lambda name: {(r["target"], r["content"], r["batch"]) for r in builds.built(spark, folder, name).collect()}
    builds.rebuild(sources([("a/1.css", "x"), ("a/2.css", "y"), ("b/1.css", "z"), ("b/c.js", "j")]), 0, folder, rules)
    assert built("css") == {("a", "x|y", 0), ("b", "z", 0)} and built("all") == {("all", "x,y,z,j", 0)}
    builds.rebuild(sources([("a/1.css", "new"), ("c/1.css", "c")]), 1, folder, rules)
    assert built("css") == {("a", "new|y", 1), ("b", "z", 0), ("c", "c", 1)} and built("all") == {("all", "new,y,z,j,c", 1)}
    builds.rebuild(sources([("a/1.css", "other")]), 1, folder, rules)  # a batch that is done
    builds.rebuild(sources([("b/c.js", None), ("c/1.css", None)]), 2, folder, rules)
    assert built("css") == {("a", "new|y", 1), ("b", "z", 0)} and built("all") == {("all", "new,y,z", 2)}


def test_groups_that_an_event_touches_are_looked_at_again(spark):
    rows = [("f", 0, "age", "x", "g"), ("f", 1, "age", "3", "g"), ("f", 2, "age", "y", "h"), ("e", 0, "age", "4", "g"), ("e", 1, "name", "", "g")]
    fields = spark.createDataFrame(rows, "form string, pos int, name string, value string, grp string")
    rules = {"age": [predicates.BUILT_IN["number"], predicates.Rule("Min", "min", 5, "Too small")]}
    found = validate.revalidated(fields.where("(form = 'f' AND pos = 1) OR form = 'e'"), fields, rules, "grp")
    assert {tuple(r) for r in found.collect()} == {("f", "g", "Must be a number</li><li>Too small", 2), ("e", "g", "Too small", 2)}
    assert validate.revalidated(fields.limit(0), fields, rules, "grp").count() == 0


def test_folds_of_long_groups(spark):
    rows = spark.range(700).select(F.lit("g").alias("k"), F.pmod(F.col("id") * 271, lit(701)).cast("int").alias("pos"), F.col("id").cast("string").alias("name"))
    order = [str(i) for _, i in sorted((i * 271 % 701, i) for i in range(700))]
    wanted = "<" + "".join(n + ("|" if k % 2 else "") for k, n in enumerate(order)) + ">"
    for order_by in ("pos", "text"):
        found = templates.fold(rows.withColumn("text", F.format_string("%04d", "pos")), ["k"], order_by, F.col("name"), "<", ">", "|")
        assert found.first()["html"] == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("listagg") >= 2
    assert templates.fold(rows.limit(0), ["k"], "pos", F.col("name")).count() == 0


def test_files_are_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{k % 3}/f{k}.txt", f"text ü {k}\n") for k in range(20)], "name string, text string")
    folder = places.put_texts(rows.repartition(4), f"file://{tmp_path}/tree")
    assert {(r["name"], r["body"]) for r in readers.templates(spark, folder).collect()} == {(f"f{k}", f"text ü {k}\n") for k in range(20)}


def test_folds(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "pos int, name string")
    html = templates.fold(rows.withColumn("g", lit(1)), ["g"], "pos", F.col("name"), "<", ">", "|").first()["html"]
    assert html == "<ab|c>"
    page = flows.categories_page(rows.withColumn("short_name", F.upper("name"))).first()["html"]
    assert page.startswith("<section>") and page.count("tile") == 3


# --- ordered work


@pytest.mark.parametrize("sent", [0, 1000])
def test_as_of_sparse_and_hot_values(spark, sent):
    """Offsets far apart, a third of the rows at one value, nulls and values that are no numbers, many ranges."""
    values = [-9000.5, -3.0, 0.0, 0.5, 1e6, 3e9, 1e18]
    offsets = spark.createDataFrame([(v, f"t{v}") for v in values] + [(None, "none")], "offset double, target string")
    asked = [y for v in values for y in (v - 0.25, v, v + 0.25)] + [0.5] * 200 + [None, float("nan"), float("inf"), -1e300]
    rows = spark.createDataFrame([(k, y, "x") for k, y in enumerate(asked)], "offset long, found double, part string")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r["offset"]: (r["target"], r["part"]) for r in ordered.as_of(rows.repartition(5), "found", offsets, sent=sent).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    def wanted(y):
        if y is None:
            return None
        least = values if y != y else [v for v in values if v <= y]
        return f"t{max(least)}" if least else None
    assert got == {k: (wanted(y), "x") for k, y in enumerate(asked)}


@pytest.mark.parametrize("sent", [0, 1000])
def test_as_of_of_other_kinds_and_empty_tables(spark, sent):
    days = [dt.date(2024, 1, d) for d in (3, 9)]
    offsets = spark.createDataFrame([(d, d.day, "a") for d in days], "offset date, target int, other string")
    rows = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 3, 8, 30)], "day date")
    got = {r["day"].day: (r["target"], r["other"]) for r in ordered.as_of(rows, "day", offsets, ("target", "other"), bottom=dt.date(2024, 1, 20), sent=sent).collect()}
    assert got == {1: (None, None), 3: (3, "a"), 8: (3, "a"), 30: (9, "a")}
    assert [r["target"] for r in ordered.as_of(rows, "day", offsets.limit(0), sent=sent, bottom=dt.date(2024, 1, 20)).collect()] == [None] * 4
    assert ordered.as_of(rows.limit(0), "day", offsets, sent=sent).count() == 0
    longs = spark.createDataFrame([(2**60,), (2**60 + 1,)], "y long")
    exact = spark.createDataFrame([(2**60 + 1, "b")], "offset long, target string")
    assert {r["y"]: r["target"] for r in ordered.as_of(longs, "y", exact, sent=sent).collect()} == {2**60: None, 2**60 + 1: "b"}


def test_states_of_a_hot_group_are_folded_by_ranges(spark):
    """One group has most rows and lies in many ranges; others are short; the plan gathers no group."""
    rows = [("hot", k, (k * 37) % 11) for k in range(3000)] + [(f"k{k % 40}", k, (k * 13) % 11) for k in range(400)] + [(None, k, k % 11) for k in range(50)]
    names = (None, "a", "b", "c")

    def after(state, x):
        if x < 3:
            return state or "a"
        return {None: "b", "a": "b", "b": "c", "c": "a"}[state] if x < 8 else "c" if state == "a" else "a"

    def step(state):
        turned = F.when(state.isNull() | (state == "a"), "b").when(state == "b", "c").otherwise("a")
        return F.when(F.col("x") < 3, F.coalesce(state, lit("a"))).when(F.col("x") < 8, turned).otherwise(F.when(state == "a", "c").otherwise("a"))

    table = spark.createDataFrame(rows, "part string, nth int, x int")
    wanted, last = {}, {}
    for key, k, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        wanted[key, k] = last[key] = after(last.get(key), x)
    for n in (1, 17):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
        try:
            found = ordered.states_in_order(table.repartition(3), "part", "nth", step, names)
            got = {(r["part"], r["nth"]): r["state"] for r in found.collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == wanted
    assert ordered.states_in_order(table.limit(0), "part", "nth", step, names).count() == 0


def test_tables_compose_in_order():
    import numpy as np

    rng = np.random.default_rng(4)
    tables, begins = rng.integers(0, 4, (300, 4)).astype(np.int8), rng.random(300) < 0.02
    begins[0] = True
    out, held = [], None
    for t, first in zip(tables, begins, strict=True):
        held = t if first else t[held]
        out.append(held)
    assert (ordered.composed(tables, begins) == np.array(out)).all()


def test_colors_are_whole_texts(spark):
    for given, wanted in ((" #0f0 ", [0, 255, 0, 1]), ("#0f0f", None), ("#12345g", None), ("rgb(1,2)", None), ("rgba(1,2,3)", None), ("rgb(1,2,3", None), ("hsl(1,2,3)", None), ("rgb(1,x,3)", None), ("", None), (None, None)):
        assert one(spark, color.parse_color(lit(given).cast("string"))) == wanted
    for given, wanted in (("1px 2px 3px 4px 5px 6px", [(False, 5, 6, 0, 0, None)]), ("1 inset", [(False, 0, 0, 0, 0, None)]), ("1 2 rgb(1,2", [(False, 1, 2, 0, 0, None)]), ("#fff,#000 1 2,", [(False, 0, 0, 0, 0, [255.0, 255.0, 255.0, 1.0]), (False, 1, 2, 0, 0, [0.0, 0.0, 0.0, 1.0]), (False, 0, 0, 0, 0, None)])):
        assert [tuple(s) for s in one(spark, color.parse_shadows(lit(given)))] == wanted


def test_a_key_with_many_answers_has_one_timer(spark, tmp_path):
    """Each answer had a timer, and each timer read all that waited for its key."""
    handle, held, calls = SimpleNamespace(timers=set(), lists=[]), [], []
    handle.registerTimer, handle.deleteTimer = lambda at: (calls.append(at), handle.timers.add(at)), lambda at: handle.timers.discard(at)
    value = SimpleNamespace(exists=lambda: bool(held), get=lambda: held[-1], update=held.append)
    waiting = SimpleNamespace(get=lambda: iter(handle.lists), appendList=lambda new: handle.lists.extend(new), put=lambda new: handle.lists.__setitem__(slice(None), new), clear=handle.lists.clear)
    handle.getValueState, handle.getListState = lambda *_: value, lambda *_: waiting
    state, at = requests.InTime(), lambda n: 1_000_000 * (n + 1)
    state.init(handle)
    now = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    lists = lambda ns, answer: Row(micros=[at(n) for n in ns], nth=list(ns), answer=[answer] * len(ns), value=["a" if n % 2 else "b" for n in ns], valid=[True] * len(ns))
    list(state.handleInputRows((7,), iter([lists(range(5000, 9000), True), lists(range(5000), True), lists([5001], False)]), now(0)))
    assert handle.timers == {1001} and len(handle.lists) == 3  # 9,000 answers, the first at 1 s
    list(state.handleInputRows((7,), iter([lists(range(2), True)]), now(1500)))  # one that the watermark has passed, one with the time of another
    assert handle.timers == {1001}
    fired = SimpleNamespace(getExpiryTimeInMs=lambda: 1001)
    found = [n for r in state.handleExpiredTimer((7,), now(6_000_500), fired) for n in r.nth]
    assert sorted(found) == sorted([1, *range(1, 6000, 2)]) and len(calls) == 2 and 6_001_001 in handle.timers
    assert sum(len(x[0]) for x in handle.lists) == 3000


def test_states_of_rows_in_lists(spark, tmp_path, monkeypatch):
    """Null and text keys, null numbers and values, and more rows of a key than a list or a packing holds, in two triggers."""
    rows = [(f"k{n % 3}" if n % 4 else None, n if n % 7 else None, n, n % 3 == 0, [None, "a", "b"][n // 3 % 3], n % 5 != 0) for n in range(9000)]
    table = spark.createDataFrame(rows, "k string, nth long, s long, answer boolean, value string, valid boolean").withColumn("at", F.timestamp_seconds("s"))
    monkeypatch.setattr(requests, "LIST", 100)
    monkeypatch.setattr(requests, "PACK_ROWS", 700)
    for part in (F.col("s") < 5000, F.col("s") >= 5000):
        table.where(part).write.mode("append").parquet(str(tmp_path / "in"))
        states = requests.requests(streams.arriving(spark, str(tmp_path / "in"), table), "k", dt.timedelta(seconds=3))
        found = streams.drained(states, str(tmp_path / "out"), str(tmp_path / "check"))
    expected, held = [], {}
    for k, nth, s, answer, of, fits in rows:
        value, valid, finished, sent, wanted, known = held.get(k, (None, True, True, 0, None, False))
        if not finished and s - sent > 3:
            valid, finished = True, True
        if answer and (finished or value != of):
            expected.append((k, nth, s, "late", of, False))
        elif answer:
            valid, finished = fits, True
            expected.append((k, nth, s, "answered", value, not valid))
            if wanted != value:
                value, valid, finished, sent = wanted, True, False, s
                expected.append((k, nth, s, "sent", value, False))
        elif not finished:
            wanted, known = of, True
            expected.append((k, nth, s, "waiting", of, False))
        elif known and value == of:
            wanted = value
            expected.append((k, nth, s, "known", value, not valid))
        else:
            value, valid, finished, sent, wanted, known = of, True, False, s, of, True
            expected.append((k, nth, s, "sent", value, False))
        held[k] = (value, valid, finished, sent, wanted, known)
    got = found.select("key", "nth", F.unix_seconds("at"), "outcome", "value", "in_error").collect()
    assert Counter(map(tuple, got)) == Counter(expected)


def test_closure_holds_lists_in_blocks(spark, monkeypatch):
    """What a start has reached are lists of bounded blocks, not a row for each name, which all travelled again in each round."""
    registry = {f"n{k}": {f"n{k * 7 % 90}", f"n{k // 2}", *(f"n{j}" for j in range(k, min(k + 12, 90)))} for k in range(90) if k % 5}
    rules = spark.createDataFrame([(k.upper(), "shortcut", " , ".join(v)) for k, v in registry.items()] + [(None, "shortcut", "n1")], "name string, type string, value string")
    start = spark.createDataFrame([("n3",), ("N3",), ("n88",), ("n5",), ("other",)], "name string")
    expected = set()
    for (name,) in start.collect():
        todo = [name.lower()]
        while todo:
            if (name, k := todo.pop()) not in expected:
                expected.add((name, k))
                todo += registry.get(k, ())
    tables, stored = [], validate.stored
    monkeypatch.setattr(validate, "stored", lambda rows: tables.append(stored(rows)) or tables[-1])
    for size in (1 << 20, 20):
        monkeypatch.setattr(validate, "BLOCK", size, raising=False)
        found = [tuple(r) for r in validate.closure(start, rules).collect()]
        assert set(found) == expected and len(found) == len(expected)
        if size > 20:
            assert sum(t.count() for t in tables if "start" in t.columns) < len(expected) // 2
        else:
            assert max(r["n"] for t in tables[-3:-1] for r in t.select(F.size("names").alias("n")).collect()) <= 40
