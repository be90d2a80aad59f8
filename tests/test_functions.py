"""Scalar functions against hand-computed cases."""

import datetime as dt

from pyspark.sql import functions as F

from shiftwise.functions import scalars as sc
from shiftwise.functions import text as tx
from shiftwise.operators import quality as qc


def one(spark, col, ddl="x string", value=("",)):
    return spark.createDataFrame([value], ddl).select(col.alias("r")).first().r


def test_parsers(spark):
    df = spark.createDataFrame([("June", "6/24/25, 1:47:45 PM", "17-JUN-13", "1h 59m 6s", " 3h ", "59m 6s")],
                               "m string, ts string, od string, d string, h string, d2 string")
    r = df.select(sc.month_number("m").alias("m"), sc.month_number(F.lit("6")).alias("m2"),
                  sc.parse_ts("ts").alias("ts"), sc.parse_oracle_date("od").alias("od"),
                  sc.duration_seconds("d").alias("d"), sc.duration_seconds("d2").alias("d2"),
                  sc.duration_seconds(F.lit("n/a")).alias("d3"),
                  sc.parse_hours("h").alias("h"), sc.parse_hours(F.lit("x")).alias("h2"),
                  sc.make_day(F.lit(2025), F.lit(2), F.lit(30)).alias("bad"),
                  sc.make_day(F.lit(2025), F.lit(6), F.lit(5)).alias("good")).first()
    assert (r.m, r.m2) == (6, 6)
    assert r.ts == dt.datetime(2025, 6, 24, 13, 47, 45)
    assert r.od == dt.date(2013, 6, 17)
    assert (r.d, r.d2, r.d3) == (7146, 3546, 0)
    assert (r.h, r.h2) == (3, None)
    assert r.bad is None and r.good == dt.date(2025, 6, 5)


def test_names_labels_and_lists(spark):
    df = spark.createDataFrame([("Ana", None, "PKG.MOD.SUB", " a, ,b ,c ")], "f string, l string, q string, t string")
    pkg, mod = sc.split_qualified_name(F.col("q"))
    r = df.select(sc.full_name("f", "l").alias("n"), pkg.alias("p"), mod.alias("m"),
                  sc.module_label(F.lit("PKG.MOD"), F.lit("PKG"), F.lit("procedure")).alias("lab"),
                  sc.module_label(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("X")).alias("anon"),
                  sc.split_list("t").alias("items"),
                  sc.render_document(F.lit("T"), F.array(F.lit("a"), F.lit("b")), F.lit("S")).alias("doc"),
                  sc.document_id(F.lit("T")).alias("id"),
                  sc.map_constant(F.lit("Brasov"), {"Brasov": "M1", "Suceava": "M2"}).alias("mgr"),
                  sc.estimate_tokens(F.lit("  one two\nthree  ")).alias("tok"),
                  sc.estimate_tokens(F.lit("")).alias("tok0")).first()
    assert r.n == "Ana" and (r.p, r.m) == ("PKG", "MOD.SUB")
    assert r.lab == "[Package] --> PKG    [PROCEDURE] --> MOD"
    assert r.anon == "No package; No procedure; No function. Check anonymous PL/SQL blocks."
    assert r.items == ["a", "b", "c"]
    assert r.doc == "Title: T\nThemes: a, b\nSummary: S" and r.id == "book_T" and r.mgr == "M1"
    assert (r.tok, r.tok0) == (3, 0)


def test_usage_cost(spark):
    prices = spark.createDataFrame([("gpt-4.1-nano", 0.0004, 0.0016)], "model string, price_in double, price_out double")
    df = spark.createDataFrame([("GPT-4.1-nano", 1000, 500), ("other", 10, 10)], "model string, i long, o long")
    got = {r.model: float(r.usd_cost) for r in sc.usage_cost(df, prices, "model", "i", "o").collect()}
    assert got == {"GPT-4.1-nano": 0.0012, "other": 0.0}


def test_text_rules(spark):
    rows = [("Scrie un script Python",), ("Care este PRIMA carte?",), ("Câte pagini are?",),
            ("vreau ceva frumos",), ("ce bou",), ("fuckery is fine",), ("a doua te rog",)]
    df = spark.createDataFrame(rows, "t string")
    got = [(r.i, r.o, r.a, r.b) for r in df.select(
        tx.classify_intent("t").alias("i"), tx.ordinal_ref("t").alias("o"),
        tx.is_offensive_regex("t").alias("a"), tx.is_offensive_tokens("t").alias("b")).collect()]
    assert got == [("out_of_scope", None, False, False), ("ordinal", 1, False, False),
                   ("book_followup", None, False, False), ("recommendation", None, False, False),
                   ("recommendation", None, False, True), ("recommendation", None, False, False),
                   ("ordinal", 2, False, False)]
    titles = spark.createDataFrame([('"Ion" (ed. 2) - roman de Liviu',), ("  Maitreyi: a novel ",)], "t string")
    assert [r.n for r in titles.select(tx.normalize_title("t").alias("n")).collect()] == ['ion" (ed. 2)', 'maitreyi']


def test_formats_and_lookup(spark):
    df = spark.createDataFrame([("a@b.ro", "ab"), ("bad@", "okname"), (None, "x" * 31)], "e string, u string")
    r = df.select(qc.invalid_email("e").alias("bad"), qc.length_outside("u", 3, 30).alias("len")).collect()
    assert [(x.bad, x.len) for x in r] == [(False, True), (True, False), (None, True)] or \
           [(bool(x.bad), x.len) for x in r] == [(False, True), (True, False), (False, True)]
    users = spark.createDataFrame([(1, "ana", "a@x.ro"), (2, "bo", "bo@x.ro")], "id int, username string, email string")
    ids = spark.createDataFrame([("ana",), ("bo@x.ro",), ("none",)], "ident string")
    got = sorted((r.identifier, r.id) for r in sc.lookup_many(users, ["username", "email"], ids, "ident", ["id"]).collect())
    assert got == [("ana", 1), ("bo@x.ro", 2)]
    seeded = sc.literal_rows(spark, [("REG", "Regular")], "code string, name string")
    assert seeded.collect()[0].name == "Regular"
