"""Expected results on the constant relations."""

import pytest
from pyspark.sql import functions as F

from lotlens.functions import scalars as S
from lotlens.operators import export as E
from lotlens.operators import keyed_state as K
from lotlens.operators import metrics as M
from lotlens.operators import mutations as U
from lotlens.operators import search as Q
from lotlens.sources import constants as C


def ids(df):
    return " ".join(r["id"] for r in df.select("id").collect())


def catalog(spark, sort, **f):
    return ids(C.catalog(spark).where(Q.CatalogFilter(**f).predicate()).orderBy(*Q.catalog_order(sort)))


DEFAULT = dict(region="м. Київ", year_from=2018, year_to=2024, price_from=400000, price_to=900000, fuels=("Бензин",), transmissions=("Автомат",), sources=("AUTO.RIA", "OLX", "Telegram"))


@pytest.mark.parametrize(("sort", "filters", "expected"), [
    ("price_asc", {}, "15 11 13 6 9 2 5 8 4 1 12 3 7 14 10"),
    ("price_desc", {}, "10 14 7 3 12 1 4 8 5 2 9 6 13 11 15"),
    ("year_desc", {}, "10 3 12 1 8 4 7 14 2 5 11 6 9 15 13"),
    ("mileage_asc", {}, "10 3 12 8 1 7 14 4 11 2 15 6 9 5 13"),
    ("price_asc", DEFAULT, "2 1"),
    ("price_asc", DEFAULT | dict(brand="Toyota", model="Camry"), "2 1"),
    ("price_asc", dict(brand="Toyota", model="Camry"), "13 2 4 1 3"),
    ("mileage_asc", dict(mileage_to=50000), "10 3 12 8 1"),
    ("price_asc", dict(sources=("OLX",), fuels=("Дизель", "Електро")), "11 5"),
    ("price_asc", dict(brand="Toyota", region="Волинська область"), ""),
])
def test_catalog_search(spark, sort, filters, expected):
    assert catalog(spark, sort, **filters) == expected


@pytest.mark.parametrize(("stored", "expected"), [
    ({}, "003 002 001"), ({"price_to": 0}, "003 002 001"), ({"mileage_to": 50000}, "003 002 001"), ({"fuel": []}, "003 002 001"),
    ({"brand": "toy"}, "001"), ({"fuel": ["Бензин"]}, "003 001"), ({"year_from": 2019}, "002 001"), ({"sources": ["olx"]}, "002"),
    ({"sources": ["OLX"]}, ""), ({"region": "Київ"}, "001"), ({"region": "м. Київ"}, ""), ({"region": "київ"}, "001"),
])
def test_server_search(spark, stored, expected):
    rows = C.demo_listings(spark).where(Q.SearchSpec.of(stored).predicate()).withColumn("id", F.substring("external_id", 6, 3))
    assert ids(rows.orderBy(F.asc("price"))) == expected


def test_pages(spark):
    rows = C.demo_listings(spark).withColumn("id", F.substring("external_id", 6, 3))
    assert ids(Q.page(rows, [F.asc("price")], 2, 2)) == "001"
    assert Q.envelope(rows, 2, 2).first()["pages"] == 2
    with pytest.raises(ValueError):
        Q.page(rows, [F.asc("price")], 0)
    with pytest.raises(ValueError):
        Q.page(rows, [F.asc("price")], 1, 101)


def test_regions_match_themselves(spark):
    rows = spark.createDataFrame([(r,) for r in C.REGION_KEYWORDS], "region string")
    k = C.region_keywords(spark).withColumnRenamed("region", "filter")
    got = {(r["region"], r["filter"]) for r in rows.join(k, F.exists("keywords", lambda w: F.contains(F.lower("region"), w))).select("region", "filter").collect()}
    assert sum((r, r) in got for r in C.REGION_KEYWORDS) == 14
    assert {f for r, f in got if r == "Київська область"} == {"м. Київ"}


@pytest.mark.parametrize(("counts", "mrr", "paid", "arpu"), [((5, 3, 2, 1), 11500, 6, 1045.45), ((2, 1, 0, 0), 500, 1, 166.67), ((0, 0, 0, 0), 0, 0, 0.0)])
def test_revenue(spark, counts, mrr, paid, arpu):
    users = spark.createDataFrame([(p[0],) for p, n in zip(C.PLANS, counts, strict=True) for _ in range(n)], "plan string")
    by_plan = M.revenue_by_plan(users, C.plans(spark))
    assert by_plan.count() == 4
    r = M.revenue_summary(by_plan).first()
    assert (r["mrr"], r["arr"], r["paid_users"], r["arpu"]) == (mrr, mrr * 12, paid, arpu)


def test_seeding_twice(spark):
    none = C.demo_listings(spark).limit(0)
    once = U.insert_missing(none, C.demo_listings(spark), ["external_id"], ["external_id"])
    assert (once.count(), U.insert_missing(once, C.demo_listings(spark), ["external_id"], ["external_id"]).count()) == (3, 3)
    body = U.seed_notifications(once.where("external_id = 'demo-001'"), "u", "s", C.SOURCE_LABELS).first()
    assert body["body"] == "2021 · 45,000 км · 780,000 грн · Київ"
    assert body["payload"]["source_label"] == "AUTO.RIA"


def values(spark, make, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["v"] for r in rows.orderBy("i").select(make(F.col("t")).alias("v")).collect()]


def test_scalars(spark):
    assert values(spark, S.parse_number, ["400 000", "", "abc", "12a3", None]) == [400000, None, None, 123, None]
    assert values(spark, S.initials, ["", "ab", "Ann Bee", "A B C", "  "]) == ["?", "AB", "AB", "AC", "?"]
    assert values(spark, S.csv_cell, ["a,b", 'x"y', "z", None]) == ['"a,b"', '"x""y"', "z", ""]
    assert values(spark, S.safe_filename, ["a b/c", "Авто №1", "", None]) == ["a_b_c", "Авто_1", "export", "export"]
    assert values(spark, S.six_cells, ["12-34", "1234567"]) == ["1234  ", "123456"]
    now = F.lit("2024-01-02 00:00:00")
    assert values(spark, lambda t: S.relative_age(t, now), ["2024-01-01 23:01:00", "2024-01-01 23:00:00", "2024-01-01 00:00:01", "2024-01-01 00:00:00"]) == ["59 m", "1 h", "23 h", "1 d"]
    assert values(spark, lambda t: S.half_up(t.cast("double")), ["2.5", "-2.5"]) == [3, -2]
    assert values(spark, lambda t: S.thousands(t.cast("int"), " "), ["780000"]) == ["780 000"]
    assert values(spark, lambda t: S.colour_bucket(t), ["ab", " Ї "]) == [(97 + 98) % 8, ord("Ї") % 8]


def test_keyed_state(spark):
    log = spark.createDataFrame([("a", "set", "1", 100.0, 1, 1), ("a", "set", "2", None, 2, 2), ("b", "set", "3", 50.0, 1, 3), ("c", "set", "4", 90.0, 1, 4), ("c", "delete", None, None, 2, 5), ("d", "set", "5", 60.5, 1, 6)], "key string, op string, value string, expires_at double, ts int, seq int")
    state = K.kv_state(log, 60.0)
    assert {(r["key"], r["value"]) for r in state.collect()} == {("a", "2"), ("d", "5")}
    keys = spark.createDataFrame([("a",), ("d",), ("x",)], "key string")
    assert {r["key"]: r["ttl"] for r in K.kv_ttl(state, keys, 60.0).collect()} == {"a": -1, "d": -2, "x": -1}
    tries = spark.createDataFrame([("u", 1, i, w) for i, w in enumerate([True] * 5 + [False])], "k string, g int, n int, wrong boolean")
    out = K.attempts(tries, "k", "g", [F.asc("n")], F.col("wrong"), 5).orderBy("n").collect()
    assert [r["deleted_now"] for r in out] == [False] * 4 + [True, False]
    assert not out[5]["accepted"]


def test_writes(spark):
    state = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id int, name string, n int")
    patched = U.patch(state, spark.createDataFrame([(1, None, 7)], "id int, name string, n int"), "id")
    assert {tuple(r) for r in patched.collect()} == {(1, "a", 7), (2, "b", None)}
    changed, n = U.bulk_set(state, F.col("n") > 1, {"name": F.lit("z")})
    assert {tuple(r) for r in changed.collect()} == {(1, "z", 5), (2, "b", None)} and n.first()["changed"] == 1
    assert {tuple(r) for r in U.set_null(state, spark.createDataFrame([(2,)], "id int"), "id").select("id").collect()} == {(None,), (2,)}
    assert U.duplicates(spark.createDataFrame([("x", None), ("x", None), ("y", 1), ("y", 1)], "a string, b int"), ["a", "b"]).count() == 1


def test_exports(spark, tmp_path):
    rows = C.catalog(spark).withColumn("desc", F.lit('<a> "b", c'))
    assert not E.write_csv(rows.limit(0), str(tmp_path / "none.csv"), [F.asc("pos")])
    assert E.write_csv(rows, str(tmp_path / "a.csv"), [F.asc("pos")])
    raw = (tmp_path / "a.csv").read_bytes().decode()
    assert raw.startswith('﻿Назва,Рік,"Пробіг, км","Ціна, грн",Регіон,') and raw.count("\r\n") == 15 and not raw.endswith("\r\n")
    assert 'Брати,12 хв тому,"<a> ""b"", c",' in raw
    assert E.write_spreadsheet(rows, str(tmp_path / "a.xls"), [F.asc("pos")])
    text = (tmp_path / "a.xls").read_text()
    assert text.count("<Row>") == 16 and '<Data ss:Type="Number">2021</Data>' in text and "&lt;a&gt; &quot;b&quot;, c" in text
    import xml.etree.ElementTree as ET

    ET.fromstring(text.split("\n", 2)[2])


def test_streaming(spark, tmp_path):
    from lotlens.streaming import live
    from tests.conftest import DATA

    batch = spark.read.parquet(f"{DATA}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("daily", live.daily_counts(source(), "ts", "event_type"), "complete"), ("firsts", live.first_wins(source(), "ts", ["user_id", "event_type"]), "append"), ("last", live.latest_values(source(), "ts", "user_id", "event_id"), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM daily").first()[0] == batch.count()
    assert spark.table("firsts").count() == batch.select("user_id", "event_type").distinct().count()
    assert spark.table("last").count() == batch.select("user_id").distinct().count()


def test_stored_tables_keep_their_schema(spark, tmp_path):
    spark.createDataFrame([("1", "a@x")], "id string, email string").write.parquet(str(tmp_path / "users"))
    got = C.stored(spark, str(tmp_path / "users"), "users").first()
    assert got["email"] == "a@x" and got["telegram_avatar_path"] is None


def test_states_are_committed_at_once(spark, tmp_path):
    path = "file://" + str(tmp_path / "state")
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    E.commit_tables({"a": a, "b": a.withColumn("id", F.lit(5))}, path)
    new = U.insert_rows(E.current_table(spark, path, "a"), spark.createDataFrame([(2, "y")], "id int, name string"))
    E.commit_tables({"a": new, "b": E.current_table(spark, path, "b").limit(0)}, path)  # from the state it replaces
    assert {tuple(r) for r in E.current_table(spark, path, "a").collect()} == {(1, "x"), (2, "y")} and E.current_table(spark, path, "b").count() == 0
    with pytest.raises(Exception):  # noqa: B017
        E.commit_tables({"a": new.limit(0), "b": new.select(F.raise_error(F.lit("no")).alias("id"))}, path)
    assert E.current_table(spark, path, "a").count() == 2


def test_ukrainian_order(spark):
    words = ["Яблуко", "ґава", "Гай", "їжак", "Іва", "єдність", "Ель", "жук", "азбука"]
    got = [r["w"] for r in spark.createDataFrame([(w,) for w in words], "w string").orderBy(S.in_ukrainian_order(F.col("w"))).collect()]
    assert got == ["азбука", "Гай", "ґава", "Ель", "єдність", "жук", "Іва", "їжак", "Яблуко"]


def test_more_scalars(spark):
    from lotlens.functions import predicates as P

    assert values(spark, S.uri_component, ["a b&~!'()*é", None]) == ["a%20b%26~!'()*%C3%A9", None]
    assert values(spark, S.uri_quoted, ["a b&~!'()*+"]) == ["a%20b%26~%21%27%28%29%2A%2B"]
    assert values(spark, lambda t: S.without_prefix(t, "connect_"), ["connect_connect_x", "xconnect_", ""]) == ["connect_x", "xconnect_", ""]
    assert values(spark, lambda t: S.uk_number(t.cast("int"), "км"), ["1234567", "12"]) == ["1\u00a0234\u00a0567 км", "12 км"]
    assert values(spark, S.strip_handle, ["@@me//", "a@b/"]) == ["me", "a@b"]
    assert values(spark, lambda t: P.dismissed_recently(t, 14 * 86_400_000), ["", None, "x", "0", " 1 ", "  "]) == [False, False, True, False, True, False]
    assert values(spark, S.colour_bucket, ["a", "🚗", "é🚗"]) == [ord("a") % 8, 0xD83D % 8, (ord("é") + 0xD83D) % 8]
    users = spark.createDataFrame([(1, True, "h"), (2, None, "h"), (3, True, ""), (4, False, None)], "id int, active boolean, secret string")
    assert [r["g"] for r in users.orderBy("id").select(P.account_gate("active", "secret").alias("g")).collect()] == ["ok", "deactivated", "invalid", "invalid"]


def test_codes_keep_their_time(spark):
    kinds = ["wrong", "register", "wrong", "refresh", "wrong", "wrong", "right", "refresh", "register", "right", "right", "register", "refresh", "wrong"]
    at = [0, 10, 20, 50, 60, 61, 62, 63, 200, 210, 220, 300, 350, 400]
    log = spark.createDataFrame([("u", i, float(t), k) for i, (t, k) in enumerate(zip(at, kinds, strict=True))], "k string, n int, at double, kind string")
    rows = K.code_tries(log, "k", ["n"], "at", "kind", 100, 2).orderBy("n").collect()
    assert [r["expires_at"] for r in rows] == [None] + [110.0] * 7 + [300.0] * 3 + [400.0] * 3
    assert [r["live"] for r in rows] == [False, False, True, True, True, True, False, False, False, True, False, False, True, False]
    assert [i for i, r in enumerate(rows) if r["deleted"]] == [5, 9] and rows[4]["failed_before"] == 0


def test_saved_search_of_its_owner(spark):
    stored = spark.createDataFrame([("s", "u", ("Toyota", 2019))], "id string, user_id string, filters struct<brand:string,year_from:int>")
    assert Q.search_for(stored, "u", "s") == Q.SearchSpec(brand="Toyota", year_from=2019) and Q.search_for(stored, "v", "s") is None


def test_models_of_a_brand(spark):
    models = C.brand_models(spark, {"A": ["z", "b"], "B": []})
    asked = spark.createDataFrame([("A",), ("B",), ("C",)], "brand string")
    assert {r["brand"]: r["models"] for r in C.models_for_brand(models, asked).collect()} == {"A": ["z", "b"], "B": [], "C": []}


def test_exact_rounding(spark):
    import random
    from fractions import Fraction

    rng = random.Random(2)
    xs = [2.675, 1.005, 0.125, -0.125, 2.5, 1e-30, 0.0, -0.0, 0.005, 1e15 + 0.5, 1e300, float("inf"), None] + [rng.randrange(10**7) / 1000 for _ in range(300)] + [rng.randrange(-(10**6), 10**6) / 2 ** rng.randrange(12) for _ in range(300)] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 18) for _ in range(300)]
    assert any(Fraction(x) * 1000 % 10 == 5 for x in xs if x and abs(x) < 1e9)
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (0, 2, 3, 10):
        want = [x if x is None or x in (float("inf"),) else round(x, digits) for x in xs]
        assert [r[0] for r in df.select(S.round_exact(F.col("x"), digits)).collect()] == want


def test_defaults_of_lookups(spark):
    from lotlens.operators.joins import with_dimension

    dim = spark.createDataFrame([("lite", 3)], "id string, most int")
    rows = spark.createDataFrame([("lite",), ("other",), (None,)], "plan string")
    assert [tuple(r) for r in with_dimension(rows, "plan", dim, "id", ["most"], "free").collect()] == [("lite", 3), ("other", None), (None, None)]
    both = dim.unionByName(spark.createDataFrame([("free", 1)], "id string, most int"))
    assert sorted(r["most"] for r in with_dimension(rows, "plan", both, "id", ["most"], "free").collect()) == [1, 1, 3]
    texts = spark.createDataFrame([('{"result": {"photos": [[{"file_id": 7}]], "a.b\'c": "x"}}',), ('{"result": null}',), ("no json",), (None,)], "t string")
    got = texts.select(S.json_get(F.col("t"), ["result", "photos", 0, 0, "file_id"], "int", F.lit(-1)), S.json_get(F.col("t"), ["result", "a.b'c"], "string")).collect()
    assert [tuple(r) for r in got] == [(7, "x"), (-1, None), (-1, None), (-1, None)]
    users = spark.createDataFrame([(True, "p"), (True, ""), (False, "p"), (None, "p"), (True, None)], "c boolean, p string")
    assert [r[0] for r in users.select(S.avatar_path(F.col("c"), F.col("p"))).collect()] == ["/auth/me/avatar", None, None, None, None]
