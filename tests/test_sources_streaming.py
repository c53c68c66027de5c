"""File sources, sinks, load bookkeeping and streaming (FIXTURES.md section 3)."""

import json
import os

from pyspark.sql import functions as F

from gapmeter.sources import load as L
from gapmeter.streaming import incremental as INC


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def test_text_csv_keeps_quoted_empty(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'a,b,c\n13,,""\n')
    r = L.read_text_csv(spark, p).first()
    assert (r.a, r.b, r.c) == ("13", None, "")


def test_null_word_csv(spark, tmp_path):
    p = write(tmp_path / "b.csv", 'x,y,z\n1,NULL,"a,b"\n')
    r = L.read_null_word_csv(spark, p).first()
    assert (r.x, r.y, r.z) == ("1", None, "a,b")


def test_quarantine(spark, tmp_path):
    p = write(tmp_path / "q.csv", 'a,b,c\n1,2,3\n4,"5,5",6\n7,8\n9,10,"11,""x""",12\n13,,""\n1,0,0\n')
    good, bad = L.quarantine_csv(spark, p, ["a", "b", "c"])
    g = sorted(tuple(r) for r in good.collect())
    assert g == [("1", "0", "0"), ("1", "2", "3"), ("13", None, ""), ("4", "5,5", "6")]
    assert sorted((r.zeile, r.felder) for r in bad.collect()) == [("7,8", 2), ('9,10,"11,""x""",12', 4)]
    r = L.quarantine_report(good, bad, "a", 7).first()
    assert (r.gut, r.doppelte_ids, r.quarantaene, r.felder_min, r.felder_max, r.differenz) == (4, 1, 2, 2, 4, -1)


def test_text_csv_quotes_and_line_breaks(spark, tmp_path):
    p = write(tmp_path / "d.csv", 'id,name,x\n1,"a ""b"", c",2\n')
    assert tuple(L.read_text_csv(spark, p).first()) == ("1", 'a "b", c', "2")
    p = write(tmp_path / "m.csv", 'id,name\n1,"two\nlines"\n2,b\n')
    assert sorted(map(tuple, L.read_text_csv(spark, p, multi_line=True).collect())) == [("1", "two\nlines"), ("2", "b")]


def test_folder_of_files_with_headers_of_their_own(spark, tmp_path):
    d = tmp_path / "f"
    d.mkdir()
    write(d / "f1.csv", "zeitstempel,wind,hydro\n1,w1,h1\n")
    write(d / "f2.csv", "hydro,zeitstempel,wind\nh2,2,w2\n")
    write(d / "f3.csv", "zeitstempel,wind,hydro\n3,w3,h3\n")
    got = L.read_by_header(spark, str(d), ["zeitstempel", "wind", "hydro", "pump"])
    assert sorted(map(tuple, got.collect())) == [("1", "w1", "h1", None), ("2", "w2", "h2", None), ("3", "w3", "h3", None)]


def test_year_overwrite_in_a_static_session(spark, tmp_path):
    from gapmeter.plans import star as ST
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        for write_years, path in ((ST.write_fact, str(tmp_path / "a")), (L.reload_years, str(tmp_path / "b"))):
            df = spark.createDataFrame([(y, i) for y in (2021, 2022, 2023) for i in range(4)], "jahr int, src_id int")
            write_years(df, path)
            write_years(df.filter("jahr = 2022"), path)
            assert spark.read.parquet(path).count() == 12
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def test_layers_follow_their_input(spark, tmp_path):
    from gapmeter.plans import layers as LY
    d = str(tmp_path / "in")
    spark.range(10).write.parquet(f"{d}/t.parquet")
    build = lambda: spark.read.parquet(f"{d}/t.parquet").agg(F.count("*").alias("n"))
    assert LY.layer(spark, d, "n", build).first().n == 10
    first = LY._WRITTEN[(spark.sparkContext.applicationId, d, "n")][1]
    assert LY.layer(spark, d, "n", lambda: 1 / 0).first().n == 10
    spark.range(3).write.mode("append").parquet(f"{d}/t.parquet")
    assert LY.layer(spark, d, "n", build).first().n == 13
    assert not os.path.exists(first.removeprefix("file://"))


def test_optional_input_reports_only_a_missing_path(spark, tmp_path):
    assert L.optional_input(spark, str(tmp_path / "none"), "x") is None
    write(tmp_path / "broken.parquet", "not parquet")
    try:
        L.optional_input(spark, str(tmp_path / "broken.parquet"), "x")
        raise AssertionError("a broken file isn't a missing one")
    except Exception as e:  # noqa: BLE001
        assert not isinstance(e, AssertionError)


def test_key_windows_cover_every_key(spark):
    df = spark.createDataFrame([(k,) for k in [*range(0, 1000), *range(10**6, 10**6 + 500), None]], "k long")
    w = L.key_windows(df, "k", rows_per_window=100).collect()
    assert sum(r.zeilen for r in w) == 1500 and all(r.von < r.bis for r in w)
    assert L.key_windows(df.limit(0), "k").collect() == []


def test_header_order_binding(spark, tmp_path):
    d = tmp_path / "gen"
    d.mkdir()
    write(d / "f1.csv", "zeitstempel,wind,hydro\n1,w1,h1\n")
    write(d / "f2.csv", "hydro,zeitstempel,wind\nh2,2,w2\n")
    rows = []
    for f in ("f1.csv", "f2.csv"):
        rows += L.read_by_header(spark, str(d / f), ["zeitstempel", "wind", "hydro", "pump"]).collect()
    assert sorted((r.zeitstempel, r.wind, r.hydro, r.pump) for r in rows) == [("1", "w1", "h1", None),
                                                                              ("2", "w2", "h2", None)]
    assert L.missing_columns(L.read_by_header(spark, str(d / "f1.csv")), ["wind", "pump"]) == ["pump"]


def test_year_reload_is_idempotent(spark, tmp_path):
    out = str(tmp_path / "fact")
    df = spark.createDataFrame([(y, i) for y in (2021, 2022, 2023) for i in range(10)], "jahr int, v int")
    L.reload_years(df, out)
    L.reload_years(df.filter("jahr = 2022").withColumn("v", F.col("v") + 100), out)
    back = spark.read.parquet(out)
    assert back.count() == 30
    assert back.filter("jahr = 2022").agg(F.min("v")).first()[0] == 100
    assert back.filter("jahr = 2021").agg(F.max("v")).first()[0] == 9


def test_series_json_later_wins_and_nulls_dropped(spark, tmp_path):
    d = tmp_path / "js"
    d.mkdir()
    write(d / "wind_0001.json", json.dumps({"series": [[1000, 5.0], [2000, None]]}))
    write(d / "wind_0002.json", json.dumps({"series": [[1000, 7.0], [3000, 1.0]]}))
    long = L.read_series_json(spark, str(d))
    got = sorted((r.epoch_ms, r.traeger, r.wert) for r in long.collect())
    assert got == [(1000, "wind", 7.0), (3000, "wind", 1.0)]


def test_version_pick_and_parse(spark):
    names = spark.createDataFrame([("co2cars_2025Pv31",), ("co2cars_2025Fv2",), ("co2cars_2024Pv3",),
                                   ("co2cars_2024Pv12",)], "tabelle string")
    got = {r.jahr: r.tabelle for r in L.pick_versions(names).collect()}
    assert got == {2025: "co2cars_2025Fv2", 2024: "co2cars_2024Pv12"}


def test_insert_if_absent(spark):
    t = spark.createDataFrame([("08",), ("29",)], "code string")
    n = spark.createDataFrame([("29",), ("99",)], "code string")
    assert sorted(r.code for r in L.insert_if_absent(t, n, ["code"]).collect()) == ["08", "29", "99"]


def test_semicolon_csv(spark, tmp_path):
    out = str(tmp_path / "prof")
    L.write_semicolon_csv(spark.createDataFrame([("a", 1)], "spalte string, n int"), out)
    txt = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv"))
    assert "spalte;n" in txt and "a;1" in txt


def test_exactly_once_append(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "id long, v double"
    spark.createDataFrame([(i, float(i)) for i in range(50)], schema).write.parquet(src + "/b1")
    sink, ck = str(tmp_path / "sink"), str(tmp_path / "ck")
    stream = lambda: INC.file_stream(spark, src + "/*", spark.read.parquet(src + "/b1").schema)
    INC.run_available_now(stream(), sink, ck)
    assert spark.read.parquet(sink).count() == 50
    INC.run_available_now(stream(), sink, ck)           # rerun: nothing new
    assert spark.read.parquet(sink).count() == 50
    spark.createDataFrame([(i, float(i)) for i in range(50, 53)], schema).write.parquet(src + "/b2")
    INC.run_available_now(stream(), sink, ck)
    assert spark.read.parquet(sink).count() == 53


def test_stream_dedup(spark, tmp_path):
    src = str(tmp_path / "dsrc")
    rows = [(2021, i % 20) for i in range(40)]
    spark.createDataFrame(rows, "jahr int, id int").write.parquet(src)
    s = INC.file_stream(spark, src, spark.read.parquet(src).schema)
    sink, ck = str(tmp_path / "dsink"), str(tmp_path / "dck")
    INC.run_batches(s, sink, ck, INC.new_keys(["jahr", "id"]))
    assert spark.read.parquet(sink).count() == 20


def test_empty_input_guard(spark, tmp_path):
    import pytest
    from gapmeter.plans import gridmix as GM
    empty = spark.createDataFrame([], "zeitpunkt timestamp, traeger string, mwh double")
    out = str(tmp_path / "mart")
    with pytest.raises(ValueError):
        L.write_mart(GM.hourly_intensity(L.require_rows(empty, "generation"), GM.factor_table(spark)), out)
    assert not os.path.exists(out)
    assert L.optional_input(spark, str(tmp_path / "nope"), "histogram") is None


def test_findings_append_and_truncate(spark, tmp_path):
    from gapmeter.operators import quality as Q
    path = str(tmp_path / "dq")
    one = Q.finding(spark.range(1), "raw", "t", "c", "p", 1, "Zeilen", 0, "ok", None)
    L.append_findings(one, path, truncate=True)
    L.append_findings(one, path)
    assert spark.read.parquet(path).count() == 2
    L.append_findings(one, path, truncate=True)
    assert spark.read.parquet(path).count() == 1


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    import datetime as dt
    src = str(tmp_path / "late")
    base = dt.datetime(2024, 1, 1, 10, 0, 0)
    schema = "ts timestamp, k string, v double"
    # one file per delivery, so each run is one micro-batch and the first run drops nothing
    spark.createDataFrame([(base + dt.timedelta(hours=h), "a", 1.0) for h in range(6)], schema) \
        .coalesce(1).write.parquet(src + "/b1")
    sink, ck = str(tmp_path / "lsink"), str(tmp_path / "lck")
    mk = lambda: INC.file_stream(spark, src + "/*", spark.read.parquet(src + "/b1").schema)  # noqa
    INC.run_available_now(INC.hourly_windows(mk(), "ts", "k", "v"), sink, ck)
    # a row 5 hours behind the newest event arrives later: beyond the 2-hour watermark
    spark.createDataFrame([(base, "a", 100.0)], schema).coalesce(1).write.parquet(src + "/b2")
    q = INC.run_available_now(INC.hourly_windows(mk(), "ts", "k", "v"), sink, ck)
    assert INC.rows_dropped_by_watermark(q) == 1
    out = spark.read.parquet(sink)
    assert out.agg(F.max("summe")).first()[0] == 1.0        # the late row never reached a window


def test_hour_and_year_follow_session_zone(spark):
    from gapmeter.plans.gridmix import epoch_ms_to_parts
    ms = 1735687800000            # 2024-12-31 23:30 UTC = 2025-01-01 00:30 in Berlin (UTC+1)
    df = spark.createDataFrame([(ms,)], "t long")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        utc = df.select(*epoch_ms_to_parts("t")).first()
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        ber = df.select(*epoch_ms_to_parts("t")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert (utc.jahr, utc.stunde) == (2024, 23)
    assert (ber.jahr, ber.stunde) == (2025, 0)


def test_stream_dedup_within_watermark(spark, tmp_path):
    import datetime as dt
    src = str(tmp_path / "wsrc")
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=i), i % 10) for i in range(40)]
    spark.createDataFrame(rows, "ts timestamp, id int").coalesce(1).write.parquet(src)
    s = INC.file_stream(spark, src, spark.read.parquet(src).schema)
    sink, ck = str(tmp_path / "wsink"), str(tmp_path / "wck")
    INC.run_available_now(INC.dedup_stream(s, ["id"], event_time="ts", delay="1 day"), sink, ck)
    assert spark.read.parquet(sink).count() == 10


def test_orphans_are_reported(spark):
    from gapmeter.plans import star as ST
    f = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, model_sk long")
    dim = spark.createDataFrame([(1,), (2,)], "model_sk long")
    assert [tuple(r) for r in ST.orphans(f, {"model": dim}).collect()] == [("model", 2)]


def test_hourly_partials_in_any_file_order(spark, tmp_path):
    src = str(tmp_path / "ev")
    for h in (5, 1, 9, 2, 1):      # one file each, out of time order
        spark.sql(f"SELECT timestamp'2024-01-01 0{h}:10:00' AS ts, 'k' AS k, {h}.0 AS v").selectExpr("ts", "k", "cast(v as double) v") \
            .coalesce(1).write.mode("append").parquet(src)
    s = INC.file_stream(spark, src, spark.read.parquet(src).schema, max_files=1)
    sink, ck = str(tmp_path / "s"), str(tmp_path / "c")
    INC.run_batches(s, sink, ck, INC.hourly_partials("ts", "k", "v"))
    got = spark.read.parquet(sink).groupBy("fenster_start").agg(F.sum("summe").alias("s"), F.sum("n").alias("n")).collect()
    assert sorted((r.fenster_start.hour, r.s, r.n) for r in got) == [(1, 2.0, 2), (2, 2.0, 1), (5, 5.0, 1), (9, 9.0, 1)]


def test_new_keys_across_batches_and_reruns(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for part in ([(1, "a"), (1, "a"), (2, None)], [(1, "a"), (2, None), (3, "c")]):
        spark.createDataFrame(part, "jahr int, id string").coalesce(1).write.mode("append").parquet(src)
    s = lambda: INC.file_stream(spark, src, spark.read.parquet(src).schema, max_files=1)
    INC.run_batches(s(), sink, ck, INC.new_keys(["jahr", "id"]))
    spark.createDataFrame([(3, "c"), (4, "d")], "jahr int, id string").coalesce(1).write.mode("append").parquet(src)
    INC.run_batches(s(), sink, ck, INC.new_keys(["jahr", "id"]))
    got = sorted(((r.jahr, r.id) for r in spark.read.parquet(sink).collect()), key=repr)
    assert got == [(1, "a"), (2, None), (3, "c"), (4, "d")]


def test_headers_are_read_without_the_rest(spark, tmp_path):
    """Files of two headers, one compressed, one huge in its second line, an empty one and markers: a group per header."""
    import gzip
    (tmp_path / "a.csv").write_text("x,y,z\n1,2,3\n")
    (tmp_path / "b.csv").write_text("z,x,y\n" + "9," * 2_000_000 + "\n")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("x,y,z\n4,5,6\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "_SUCCESS").write_text("no,header,here")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    groups = L._files(spark, f"file://{tmp_path}")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before  # no job reads the files
    assert {h: sorted(p.rsplit("/", 1)[1] for p in ps) for h, ps in groups.items()} == {"x,y,z": ["a.csv", "c.csv.gz"], "z,x,y": ["b.csv"]}


def test_scratch_folders_go_when_dropped(spark, tmp_path):
    import os

    from gapmeter.streaming import incremental as I
    path = I.scratch(spark, "some")
    spark.range(3).write.parquet(path)
    local = path.replace("file://", "")
    assert os.path.isdir(local)
    I.drop_scratch(spark)
    assert not os.path.isdir(local)


def test_writes_by_year_do_not_sort(spark, tmp_path):
    """A task that writes by year keeps a file open per year; the setting is the session's own again afterwards."""
    from gapmeter.plans import layers as LY
    from gapmeter.plans import star as ST
    from gapmeter.session import unsorted_writes
    key = "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(key, None)
    with unsorted_writes(spark):
        assert int(spark.conf.get(key)) > 7
    assert spark.conf.get(key, None) == was
    df = spark.range(5000).select((1995 + F.col("id") % 8).cast("int").alias("jahr"), F.col("id").alias("src_id")).repartition(2)
    ST.write_fact(df, str(tmp_path / "f"))
    assert len(list((tmp_path / "f").glob("jahr=*/*.parquet"))) == 16     # each of two tasks, no shuffle before
    d = str(tmp_path / "in")
    df.write.parquet(f"{d}/t.parquet")
    got = LY.layer(spark, d, "y", lambda: spark.read.parquet(f"{d}/t.parquet"), partition_by=["jahr"])
    for back in (got, spark.read.parquet(str(tmp_path / "f"))):
        assert {(r.jahr, r["count"]) for r in back.groupBy("jahr").count().collect()} == {(1995 + k, 625) for k in range(8)}
    assert spark.conf.get(key, None) == was
