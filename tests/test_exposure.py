import datetime as dt

from habitnet.operators import exposure as ex
from habitnet.sources.codecs import exposure_from_text, exposure_to_text


def D(s):
    return dt.date.fromisoformat(s)


def test_calendar_month_year_end_gap_and_terminal(spark):
    days = ["2016-11-30", "2016-12-01", "2016-12-31", "2017-01-01", "2017-01-03", "2017-01-10"]
    df = spark.createDataFrame([(D(d),) for d in days], "day date")
    cal = {r.day.isoformat(): r.next_day for r in ex.calendar(df).collect()}
    assert cal["2016-11-30"] == D("2016-12-01")      # month end
    assert cal["2016-12-31"] == D("2017-01-01")      # year end
    assert cal["2017-01-01"] is None                 # gap of 2 is terminal at max_gap = 1
    cal2 = {r.day.isoformat(): r.next_day for r in ex.calendar(df, max_gap=2).collect()}
    assert cal2["2017-01-01"] == D("2017-01-03")     # bridged gap
    b = spark.createDataFrame([(D("2017-01-03"), D("2017-01-10"))], "day date, next_day date")
    cal3 = {r.day.isoformat(): r.next_day for r in ex.calendar(df, bridges=b, terminals=["2016-12-01"]).collect()}
    assert cal3["2017-01-03"] == D("2017-01-10") and cal3["2016-12-01"] is None and cal3["2017-01-10"] is None


def test_exposure_rows_labels_and_split_neighbours(spark):
    st = spark.createDataFrame(
        [(1, "A", D("2017-01-01")), (1, "A", D("2017-01-02")), (2, "A", D("2017-01-01")), (3, "A", D("2017-01-01")),
         (2, "B", D("2017-01-02"))],
        "user bigint, app string, day date",
    )
    split = st.where("user <> 3")                    # user 3 is outside the split
    g = spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "src bigint, dst bigint")
    cal = ex.calendar(st.select("day"))
    rows = {(r.i, r.j, r.t.isoformat()): (r.m0, r.m1, sorted((x.l, x.ml0) for x in r.ni)) for r in ex.exposure_rows(split, st, g, cal).collect()}
    assert rows == {(1, "A", "2017-01-01"): (1, 1, [(2, 1)]), (2, "A", "2017-01-01"): (1, 0, [(1, 1)])}


def test_exposure_text_round_trip(spark):
    st = spark.createDataFrame([(1, "A", D("2017-01-01")), (1, "A", D("2017-01-02"))], "user bigint, app string, day date")
    g = spark.createDataFrame([(5, 6)], "src bigint, dst bigint")
    cal = ex.calendar(st.select("day"))
    rows = ex.exposure_rows(st, st, g, cal)
    txt = exposure_to_text(rows)
    assert txt.first().value == "1,A,20170101,1,1,"  # no neighbour: empty tail
    back = exposure_from_text(txt, app_type="string").first()
    assert (back.i, back.j, back.t, back.m0, back.m1, back.ni) == (1, "A", D("2017-01-01"), 1, 1, [])
    lines = spark.createDataFrame([("7,A,20170101,1,0,3#1|4#0",)], "value string")
    r = exposure_from_text(lines, app_type="string").first()
    assert [(x.l, x.ml0) for x in r.ni] == [(3, 1), (4, 0)]


def test_holdout_days_partition(spark):
    days = spark.createDataFrame([(D("2017-01-01") + dt.timedelta(days=i),) for i in range(20)], "day date")
    h = ex.holdout_days(days, 3, 0.8, 7).collect()
    for f in range(3):
        part = [r for r in h if r.fold == f]
        assert len(part) == 20 and sum(r.is_train for r in part) == 16


def test_day_bitmaps_over_many_days(spark):
    """150 days (three words), gaps, a bridge and a terminal day, a hub, users off the graph: against plain loops."""
    import random

    rng = random.Random(6)
    first = D("2016-11-20")
    days = [first + dt.timedelta(days=n) for n in range(150) if n % 11]
    used = sorted({(rng.randrange(12), rng.choice("AB"), rng.choice(days)) for _ in range(900)})
    split = [x for x in used if x[0] != 3 and x[2] < D("2017-03-01")]
    graph = sorted({(0, v) for v in range(1, 12)} | {(v, 0) for v in range(1, 12)} | {(2, 3), (3, 2), (4, 5), (5, 4), (4, 99)})
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    bridges = make([(days[9], days[80])], "day date, next_day date")
    state = make(used, "user int, app string, day date")
    cal = ex.calendar(state.select("day"), max_gap=2, bridges=bridges, terminals=[days[20].isoformat()])
    after = {r.day: r.next_day for r in cal.collect()}
    rows, links = ex.exposure_long(make(split + split[:50], "user int, app string, day date"), state, make(graph, "src int, dst int"), cal)
    on = {x for x in used}
    want = {(u, a, t, 1, int((u, a, after[t]) in on)) for u, a, t in split if after.get(t)}
    assert len({w[2] for w in want}) > 62 and {w[4] for w in want} == {0, 1}
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(want) and set(got) == want
    there = {w[0] for w in want}
    want_links = {(u, a, t, l, int((l, a, t) in on)) for u, a, t, _, _ in want for s, l in graph if s == u and l in there}
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(want_links) and set(got) == want_links
    nested = ex.exposure_rows(make(split + split[:50], "user int, app string, day date"), state, make(graph, "src int, dst int"), cal).collect()
    assert all([x.l for x in r.ni] == sorted(x.l for x in r.ni) for r in nested)
    assert {(r.i, r.j, r.t, r.m0, r.m1) for r in nested} == want and len(nested) == len(want)
    assert sorted((r.i, r.j, r.t, x.l, x.ml0) for r in nested for x in r.ni) == sorted(want_links)


def test_links_are_dealt_before_days_are_rows(spark, monkeypatch):
    """The maps are a few bytes, their days many rows: as many tasks make them as the rows need, and no shuffle moves them."""
    monkeypatch.setattr(ex, "LINKS_PER_PARTITION", 500)
    state = spark.range(60).selectExpr("id AS user", "explode(array('A', 'B')) AS app").selectExpr(
        "*", "explode(sequence(date'2020-01-01', date'2020-01-20')) AS day")
    graph = spark.range(60).selectExpr("id AS src", "explode(sequence(0, 9)) AS step").selectExpr("src", "(src + step * 6 + 1) % 60 AS dst")
    _, links = ex.exposure_long(state, state, graph, ex.calendar(state.select("day")))
    n = links.count()
    assert n == 60 * 2 * 19 * 10
    assert len([c for c in links.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if c]) > 20
    counted = links.groupBy("i", "j", "t").count()
    counted.collect()
    plan = counted._jdf.queryExecution().executedPlan().toString().split("Generate")[0]  # what lies above the days
    assert "Exchange" not in plan.replace("BroadcastExchange", "").replace("ReusedExchange", "")
