import datetime as dt

import pytest


from habitnet.operators import usage as us
from habitnet.sources.logs import parse_web_log


def _line(sec, user, host, url):
    f = [str(sec), user, "x", "x", host, "x", "x", "x", "x", "x", url]
    return "|".join(f)


def test_parse_and_match_edge_cases(spark):
    lines = [
        _line(86400, "u1", "h.com", "http://a/"),      # host matches
        _line(86400, "u2", "", "http://b/"),           # host missing, url matches
        _line(86400, "u3", "", ""),                    # neither present
        _line("12x", "u4", "h.com", "http://a/"),      # bad number: dropped
        _line(86400, "u5", "h.com", "http://b/"),      # both match: host wins
        "too|short",                                    # missing fields: dropped
    ]
    log = parse_web_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    d = spark.createDataFrame([("h.com", "A"), ("http://b/", "B"), ("http://a/", "C")], "host string, app string")
    got = {(r.user, r.app) for r in us.match_apps(log, d).collect()}
    assert got == {("u1", "A"), ("u2", "B"), ("u5", "A")}


def test_format_usage_day_bound_and_count(spark):
    day = 86400
    lines = [_line(day + 5, "u", "h", ""), _line(day + 50, "u", "h", ""), _line(3 * day, "u", "h", "")]
    log = parse_web_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    d = spark.createDataFrame([("h", "A")], "host string, app string")
    rows = us.format_usage(log, d, before="1970-01-03").collect()
    assert [(r.user, r.day, r.app, r.cnt) for r in rows] == [("u", dt.date(1970, 1, 2), "A", 2)]


def test_union_sum_and_stats(spark):
    a = spark.createDataFrame([("u", dt.date(2017, 1, 1), "A", 2), ("v", dt.date(2017, 1, 1), "A", 1)], "user string, day date, app string, cnt bigint")
    b = spark.createDataFrame([("u", dt.date(2017, 1, 1), "A", 3), ("u", dt.date(2017, 1, 2), "B", 1)], "user string, day date, app string, cnt bigint")
    u = us.union_usage(a, b)
    got = {(r.user, r.app, r.day.day): r.cnt for r in u.collect()}
    assert got == {("u", "A", 1): 5, ("v", "A", 1): 1, ("u", "B", 2): 1}
    s = us.usage_stats(u).first()
    assert (s.n_rows, s.n_users, s.n_apps, s.n_pairs) == (3, 2, 2, 3)
    assert s.mean_apps_per_user == 1.5


def test_popularity_bound_is_inclusive(spark):
    rows = [(f"u{i}", dt.date(2017, 1, 1), "A", 1) for i in range(10)] + [(f"u{i}", dt.date(2017, 1, 1), "B", 1) for i in range(9)]
    u = spark.createDataFrame(rows, "user string, day date, app string, cnt bigint")
    assert {r.app for r in us.popular_apps(u, 10).collect()} == {"A"}
    inv = us.involved_usage(u, spark.createDataFrame([("u1",), ("u2",)], "user string"), min_users=2)
    assert {(r.user, r.app) for r in inv.collect()} == {("u1", "A"), ("u1", "B"), ("u2", "A"), ("u2", "B")}


def test_split_by_day_drops_gap(spark):
    u = spark.createDataFrame([(d,) for d in [dt.date(2017, 1, 24), dt.date(2017, 1, 25), dt.date(2017, 2, 1)]], "day date")
    got = {(r.day.isoformat(), r.part) for r in us.split_by_day(u, "2017-01-24", "2017-02-01").collect()}
    assert got == {("2017-01-24", "train"), ("2017-02-01", "test")}


def test_user_app_sets_sorted(spark):
    u = spark.createDataFrame([("u", "b"), ("u", "a"), ("u", "b")], "user string, app string")
    r = us.user_app_sets(u).first()
    assert r.apps == ["a", "b"] and r.n_apps == 2


def test_counted_and_approx_stats(spark):
    u = spark.createDataFrame([("u", dt.date(2017, 1, 1), "A", 1), ("v", dt.date(2017, 1, 1), "B", 1)], "user string, day date, app string, cnt bigint")
    df, obs = us.counted(u.where("cnt > 0"), "rows_after_filter")
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 2
    s = us.usage_stats(u, approx=True).first()
    assert (s.n_users, s.n_apps) == (2, 2)


def test_day_split_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "usage")
    spark.sql("SELECT 1 AS user, DATE'2020-01-05' AS day, 2 AS app, 3L AS cnt").write.parquet(path)
    split = us.split_by_day(spark.read.parquet(path), "2020-01-10", "2020-02-01")
    assert [r["part"] for r in split.collect()] == ["train"]
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Or(LessThanOrEqual(day" in plan


@pytest.fixture
def skewed(spark):
    """Sizes at which a few thousand rows count as skewed and nothing is broadcast; gives the plan that ran."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for key, old in before.items():
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def test_a_hot_host_is_split_and_the_log_is_not_stored(spark, skewed, monkeypatch):
    """A third of the lines have one host, a third no host and one url; the only checkpoint is the dictionary."""
    stored = []
    monkeypatch.setattr(us, "cut_lineage", lambda df, own=us.cut_lineage: stored.append(df.count()) or own(df))
    case = "CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN concat('h', id % 500) END"
    log = spark.range(0, 90_000, 1, 8).selectExpr("concat('u', id) AS user", "id AS sec", f"{case} AS host", "CASE id % 3 WHEN 2 THEN 'http://hot/' ELSE concat('http://', id) END AS url")
    hosts = [("hot", "A"), ("http://hot/", "B"), ("http://never/", "C")] + [(f"h{i}", "H") for i in range(0, 500, 2)]
    out = us.match_apps(log, spark.createDataFrame(hosts, "host string, app string"))
    got = {}
    for r in out.collect():
        got[r.app] = got.get(r.app, 0) + 1
    assert got == {"A": 30_000, "B": 30_000, "H": 15_000} and out.columns == [*log.columns, "app"]
    assert stored == [len(hosts)]
    assert skewed(out).count("skew=true") >= 2


def test_hot_keys_of_semi_joins_are_split(spark, skewed):
    from habitnet.operators import joins

    rows = spark.range(0, 90_000, 1, 8).selectExpr("IF(id % 3 = 0, -1, id % 700) AS user", "concat('padding', id) AS x")
    keys = spark.range(-1, 400).selectExpr("id AS user")
    out = joins.semi_join(rows, keys.unionByName(keys), "user")
    assert out.collect().__len__() == 30_000 + sum(1 for i in range(90_000) if i % 3 and i % 700 < 400)
    assert "skew=true" in skewed(out)
    edges = spark.range(0, 90_000, 1, 8).selectExpr("IF(id % 3 = 0, -1, id % 700) AS src", "IF(id % 3 = 1, -1, id % 600) AS dst", "id AS x")
    out = joins.both_ends_in(edges, keys, "user")
    out.collect()
    assert skewed(out).count("skew=true") >= 2
