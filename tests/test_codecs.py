import os


from habitnet.sources import codecs, logs


def test_text_round_trips(spark, tmp_path):
    sets = spark.createDataFrame([("u1", ["a", "b"]), ("u2", ["c"])], "user string, apps array<string>")
    p = str(tmp_path / "sets")
    codecs.write_text(codecs.app_sets_to_text(sets), p, 2)
    assert len([f for f in os.listdir(p) if f.startswith("part-")]) == 2
    back = {r.user: r.apps for r in codecs.app_sets_from_text(spark.read.text(p)).collect()}
    assert back == {"u1": ["a", "b"], "u2": ["c"]}

    fac = spark.createDataFrame([("x", [0.25, -1.5])], "id string, factor array<double>")
    t = codecs.factors_to_text(fac)
    assert t.first().value == "x,0.25,-1.5"
    assert codecs.factors_from_text(t).first().factor == [0.25, -1.5]

    idx = spark.createDataFrame([("u", 7)], "user string, idx bigint")
    assert codecs.index_from_text(codecs.index_to_text(idx)).first().idx == 7


def test_materialize_builds_once(spark, tmp_path):
    p = str(tmp_path / "m")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert codecs.materialize(spark, p, build).count() == 5
    assert codecs.materialize(spark, p, build).count() == 5
    assert len(calls) == 1


def test_log_readers(spark, tmp_path):
    (tmp_path / "voice").mkdir()
    (tmp_path / "voice" / "p0").write_text("10|a|x|x|x|b|x|x|15000\n11|a|x|x|x|c|x|x|bad\n")
    v = logs.read_voice_log(spark, str(tmp_path / "voice" / "*")).collect()
    assert [(r.src, r.dst, r.dur) for r in v] == [("a", "b", 15000)]
    (tmp_path / "sms.txt").write_text("10|a|x|x|x|b|x|1\n")
    s = logs.read_sms_log(spark, str(tmp_path / "sms.txt")).first()
    assert (s.src, s.dst, s.flag) == ("a", "b", 1)
    (tmp_path / "users.txt").write_text("a\nb\n\na\n")
    assert logs.read_id_list(spark, str(tmp_path / "users.txt")).count() == 2
    (tmp_path / "dict.csv").write_text("h1,A\nh2,B\nh1,C\n")
    d = {r.host: r.app for r in logs.read_host_app(spark, str(tmp_path / "dict.csv")).collect()}
    assert d == {"h1": "C", "h2": "B"}  # later line wins
    (tmp_path / "e.csv").write_text("a,b\nb,c\n")
    assert logs.read_edge_list(spark, str(tmp_path / "e.csv")).count() == 2


def test_materialize_builds_a_half_written_folder_again(spark, tmp_path):
    from habitnet.sources.codecs import materialize

    path = tmp_path / "stage"
    path.mkdir()
    (path / "part-00000.parquet").write_bytes(b"left by a job that died")
    assert materialize(spark, str(path), lambda: spark.range(3)).count() == 3
    assert materialize(spark, str(path), lambda: spark.range(9)).count() == 3  # finished: read, not built


def test_short_lines_decode_to_nulls(spark):
    from habitnet.sources import codecs

    lines = spark.createDataFrame([("only",), ("",)], "value string")
    assert [r["apps"] for r in codecs.app_sets_from_text(lines).collect()] == [None, None]
    assert [r["idx"] for r in codecs.index_from_text(lines).collect()] == [None, None]
    assert codecs.exposure_from_text(lines).count() == codecs.factors_from_text(lines).count() == 2
