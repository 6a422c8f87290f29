from habitnet.operators import contacts as ct


def test_voice_duration_bound_and_valid_users(spark):
    v = spark.createDataFrame(
        [(1, "a", "b", 14999), (1, "a", "c", 15000), (1, "a", "x", 60000), (1, "d", "d", 20000)],
        "sec bigint, src string, dst string, dur bigint",
    )
    valid = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "user string")
    got = {(r.src, r.dst) for r in ct.voice_graph(v, valid, 15).collect()}
    assert got == {("a", "c"), ("c", "a"), ("d", "d")}  # self-call kept


def test_mutual_sms_flags(spark):
    s = spark.createDataFrame(
        [
            (1, "a", "b", 0),              # one flag only
            (1, "c", "d", 0), (2, "c", "d", 1),  # both flags from the same side
            (1, "e", "f", 0), (2, "f", "e", 1),  # one flag from each side
        ],
        "sec bigint, src string, dst string, flag bigint",
    )
    got = {(r.src, r.dst) for r in ct.mutual_sms_graph(s, None).collect()}
    assert got == {("c", "d"), ("d", "c"), ("e", "f"), ("f", "e")}


def test_contact_graph_union_distinct(spark):
    a = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    b = spark.createDataFrame([("a", "b"), ("c", "d")], "src string, dst string")
    assert ct.contact_graph(a, b).count() == 3


def test_mutual_sms_of_self_pairs_and_nulls(spark):
    rows = [("a", "a", 0), ("a", "a", 1), (None, "b", 0), ("b", None, 1), ("b", "c", 0), ("c", "b", None)]
    s = spark.createDataFrame(rows, "src string, dst string, flag bigint")
    got = [tuple(r) for r in ct.mutual_sms_graph(s, None).collect()]
    assert len(got) == 3 and set(got) == {("a", "a"), (None, "b"), ("b", None)}


def test_mutual_sms_counts_a_pair_once(spark):
    """The aggregate's input holds each record once, not once per direction."""
    s = spark.createDataFrame([("a", "b", 0), ("b", "a", 1)], "src string, dst string, flag bigint")
    plan = ct.mutual_sms_graph(s, None)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Aggregate")  # the mirror is above
