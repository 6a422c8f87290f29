"""End-to-end: the three jobs over small log files in a temporary folder."""

from pyspark.sql import functions as F

from habitnet.plans import jobs

DAY = 86400
BASE_SEC = 17167 * DAY  # 2017-01-01


def _web(user, day, host, url=""):
    f = [str(BASE_SEC + day * DAY + 60), user, "-", "-", host, "-", "-", "-", "-", "-", url]
    return "|".join(f)


def test_three_jobs(spark, tmp_path):
    users = [f"u{i}" for i in range(6)]
    lines = []
    for d in range(8):
        for i, u in enumerate(users):
            for a in range(4):
                if (i + a + d) % 3 != 0:
                    lines.append(_web(u, d, f"h{a}.com"))
    lines.append(_web("u0", 1, "", "http://x/"))        # matched by url
    lines.append(_web("u0", 1, "unknown.com", ""))      # unmatched: dropped
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "part0").write_text("\n".join(lines[: len(lines) // 2]) + "\n")
    (tmp_path / "web" / "part1").write_text("\n".join(lines[len(lines) // 2:]) + "\n")
    (tmp_path / "dict.csv").write_text("h0.com,A\nh1.com,B\nh2.com,C\nh3.com,D\nhttp://x/,A\n")
    voice = [f"1|{users[i]}|-|-|-|{users[(i + 1) % 6]}|-|-|20000" for i in range(5)]
    (tmp_path / "voice.txt").write_text("\n".join(voice) + "\n")
    (tmp_path / "sms.txt").write_text("1|u0|-|-|-|u3|-|0\n2|u3|-|-|-|u0|-|1\n")
    (tmp_path / "valid.txt").write_text("\n".join(users) + "\n")
    base = str(tmp_path / "out")

    usage = jobs.usage_job(spark, base, [str(tmp_path / "web" / "*")], str(tmp_path / "dict.csv"))
    assert usage.where("user = 'u0' AND app = 'A'").count() > 0
    again = jobs.usage_job(spark, base, ["/nonexistent"], "/nonexistent")  # built once: reused
    assert again.count() == usage.count()

    g = jobs.graph_job(spark, base, usage, [str(tmp_path / "voice.txt")], [str(tmp_path / "sms.txt")],
                       str(tmp_path / "valid.txt"), 15, [2], min_users=2, rank=2, lmf_steps=2, lmf_restarts=1)
    assert {r.node for r in g["largest"].collect()} == set(users)
    assert g["direct_2"].count() > 0 and g["improved_2"].count() > 0

    res = jobs.model_job(spark, base, usage, {"contacts": g["subgraph"], "direct_2": g["direct_2"]},
                         g["largest"].select(F.col("node").alias("user")), ranks=[2], folds=2, max_epochs=2, min_users=2)
    out = {r.graph: r.min_rmse for r in res.collect()}
    assert set(out) == {"contacts", "direct_2"} and all(v == v for v in out.values())


def test_sweep_job_shape(spark, tmp_path):
    users = [f"u{i}" for i in range(5)]
    lines = [_web(u, d, f"h{a}.com") for d in range(6) for i, u in enumerate(users) for a in range(3) if (i + a + d) % 2]
    (tmp_path / "web.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "dict.csv").write_text("h0.com,A\nh1.com,B\nh2.com,C\n")
    (tmp_path / "voice.txt").write_text("\n".join(f"1|{users[i]}|-|-|-|{users[i + 1]}|-|-|30000" for i in range(4)) + "\n")
    (tmp_path / "sms.txt").write_text("1|u0|-|-|-|u4|-|0\n")
    (tmp_path / "valid.txt").write_text("\n".join(users) + "\n")
    base = str(tmp_path / "out")
    usage = jobs.usage_job(spark, base, [str(tmp_path / "web.txt")], str(tmp_path / "dict.csv"))
    res = jobs.sweep_job(spark, base, usage, [str(tmp_path / "voice.txt")], [str(tmp_path / "sms.txt")], str(tmp_path / "valid.txt"),
                         secs=[15], ks=[1], ranks=[1, 2], model_rank=2, combined_k=1, folds=1, max_epochs=2, min_users=2,
                         lmf_steps=1, lmf_restarts=1)
    got = {(r.sec, r.graph, r.rank) for r in res.collect()}
    assert got == {(15, "direct_1", 2), (15, "improved_1", 2), (15, "combined", 1), (15, "combined", 2)}
