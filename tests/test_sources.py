from __future__ import annotations

import datetime
import json

import pytest
import zstandard

from lexitide.cli import main
from lexitide.sources import dumps, tables
from pyspark.sql import functions as F


def dump(path, rows, end=b"\n", **kw):
    body = b"\n".join(r if isinstance(r, bytes) else json.dumps(r, ensure_ascii=False).encode() for r in rows) + end
    params = zstandard.ZstdCompressionParameters.from_level(3, **kw)
    path.write_bytes(zstandard.ZstdCompressor(compression_params=params).compress(body))
    return str(path)


SUBS = [{"id": "1", "author": "a", "created_utc": 10, "title": "é", "num_comments": 3, "selftext": "x\ny"}, {"id": "2", "author": "b", "created_utc": "11", "title": "t", "num_comments": 0}, {"id": "3"}, b"{broken", {"id": "4", "author": "d", "created_utc": 12, "title": "z", "num_comments": 1, "selftext": "last"}]


@pytest.mark.parametrize("how", ["plain", "long", "store"])
def test_zst_lines(spark, tmp_path, how):
    path = dump(tmp_path / "s.zst", SUBS, **({"window_log": 28} if how != "plain" else {}))
    got = dumps.decode(dumps.lines(spark, f"file://{path}" if how == "store" else path, how != "plain"), "submission")
    assert sorted(r["id"] for r in got.where("ok").collect()) == ["1", "2", "4"]
    assert dumps.bad_lines(got).first()["bad_lines"] == 2


def test_last_line_without_end(spark, tmp_path):
    path = dump(tmp_path / "s.zst", SUBS, end=b"")
    n = lambda **kw: dumps.lines(spark, path, True, **kw).count()
    assert n() == 4 and n(unterminated="keep") == 5


def test_required_parent(spark):
    rows = spark.createDataFrame([(json.dumps({"id": "1", "author": "a", "created_utc": 1, "body": "b", **p}),) for p in ({}, {"parent_id": "t3_x"})], "value string")
    assert [dumps.decode(rows, "comment", need).where("ok").count() for need in (False, True)] == [2, 1]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"\nnow', 1.5), (None, "y", None)], "a string, b string, c double")
    tables.write_csv(df, str(tmp_path / "csv"))
    assert {tuple(r) for r in tables.read_csv(spark, str(tmp_path / "csv"), "a string, b string, c double").collect()} == {tuple(r) for r in df.collect()}
    assert tables.read_csv(spark, str(tmp_path / "csv"), "a string, b string, c double", 1).count() == 1
    tables.write_params(spark, [("uid", "1e5"), ("k", "a:\tb")], str(tmp_path / "p"))
    assert {tuple(r) for r in tables.read_params(spark, str(tmp_path / "p")).collect()} == {("uid", "1e5"), ("k", "a:\tb")}
    lists = spark.createDataFrame([("['a', 'b']",), ('["it\'s"]',)], "s string").select(tables.string_list(F.col("s")))
    assert [r[0] for r in lists.collect()] == [["a", "b"], ["it's"]]
    runs = spark.createDataFrame([("r2", "threshold_in_days", "1"), ("r2", "end_buffer", "0"), ("r1", "end_buffer", "0"), ("r0", "threshold_in_days", "1"), ("r0", "end_buffer", "2")], "run_uid string, key string, value string")
    assert tables.unpadded(runs).first()[0] == "r2"
    assert spark.range(1).select(tables.community(F.lit("Chess_snapshots_x"))).first()[0] == "Chess"


def test_zstandard_files_by_spark(spark, tmp_path):
    """Frames, and line ends that are frames to skip, read back by both readers; empty parts do no harm."""
    lines = [(f'{{"n": {i}, "t": "é{i}"}}',) for i in range(2000)]
    df = spark.createDataFrame(lines, "value string").repartition(3).union(spark.createDataFrame([], "value string"))
    path = f"file://{tmp_path}/z"
    dumps.write_zst(df, path)
    assert sorted(r[0] for r in dumps.lines(spark, path, long_window=True).collect()) == sorted(x[0] for x in lines)
    files = ",".join(str(p) for p in (tmp_path / "z").glob("part-*"))
    assert dumps.lines(spark, files, long_window=True).count() == 2000


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_folders_of_zstandard_files(spark, tmp_path, scheme):
    """A folder reads alike however its path is written; marker files and folders without files give no lines."""
    at = f"{scheme}{tmp_path}/z"
    dumps.write_zst(spark.range(500).select(F.col("id").cast("string")).repartition(3), at)
    (tmp_path / "z" / "_marker").write_bytes(b"no frame")
    dump(tmp_path / "z" / "a,b.zst", [{"id": "1"}], window_log=28)
    got = [r[0] for r in dumps.lines(spark, at, long_window=True).collect()]
    assert sorted(got) == sorted([*map(str, range(500)), '{"id": "1"}'])
    (tmp_path / "none").mkdir()
    assert dumps.lines(spark, f"{scheme}{tmp_path}/none", long_window=True).count() == 0


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    from lexitide.sources.shared import Scratch
    from lexitide.streaming import live

    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    path = f"{tmp_path}/events"
    spark.createDataFrame([(1, 1, t(0)), (1, 2, t(24)), (2, 3, t(5))], "user_id long, event_id long, ts timestamp").coalesce(1).write.parquet(path)
    scratch = Scratch(spark, "t")
    run = lambda: sorted(tuple(r) for r in live.drain(live.running_experience(live.events(spark, path), 1.0), scratch, "x", "append").collect())
    first = run()
    spark.createDataFrame([(1, 4, t(48)), (1, 5, t(12))], "user_id long, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    both = run()
    one = 1 - 2.718281828459045 ** -1
    assert [r[:2] for r in both] == [(1, 1), (1, 2), (1, 4), (1, 5), (2, 3)] and set(first) < set(both)
    assert [r[2] for r in both] == pytest.approx([0, one, 2 * one, one, 0])  # the late row adds nothing
    assert run() == both


def test_intermediate_tables_go(spark):
    from pathlib import Path

    from lexitide.sources.shared import Scratch, temporary

    with temporary():
        scratch = Scratch(spark, "t")
        a, b = scratch.save(spark.range(5), "a"), scratch.save(spark.range(3), "b")
        at = Path(scratch.root.removeprefix("file://"))
        scratch.keep_only("b")
        assert b.count() == 3 and a.schema == b.schema and sorted(x.name for x in at.iterdir()) == ["b"]
    assert not at.exists()


def test_a_cluster_has_to_name_its_shared_folder():
    from types import SimpleNamespace

    from lexitide.sources.shared import shared_dir

    conf = SimpleNamespace(get=lambda key, default: default, set=None)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_command_line(spark, tmp_path):
    """Dumps of two years to averaged trajectories."""
    import random

    r = random.Random(5)
    words = ["the", "a", "cat", "dog", "sat", "ran", "on", "mat", "big", "red", "and", "then", "it", "was", "so"] + [f"w{i}" for i in range(60)]
    weights = [40 / (i + 1) for i in range(len(words))]
    subs, comments = [], []
    for i in range(900):
        body = " ".join(r.choices(words, weights, k=r.randint(8, 25))) + "."
        base = {"id": f"p{i}", "author": f"u{r.randint(0, 11)}", "created_utc": 1577836800 + r.randint(0, 180 * 86400)}
        if i % 3:
            comments.append(base | {"body": body, "parent_id": "t3_p0"})
        else:
            subs.append(base | {"title": "t", "num_comments": 1, "selftext": body})
    s, c = dump(tmp_path / "s.zst", subs), dump(tmp_path / "c.zst", comments)
    base = str(tmp_path / "community")
    (tmp_path / "snap.json").write_text(json.dumps({"users_per_month": 5, "posts_per_user": 4, "leave_unknown": 5}))
    (tmp_path / "traj.json").write_text(json.dumps({"num_phases": 4, "minimum_user_posts": 10, "min_instances": 20}))
    run = lambda *a: main([*a, "--base", base], spark)
    run("preprocess", "--submissions", s, "--comments", c)
    for n in (1, 2):
        run("snapshot", "--uid", f"ab{n}", "--run-number", str(n), "--config", str(tmp_path / "snap.json"))
        run("score", "--uid", f"ab{n}")
    run("progressive", "--uid", "ab1", "--month-delta", "1")
    run("trajectories", "--config", str(tmp_path / "traj.json"))
    run("trajectories", "--config", str(tmp_path / "traj.json"), "--high-post-limit", "80")
    run("average", "--strict")
    run("average", "--high-post-limit", "80")
    run("report", "--uid", "ab2", "--high-post-limit", "80")
    run("average-report")
    run("score", "--uid", "ab2", "--all-posts")
    run("characterize")
    run("experience", "--first", "2020-01-01", "--last", "2020-06-01", "--threshold", "20")
    read = lambda name: spark.read.parquet(f"{base}/{name}")
    shares = [read("experience_overall").first()["fraction"]]
    for threshold in ("182", None):  # no run has one, so half a year
        run("experience", "--first", "2020-01-01", "--last", "2020-06-01", *(["--threshold", threshold] if threshold else []))
        shares.append(read("experience_overall").first()["fraction"])
    assert shares[0] > shares[1] == shares[2]
    assert read("posts").count() == 900 and read("users").count() == 12
    assert read("run_uid=ab1/scores").join(read("run_uid=ab1/sample"), "post_id", "left_semi").count() == 0
    assert read("run_uid=ab1/scores").count() > 300
    assert {(r[0], r[1]) for r in read("trajectories/phase").select("high_post_limit", "run_uid").distinct().collect()} == {(n, u) for n in (80, 5000) for u in ("ab1", "ab2")}
    marked = read("run_uid=ab2/scores_all")
    assert marked.count() == 900 and marked.where("score = -999").count() == 900 - read("run_uid=ab2/scores").count()
    assert json.loads(spark.read.text(f"{base}/trajectories/options").first()[0])["num_phases"] == "4"
    assert "<svg" in spark.read.text(f"{base}/run_uid=ab2/report").first()[0] and read("average_hpl_80/phase").count() == 4
    average = read("average/phase").collect()
    assert len(average) == 4 and all(x["score"] > 0 and x["std_dev"] is not None for x in average)
    assert "<svg" in spark.read.text(f"{base}/average/report").first()[0]
    assert read("characteristics/tiers").first()["users"] == 12 and read("experience_by_month").count() == 5
