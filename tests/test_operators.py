from __future__ import annotations

import datetime
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitide import config
from lexitide.functions import dates, text
from lexitide.operators import average, clean, months, reports, sampling, timeline, trajectory, users
from lexitide.operators.medians import medians


def values(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_phase_split(spark):
    df = spark.createDataFrame([("a", i, 5, float(s)) for i, s in enumerate((4, 6, 8, 2, 10))], "author string, post_number long, total_user_posts long, score double")
    got = trajectory.weighted(trajectory.by_phase(df, 2), "phase")
    assert values(got, "phase", F.round("score", 9), "nposts") == [(1.0, 5.6, 2.5), (2.0, 6.4, 2.5)]


@pytest.mark.parametrize("total,phases", [(1, 1), (5, 5), (7, 3), (50, 20), (64, 20)])
def test_phase_weights_add_up_to_posts(spark, total, phases):
    df = spark.createDataFrame([("a", i, total, 0.0 if i == 3 else 1.5) for i in range(total)], "author string, post_number long, total_user_posts long, score double")
    got = trajectory.by_phase(df, phases).agg(F.sum("weight"), F.min("stage"), F.max("stage")).first()
    assert abs(got[0] - (total - (total > 3))) < 1e-9 and got[1] == 1 and got[2] <= phases


@pytest.mark.parametrize("sizes,want", [({1: 100, 2: 80, 3: 40, 4: 60}, 3), ({1: 100, 2: 80, 3: 60, 4: 55}, 3), ({1: 10}, 0), ({1: 60}, 0)])
def test_last_stage(spark, sizes, want):
    df = spark.createDataFrame([(s,) for s, n in sizes.items() for _ in range(n)], "stage int")
    rows = df.withColumn("score", F.lit(2.0)).withColumn("weight", F.lit(1.0))
    assert values(trajectory.weighted(rows, "x", 10, 50), "x") == [(10.0 * i,) for i in range(1, want + 1)]


def test_experience(spark):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    rows = [("a", 1, day(0)), ("a", 2, day(2)), ("a", 3, day(6)), ("b", 4, day(0)), ("b", 5, day(3)), ("c", 6, day(1))]
    df = spark.createDataFrame(rows, "author string, post_id long, true_date timestamp_ntz")
    got = {r[0]: (r[1], r[2]) for r in timeline.experience(df).select("post_id", "dt", F.round("experience", 6)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: None, 2: 2.0, 3: 4.0, 4: None, 5: 3.0, 6: None}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({1: 0, 2: 1.459749, 3: 3.668958, 4: 0, 5: 1.896362, 6: 0}, abs=2e-6)
    single = timeline.experience(df.where("author = 'c'")).collect()
    assert [r["experience"] for r in single] == [0.0]


def test_mean_gap_of_spans_beyond_a_long_in_sum(spark):
    """Forty thousand authors, each with posts ten years apart, and one with a gap of a day."""
    first = F.lit(datetime.datetime(1995, 1, 1)).cast("timestamp_ntz")
    days = F.explode(F.array(F.lit(0), F.when(F.col("id") == 0, 1).otherwise(3650)))
    rows = spark.range(40_000).select(F.col("id").alias("author"), days.alias("post_id")).withColumn("true_date", F.timestamp_add("DAY", F.col("post_id"), first))
    assert timeline.mean_gap(rows).first()[0] == pytest.approx((3650 * 39_999 + 1) / 40_000, rel=1e-12)


@pytest.mark.parametrize("flags,want", [("FTTFTT", (1, 2)), ("TTT", (0, 2)), ("FF", None), ("TFTT", (2, 3))])
def test_longest_run(spark, flags, want):
    df = spark.createDataFrame([(datetime.date(2020, i + 1, 1), f == "T") for i, f in enumerate(flags)], "month date, success boolean")
    got = months.longest_run(df).first()
    assert (got and (got[0].month - 1, got[1].month - 1)) == want


def test_month_range():
    assert months.model_range("2012-12-05") == (datetime.date(2013, 1, 1), datetime.date(2022, 11, 1))
    assert months.model_range("2000-01-01", 1, 1) == (datetime.date(2006, 6, 1), datetime.date(2022, 11, 1))


def test_average_over_runs(spark):
    df = spark.createDataFrame([("r1", 1, 2.0, 10.0), ("r2", 1, 4.0, 30.0), ("r1", 2, 5.0, 7.0)], "run_uid string, phase int, score double, nposts double")
    assert values(average.average(df, "phase")) == [(1, 3.0, pytest.approx(2**0.5), 10.0), (2, 5.0, None, 7.0)]
    assert values(average.average(df, "phase", min_posts=8), "phase") == [(1,)]


def test_cleaning(spark):
    url = spark.createDataFrame([("see HTTPS://a.b/c?d=1, ok",), ("http://x",), (None,)], "t string")
    assert [r[0] for r in url.select(text.clean(F.col("t"))).collect()] == ["see , ok", "", None]
    rows = [("a", "fine"), ("[deleted]", "x"), ("AutoModerator", "x"), ("a", "was [removed] here"), ("a", "nan"), ("a", ""), ("a", None), (None, "x"), ("b", "NaN")]
    got = clean.cleaned(spark.createDataFrame(rows, "author string, text string"))
    assert values(got) == [("a", "fine"), ("b", "NaN")]
    echo = spark.createDataFrame([("a", "text"), ("author", "x"), ("b", None), ("c", "y")], "author string, text string")
    assert values(clean.without_header_echo(echo), "author") == [("b",), ("c",)]


def test_post_rows(spark):
    schema = "kind string, id string, author string, created_utc string, title string, selftext string, body string, parent_id string, num_comments string"
    raw = spark.createDataFrame([("submission", "s", "a", "1577836800.9", "T\nT", "two\r\nlines", None, "t3_z", "4"), ("comment", "c", "a", "1577836801", None, None, "reply", "t3_s", None), ("comment", "d", "a", "1577836802", "t", None, None, "t1_c", "9")], schema)
    start = datetime.datetime(2020, 1, 1)
    second = datetime.timedelta(seconds=1)
    want = [("c", "comment", "a", start + second, "", "reply", "t3_s", 0), ("s", "submission", "a", start, "TT", "twolines", "", 4)]
    assert values(clean.posts(raw)) == want
    assert values(clean.posts(raw, False))[1] == ("d", "comment", "a", start + 2 * second, "", "", "t1_c", 0)
    assert values(clean.activity(raw), "post_id", "top_level", "parent_id") == [("c", True, ""), ("d", False, ""), ("s", True, "")]


def test_tokens(spark):
    df = spark.createDataFrame([("How do I? Thanks.",), ("it's",), ("",), (None,), ("... a",)], "t string")
    got = [r[0] for r in df.select(text.padded(F.col("t"))).collect()]
    assert got == [["<s>", "How", "do", "I", "?", "</s>", "<s>", "Thanks", ".", "</s>"], ["<s>", "it's", "</s>"], [], [], ["<s>", "...", "</s>", "<s>", "a", "</s>"]]
    assert [r[0] for r in df.select(text.sentences(F.col("t"))).collect()][0] == [["How", "do", "I", "?"], ["Thanks", "."]]
    pairs = df.select(text.bigrams(text.padded(F.col("t")))).collect()
    assert [tuple(x) for x in pairs[1][0]] == [("<s>", "it's"), ("it's", "</s>")] and pairs[2][0] == []
    assert df.select(text.truncated(text.tokens(F.col("t")), 2)).first()[0] == ["How", "do"]


def test_samples_have_exact_sizes_and_ignore_order(spark):
    rows = [(m, a, 100 * a + 10 * i + m) for m in (1, 2) for a in range(30) for i in range(4)]
    df = spark.createDataFrame(rows, "month int, author int, post_id long")
    draw = lambda d, seed: values(sampling.sample_posts(users.only(d, sampling.sample_users(d.select("month", "author").distinct(), 5, seed), ["month", "author"]), 2, seed))
    a = draw(df.repartition(7), 1)
    assert len(a) == 2 * 5 * 2 and a == draw(df.orderBy(F.desc("post_id")), 1) and a != draw(df, 2)
    assert sampling.grid(a=[1, 2], b=["x"]) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    assert {r["part"] for r in sampling.split(df, "author").select("part").distinct().collect()} == {"train", "validation"}


def test_month_rules_in_order(spark):
    rows = [(datetime.datetime(2020, m, 1), f"u{i % people}", i) for m, n, people in ((1, 3, 3), (2, 9, 3), (3, 9, 9), (4, 8, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "true_date timestamp_ntz, author string, post_id long")
    got = {r["month"].month: r["reason"] for r in months.month_table(df, 2, 2).collect()}
    assert got == {1: "posts", 2: "users", 3: "candidates", 4: None}


def test_numbers_break_ties_by_key(spark):
    df = spark.createDataFrame([("a", 5, 2), ("a", 5, 1), ("b", 1, 3)], "author string, seconds long, post_id long")
    assert values(timeline.numbered(df), "post_id", "post_number", "total_user_posts") == [(1, 0, 2), (2, 1, 2), (3, 0, 1)]


def test_bins_truncate_and_skip_nulls(spark):
    df = spark.createDataFrame([(0.0, 1.0), (27.9, 2.0), (28.0, 0.0), (None, 3.0)], "experience double, score double")
    assert values(trajectory.by_bin(df, trajectory.experience_stage(28)), "stage", "weight") == [(1, 1.0), (1, 1.0), (2, 0.0)]
    assert spark.range(1).select(dates.whole_bin(F.lit(59), 10)).first()[0] == 6


def test_epoch_seconds_that_no_timestamp_holds_are_null(spark):
    df = spark.createDataFrame([(x,) for x in ("4102444800", "-1.5", "x", "nan", "inf", "1e300", "99999999999999", None)], "s string")
    got = [r[0] for r in df.select(dates.from_epoch(F.col("s"))).collect()]
    assert got == [datetime.datetime(2100, 1, 1), datetime.datetime(1969, 12, 31, 23, 59, 59)] + 6 * [None]


def test_user_averages_leave_out_first_posts(spark):
    df = spark.createDataFrame([("a", 0, 9.0), ("a", 1, 2.0), ("b", 1, 4.0), ("b", 2, 0.0)], "author string, post_number long, score double")
    assert values(trajectory.user_averaged(trajectory.by_number(df, 5), "posts")) == [(1, 3.0, 2), (2, None, 1)]


def test_reports():
    x = list(range(40))
    assert reports.lowess(x, [2 * v + 1 for v in x], 0.3) == pytest.approx([2 * v + 1 for v in x])
    spiky = [v + (v * 7 % 5 - 2) / 4 for v in x]
    spiky[20] = 500
    assert abs(reports.lowess(x, spiky, 0.4)[20] - 20) < 3
    page = reports.page(reports.as_table({"<a>": 1.5}, "t&t"), reports.svg_scatter([1, 2], [3, 4], [0.1, 0]))
    assert "&lt;a&gt;" in page and "t&amp;t" in page and page.count("<circle") == 2
    assert reports.as_table([{"a": 1}, {"b": 2}]).count("<th>") == 2


def plain_lowess(x, y, fraction, rounds=3):
    """Point by point from the definition: weighted least squares by normal equations, with sorted distances."""
    n = len(x)
    k = min(n, max(2, int(fraction * n + 1e-10)))
    trust, fit = [1.0] * n, list(y)
    for _ in range(rounds + 1):
        fit = []
        for i in range(n):
            reach = sorted(abs(v - x[i]) for v in x)[k - 1]
            weight = []
            for j in range(n):
                d = abs(x[j] - x[i])
                tri = 1.0 if d <= 0.001 * reach else (1 - (d / reach) ** 3) ** 3 if d < 0.999 * reach else 0.0
                weight.append(tri * trust[j])
            rows = np.array([[1.0, v - x[i]] for v in x])
            w = np.array(weight)
            if not w.sum():
                fit.append(y[i])
                continue
            left, right = (rows * w[:, None]).T @ rows, (rows * w[:, None]).T @ np.array(y)
            fit.append(float(np.linalg.solve(left, right)[0]) if abs(np.linalg.det(left)) > 1e-9 * w.sum() ** 2 else float(right[0] / left[0, 0]))
        error = [abs(a - b) for a, b in zip(y, fit, strict=True)]
        scale = 6 * statistics.median(error)
        if scale <= 1e-12:
            break
        trust = [max(0.0, 1 - (e / scale) ** 2) ** 2 for e in error]
    return fit


@pytest.mark.parametrize("seed,fraction", [(1, 0.3), (2, 0.5), (3, 0.2)])
def test_smoothing_against_its_definition(spark, seed, fraction):
    r = np.random.default_rng(seed)
    x = np.sort(r.uniform(0, 20, 45))
    y = np.sin(x / 3) * 4 + r.normal(0, 0.4, 45)
    y[r.integers(0, 45, 3)] += 9
    want = plain_lowess(x.tolist(), y.tolist(), fraction)
    assert reports.lowess(x, y, fraction) == pytest.approx(want, abs=1e-7)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y, strict=True)], "g string, x double, y double")
    assert [row["fit"] for row in reports.smoothed(df, "x", "y", "g", fraction).orderBy("x").collect()] == pytest.approx(want, abs=1e-7)


def test_medians(spark):
    r = np.random.default_rng(7)
    groups = {"a": r.normal(0, 1, 1001), "b": r.integers(0, 3, 500).astype(float), "c": np.array([4.0]), "d": np.array([1.0, 2.0]), "e": np.full(300, -7.5), "f": np.array([-1e300, 1e300, 5.0, 6.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("z", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {x["g"]: (x["m"], x["half"]) for x in medians(df, {"m": F.col("v"), "half": F.col("v") / 2}, ["g"]).collect()}
    assert got == {g: (float(np.median(v)), float(np.median(v / 2))) for g, v in groups.items()}
    assert medians(df, {"m": F.col("v")}).first()["m"] == float(np.median(np.concatenate(list(groups.values()))))
    assert medians(df.where("false"), {"m": F.col("v")}).first()["m"] is None


def test_all_runs_at_once_are_each_run_alone(spark):
    rows = [(run, a, n, float(n % 5 + a)) for run in ("r1", "r2") for a in range(6) for n in range(10 + 3 * a) if (run, a) != ("r2", 3)]
    df = spark.createDataFrame(rows, "run_uid string, author int, post_number long, score double")
    dealt = trajectory.by_bin(df, trajectory.posts_stage(4))
    both = trajectory.weighted(dealt, "posts", 4, 8, by=("run_uid",))
    for run in ("r1", "r2"):
        alone = trajectory.weighted(dealt.where(F.col("run_uid") == run), "posts", 4, 8)
        assert values(both.where(F.col("run_uid") == run), "posts", "score", "nposts") == values(alone, "posts", "score", "nposts") != []
        own = trajectory.user_averaged(dealt.where(F.col("run_uid") == run), "posts")
        assert values(trajectory.user_averaged(dealt, "posts", by=("run_uid",)).where(F.col("run_uid") == run), *own.columns) == values(own)
    assert values(trajectory.weighted(dealt.where("false"), "posts", 4, 8)) == []


def test_authors_without_profile_are_an_error_when_asked_for(spark):
    posts = spark.createDataFrame([("a", datetime.datetime(2020, 1, 2)), ("b", datetime.datetime(2020, 1, 3))], "author string, created timestamp_ntz")
    people = spark.createDataFrame([("a", datetime.datetime(2020, 1, 1))], "author string, first_post timestamp_ntz")
    assert values(timeline.seconds(posts, people), "author", "user_seconds") == [("a", 86400), ("b", None)]
    assert timeline.seconds(posts.where("author = 'a'"), people, strict=True).count() == 1
    with pytest.raises(Exception, match="no profile of author b"):
        timeline.seconds(posts, people, strict=True).collect()


def test_month_names(spark):
    df = spark.createDataFrame([("march",), ("MAR",), ("May",), ("sept",), (None,), ("December",)], "n string")
    assert [r[0] for r in df.select(dates.month_number(F.col("n"))).collect()] == [3, 3, 5, None, None, 12]
    one = spark.range(1).select(dates.month_name(F.lit("2024-02-10").cast("date")), dates.month_end(F.lit("2024-02-10").cast("date")), text.uid_of(F.lit("a"), F.lit(1))).first()
    assert (one[0], one[1], len(one[2])) == ("February", datetime.date(2024, 2, 29), 8)
    assert len(text.new_uid()) == 8 and text.new_uid() != text.new_uid()


def test_plot_filter(spark):
    df = spark.range(5)
    assert [df.where(clean.compare("id", op, 2)).count() for op in ("==", "<=", ">=", "?")] == [1, 3, 3, 3]


def test_options(tmp_path):
    (tmp_path / "c.json").write_text('{"users_per_month": 3, "unknown": 1}')
    got = config.Snapshot.load(str(tmp_path / "c.json"))
    assert got.users_per_month == 3 and got.posts_per_user == 2 and ("max_discount", "0.9") in got.rows()
