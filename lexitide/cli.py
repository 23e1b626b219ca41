"""``python -m lexitide COMMAND --base FOLDER``: the stages of the analysis over tables in one folder.

preprocess     compressed JSON-lines dumps to posts, users, experience
snapshot       a seeded sample and a language model for every month that may have one
score          posts by their own month's model
progressive    posts by the models of neighbouring months
trajectories   mean scores by life phase, posts, time, experience and length, of all runs at once
report         the pages of runs again, from stored trajectories
average        means and deviations over runs, with a report
average-report the page of the averages again, from stored tables
characterize   users, posts and months of the community, with a report
experience     share, mean and median of experience by month

Runs lie under run_uid=<uid>. --config names a JSON file with options (see config.py); others keep their defaults.
"""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide import config as options
from lexitide.operators import average, katz, months, reports, snapshots, trajectory, users
from lexitide.pipeline import Pipeline, trajectories
from lexitide.sources import dumps, tables

KINDS = {"phase": "phase", "posts": "posts", "weeks": "weeks", "pseudo_weeks": "pseudo_weeks", "ntokens": "ntokens", "user_phase": "phase", "user_posts": "posts", "user_posts_median": "posts"}


class Folder:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return tables.read_table(self.spark, f"{self.base}/{name}")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        tables.write_table(df, f"{self.base}/{name}")
        return self.read(name)

    def run(self, uid: str, name: str) -> str:
        return f"run_uid={uid}/{name}"

    def params(self) -> DataFrame:
        return tables.runs(self.spark, self.base, "parameters").withColumn("run_uid", F.col("run_uid").cast("string"))

    def page(self, name: str, *parts: str) -> None:
        """A report as one HTML file of text."""
        self.spark.createDataFrame([(reports.page(*parts, title=name),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.base}/{name}")


def preprocess(f: Folder, a) -> None:
    raw = dumps.both(dumps.lines(f.spark, a.submissions, a.long_window), dumps.lines(f.spark, a.comments, a.long_window))
    p = Pipeline(raw, _options(options.Preprocess, a), keep=f.write)
    f.write(dumps.bad_lines(p.raw), "bad_lines")


def _options(kind, a):
    return kind.load(a.config) if a.config else kind()


def snapshot(f: Folder, a) -> None:
    c = _options(options.Snapshot, a)
    pool = users.only(f.read("posts"), users.sampling_users(f.read("users"), c.min_user_posts), ["author"])
    first, last = months.model_range(str(f.read("users").agg(F.min("first_post")).first()[0]), c.start_buffer, c.end_buffer)
    pool = pool.where(F.trunc(F.col("true_date").cast("date"), "MM").between(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date")))
    table = f.write(snapshots.admitted(pool, c), f.run(a.uid, "months"))
    sampled = f.write(snapshots.sample(pool, c, a.run_number), f.run(a.uid, "sample"))
    model = snapshots.fit(sampled, c, keep=lambda df, name: f.write(df, f.run(a.uid, f"fit/{name}")))
    model.save(f"{f.base}/{f.run(a.uid, 'model')}")
    fitted = katz.Model.load(f.spark, f"{f.base}/{f.run(a.uid, 'model')}", ["month"]).groups.select("month", F.col("success").alias("fitted"), F.col("reason").alias("why"))
    done = table.join(fitted, "month", "left").withColumn("success", F.coalesce("fitted", F.lit(False)))
    run = months.longest_run(done).first()
    span = {"start_month": run[0].isoformat(), "end_month": run[1].isoformat()} if run else {}
    rows = [("uid", a.uid), ("run_number", str(a.run_number)), *((k, v) for k, v in c.rows() if v != "None"), *span.items()]
    f.write(f.spark.createDataFrame(rows, "key string, value string"), f.run(a.uid, "parameters"))


def _model(f: Folder, uid: str):
    return f.read(f.run(uid, "sample")), katz.Model.load(f.spark, f"{f.base}/{f.run(uid, 'model')}", ["month"])


def score(f: Folder, a) -> None:
    scored = f.write(snapshots.scores(f.read("posts"), *_model(f, a.uid)), f.run(a.uid, "scores"))
    if a.all_posts:  # all posts, those without a score marked by a number
        f.write(snapshots.unscored_as(f.read("posts").select("post_id"), scored), f.run(a.uid, "scores_all"))


def progressive(f: Folder, a) -> None:
    long = f.write(snapshots.progressive_scores(f.read("posts"), *_model(f, a.uid), a.month_delta), f.run(a.uid, "progressive"))
    f.write(snapshots.wide(long, a.uid), f.run(a.uid, "progressive_wide"))


def trajectorize(f: Folder, a) -> None:
    """All runs in one job for each kind, by run and by limit, so another limit does not overwrite."""
    t = _options(options.Trajectory, a)
    if a.high_post_limit:
        t = dataclasses.replace(t, remove_high_posters=True, high_post_limit=a.high_post_limit)
    scored = tables.runs(f.spark, f.base, "scores").withColumn("run_uid", F.col("run_uid").cast("string"))
    if a.uid:
        scored = scored.where(F.col("run_uid") == a.uid)
    got = trajectories(f.read("posts"), f.read("users"), scored, t, ("run_uid",))
    limit = F.lit(t.high_post_limit if t.remove_high_posters else 0)
    for kind, df in got.items():
        out = df.withColumn("high_post_limit", limit).repartition("run_uid")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("high_post_limit", "run_uid").parquet(f"{f.base}/trajectories/{kind}")
    rows = [(k, v) for k, v in trajectory.info(t)]
    f.write(f.spark.createDataFrame(rows, "key string, value string"), f"trajectories/info/high_post_limit={t.high_post_limit if t.remove_high_posters else 0}")
    tables.write_json(f.spark, dict(rows), f"{f.base}/trajectories/options")
    report(f, a)


def _trajectory(f: Folder, kind: str, limit: int | None) -> DataFrame:
    """The stored trajectories of a kind, of the limit given, or else of the highest one there is (0 stands for none)."""
    rows = f.read(f"trajectories/{kind}").withColumn("run_uid", F.col("run_uid").cast("string"))
    if limit is None:
        top = rows.agg(F.max("high_post_limit")).first()[0]
        limit = 0 if top is None else top
    return rows.where(F.col("high_post_limit") == limit).drop("high_post_limit")


def report(f: Folder, a) -> None:
    """The page of each run, from the stored trajectories: nothing is computed anew."""
    pages: dict[str, list[str]] = {}
    for kind, x in KINDS.items():
        got = _trajectory(f, kind, a.high_post_limit).where("score IS NOT NULL").orderBy("run_uid", x)
        columns = [c for c in got.columns if c != "run_uid"]
        runs: dict[str, list] = {}
        for r in (got.where(F.col("run_uid") == a.uid) if a.uid else got).collect():  # tens of rows a run
            runs.setdefault(r["run_uid"], []).append(r)
        for uid, rows in runs.items():
            pages.setdefault(uid, []).extend([reports.html_table(columns, [[r[c] for c in columns] for r in rows], kind), reports.svg_scatter([r[x] for r in rows], [r["score"] for r in rows], labels=(x, "score"))])
    for uid, parts in pages.items():
        f.page(f.run(uid, "report"), reports.html_table(["key", "value"], [("uid", uid)], uid), *parts)


def averages(f: Folder, a) -> None:
    params = f.params()
    uids = {r["run_uid"] for r in average.is_experience_run(params).where(F.col("is_exp") == a.exp).collect()}
    odd = average.inconsistent(params.where(F.col("run_uid").isin(sorted(uids)))).orderBy("key", "run_uid")
    out = _average_folder(a)
    if a.strict and not odd.isEmpty():
        raise ValueError(f"parameters differ between runs: {[tuple(r) for r in odd.limit(20).collect()]}")
    f.write(odd, f"{out}/inconsistent")
    for kind, x in KINDS.items():
        weight = "nusers" if kind.startswith("user_") else "nposts"
        rows = _trajectory(f, kind, a.high_post_limit).where(F.col("run_uid").isin(sorted(uids)))
        f.write(average.average(rows, x, weight, a.min_posts if weight == "nposts" else None), f"{out}/{kind}")
    average_report(f, a)


def _average_folder(a) -> str:
    return ("average_exp" if a.exp else "average") + (f"_hpl_{a.high_post_limit}" if a.high_post_limit else "")


def average_report(f: Folder, a) -> None:
    """The page of the averages, from the stored tables."""
    out = _average_folder(a)
    parts = [reports.html_table(["run_uid", "key", "value", "expected"], f.read(f"{out}/inconsistent").collect(), "parameters that differ")]
    for kind, x in KINDS.items():
        df = f.read(f"{out}/{kind}")
        got = df.where("score IS NOT NULL").orderBy(x).collect()
        xs, ys = [r[x] for r in got], [r["score"] for r in got]
        parts += [reports.html_table(df.columns, got, kind), reports.svg_scatter(xs, ys, [r["std_dev"] or 0 for r in got], reports.lowess(xs, ys), labels=(x, "score"))]
    f.page(f"{out}/report", *parts)


def characterize(f: Folder, a) -> None:
    people, posts = f.read("users"), f.read("posts")
    total = F.col("comments") + F.col("submissions")
    parts = {"posts": reports.post_statistics(posts), "users": reports.user_statistics(people), "users_several": reports.user_statistics(people.where(total > 1)), "users_fifty": reports.user_statistics(people.where(total >= 50)), "tiers": users.tiers(people), "months": months.spine(posts).orderBy("month")}
    shown = []
    for name, df in parts.items():
        df = f.write(df, f"characteristics/{name}")
        shown.append(reports.as_table(df, name))
    series = f.read("characteristics/months").orderBy("month").collect()
    f.page("characteristics/report", *shown, reports.svg_scatter([r["month_number"] for r in series], [r["posts"] for r in series], labels=("month", "posts")))


def experience(f: Folder, a) -> None:
    rows, threshold = f.read("posts"), a.threshold
    if threshold is None:
        threshold = _threshold(f)
    f.write(reports.experience_summary(rows, threshold), "experience_overall")
    f.write(reports.experience_by_month(rows, threshold, a.first, a.last), "experience_by_month")


def _threshold(f: Folder) -> float:
    """That of the first experience-gated run without an end buffer, or half a year if there is none."""
    try:
        params = f.params()
    except AnalysisException:  # no run yet
        return 182
    run = tables.unpadded(params).first()
    found = run and params.where((F.col("run_uid") == run[0]) & (F.col("key") == "threshold_in_days")).first()
    return float(found["value"]) if found else 182


COMMANDS = {"preprocess": preprocess, "snapshot": snapshot, "score": score, "progressive": progressive, "trajectories": trajectorize, "report": report, "average": averages, "average-report": average_report, "characterize": characterize, "experience": experience}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexitide", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        p.add_argument("--base", required=True)
        p.add_argument("--config")
        if name == "preprocess":
            p.add_argument("--submissions", required=True)
            p.add_argument("--comments", required=True)
            p.add_argument("--long-window", action="store_true")
        if name in ("snapshot", "score", "progressive", "trajectories", "report"):
            p.add_argument("--uid", required=name not in ("trajectories", "report"))
        if name == "score":
            p.add_argument("--all-posts", action="store_true")
        if name == "snapshot":
            p.add_argument("--run-number", type=int, default=1)
        if name == "progressive":
            p.add_argument("--month-delta", type=int, required=True)
        if name in ("trajectories", "report", "average", "average-report"):
            p.add_argument("--high-post-limit", type=int)
        if name in ("average", "average-report"):
            p.add_argument("--exp", action="store_true")
        if name == "average":
            p.add_argument("--min-posts", type=float)
            p.add_argument("--strict", action="store_true", help="stop if parameters differ between runs")
        if name == "experience":
            p.add_argument("--threshold", type=float)
            p.add_argument("--first", required=True)
            p.add_argument("--last", required=True)
    return top


def main(argv: list[str], spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"lexitide {a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    COMMANDS[a.command](Folder(spark, a.base), a)
