"""Queries over events and orders: profiles, timelines, months, samples, trajectories, averages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.config import Snapshot
from lexitide.functions import dates, text
from lexitide.operators import average, clean, months, reports, sampling, snapshots, timeline, trajectory, users
from lexitide.sources.shared import Scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def events(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("post_id"), F.col("user_id").alias("author"), F.col("ts").alias("true_date"), "event_type", F.col("value").alias("score"), "props")


def orders(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("true_date"), F.col("o_totalprice").alias("score"), "o_orderstatus", "o_orderpriority")


def numbered_events(spark, d):
    return timeline.numbered(events(spark, d), order=("true_date", "post_id"))


EVENTS = "e AS (SELECT event_id AS post_id, user_id AS author, ts AS true_date, event_type, value AS score FROM events)"
NUMBERED = EVENTS + """,
n AS (SELECT *, count(*) OVER (PARTITION BY author) AS total_user_posts, row_number() OVER (PARTITION BY author ORDER BY true_date, post_id) - 1 AS post_number FROM e)"""
PHASES = NUMBERED + """,
p AS (SELECT *, total_user_posts / 20.0::DOUBLE AS p, post_number::DOUBLE AS m FROM n WHERE score <> 0),
q AS (SELECT *, CAST(trunc(m / p) AS INTEGER) + 1 AS stage, least(p - m % p, 1.0::DOUBLE) AS f FROM p),
w AS (SELECT author, score, stage, f AS weight FROM q WHERE f > 0 UNION ALL SELECT author, score, stage + 1, 1 - f FROM q WHERE 1 - f > 0)"""
PROFILE = """u AS (
  SELECT o_custkey AS author, min(o_orderdate) AS first_post, max(o_orderdate) AS last_post, count(*) FILTER (WHERE o_orderstatus = 'O') AS submissions,
         count(*) FILTER (WHERE o_orderstatus <> 'O') AS comments, count(*) FILTER (WHERE o_orderstatus <> 'O' AND o_orderpriority < '4') AS top_level_comments
  FROM orders GROUP BY 1)"""


def _profile(spark, d):
    return users.profiles(orders(spark, d), "author", "true_date", F.col("o_orderstatus") == "O", F.col("o_orderpriority") < "4")


@query(f"WITH {PHASES} SELECT stage::DOUBLE AS phase, round(sum(score * weight) / sum(weight), 6) AS score, round(sum(weight), 6) AS nposts FROM w GROUP BY stage")
def traj_phase(spark, d):
    """Mean score by life phase: the flagship."""
    got = trajectory.weighted(trajectory.by_phase(numbered_events(spark, d), 20), "phase")
    return rounded(got.drop("avg_ntokens"), "score", "nposts")


@query(f"WITH {PROFILE} SELECT * FROM u")
def user_profile(spark, d):
    return _profile(spark, d)


@query(f"WITH {PROFILE} SELECT author, top_level_comments + submissions AS total_posts FROM u WHERE top_level_comments + submissions BETWEEN 5 AND 12")
def good_users(spark, d):
    return users.trajectory_users(_profile(spark, d), 5, 12).select("author", "total_posts")


@query(f"WITH {PROFILE} SELECT author FROM u WHERE top_level_comments >= 3")
def sampling_users(spark, d):
    return users.sampling_users(_profile(spark, d), 3).select("author")


@query(f"WITH {PROFILE} SELECT author FROM u WHERE last_post <= TIMESTAMP '2001-06-30' - INTERVAL 336 DAY")
def ended_users(spark, d):
    return users.ended_users(_profile(spark, d), 48, "2001-06-30").select("author")


@query(f"WITH {PROFILE} SELECT author FROM u WHERE date_diff('second', first_post, last_post) >= 31536000 AND comments + submissions >= 5")
def persistent_users(spark, d):
    return users.persistent(_profile(spark, d), 31536000, 5).select("author")


@query(f"WITH {PROFILE} SELECT count(*) AS users, count(*) FILTER (WHERE comments + submissions = 1) AS one_post, count(*) FILTER (WHERE comments + submissions > 1) AS several, count(*) FILTER (WHERE comments + submissions >= 50) AS fifty FROM u")
def user_tiers(spark, d):
    return users.tiers(_profile(spark, d))


@query(f"WITH {NUMBERED} SELECT post_id, author, total_user_posts, post_number FROM n")
def post_numbering(spark, d):
    return numbered_events(spark, d).select("post_id", "author", "total_user_posts", F.col("post_number").cast("long").alias("post_number"))


@query(f"WITH {EVENTS} SELECT post_id, author, date_sub('second', (SELECT min(true_date) FROM e), true_date) AS seconds, date_sub('second', min(true_date) OVER (PARTITION BY author), true_date) AS user_seconds FROM e")
def seconds_since_start(spark, d):
    return timeline.seconds(events(spark, d), None, "true_date").select("post_id", "author", "seconds", "user_seconds")


@query(f"WITH {EVENTS} SELECT post_id, TIMESTAMP '2024-01-01' + to_seconds(date_sub('second', (SELECT min(true_date) FROM e), true_date)) AS true_date FROM e")
def true_dates(spark, d):
    rows = timeline.seconds(events(spark, d), None, "true_date")
    return timeline.dated(rows, "2024-01-01 00:00:00").select("post_id", "true_date")


GAPS = EVENTS + """,
g AS (SELECT *, (epoch_us(true_date) - epoch_us(lag(true_date) OVER (PARTITION BY author ORDER BY true_date, post_id))) / 86400000000.0::DOUBLE AS dt FROM e),
k AS (SELECT avg(dt) AS k FROM g),
x AS (SELECT g.*, sum(CASE WHEN dt IS NULL THEN 0 ELSE k * (1 - exp(-dt / k)) END) OVER (PARTITION BY author ORDER BY true_date, post_id ROWS UNBOUNDED PRECEDING) AS experience FROM g, k)"""


@query(f"WITH {GAPS} SELECT post_id, round(dt, 6) AS dt, round(experience, 6) AS experience FROM x")
def experience(spark, d):
    return rounded(timeline.experience(events(spark, d)).select("post_id", "dt", "experience"), "dt", "experience")


@query(f"WITH {GAPS} SELECT round(k, 6) AS k FROM k")
def mean_gap(spark, d):
    return rounded(timeline.mean_gap(events(spark, d)), "k")


ORDERS = "o AS (SELECT o_orderkey AS post_id, o_custkey AS author, o_orderdate AS true_date, o_totalprice AS score, date_trunc('month', o_orderdate)::DATE AS month FROM orders)"
ORDER_GAPS = ORDERS + """,
g AS (SELECT *, (epoch_us(true_date) - epoch_us(lag(true_date) OVER (PARTITION BY author ORDER BY true_date, post_id))) / 86400000000.0::DOUBLE AS dt FROM o),
k AS (SELECT avg(dt) AS k FROM g),
x AS (SELECT g.*, sum(CASE WHEN dt IS NULL THEN 0 ELSE k * (1 - exp(-dt / k)) END) OVER (PARTITION BY author ORDER BY true_date, post_id ROWS UNBOUNDED PRECEDING) AS experience FROM g, k)"""


@query(
    f"WITH {ORDER_GAPS} SELECT year(true_date) || '-' || month(true_date) AS true_month, round_even(count(*) FILTER (WHERE experience > 500) / count(*), 3) AS fraction, "
    "round_even(avg(experience), 1) AS avg_exp, round_even(median(experience), 1) AS median_exp FROM x WHERE true_date BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '2001-06-01' GROUP BY 1"
)
def experience_by_month(spark, d):
    return reports.experience_by_month(timeline.experience(orders(spark, d)), 500, "1995-03-01", "2001-06-01")


@query(f"WITH {ORDER_GAPS} SELECT round_even(count(*) FILTER (WHERE experience > 500) / count(*), 3) AS fraction, round_even(avg(experience), 1) AS avg_exp, round_even(median(experience), 1) AS median_exp FROM x")
def experience_overall(spark, d):
    return reports.experience_summary(timeline.experience(orders(spark, d)), 500)


MONTHS = ORDERS + """,
a AS (SELECT month, author, count(*) AS n FROM o GROUP BY ALL),
t AS (SELECT month, sum(n)::BIGINT AS nposts, count(*) AS nusers, count(*) FILTER (WHERE n >= 1) AS cand_users FROM a GROUP BY month),
m AS (SELECT *, CASE WHEN nposts < 180 THEN 'posts' WHEN nusers < 180 THEN 'users' WHEN cand_users < 90 THEN 'candidates' END AS reason FROM t)"""


@query(f"WITH {MONTHS} SELECT *, reason IS NULL AS success FROM m")
def month_table(spark, d):
    return months.month_table(orders(spark, d), 90, 1)


@query(
    f"""WITH {ORDER_GAPS},
a AS (SELECT month, author, count(*) AS n, count(*) FILTER (WHERE experience >= 182) AS above FROM x GROUP BY ALL),
t AS (SELECT month, sum(n)::BIGINT AS nposts, count(*) AS nusers, count(*) FILTER (WHERE above >= 1) AS cand_users, sum(above)::BIGINT AS nposts_above FROM a GROUP BY month),
m AS (SELECT *, CASE WHEN nposts_above < 120 THEN 'posts' WHEN cand_users < 60 THEN 'candidates' END AS reason FROM t)
SELECT *, reason IS NULL AS success FROM m"""
)
def month_table_gated(spark, d):
    return months.month_table(timeline.experience(orders(spark, d)), 60, 1, gate=F.coalesce(F.col("experience") >= 182, F.lit(False)))


@query(
    f"""WITH {ORDERS}, s AS (SELECT unnest(generate_series((SELECT min(month) FROM o)::TIMESTAMP, (SELECT max(month) FROM o)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month),
c AS (SELECT month, count(*) AS posts FROM o GROUP BY 1)
SELECT s.month, row_number() OVER (ORDER BY s.month) AS month_number, coalesce(posts, 0) AS posts FROM s LEFT JOIN c USING (month)"""
)
def posts_per_month_spine(spark, d):
    return months.spine(orders(spark, d))


@query(
    f"""WITH {MONTHS}, i AS (SELECT *, row_number() OVER (ORDER BY month) AS i FROM m),
g AS (SELECT month, i - row_number() OVER (ORDER BY month) AS g FROM i WHERE reason IS NULL),
r AS (SELECT min(month) AS start_month, max(month) AS end_month, count(*) AS months FROM g GROUP BY g)
SELECT * FROM r ORDER BY months DESC, start_month LIMIT 1"""
)
def longest_month_run(spark, d):
    return months.longest_run(months.month_table(orders(spark, d), 90, 1))


SAMPLED = ORDERS + """,
a AS (SELECT DISTINCT month, author FROM o),
su AS (SELECT month, author FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY md5('7:' || month || ':' || author), author) AS n FROM a) WHERE n <= 20),
sp AS (SELECT month, author, post_id FROM (SELECT o.*, row_number() OVER (PARTITION BY month, author ORDER BY md5('7:' || post_id), post_id) AS n FROM o SEMI JOIN su USING (month, author)) WHERE n <= 1)"""


def _monthly(spark, d):
    return orders(spark, d).withColumn("month", dates.month(F.col("true_date")))


def _sampled_users(spark, d):
    return sampling.sample_users(_monthly(spark, d).select("month", "author").distinct(), 20, 7)


def _sampled_posts(spark, d):
    return sampling.sample_posts(users.only(_monthly(spark, d), _sampled_users(spark, d), ["month", "author"]), 1, 7)


@query(f"WITH {SAMPLED} SELECT month, author FROM su")
def sampled_users(spark, d):
    return _sampled_users(spark, d)


@query(f"WITH {SAMPLED} SELECT month, author, post_id FROM sp")
def sampled_posts(spark, d):
    return _sampled_posts(spark, d).select("month", "author", "post_id")


GATED = Snapshot(users_per_month=60, posts_per_user=1, threshold_in_days=182)


@query(
    f"""WITH {ORDER_GAPS},
a AS (SELECT month, author, count(*) FILTER (WHERE experience >= 182) AS above FROM x GROUP BY ALL),
ok AS (SELECT month FROM a GROUP BY month HAVING sum(above) >= 120 AND count(*) FILTER (WHERE above >= 1) >= 60),
pool AS (SELECT * FROM x WHERE experience >= 182 AND month IN (SELECT month FROM ok)),
c AS (SELECT DISTINCT month, author FROM pool),
su AS (SELECT month, author FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY md5('7:' || month || ':' || author), author) AS n FROM c) WHERE n <= 60)
SELECT month, author, post_id FROM (SELECT pool.*, row_number() OVER (PARTITION BY month, author ORDER BY md5('7:' || post_id), post_id) AS n FROM pool SEMI JOIN su USING (month, author)) WHERE n <= 1"""
)
def gated_sample(spark, d):
    """The sample of authors and posts above the threshold of experience, of months that have enough of both."""
    rows = Scratch(spark, "gated").save(timeline.experience(orders(spark, d)).select("post_id", "author", "true_date", "experience"), "experience")
    return snapshots.sample(rows, GATED, 7).select("month", "author", "post_id")


@query("SELECT o_orderkey AS post_id, user_seconds FROM (SELECT o_orderkey, date_sub('second', min(o_orderdate) OVER (PARTITION BY o_custkey), o_orderdate) AS user_seconds FROM orders) WHERE user_seconds BETWEEN 8640000 AND 86400000")
def user_seconds_range(spark, d):
    return timeline.within(timeline.seconds(orders(spark, d), None, "true_date"), 8640000, 86400000).select("post_id", "user_seconds")


@query("SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month, monthname(o_orderdate) AS name, month(o_orderdate)::INTEGER AS number, last_day(o_orderdate) AS last, strftime(date_trunc('month', o_orderdate), '%Y/%m/%d') AS shown FROM orders")
def month_names(spark, d):
    month = dates.month(F.col("true_date"))
    rows = orders(spark, d).select(month.alias("month")).distinct()
    name = dates.month_name(F.col("month"))
    return rows.select("month", name.alias("name"), dates.month_number(F.lower(F.substring(name, 1, 3))).alias("number"), dates.month_end(F.col("month")).alias("last"), dates.formatted(F.col("month"), "yyyy/MM/dd").alias("shown"))


@query("SELECT n_name, substr(md5(n_regionkey::VARCHAR || ':' || n_name), 1, 8) AS uid FROM nation")
def run_uids(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select("n_name", text.uid_of(F.col("n_regionkey"), F.col("n_name")).alias("uid"))


@query(f"WITH {PROFILE} SELECT post_id, author, date_sub('second', first_post, true_date) AS user_seconds FROM (SELECT o_orderkey AS post_id, o_custkey AS author, o_orderdate AS true_date FROM orders) JOIN u USING (author)")
def first_post_join(spark, d):
    """Seconds since the first post in the author's profile; an author without one would be an error."""
    return timeline.seconds(orders(spark, d), _profile(spark, d), "true_date", strict=True).select("post_id", "author", "user_seconds")


@query(f"WITH {SAMPLED} SELECT post_id FROM o ANTI JOIN sp USING (post_id)")
def training_exclusion(spark, d):
    return users.without(orders(spark, d), _sampled_posts(spark, d), ["post_id"]).select("post_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def dedupe_first(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return clean.first_of(rows, ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")])


@query("SELECT o_custkey AS author, CASE WHEN ('0x' || substr(md5('42:' || o_custkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.8 THEN 'train' ELSE 'validation' END AS part FROM (SELECT DISTINCT o_custkey FROM orders)")
def split_users(spark, d):
    return sampling.split(orders(spark, d).select("author").distinct(), "author")


@query("SELECT event_id AS post_id, (props ->> '$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return events(spark, d).select("post_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id AS post_id, event_type, NOT (event_type = 'click' AND value < 10) AS top_level FROM events")
def activity_flags(spark, d):
    """Clicks of low value stand for comments that answer comments."""
    parent = F.when(F.col("score") < 10, "t1_x").otherwise("t3_x")
    kind = F.when(F.col("event_type") == "click", "comment").otherwise("submission")
    return events(spark, d).select("post_id", "event_type", clean.top_level(kind, parent).alias("top_level"))


def _binned(sql_stage: str, x: str, scale: str, least: int, source: str, extra: str = "", digits: int = 6) -> str:
    return f"""WITH {source}{extra},
b AS (SELECT *, {sql_stage} AS stage, CASE WHEN score = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS weight FROM src),
z AS (SELECT stage, count(*) AS n FROM b WHERE stage IS NOT NULL GROUP BY stage),
l AS (SELECT CASE WHEN count(*) FILTER (WHERE n >= {least}) = count(*) THEN count(*) - 1 ELSE count(*) FILTER (WHERE n >= {least}) END AS m FROM z),
s AS (SELECT unnest(range(1, (SELECT m FROM l) + 1))::INTEGER AS stage),
sums AS (SELECT stage, sum(score * weight) AS s, sum(weight) AS w FROM b GROUP BY stage)
SELECT s.stage * {scale}::DOUBLE AS {x}, round(sums.s / nullif(w, 0), {digits}) AS score, round(coalesce(w, 0), 6) AS nposts FROM s LEFT JOIN sums USING (stage)"""


def _out(df, digits: int = 6):
    return rounded(rounded(df.drop("avg_ntokens"), "score", digits=digits), "nposts")


@query(_binned("CAST(trunc(post_number / 10.0::DOUBLE) AS INTEGER) + 1", "posts", "10", 50, NUMBERED, ", src AS (SELECT * FROM n)"))
def traj_posts(spark, d):
    return _out(trajectory.weighted(trajectory.by_bin(numbered_events(spark, d), trajectory.posts_stage(10)), "posts", 10, 50))


@query(_binned("CAST(trunc(user_seconds / 15724800.0::DOUBLE) AS INTEGER) + 1", "weeks", "26", 50, ORDERS, ", src AS (SELECT *, date_sub('second', min(true_date) OVER (PARTITION BY author), true_date) AS user_seconds FROM o)", digits=3))
def traj_time(spark, d):
    rows = timeline.seconds(orders(spark, d), None, "true_date")
    return _out(trajectory.weighted(trajectory.by_bin(rows, trajectory.time_stage(26)), "weeks", 26, 50), digits=3)


@query(_binned("CAST(trunc(experience / 2.0::DOUBLE) AS INTEGER) + 1", "pseudo_weeks", "(2.0 / 7.0)", 50, GAPS, ", src AS (SELECT * FROM x)"))
def traj_experience(spark, d):
    rows = timeline.experience(events(spark, d))
    got = trajectory.weighted(trajectory.by_bin(rows, trajectory.experience_stage(2)), "pseudo_weeks", 2 / 7, 50)
    return rounded(_out(got), "pseudo_weeks")


ORACLES["traj_experience"] = ORACLES["traj_experience"].replace("s.stage * (2.0 / 7.0)::DOUBLE AS pseudo_weeks", "round(s.stage * (2.0::DOUBLE / 7.0::DOUBLE), 6) AS pseudo_weeks")

USER_AVG = "a AS (SELECT stage, author, sum(score * weight) / nullif(sum(weight), 0) AS m FROM w GROUP BY ALL)"


@query(f"WITH {PHASES}, {USER_AVG} SELECT stage AS phase, round(avg(m), 6) AS score, count(*) AS nusers FROM a GROUP BY stage")
def traj_user_avg_phase(spark, d):
    return rounded(trajectory.user_averaged(trajectory.by_phase(numbered_events(spark, d), 20), "phase"), "score")


_NUMBERED_W = ", w AS (SELECT author, score, post_number AS stage, CASE WHEN score = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS weight FROM n WHERE post_number BETWEEN 1 AND {last})"


@query(f"WITH {NUMBERED}{_NUMBERED_W.format(last=50)}, {USER_AVG} SELECT stage::INTEGER AS posts, round(avg(m), 6) AS score, count(*) AS nusers FROM a GROUP BY stage")
def traj_user_avg_posts(spark, d):
    return rounded(trajectory.user_averaged(trajectory.by_number(numbered_events(spark, d), 50), "posts"), "score")


@query(f"WITH {NUMBERED}, l AS (SELECT trunc(median(t))::INTEGER AS last FROM (SELECT author, count(*) AS t FROM e GROUP BY 1)){_NUMBERED_W.format(last='(SELECT last FROM l)')}, {USER_AVG} SELECT stage::INTEGER AS posts, round(avg(m), 6) AS score, count(*) AS nusers FROM a GROUP BY stage")
def traj_user_avg_median(spark, d):
    rows = events(spark, d)
    totals = rows.groupBy("author").agg(F.count("*").alias("total_posts"))
    return rounded(trajectory.user_averaged(trajectory.by_median_number(numbered_events(spark, d), totals), "posts"), "score")


def _runs(spark, d):
    """Four runs: the order status and priority stand for repeated samples."""
    rows = timeline.numbered(orders(spark, d), order=("true_date", "post_id")).withColumn("run_uid", F.substring("o_orderpriority", 1, 1))
    dealt = trajectory.by_bin(rows, trajectory.posts_stage(2))
    return dealt.groupBy("run_uid", "stage").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("score"), F.sum("weight").alias("nposts")).withColumnRenamed("stage", "posts")


RUNS = ORDERS.replace("o_totalprice AS score", "o_totalprice AS score, substr(o_orderpriority, 1, 1) AS run_uid") + """,
n AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY true_date, post_id) - 1 AS post_number FROM o),
r AS (SELECT run_uid, CAST(trunc(post_number / 2.0::DOUBLE) AS INTEGER) + 1 AS posts, avg(score) AS score, count(*)::DOUBLE AS nposts FROM n GROUP BY ALL)"""


BY_RUN = RUNS.split("r AS")[0].rstrip().rstrip(",") + """,
b AS (SELECT *, CAST(trunc(post_number / 2.0::DOUBLE) AS INTEGER) + 1 AS stage, CASE WHEN score = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS weight, {limit} AS high_post_limit FROM {source}),
z AS (SELECT high_post_limit, run_uid, stage, count(*) AS n, sum(score * weight) AS s, sum(weight) AS w FROM b GROUP BY ALL),
l AS (SELECT high_post_limit, run_uid, CASE WHEN count(*) FILTER (WHERE n >= 10) = count(*) THEN count(*) - 1 ELSE count(*) FILTER (WHERE n >= 10) END AS m FROM z GROUP BY ALL),
st AS (SELECT high_post_limit, run_uid, unnest(range(1, m + 1))::INTEGER AS stage FROM l),
t AS (SELECT st.high_post_limit, st.run_uid, st.stage * 2.0::DOUBLE AS posts, z.s / nullif(w, 0) AS score, coalesce(w, 0) AS nposts FROM st LEFT JOIN z USING (high_post_limit, run_uid, stage))"""


def _by_run(spark, d):
    return timeline.numbered(orders(spark, d), order=("true_date", "post_id")).withColumn("run_uid", F.substring("o_orderpriority", 1, 1))


@query(f"WITH {BY_RUN.format(limit='0', source='n')} SELECT run_uid, posts, round(ln(score), 9) AS log_score, nposts FROM t")
def traj_all_runs(spark, d):
    """The trajectories of all runs in one job; in logs, as means of prices end on fives, which engines round either way."""
    got = trajectory.weighted(trajectory.by_bin(_by_run(spark, d), trajectory.posts_stage(2)), "posts", 2, 10, by=("run_uid",))
    return got.select("run_uid", "posts", F.round(F.ln("score"), 9).alias("log_score"), "nposts")


_LIMITS = "(SELECT n.*, h FROM (SELECT *, count(*) OVER (PARTITION BY author) AS total FROM n) n, (SELECT unnest([12, 30]) AS h) WHERE total <= h)"


@query(f"WITH {BY_RUN.format(limit='h', source=_LIMITS)} SELECT high_post_limit, posts, round(ln(avg(score)), 9) AS log_score, round(stddev_samp(score), 4) AS std_dev, arg_min(nposts, run_uid) AS nposts FROM t GROUP BY ALL")
def average_high_post_limit(spark, d):
    """Averages over runs for two limits on the posts of an author."""
    rows = _by_run(spark, d).withColumn("high_post_limit", F.explode(F.array(F.lit(12), F.lit(30)))).where("total_user_posts <= high_post_limit")
    keys = ("high_post_limit", "run_uid")
    got = trajectory.weighted(trajectory.by_bin(rows, trajectory.posts_stage(2)), "posts", 2, 10, by=keys)
    got = average.average(got, "posts", by=("high_post_limit",))
    return rounded(got.select("high_post_limit", "posts", F.round(F.ln("score"), 9).alias("log_score"), "std_dev", "nposts"), "std_dev", digits=4)


@query(f"WITH {RUNS} SELECT posts, round(avg(score), 4) AS score, round(stddev_samp(score), 4) AS std_dev, arg_min(nposts, run_uid) AS nposts FROM r GROUP BY posts")
def average_runs(spark, d):
    return rounded(average.average(_runs(spark, d), "posts"), "score", "std_dev", digits=4)


@query(f"WITH {RUNS} SELECT posts, round(avg(score), 4) AS score, round(avg(nposts), 6) AS nposts FROM r GROUP BY posts")
def average_all_columns(spark, d):
    return rounded(rounded(average.average_columns(_runs(spark, d), "posts"), "score", digits=4), "nposts")


def _params(spark, d):
    """Each event type is a run with parameters of its own rows."""
    rows = events(spark, d).groupBy(F.col("event_type").alias("run_uid")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.countDistinct("author").alias("authors"))
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("n", "low", "authors")))
    return rows.select("run_uid", F.inline(pairs))


PARAMS = "p AS (SELECT event_type AS run_uid, unnest(['n', 'low', 'authors']) AS key, unnest([count(*)::VARCHAR, min(value)::VARCHAR, count(DISTINCT user_id)::VARCHAR]) AS value FROM events GROUP BY 1)"


@query(f"WITH {PARAMS}, b AS (SELECT key, value AS expected FROM p WHERE run_uid = (SELECT min(run_uid) FROM p)) SELECT run_uid, key, value, expected FROM p JOIN b USING (key) WHERE value IS DISTINCT FROM expected")
def run_param_consistency(spark, d):
    return average.inconsistent(_params(spark, d))


@query("SELECT event_type AS run_uid, event_type = 'click' AS is_exp FROM (SELECT DISTINCT event_type FROM events)")
def run_kinds(spark, d):
    rows = events(spark, d).select(F.col("event_type").alias("run_uid")).distinct()
    key = F.when(F.col("run_uid") == "click", "threshold_in_days").otherwise("uid")
    return average.is_experience_run(rows.withColumn("key", key))


@query("SELECT label, pos::INTEGER AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL")
def element_average(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rounded(average.element_average(rows, "embedding", ["label"]), "mean")


@query(
    f"""WITH {PROFILE} SELECT count(*) AS users, round_even(avg(comments), 2) AS mean_comments, median(comments)::DOUBLE AS median_comments, round_even(avg(submissions), 2) AS mean_submissions,
median(submissions)::DOUBLE AS median_submissions, round_even(avg(date_sub('day', first_post, last_post)), 2) AS mean_days, median(date_sub('day', first_post, last_post))::DOUBLE AS median_days FROM u"""
)
def characteristics(spark, d):
    return reports.user_statistics(_profile(spark, d))


@query()
def lowess_fit(spark, d):
    return reports.smoothed(_runs(spark, d), "posts", "score", "run_uid")


@query()
def html_report(spark, d):
    """The flagship as a page with table and plot; trajectories are tens of rows."""

    def write(batches):
        for pdf in batches:
            for rows in pdf["rows"]:
                x, y = [r["phase"] for r in rows], [r["score"] for r in rows]
                table = reports.html_table(["phase", "score", "nposts"], [(r["phase"], r["score"], r["nposts"]) for r in rows], "Mean score by life phase")
                yield pd.DataFrame({"html": [reports.page(table, reports.svg_scatter(x, y, line=reports.lowess(x, y, 0.3)))]})

    rows = traj_phase(spark, d).agg(F.sort_array(F.collect_list(F.struct("phase", "score", "nposts"))).alias("rows"))
    return rows.mapInPandas(write, "html string")
