"""Queries over what is stored and read back, and over small expressions: files, parameters, runs, models, names, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.functions import dates, text
from lexitide.operators import clean, katz, sampling, timeline
from lexitide.plans import activity, language
from lexitide.sources import tables
from lexitide.sources.shared import Scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def nations(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))


@query("""SELECT n_nationkey::BIGINT AS id, n_name || ', "so" ' || chr(10) || 'called' AS name, CASE WHEN n_regionkey <> 1 THEN n_regionkey / 4.0::DOUBLE END AS share FROM nation""")
def csv_tables(spark, d):
    """Typed CSV with quotes, commas, line ends and nulls, written and read back."""
    path = Scratch(spark, "csv").path("rows")
    name = F.concat("name", F.lit(', "so" \ncalled'))
    tables.write_csv(nations(spark, d).select("id", name.alias("name"), F.when(F.col("region") != 1, F.col("region") / 4.0).alias("share")), path)
    return tables.read_csv(spark, path, "id long, name string, share double")


@query("SELECT 'uid' AS key, '1e5' AS value UNION ALL SELECT 'k', '3.5' UNION ALL SELECT 'note', 'a:' || chr(9) || 'b' UNION ALL SELECT 'empty', ''")
def run_parameters(spark, d):
    """A file of parameters; lines of another form go."""
    path = Scratch(spark, "params").path("file")
    tables.write_params(spark, [("uid", "1e5"), ("k", "3.5"), ("note", "a:\tb"), ("empty", "")], path)
    return tables.read_params(spark, path)


@query("SELECT 'run' || n_regionkey AS run_uid, n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def runs_catalogue(spark, d):
    """The tables of all runs under one folder, each with its run."""
    base = Scratch(spark, "runs").path("base")
    for i in range(5):
        tables.write_table(nations(spark, d).where(F.col("region") == i).drop("region"), f"{base}/run_uid=run{i}/nations")
    return tables.runs(spark, base, "nations").select("run_uid", "id", "name")


@query("SELECT min(n_name) AS run_uid FROM nation WHERE n_regionkey IN (2, 3) AND n_nationkey % 2 = 0")
def unpadded_run(spark, d):
    """The first gated run without an end buffer: regions 2 and 3 stand for gated runs, even keys for those without a buffer."""
    gated = F.when(F.col("region").isin(2, 3), F.struct(F.lit("threshold_in_days").alias("key"), F.lit("182").alias("value")))
    buffer = F.struct(F.lit("end_buffer").alias("key"), F.when(F.col("id") % 2 == 0, "0").otherwise("4").alias("value"))
    params = nations(spark, d).select(F.col("name").alias("run_uid"), F.explode(F.array(gated, buffer)).alias("p")).where("p IS NOT NULL").select("run_uid", "p.key", "p.value")
    return tables.unpadded(params)


@query(f"WITH {language.GROUPS} SELECT grp, w1, w2, n, round(p_ml, 6) AS p_ml FROM seen WHERE grp = 3")
def stored_model(spark, d):
    """The bigrams of one group of a model that was stored by group: the folders of others are not read."""
    path = Scratch(spark, "stored").path("model")
    language._fitted(spark, d).save(path)
    one = katz.Model.load(spark, path, ["grp"], F.col("grp") == 3)
    return one.bigrams.select("grp", "w1", "w2", "n", F.round("p_ml", 6).alias("p_ml"))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS community, n_name || '|it''s' AS parts FROM nation")
def communities(spark, d):
    """Names before a suffix of folders, and lists of strings from their printed form."""
    rows = nations(spark, d)
    printed = F.concat(F.lit('["'), "name", F.lit('", "it\'s"]'))
    return rows.select("id", tables.community(F.concat("name", F.lit("_snapshots_2020"))).alias("community"), F.array_join(tables.string_list(printed), "|").alias("parts"))


@query("SELECT event_id, epoch_ms((epoch_us(ts) // 1000000) * 1000)::TIMESTAMP AS created, NULL::TIMESTAMP AS broken FROM events")
def epoch_dates(spark, d):
    """Seconds as strings to timestamps; what is no number gives none."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", dates.seconds_between(dates.from_epoch(F.lit(0)), F.col("ts")).cast("string").alias("s"))
    return rows.select("event_id", dates.from_epoch(F.col("s")).alias("created"), dates.from_epoch(F.concat("s", F.lit("x"))).alias("broken"))


@query(f"WITH {language.POSTS} SELECT post_id, len(list_filter(text, lambda x: x = '<s>'))::BIGINT AS sentences, array_to_string(text[1:12], ' ') AS head, len(list_filter(text, lambda x: x NOT IN ('<s>', '</s>')))::BIGINT AS words FROM p")
def nested_sentences(spark, d):
    """Sentences as arrays of their own, and the first twelve tokens."""
    rows = language.documents(spark, d).select(F.col("doc_id").alias("post_id"), text.sentences(F.col("text")).alias("s"), text.truncated(text.padded(F.col("text")), 12).alias("head"))
    words = F.aggregate("s", F.lit(0), lambda a, x: a + F.size(x))
    return rows.select("post_id", F.size("s").cast("long").alias("sentences"), F.array_join("head", " ").alias("head"), words.cast("long").alias("words"))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_name <> 'BRAZIL'")
def without_header_rows(spark, d):
    """Rows that repeat the header go; Brazil's stands for one."""
    rows = nations(spark, d).drop("region")
    return clean.without_header_echo(rows.withColumn("name", F.when(F.col("name") == "BRAZIL", "name").otherwise(F.col("name"))))


@query("SELECT n_nationkey::BIGINT AS id, n_regionkey = 2 AS equal, n_regionkey <= 2 AS below, n_regionkey >= 2 AS other FROM nation")
def plot_filters(spark, d):
    return nations(spark, d).select("id", *(clean.compare("region", op, 2).alias(n) for op, n in (("==", "equal"), ("<=", "below"), ("?", "other"))))


@query(f"WITH {activity.ORDER_GAPS} SELECT o.post_id, round(experience, 6) AS experience FROM o LEFT JOIN (SELECT * FROM x WHERE post_id % 3 <> 0) y ON y.post_id = o.post_id")
def experience_of_posts(spark, d):
    """Posts with the experience of their authors; posts that are not among the activity stay, without one."""
    rows = activity.orders(spark, d)
    known = timeline.experience(rows).where("post_id % 3 <> 0").select("post_id", "experience")
    return rows.select("post_id").join(known, "post_id", "left").withColumn("experience", F.round("experience", 6))


@query("SELECT v::BIGINT AS vocab_size, m::DOUBLE AS max_discount FROM (SELECT unnest([500, 2000, 8000]) AS v), (SELECT unnest([0.8, 0.9]) AS m)")
def parameter_grid(spark, d):
    rows = sampling.grid(vocab_size=[500, 2000, 8000], max_discount=[0.8, 0.9])
    return spark.createDataFrame([(r["vocab_size"], r["max_discount"]) for r in rows], "vocab_size long, max_discount double")
