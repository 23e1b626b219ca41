"""Queries over documents: cleaning, tokens, Katz models, scores of posts, dumps and streams.

Documents stand for posts: the source is the author, the id deals them to half a year of days and to five groups.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.config import Snapshot
from lexitide.functions import dates, text
from lexitide.operators import clean, katz, reports, sampling, snapshots, timeline, trajectory
from lexitide.sources import dumps
from lexitide.sources.shared import Scratch, spread
from lexitide.streaming import live

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


def documents(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def posts(spark, d: str) -> DataFrame:
    day = F.timestamp_add("DAY", (F.col("doc_id") % 182).cast("int"), F.lit("2020-01-01").cast("timestamp_ntz"))
    rows = spread(documents(spark, d).select("doc_id", "source", "text")).select(F.col("doc_id").alias("post_id"), F.col("source").alias("author"), day.alias("true_date"), (F.col("doc_id") % 5).alias("grp"), text.padded(F.col("text")).alias("text"))
    return rows.withColumn("month", dates.month(F.col("true_date")))


TOKENS = "regexp_extract_all(coalesce(text, ''), '{}')".format(text.TOKEN.replace("'", "''"))
POSTS = f"""t AS (SELECT doc_id AS post_id, source AS author, TIMESTAMP '2020-01-01' + to_days((doc_id % 182)::INTEGER) AS true_date, doc_id % 5 AS grp, {TOKENS} AS t FROM documents),
p AS MATERIALIZED (SELECT post_id, author, true_date, grp, date_trunc('month', true_date)::DATE AS month, flatten(list_transform(t, lambda x, i: list_concat(list_concat(
  CASE WHEN i = 1 OR regexp_matches(t[i - 1], '^[.!?]+$') THEN ['<s>'] ELSE []::VARCHAR[] END, [x]), CASE WHEN i = len(t) OR regexp_matches(x, '^[.!?]+$') THEN ['</s>'] ELSE []::VARCHAR[] END))) AS text FROM t)"""


def _pairs(keys: str, source: str) -> str:
    return f"SELECT {keys}, w1, w2, count(*) AS n FROM (SELECT {keys}, unnest(text[1:len(text) - 1]) AS w1, unnest(text[2:len(text)]) AS w2 FROM {source} WHERE len(text) > 1) GROUP BY ALL"


def _known(keys: str, source: str, by: str) -> str:
    """Pairs of source with words outside the vocabulary as <UNK>."""
    names = ", ".join(f"r.{k}" for k in keys.split(", "))
    return f"""SELECT {names}, CASE WHEN a.token IS NULL THEN '<UNK>' ELSE r.w1 END AS w1, CASE WHEN b.token IS NULL THEN '<UNK>' ELSE r.w2 END AS w2, sum(r.n)::BIGINT AS n
  FROM {source} r LEFT JOIN voc a ON a.{by} = r.{by} AND a.token = r.w1 LEFT JOIN voc b ON b.{by} = r.{by} AND b.token = r.w2 GROUP BY ALL"""


def model_sql(by: str, leave: int = 0, size: int | None = None, default: float | None = None) -> str:
    """The model of src(by, post_id, text) as a chain of CTEs; with a size and a default discount that of plain Good-Turing."""
    voc = f"ORDER BY n, token DESC) AS k FROM tc) WHERE k > {leave}" if size is None else f"ORDER BY n DESC, token) AS k FROM tc) WHERE k <= {size}"
    cs = f"SELECT {by}, r, n_r, CASE WHEN r < r_switch THEN x ELSE y END AS c_star FROM z3 WHERE a <= -1 AND r_switch IS NOT NULL AND r_gap >= r_switch"
    if default is not None:
        cs = f"SELECT f.{by}, f.r, f.n_r, coalesce((f.r + 1) * g.n_r / f.n_r, f.r * {default}::DOUBLE) AS c_star FROM fr f LEFT JOIN fr g ON g.{by} = f.{by} AND g.r = f.r + 1"
    return f"""tc AS MATERIALIZED (SELECT {by}, token, count(*) AS n FROM (SELECT {by}, unnest(text) AS token FROM src) GROUP BY ALL),
voc AS MATERIALIZED (SELECT {by}, token FROM (SELECT *, row_number() OVER (PARTITION BY {by} {voc}),
raw AS ({_pairs(by, "src")}),
pairs AS MATERIALIZED ({_known(by, "raw", by)}),
fr AS (SELECT {by}, n AS r, count(*) AS n_r FROM pairs GROUP BY ALL),
z0 AS (SELECT *, lag(r, 1, 0) OVER w AS before, coalesce(lead(r) OVER w, 2 * r - lag(r) OVER w) AS after, sum(n_r) OVER (PARTITION BY {by}) AS total,
  (CASE WHEN lead(r) OVER w = r + 1 THEN lead(n_r) OVER w END)::DOUBLE AS n_next FROM fr WINDOW w AS (PARTITION BY {by} ORDER BY r)),
z1 AS (SELECT *, 2.0::DOUBLE * (n_r::DOUBLE / total::DOUBLE) / nullif(after - before, 0)::DOUBLE AS z FROM z0),
fit AS (SELECT {by}, regr_slope(ln(z), ln(r::DOUBLE)) AS a, regr_intercept(ln(z), ln(r::DOUBLE)) AS b FROM z1 GROUP BY {by}),
z2 AS (SELECT z1.*, a, (r + 1) * n_next / n_r AS x, (r + 1) * exp(a * ln(r + 1.0::DOUBLE) + b) / exp(a * ln(r::DOUBLE) + b) AS y,
  1.959963984540054::DOUBLE * sqrt((r + 1) * (r + 1) * (n_next / (n_r::DOUBLE * n_r::DOUBLE)) * (1 + n_next / n_r)) AS width FROM z1 JOIN fit ON fit.{by} = z1.{by}),
z3 AS (SELECT *, min(CASE WHEN abs(x - y) <= width THEN r END) OVER (PARTITION BY {by}) AS r_switch, min(CASE WHEN n_next IS NULL THEN r END) OVER (PARTITION BY {by}) AS r_gap FROM z2),
cs AS MATERIALIZED ({cs}),
good AS MATERIALIZED (SELECT DISTINCT {by} FROM cs),
seen AS MATERIALIZED (SELECT q.{by}, w1, w2, n, n::DOUBLE / (sum(n) OVER (PARTITION BY q.{by}, w1))::DOUBLE AS p_ml, least(c_star / n, 0.9::DOUBLE) AS discount FROM pairs q JOIN cs ON cs.{by} = q.{by} AND cs.r = q.n),
uc AS (SELECT {by}, token AS w, n FROM tc SEMI JOIN voc USING ({by}, token)
  UNION ALL SELECT tc.{by}, '<UNK>', coalesce(sum(CASE WHEN v.token IS NULL THEN n END), 0)::BIGINT FROM tc LEFT JOIN voc v ON v.{by} = tc.{by} AND v.token = tc.token GROUP BY tc.{by}),
un AS MATERIALIZED (SELECT {by}, w, (n + 0.2::DOUBLE) / ((sum(n) OVER (PARTITION BY {by}))::DOUBLE + 0.2::DOUBLE * count(*) OVER (PARTITION BY {by})) AS p FROM uc),
fol AS (SELECT s.{by}, s.w1, (1 - sum(discount * p_ml)) / nullif(sum(coalesce(c.p, k.p)), 0) AS alpha
  FROM seen s LEFT JOIN un c ON c.{by} = s.{by} AND c.w = substr(s.w2, 1, 1) LEFT JOIN un k ON k.{by} = s.{by} AND k.w = '<UNK>' GROUP BY ALL),
al AS (SELECT un.{by}, un.w AS w1, coalesce(alpha, 0.1::DOUBLE) AS alpha FROM un LEFT JOIN fol ON fol.{by} = un.{by} AND fol.w1 = un.w WHERE un.{by} IN (SELECT {by} FROM good))"""


def score_sql(by: str) -> str:
    """sc(by, post_id, n_bigrams, raw, score) of target(by, post_id, text) under the model."""
    return f"""tp AS ({_pairs(f"{by}, post_id", "target")}),
tk AS ({_known(f"{by}, post_id", "tp", by)}),
pr AS (SELECT tk.{by}, post_id, tk.n, coalesce(s.discount * s.p_ml, al.alpha * un.p) AS prob FROM tk
  LEFT JOIN seen s ON s.{by} = tk.{by} AND s.w1 = tk.w1 AND s.w2 = tk.w2 LEFT JOIN al ON al.{by} = tk.{by} AND al.w1 = tk.w1 LEFT JOIN un ON un.{by} = tk.{by} AND un.w = tk.w2),
ps AS (SELECT {by}, post_id, sum(n)::BIGINT AS n_bigrams, -sum(n * log2(prob)) AS raw FROM pr GROUP BY ALL),
sc AS (SELECT target.{by}, target.post_id, coalesce(n_bigrams, 0) AS n_bigrams, coalesce(raw, 0) AS raw, coalesce(raw / n_bigrams, 0) AS score
  FROM target LEFT JOIN ps ON ps.{by} = target.{by} AND ps.post_id = target.post_id WHERE target.{by} IN (SELECT {by} FROM good))"""


GROUPS = f"{POSTS}, src AS (SELECT grp, post_id, text FROM p), {model_sql('grp', 100)}"
GROUP_SCORES = f"{GROUPS}, target AS (SELECT grp, post_id, text FROM p), {score_sql('grp')}"


def _fitted(spark, d) -> katz.Model:
    """The models of the posts by group; the posts are stored while they are read."""
    scratch = Scratch(spark, "katz", tidy=True)
    rows = scratch.save(posts(spark, d).select("grp", "post_id", "text"), "posts")
    model = katz.fit(rows, ["grp"], keep=scratch.save)
    scratch.drop("posts", "tokens")
    return model


def _own_scores(spark, d) -> DataFrame:
    """The posts under the models of their groups, which were fitted on them."""
    return katz.own_entropies(posts(spark, d).select("grp", "post_id", "text"), ["grp"], Scratch(spark, "own", tidy=True))


@query("SELECT page_id, regexp_replace('See ' || url || ' now, or HTTPS://a.b/c?d=1, ok', '\\bhttps?\\S+\\b', '', 'gi') AS text FROM pages")
def clean_urls(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet")
    return rows.select("page_id", text.clean(F.concat(F.lit("See "), "url", F.lit(" now, or HTTPS://a.b/c?d=1, ok"))).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '[^a-zA-Z\\s]|\\bhttps?\\S+\\b', '', 'gi') AS text FROM documents")
def clean_full(spark, d):
    return documents(spark, d).select("doc_id", text.clean(F.col("text"), "full").alias("text"))


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND text <> '' AND NOT contains(text, 'a') AND turn % 3 <> 1")
def drop_deleted(spark, d):
    """System turns stand for ignored authors; texts with an a, and each third turn, for removed ones."""
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    body = F.when(F.contains("text", F.lit("a")), F.concat("text", F.lit(" [removed] "))).when(F.col("turn") % 3 == 1, "nan").otherwise(F.col("text"))
    author = F.when(F.col("role") == "system", "AutoModerator").otherwise(F.col("role"))
    return clean.with_text(clean.known_authors(rows.withColumn("text", body).withColumn("author", author))).select("conv_id", "turn")


@query(f"WITH {POSTS} SELECT token, count(*) AS n FROM (SELECT unnest(text) AS token FROM p) GROUP BY ALL")
def token_counts(spark, d):
    return katz.token_counts(posts(spark, d), [])


@query(f"WITH {POSTS} SELECT post_id, len(list_filter(text, lambda x: x = '</s>'))::INTEGER AS sentences, len(text)::INTEGER AS ntokens FROM p")
def sentence_counts(spark, d):
    ends = F.size("text") - F.size(F.array_remove("text", text.STOP))
    return posts(spark, d).select("post_id", ends.alias("sentences"), F.size("text").alias("ntokens"))


@query(f"WITH {POSTS} SELECT count(*) AS posts, round_even(avg(len(text)), 2) AS mean_tokens, median(len(text))::DOUBLE AS median_tokens FROM p")
def token_statistics(spark, d):
    return reports.post_statistics(posts(spark, d))


@query(f"WITH {POSTS}, src AS (SELECT grp, post_id, text FROM p), {model_sql('grp', 100).split('raw AS')[0].rstrip().rstrip(',')} SELECT grp, token FROM voc")
def vocabulary(spark, d):
    counts = Scratch(spark, "vocabulary", tidy=True).save(katz.token_counts(posts(spark, d), ["grp"]), "tokens")
    return katz.vocabulary(counts, ["grp"], leave_unknown=100).select("grp", "token")


@query(f"WITH {POSTS}, c AS (SELECT grp, token, count(*) AS n FROM (SELECT grp, unnest(text) AS token FROM p) GROUP BY ALL) SELECT grp, token, n, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, token) AS k FROM c) WHERE k <= 500")
def top_tokens(spark, d):
    return katz.vocabulary(katz.token_counts(posts(spark, d), ["grp"]), ["grp"], max_size=500)


def _grouped_pairs(spark, d) -> DataFrame:
    scratch = Scratch(spark, "pairs", tidy=True)
    rows = scratch.save(posts(spark, d).select("grp", "text"), "posts")
    counts = scratch.save(katz.token_counts(rows, ["grp"]), "tokens")
    vocab = katz.vocabulary(counts, ["grp"], leave_unknown=100)
    return katz.known_pairs(rows, ["grp"], "text", counts, vocab, leave_unknown=100).drop("total")


def _frequencies(spark, d) -> DataFrame:
    scratch = Scratch(spark, "pairs", tidy=True)
    rows = scratch.save(posts(spark, d).select("grp", "text"), "posts")
    counts = scratch.save(katz.token_counts(rows, ["grp"]), "tokens")
    return scratch.save(katz.known_frequencies(rows, ["grp"], "text", counts, katz.vocabulary(counts, ["grp"], leave_unknown=100), leave_unknown=100), "frequencies")


@query(f"WITH {GROUPS} SELECT grp, w1, w2, n FROM pairs")
def bigram_counts(spark, d):
    return _grouped_pairs(spark, d)


@query(f"WITH {GROUPS} SELECT grp, r, n_r FROM fr")
def freq_of_freqs(spark, d):
    return _frequencies(spark, d)


@query(f"WITH {GROUPS} SELECT grp, r, n_r, round(c_star, 6) AS c_star FROM cs")
def sgt_cstars(spark, d):
    return rounded(katz.good_turing(_frequencies(spark, d), ["grp"])[0], "c_star")


@query(f"WITH {GROUPS} SELECT a.grp, a.r, a.n_r, round(coalesce((a.r + 1) * b.n_r / a.n_r, a.r * 0.5), 6)::DOUBLE AS c_star FROM fr a LEFT JOIN fr b ON b.grp = a.grp AND b.r = a.r + 1")
def turing_cstars(spark, d):
    return rounded(katz.plain_turing(_frequencies(spark, d), ["grp"], 0.5)[0], "c_star")


@query(f"WITH {GROUPS} SELECT grp, w1, w2, n, round(p_ml, 6) AS p_ml, round(discount, 6) AS discount FROM seen")
def katz_discounts(spark, d):
    return rounded(_fitted(spark, d).bigrams.drop("p"), "p_ml", "discount")


@query(f"WITH {GROUPS} SELECT grp, w1, round(alpha, 6) AS alpha FROM al")
def katz_alphas(spark, d):
    return rounded(_fitted(spark, d).alphas, "alpha")


@query(f"WITH {GROUPS} SELECT grp, w, round(p, 9) AS p FROM un WHERE grp IN (SELECT grp FROM good)")
def katz_unigrams(spark, d):
    return rounded(_fitted(spark, d).unigrams.drop("n"), "p", digits=9)


@query(f"WITH {GROUP_SCORES} SELECT grp, post_id, n_bigrams, round(score, 6) AS score FROM sc")
def post_entropy(spark, d):
    return rounded(_own_scores(spark, d).drop("raw", "n_words"), "score")


@query(f"WITH {GROUP_SCORES} SELECT grp, round(sum(raw) / sum(n_bigrams), 6) AS entropy, round(avg(score), 6) AS mean_entropy, count(*) AS posts, round(pow(2, sum(raw) / sum(n_bigrams)), 4) AS perplexity FROM sc GROUP BY grp")
def corpus_entropy(spark, d):
    got = katz.evaluation(_own_scores(spark, d), ["grp"])
    return rounded(rounded(got, "entropy", "mean_entropy"), "perplexity", digits=4)


@query(
    f"""WITH {GROUP_SCORES}, b AS (SELECT CAST(trunc(len(text) / 200.0::DOUBLE) AS INTEGER) + 1 AS stage, score, len(text) AS ntokens, CASE WHEN score = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS weight FROM sc JOIN p USING (post_id)),
z AS (SELECT stage, count(*) AS n FROM b GROUP BY stage),
l AS (SELECT CASE WHEN count(*) FILTER (WHERE n >= 10) = count(*) THEN count(*) - 1 ELSE count(*) FILTER (WHERE n >= 10) END AS m FROM z),
s AS (SELECT unnest(range(1, (SELECT m FROM l) + 1))::INTEGER AS stage),
sums AS (SELECT stage, sum(score * weight) AS s, sum(weight) AS w, sum(ntokens * weight) AS t FROM b GROUP BY stage)
SELECT s.stage * 200.0::DOUBLE AS ntokens, round(sums.s / nullif(w, 0), 5) AS score, coalesce(w, 0) AS nposts, round(t / nullif(w, 0), 5) AS avg_ntokens FROM s LEFT JOIN sums USING (stage)"""
)
def traj_ntokens(spark, d):
    """Mean cross-entropy by length of post."""
    scored = _own_scores(spark, d).withColumn("ntokens", F.col("n_words").cast("int"))
    got = trajectory.weighted(trajectory.by_bin(scored, trajectory.ntokens_stage(200)), "ntokens", 200, 10, "ntokens")
    return rounded(got, "score", "avg_ntokens", digits=5)


#: Months of about a sixth of the documents, by 20 authors.
MONTHLY = Snapshot(users_per_month=8, posts_per_user=2, leave_unknown=20)
MONTH_MODEL = f"""{POSTS},
a AS (SELECT month, author, count(*) AS n FROM p GROUP BY ALL),
mt AS (SELECT month FROM a GROUP BY month HAVING sum(n) >= 32 AND count(*) >= 16 AND count(*) FILTER (WHERE n >= 2) >= 8),
su AS (SELECT month, author FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY md5('7:' || month || ':' || author), author) AS k FROM a WHERE n >= 2 AND month IN (SELECT month FROM mt)) WHERE k <= 8),
sp AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY month, author ORDER BY md5('7:' || post_id), post_id) AS k FROM p SEMI JOIN su USING (month, author)) WHERE k <= 2),
src AS (SELECT month, post_id, text FROM sp), {model_sql("month", 20)}"""


def _monthly(spark, d):
    scratch = Scratch(spark, "months", tidy=True)
    rows = scratch.save(posts(spark, d), "posts")
    sampled = scratch.save(snapshots.sample(rows, MONTHLY, 7), "sample")
    return rows, sampled, snapshots.fit(sampled, MONTHLY, keep=scratch.save)


@query(f"WITH {MONTH_MODEL}, target AS (SELECT month, post_id, text FROM p ANTI JOIN sp USING (post_id)), {score_sql('month')} SELECT month, post_id, round(score, 6) AS score FROM sc")
def snapshot_scores(spark, d):
    """Every post that no model was fitted on, under its own month's model."""
    return rounded(snapshots.scores(*_monthly(spark, d)), "score")


def gated_model(days: float) -> str:
    """The models of samples from posts of authors with so many days of experience."""
    return f"""{POSTS},
g AS (SELECT p.*, (epoch_us(true_date) - epoch_us(lag(true_date) OVER (PARTITION BY author ORDER BY true_date, post_id))) / 86400000000.0::DOUBLE AS dt FROM p),
k AS (SELECT avg(dt) AS k FROM g),
x AS (SELECT g.*, sum(CASE WHEN dt IS NULL THEN 0 ELSE k * (1 - exp(-dt / k)) END) OVER (PARTITION BY author ORDER BY true_date, post_id ROWS UNBOUNDED PRECEDING) AS experience FROM g, k),
a AS (SELECT month, author, count(*) FILTER (WHERE experience >= {days}) AS n FROM x GROUP BY ALL),
mt AS (SELECT month FROM a GROUP BY month HAVING sum(n) >= 32 AND count(*) FILTER (WHERE n >= 2) >= 8),
su AS (SELECT month, author FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY md5('7:' || month || ':' || author), author) AS k FROM a WHERE n >= 2 AND month IN (SELECT month FROM mt)) WHERE k <= 8),
sp AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY month, author ORDER BY md5('7:' || post_id), post_id) AS k FROM x SEMI JOIN su USING (month, author) WHERE experience >= {days}) WHERE k <= 2),
src AS (SELECT month, post_id, text FROM sp), {model_sql("month", 20)}"""


@query(f"WITH {gated_model(10)}, target AS (SELECT month, post_id, text FROM p ANTI JOIN sp USING (post_id)), {score_sql('month')} SELECT month, post_id, round(score, 6) AS score FROM sc")
def snapshot_scores_gated(spark, d):
    """Scores under models of what authors with ten days of experience wrote."""
    scratch = Scratch(spark, "gated", tidy=True)
    rows = scratch.save(posts(spark, d), "posts")
    old = scratch.save(timeline.experience(rows.select("post_id", "author", "true_date")).select("post_id", "experience"), "experience")
    config = dataclasses.replace(MONTHLY, threshold_in_days=10)
    sampled = scratch.save(snapshots.sample(rows.join(old, "post_id"), config, 7), "sample")
    return rounded(snapshots.scores(rows, sampled, snapshots.fit(sampled, config, keep=scratch.save)), "score")


@query(f"WITH {MONTH_MODEL}, target AS (SELECT month, post_id, text FROM p ANTI JOIN sp USING (post_id)), {score_sql('month')} SELECT p.post_id, round(coalesce(score, -999), 6) AS score FROM p LEFT JOIN sc USING (post_id)")
def scores_with_marker(spark, d):
    """Every post; those without a score, as they trained a model or their month has none, are marked by -999."""
    rows, sampled, model = _monthly(spark, d)
    return rounded(snapshots.unscored_as(rows.select("post_id"), snapshots.scores(rows, sampled, model)), "score")


PROGRESSIVE = f"""{MONTH_MODEL},
dealt AS (SELECT post_id, text, (month + to_months(s::INTEGER))::DATE AS month FROM p, (SELECT unnest([-1, 0, 1, 2]) AS s)),
target AS (SELECT month, post_id, text FROM dealt ANTI JOIN sp USING (month, post_id)), {score_sql("month")}"""


@query(f"WITH {PROGRESSIVE} SELECT month, post_id, round(score, 6) AS score FROM sc")
def progressive_scores(spark, d):
    return rounded(snapshots.progressive_scores(*_monthly(spark, d), 2), "score")


_COLUMNS = [f"run_ss_2020_{m}" for m in range(1, 7)]


@query(f"WITH {PROGRESSIVE} SELECT post_id, {', '.join(f'round(max(CASE WHEN month(month) = {i + 1} THEN score END), 6) AS {c}' for i, c in enumerate(_COLUMNS))} FROM sc GROUP BY post_id")
def progressive_wide(spark, d):
    return rounded(snapshots.wide(snapshots.progressive_scores(*_monthly(spark, d), 2), "run", _COLUMNS), *_COLUMNS)


_PART = "CASE WHEN ('0x' || substr(md5('42:' || post_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.8 THEN 'train' ELSE 'validation' END"


def _grid_sql(size: int) -> str:
    return f"""SELECT * FROM (WITH {POSTS}, sp AS (SELECT grp, post_id, text, {_PART} AS part FROM p), src AS (SELECT grp, post_id, text FROM sp WHERE part = 'train'), {model_sql("grp", size=size, default=0.5)},
target AS (SELECT grp, post_id, text FROM sp WHERE part = 'validation'), {score_sql("grp")}, vs AS (SELECT grp, count(*) AS n FROM voc GROUP BY grp)
SELECT {size}::BIGINT AS vocab_size, 0.5::DOUBLE AS default_discount, 0.9::DOUBLE AS max_discount, sc.grp, any_value(vs.n) AS actual_vocab_size, round(sum(raw) / sum(n_bigrams), 6) AS entropy, round(pow(2, sum(raw) / sum(n_bigrams)), 3) AS perplexity
FROM sc JOIN vs USING (grp) GROUP BY sc.grp)"""


@query(f"{_grid_sql(500)} UNION ALL {_grid_sql(2000)}")
def grid_search(spark, d):
    """Entropy of the validation documents for combinations of parameters."""
    rows = Scratch(spark, "grid", tidy=True).save(sampling.split(posts(spark, d).select("grp", "post_id", "text"), "post_id"), "posts")
    got = katz.grid_search(rows.where("part = 'train'"), rows.where("part = 'validation'"), ["grp"], [500, 2000], [0.5], [0.9], keep=Scratch(spark, "grid", tidy=True).save)
    return rounded(rounded(got, "entropy"), "perplexity", digits=3)


def _dumps(spark, d) -> DataFrame:
    """Dumps of both kinds, written and read back; the first turns lack their parent."""
    scratch = Scratch(spark, "dumps")
    line = lambda **c: F.to_json(F.struct(*(v.alias(k) for k, v in c.items()))).alias("value")
    subs = documents(spark, d).select(line(id=F.col("doc_id").cast("string"), author=F.col("source"), created_utc=F.col("doc_id") * 86400, title=F.col("lang"), selftext=F.col("text"), num_comments=F.lit(0)))
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    comments = turns.select(line(id=F.concat_ws("-", "conv_id", "turn"), author=F.col("role"), created_utc=F.col("turn"), body=F.col("text"), parent_id=F.when(F.col("turn") != 1, "t3_x")))
    subs.write.mode("overwrite").option("compression", "gzip").text(scratch.path("submissions"))
    dumps.write_zst(comments, scratch.path("comments"))
    return dumps.both(dumps.lines(spark, scratch.path("submissions")), dumps.lines(spark, scratch.path("comments"), long_window=True))


@query(
    """SELECT 'submission' AS kind, count(*) FILTER (WHERE lang IS NULL OR source IS NULL) AS bad_lines, count(*) AS lines FROM documents
UNION ALL SELECT 'comment', count(*) FILTER (WHERE role IS NULL OR turn = 1), count(*) FROM conversations"""
)
def dump_ingest(spark, d):
    """Compressed JSON lines, gzip and Zstandard, written and read back; lines that lack a required field are counted."""
    return dumps.bad_lines(_dumps(spark, d))


@query(
    r"""SELECT doc_id::VARCHAR AS post_id, 'submission' AS kind, source AS author, make_timestamp(doc_id * 86400000000) AS created, lang AS title, regexp_replace(coalesce(text, ''), '[\r\n]', '', 'g') AS text, '' AS parent_id, 0::BIGINT AS num_comments
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL
UNION ALL SELECT conv_id || '-' || turn, 'comment', role, make_timestamp(turn::BIGINT * 1000000), '', regexp_replace(coalesce(text, ''), '[\r\n]', '', 'g'), 't3_x', 0 FROM conversations WHERE role IS NOT NULL AND turn <> 1"""
)
def post_rows(spark, d):
    """Post rows of good lines that start or answer a submission."""
    return clean.posts(_dumps(spark, d).where("ok"), join_titles=False)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    """The events read as a stream, to its present end."""
    scratch = Scratch(spark, "stream")
    counts = live.daily_counts(live.events(spark, f"{d}/events.parquet"))
    return live.drain(counts, scratch, "counts", "complete").select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query(
    """WITH g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 86400000000.0::DOUBLE AS dt FROM events)
SELECT user_id, event_id, round(sum(CASE WHEN dt IS NULL THEN 0 ELSE 0.4::DOUBLE * (1 - exp(-dt / 0.4::DOUBLE)) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS experience FROM g"""
)
def stream_experience(spark, d):
    """Running experience from a stream, for a mean gap of 0.4 days."""
    scratch = Scratch(spark, "stream")
    return rounded(live.drain(live.running_experience(live.events(spark, f"{d}/events.parquet"), 0.4), scratch, "experience", "append"), "experience")


@query(f"WITH {POSTS}, n AS (SELECT post_id, author, row_number() OVER (PARTITION BY author ORDER BY true_date, post_id) - 1 AS post_number, len(text) AS ntokens FROM p) SELECT author, post_number, ntokens::INTEGER AS ntokens FROM n")
def document_numbering(spark, d):
    rows = timeline.numbered(posts(spark, d).select("post_id", "author", "true_date", F.size("text").alias("ntokens")), order=("true_date", "post_id"))
    return rows.select("author", F.col("post_number").cast("long").alias("post_number"), "ntokens")
