"""The whole analysis as one object: lazily composed stages from decoded dumps to averaged trajectories."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.config import Preprocess, Snapshot, Trajectory
from lexitide.functions import text
from lexitide.operators import average, clean, snapshots, timeline, trajectory, users


@dataclass
class Pipeline:
    """raw: decoded rows of both kinds (sources.dumps.both). keep(df, name) may store tables that are read more than once."""

    raw: DataFrame
    preprocess: Preprocess = field(default_factory=Preprocess)
    snapshot: Snapshot = field(default_factory=Snapshot)
    trajectory: Trajectory = field(default_factory=Trajectory)
    keep: object = lambda df, name: df

    def __post_init__(self):
        good = self.raw.where("ok")
        rows = clean.posts(good, self.preprocess.top_level_only)
        everything = clean.posts(good, False)
        top = clean.top_level(F.col("kind"), F.col("parent_id"))
        self.users = self.keep(users.profiles(everything, "author", "created", F.col("kind") == "submission", top), "users")
        tokens = clean.cleaned(rows, self.preprocess.clean_text).withColumn("text", text.padded(F.col("text")))
        dated = timeline.numbered(timeline.seconds(tokens, self.users)).withColumn("true_date", F.col("created")).withColumn("ntokens", F.size("text"))
        activity = clean.known_authors(clean.activity(good)).withColumnRenamed("created", "true_date")
        unique = clean.first_of(activity, ["post_id"], [F.col("true_date")])
        self.experience = self.keep(timeline.experience(unique).select("post_id", "dt", "experience"), "experience")
        self.posts = self.keep(dated.join(self.experience, "post_id", "left"), "posts")

    def run(self, uid: str, number: int) -> dict[str, DataFrame]:
        """sample, model and scores of one run; number is the seed."""
        pool = users.only(self.posts, users.sampling_users(self.users, self.snapshot.min_user_posts), ["author"])
        sampled = self.keep(snapshots.sample(pool, self.snapshot, number), f"{uid}-sample")
        model = snapshots.fit(sampled, self.snapshot, keep=lambda df, name: self.keep(df, f"{uid}-{name}"))
        scored = self.keep(snapshots.scores(self.posts, sampled, model), f"{uid}-scores")
        return {"sample": sampled, "model": model, "scores": scored.withColumn("run_uid", F.lit(uid))}

    def trajectories(self, scored: DataFrame) -> dict[str, DataFrame]:
        return trajectories(self.posts, self.users, scored, self.trajectory)

    def averaged(self, trajectories: DataFrame, x: str) -> DataFrame:
        return average.average(trajectories, x)


def trajectories(posts: DataFrame, profiles: DataFrame, scored: DataFrame, t: Trajectory, by: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All kinds of trajectories of scored(by, post_id, score), for all runs at once if run_uid is in by; phases are those of authors who have ended."""
    chosen = users.trajectory_users(profiles, t.minimum_user_posts, t.high_post_limit if t.remove_high_posters else None)
    rows = users.only(posts.join(scored.select(*by, "post_id", "score"), "post_id"), chosen, ["author"])
    ended = users.only(rows, users.ended_users(profiles), ["author"])
    bins = {
        "posts": (trajectory.posts_stage(t.post_bin_size), t.post_bin_size),
        "weeks": (trajectory.time_stage(t.period_in_weeks), t.period_in_weeks),
        "pseudo_weeks": (trajectory.experience_stage(t.experience_bin_size), t.experience_bin_size / 7),
        "ntokens": (trajectory.ntokens_stage(t.ntokens_bin_size), t.ntokens_bin_size),
    }
    out = {k: trajectory.weighted(trajectory.by_bin(rows, s), k, scale, t.min_instances, "ntokens", by) for k, (s, scale) in bins.items()}
    out["phase"] = trajectory.weighted(trajectory.by_phase(ended, t.num_phases), "phase", ntokens="ntokens", by=by)
    out["user_phase"] = trajectory.user_averaged(trajectory.by_phase(ended, t.num_phases), "phase", by=by)
    out["user_posts"] = trajectory.user_averaged(trajectory.by_number(rows, t.num_posts), "posts", by=by)
    out["user_posts_median"] = trajectory.user_averaged(trajectory.by_median_number(rows, chosen), "posts", by=by)
    return out
