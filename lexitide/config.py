"""Options of the stages, with the values the analysis is usually run with."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass


class _FromFile:
    @classmethod
    def load(cls, path: str):
        """From a JSON file; keys that are absent keep their defaults, unknown ones are left out."""
        with open(path) as f:
            got = json.load(f)
        return cls(**{f.name: got[f.name] for f in dataclasses.fields(cls) if f.name in got})

    def rows(self) -> list[tuple[str, str]]:
        return [(k, str(v)) for k, v in dataclasses.asdict(self).items()]


@dataclass(frozen=True)
class Preprocess(_FromFile):
    top_level_only: bool = True
    clean_text: str = "urls_only"


@dataclass(frozen=True)
class Snapshot(_FromFile):
    users_per_month: int = 500
    posts_per_user: int = 2
    use_run_number_as_seed: bool = True
    start_buffer: int = 0
    end_buffer: int = 0
    min_user_posts: int = 1
    leave_unknown: float | int | None = 100
    max_vocab_size: int | None = None
    max_discount: float = 0.9
    gamma: float = 0.2
    threshold_in_days: float | None = None
    alpha_mode: str = "reference"


@dataclass(frozen=True)
class Trajectory(_FromFile):
    num_phases: int = 20
    post_bin_size: int = 10
    period_in_weeks: float = 4
    min_instances: int = 50
    experience_bin_size: float = 28
    ntokens_bin_size: int = 5
    minimum_user_posts: int = 50
    remove_high_posters: bool = True
    high_post_limit: int = 5000
    min_posts: int = 2000
    num_posts: int = 50
