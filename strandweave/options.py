"""Options of the two commands, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CallOptions:
    """Calling variants from one sample."""

    cutoff: int = 4
    min_vote: int = -1
    min_map_q: int = 20
    min_sv_size: int = 50
    adj_tol: int = 50
    report_filtered: bool = False
    use_pairs: bool = True
    use_clips: bool = True
    use_depth: bool = True
    rank_aggregation: bool = True
    max_split: int = 2
    max_overlap: int = 20
    min_split_support: int = 1
    pair_search_size: int = 500
    insert_deviations: float = 9.0
    depth_outlier: float = 1.0
    min_pair_support: int = 1
    min_clip_size: int = 20
    clip_error_rate: float = 0.1
    assemble_clips: bool = False
    depth_samples: int = 100_000
    depth_window: int = 20
    depth_threshold: float = 1.0
    depth_for_balanced: bool = False
    compat_double_deletion: bool = False

    @property
    def votes_needed(self) -> int:
        """The default asks for a vote of every kind of evidence in use."""
        return self.min_vote if self.min_vote >= 0 else 1 + int(self.use_pairs) + int(self.use_depth)


@dataclass(frozen=True)
class MergeOptions:
    """Merging call sets of several samples."""

    use_all: bool = False
    overlap: float = 0.8
