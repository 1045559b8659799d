"""Psychometric item analysis of evaluation suites, as DataFrame operations."""

from .operators.inference import backwards_p_values, benjamini_hochberg, tail_method
from .operators.items import correlation, difficulty, discrimination, item_moments, item_statistics, item_variance, model_totals
from .operators.suites import real_gap, reliability, suite_summary
from .plans.analysis import Report, analyze
from .plans.leaderboard import Leaderboard, leaderboard_study
from .plans.rendering import diagnosis, to_html, to_text
from .sources.ingest import items_from_dicts, items_from_jsonl, responses_from_records, responses_from_scores
from .sources.results_tree import read_matrix, read_tree, write_matrix_file

__all__ = [
    "Leaderboard",
    "Report",
    "analyze",
    "backwards_p_values",
    "benjamini_hochberg",
    "correlation",
    "diagnosis",
    "difficulty",
    "discrimination",
    "item_moments",
    "item_statistics",
    "item_variance",
    "items_from_dicts",
    "items_from_jsonl",
    "leaderboard_study",
    "model_totals",
    "read_matrix",
    "read_tree",
    "real_gap",
    "reliability",
    "responses_from_records",
    "responses_from_scores",
    "suite_summary",
    "tail_method",
    "to_html",
    "to_text",
    "write_matrix_file",
]
