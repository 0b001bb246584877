"""Column expressions. All are built-in functions, so they stay inside code generation."""

from .flags import is_own, voted_down, voted_up
from .scores import blank_zero, level, score_bar_text, score_bars
from .text import (
    default_photo,
    extract_mentions,
    is_long_post,
    linkify,
    notification_link,
    notification_text,
    truncate_post,
)
from .times import display_date, display_day, hours, local_day, ntz, time_ago

__all__ = [
    "blank_zero",
    "default_photo",
    "display_date",
    "display_day",
    "extract_mentions",
    "hours",
    "is_long_post",
    "is_own",
    "level",
    "linkify",
    "local_day",
    "notification_link",
    "notification_text",
    "ntz",
    "score_bar_text",
    "score_bars",
    "time_ago",
    "truncate_post",
    "voted_down",
    "voted_up",
]
