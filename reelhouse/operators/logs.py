"""Structured log records: envelope building and level routing (L1), category-domain check
with a quarantine (L2). Per-row expressions only; routing is a column (the sink partitions
by it), so nothing is collected or looped over on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.exprs import format_text

APP_NAME = "media-api"


def log_channel(level, app: str = APP_NAME):
    return F.concat(F.lit(f"logs:{app}:"), F.col(level) if isinstance(level, str) else level)


def envelope(category="category", level="level", message="message", source_id="source_id"):
    """The JSON envelope: category, level, message and source_id, the last omitted when
    empty (to_json drops NULL fields, so '' becomes NULL first)."""
    return F.to_json(F.struct(F.col(category).alias("category"), F.col(level).alias("level"),
                              F.col(message).alias("message"),
                              F.nullif(F.col(source_id), F.lit("")).alias("source_id")))


def _valid(category="category", level="level"):
    return F.coalesce(F.col(category).isin(*S.LOG_CATEGORIES) & F.col(level).isin(*S.LOG_LEVELS), F.lit(False))


def log_envelopes(records: DataFrame, app: str = APP_NAME, key: str = "event_id") -> DataFrame:
    """L1: envelopes of the records with a valid category and level, with their channel."""
    return records.filter(_valid()).select(key, "level", log_channel("level", app).alias("channel"),
                                           envelope().alias("envelope"))


def formatted_envelopes(calls: DataFrame, app: str = APP_NAME, key: str = "event_id") -> DataFrame:
    """L1 from the logger's call: records with ``template`` and ``args`` (array of text) instead of a
    message (see ``exprs.format_text``)."""
    message = format_text("template", "args")
    return log_envelopes(calls.select(key, "level", "category", "source_id", message.alias("message")), app, key)


def log_quarantine(records: DataFrame, key: str = "event_id") -> DataFrame:
    """L2: records whose category (or level) is outside the domain."""
    reason = F.when(~F.coalesce(F.col("category").isin(*S.LOG_CATEGORIES), F.lit(False)), "invalid category") \
        .otherwise("invalid level")
    return records.filter(~_valid()).select(key, "category", "level", "message", reason.alias("reason"))
