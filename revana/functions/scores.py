"""Score and sentiment rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Class names of the comment table.
GOOD, MIDDLING, BAD = "好评", "中评", "差评"

# Fixed order of the sentiment labels.
LABELS = ("positive", "neutral", "negative")

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(value: Column, default: float = 0.0) -> Column:
    """Numeric value of a column; what is no number becomes ``default``."""
    text = value.cast("string")
    number = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    return F.coalesce(number, F.lit(float(default)))


def comment_class(score: Column, good: str = GOOD, middling: str = MIDDLING,
                  bad: str = BAD) -> Column:
    """4 and up is good, exactly 3 middling, the rest bad, 3.5 included."""
    return F.when(score >= 4, good).when(score == 3, middling).otherwise(bad)


def true_label(score: Column) -> Column:
    """4 and up is positive, up to 2 negative, between neutral (3.5 too)."""
    return F.when(score >= 4, "positive").when(score <= 2, "negative").otherwise("neutral")


def predicted_label(sentiment: Column, pos: float = 0.2, neg: float = 0.05) -> Column:
    return (F.when(sentiment > pos, "positive")
            .when(sentiment < neg, "negative").otherwise("neutral"))


def sharpen(raw: Column, gamma: float = 0.5) -> Column:
    """Power transform ``r^g / (r^g + (1-r)^g)`` of a probability."""
    up, down = F.pow(raw, F.lit(gamma)), F.pow(1 - raw, F.lit(gamma))
    return up / (up + down)


def sentiment_score(raw: Column, is_blank: Column, gamma: float = 0.5,
                    blank: float = 0.8) -> Column:
    """Sharpened probability, or ``blank`` for text without a token.

    Rounded to 9 digits so that the thresholds do not depend on the order in
    which a distributed sum was taken.
    """
    return F.when(is_blank, F.lit(blank)).otherwise(F.round(sharpen(raw, gamma), 9))
