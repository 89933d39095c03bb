"""Estimates of token counts, and fitting texts to a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def estimate(text: Column) -> Column:
    """A quarter token per byte; white space counts half, a punctuation mark 0.3
    more, a digit 0.05 less; at least 1, rounded half up. Null and '' give 0."""
    t = F.coalesce(text, F.lit(""))
    n = lambda p: F.regexp_count(t, F.lit(p))
    raw = F.octet_length(t) / 4.0 - n(SPACES) * 0.125 + n(r"\p{P}") * 0.3 - n(r"\p{Nd}") * 0.05
    return F.when(t == "", 0).when(raw < 1, 1).otherwise(F.floor(raw + 0.5)).cast("int")


def estimate_block(content: Column, section: Column) -> Column:
    return estimate(content) + estimate(section)


def estimate_result(content: Column, snip: Column) -> Column:
    extra = F.when((snip != "") & (snip != content), F.floor(estimate(snip) / 3)).otherwise(0)
    return (estimate(content) + extra).cast("int")


def truncated(text: Column, limit: int) -> Column:
    """Cut to about ``limit`` tokens, at the last blank if that is past half,
    with '...'. Cut by characters, so that no character is torn."""
    if limit <= 0:
        return text
    est = estimate(text)
    size = F.floor(F.char_length(text) * (F.lit(float(limit)) / est) * 0.95).cast("int")
    cut = F.substring(text, F.lit(1), size)
    whole = F.regexp_replace(cut, r"\s\S*\z", "")
    back = F.when(F.char_length(whole) > F.floor(size / 2), whole).otherwise(cut)
    return F.when(est <= limit, text).otherwise(F.concat(F.trim(back), F.lit("...")))


def fits(text: Column, limit: int) -> Column:
    return estimate(text) <= limit


def within_budget(df: DataFrame, tokens: str, budget: int, group: list[str], order: list) -> DataFrame:
    """df with ``used`` (tokens so far) and ``kept`` (still within the budget)."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(tokens).over(w)).withColumn("kept", F.col("used") <= budget)


def estimate_context(before: Column, content: Column, after: Column) -> Column:
    """Of a block and of the arrays of contents around it."""
    total = lambda xs: F.aggregate(F.transform(F.coalesce(xs, F.array().cast("array<string>")), estimate), F.lit(0), lambda a, x: a + x)
    return total(before) + estimate(content) + total(after)


class Grouping:
    """Numbers of greedy groups of items, in order, whose weights add up to at
    most ``limit``. With ``alone`` an item above the limit has a group of its own
    and does not end up in the next one."""

    def __init__(self, limit: int, alone: bool = False):
        self.limit, self.alone = limit, alone
        self.group = self.used = self.n = 0

    def next(self, weight: int) -> int:
        big = self.alone and weight > self.limit
        new = self.n > 0 and (big or self.used + weight > self.limit)
        self.group += new
        self.used = self.limit + 1 if big else weight if new else self.used + weight
        self.n += 1
        return self.group


@dataclass
class TokenBudget:
    """Bookkeeping of a budget outside of queries."""

    limit: int
    used: int = 0

    def add(self, n: int) -> bool:
        if self.used + n > self.limit:
            return False
        self.used += n
        return True

    @property
    def remaining(self) -> int:
        return max(0, self.limit - self.used)

    @property
    def exhausted(self) -> bool:
        return self.used >= self.limit

    def reset(self) -> None:
        self.used = 0

    def usage(self) -> float:
        return 100.0 * self.used / self.limit if self.limit > 0 else 0.0
