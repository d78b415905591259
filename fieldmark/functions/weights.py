"""Weights of neighbours and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lnbnn(vote: Column, norm: Column) -> Column:
    return norm - vote


def ratio(vote: Column, norm: Column) -> Column:
    return F.try_divide(vote, norm)


def bar_l2(vote: Column, norm: Column) -> Column:
    return 1 - vote


def loglnbnn(vote: Column, norm: Column) -> Column:
    return F.ln(norm - vote + 1)


def logratio(vote: Column, norm: Column) -> Column:
    return F.ln(norm / (vote + 1e-8) + 1)


def normonly(vote: Column, norm: Column) -> Column:
    return norm


def const(vote: Column, norm: Column) -> Column:
    return F.lit(1.0)


def foreground(query: Column, other: Column) -> Column:
    return F.sqrt(query * other)


NAMED = {"lnbnn": lnbnn, "ratio": ratio, "bar_l2": bar_l2, "loglnbnn": loglnbnn, "logratio": logratio, "normonly": normonly, "const": const}


def idf(total: Column, holding: Column) -> Column:
    """ln(total / holding); 0 where nothing holds the word."""
    return F.when(holding > 0, F.ln(total / holding)).otherwise(0.0)


def selectivity(u: Column, alpha: float = 3.0, least: float = 0.0) -> Column:
    """sign(u) |u|^alpha from the threshold on, else 0."""
    return F.when(u >= least, F.signum(u) * F.pow(F.abs(u), F.lit(alpha))).otherwise(0.0)


def any_remain(rate: Column, patience: int, binomial: bool = True) -> Column:
    """Probability that one of `patience` more reviews is meaningful, by the moving average of those so far."""
    return 1 - F.pow(1 - rate, F.lit(float(patience))) if binomial else 1 - F.exp(-rate * patience)


def cut_weight(reviews: Column, probability: Column, confidence: Column) -> Column:
    """An edge's weight in a minimum cut. Fixed values by confidence."""
    sure = F.when(confidence == "absolutely_sure", 4.0).when(confidence == "pretty_sure", 0.6).when(confidence == "not_sure", 0.2).otherwise(0.0)
    return F.coalesce(reviews, F.lit(1)) + F.coalesce(probability, F.lit(0.0)) + sure
