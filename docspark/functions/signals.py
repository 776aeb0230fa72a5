"""Query signals and the rule-based choice of a retrieval mode."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import strip


# Phrases looked for anywhere in the lower-cased query. One that is listed twice counts twice.
SPECIFIC = [
    "how many", "what is the value", "exact", "specific", "what was", "which number", "what score", "what rate", "how much", "how long", "how large",
    "how fast", "table", "figure", "result", "score", "metric", "benchmark", "performance", "accuracy", "bleu", "perplexity", "loss", "precision",
    "recall", "f1", "wmt", "newstest", "dataset", "learning rate", "batch size", "epoch", "step", "dropout", "regularization", "weight decay",
    "warmup", "optimizer", "adam", "gpu", "parameter", "layer", "head", "dimension", "size", "weight decay", "p_drop", "label smoothing",
    "checkpoint", "warmup steps", "beta", "epsilon",
]
BROAD = [
    "why", "how does", "what is the purpose", "explain", "describe", "overview", "concept", "motivation", "advantage", "benefit", "intuition",
    "difference between", "what makes", "what approach", "summarize", "what is", "how does this work", "what problem", "contribution", "novel",
    "propose", "main idea", "key insight", "compare", "versus", "what problem", "what challenge", "what limitation", "solve", "address", "tackle",
    "overcome", "what does", "how is", "in what way", "what role", "what purpose", "what effect", "what impact",
]
#: Empty phrases in the list of broad ones: each counts for every query.
EMPTY_BROAD = 3
TABLE = [
    "table", "comparison", "versus", "vs", "compared to", "results show", "in table", "performance of", "benchmark", "leaderboard", "outperforms",
    "beats", "achieves",
]
EQUATION = [
    "formula", "equation", "calculate", "compute", "loss function", "learning rate formula", "objective", "mathematically", "expression",
    "defined as", "softmax", "attention formula", "function",
]
FIGURE = [
    "figure", "diagram", "architecture diagram", "visualization", "plot", "graph", "shown in", "illustrated", "depicted", "image", "picture",
]
CROSS_SECTION = [
    "throughout", "overall", "in general", "the paper", "main contribution", "key idea", "approach", "the method", "the model", "the system",
    "proposed", "summarize the paper", "what does this paper", "entire paper", "whole paper", "this work",
]
NUMBER = r"\b[0-9]+\.?[0-9]*\b"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _count(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(p).cast("int") for p in phrases])


def _some(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def signals(query: Column, compat: bool = True) -> dict[str, Column]:
    """The signals of a query; ``compat`` counts the empty phrases and repeats of the lists."""
    q = F.coalesce(strip(F.lower(query)), F.lit(""))
    specific, broad = (SPECIFIC, BROAD) if compat else (list(dict.fromkeys(SPECIFIC)), list(dict.fromkeys(BROAD)))
    number = q.rlike(NUMBER)
    return {
        "specific_score": _once(q, lambda v: _count(v, specific)) + number.cast("int"),
        "broad_score": _once(q, lambda v: _count(v, broad)) + F.lit(EMPTY_BROAD if compat else 0),
        "table_signal": _once(q, lambda v: _some(v, TABLE)),
        "equation_signal": _once(q, lambda v: _some(v, EQUATION)),
        "figure_signal": _once(q, lambda v: _some(v, FIGURE)),
        "cross_section": _once(q, lambda v: _some(v, CROSS_SECTION)),
        "has_number": number,
    }


def mode() -> Column:
    """Retrieval mode from columns named as :func:`signals` names them: modality, broad, specific, balanced, in this order."""
    c = F.col
    return (
        F.when(c("table_signal") | c("equation_signal") | c("figure_signal"), "D")
        .when(c("cross_section") | (c("broad_score") > c("specific_score") + 1), "B")
        .when((c("specific_score") > c("broad_score") + 1) | c("has_number"), "A")
        .otherwise("C")
    )


#: Fixed values by mode: weight of the dense and of the sparse leg, results per leg, lowest and highest level, results after re-ranking, section boosts.
PLANS = {
    "A": (0.40, 0.60, 8, 0, 0, 4, False),
    "B": (0.65, 0.35, 6, 1, 3, 4, True),
    "C": (0.50, 0.50, 12, 0, 99, 5, True),
    "D": (0.50, 0.50, 8, 0, 99, 4, True),
}
PLAN_FIELDS = ("dense_weight", "sparse_weight", "top_k", "least_level", "most_level", "rerank_n", "boosted")


def plan(chosen: Column) -> dict[str, Column]:
    """The plan of a mode, one column per field."""
    out = {}
    for n, field in enumerate(PLAN_FIELDS):
        out[field] = F.create_map(*[F.lit(x) for m, values in PLANS.items() for x in (m, values[n])])[chosen]
    return out
