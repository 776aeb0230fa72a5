"""Section rules: how an element is treated, weighted and tagged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import normalize_title, strip


# Section titles (normalised), matched whole or as a prefix.
SKIP = [
    "references", "bibliography", "acknowledgements", "acknowledgments", "author contributions", "credit author statement", "conflict of interest",
    "conflict of interest statement", "funding", "funding sources", "neurips checklist", "iclr checklist", "reproducibility checklist", "licenses",
    "legal notices",
]
HIGH = [
    "abstract", "introduction", "motivation", "conclusion", "conclusions", "contributions", "summary of contributions", "problem statement",
    "problem formulation", "method", "methods", "methodology", "proposed method", "our approach", "approach", "model", "architecture", "framework",
    "algorithm", "experiments", "experimental setup", "experimental results", "results", "evaluation", "evaluation setup", "baselines", "datasets",
    "data", "implementation details", "training details", "training", "training setup", "ablation study", "ablation studies", "analysis",
    "quantitative results", "discussion", "limitations", "limitations and future work",
]
LOW = [
    "reproducibility statement", "iclr reproducibility statement", "qualitative examples",
]
METADATA_ONLY = ["references", "bibliography"]
# Parts of a title that mark a broad section.
BROAD = [
    "abstract", "introduction", "conclusion", "discussion", "related work", "background", "contributions",
]
# First words that mark an acknowledgement inside a text.
ACKNOWLEDGEMENT = [
    "acknowledgements", "acknowledgments", "acknowledgement", "acknowledgment",
]
# First header cells that label rows.
ROW_LABELS = ["n", "row", "model", "method", "layer type", ""]


def _any(text: Column, test: str, words: list[str]) -> Column:
    """One pattern for all words, so that ``text`` is evaluated once and not once a word."""
    return text.rlike(("^" if test == "startswith" else "") + "(?:" + "|".join(words) + ")")


def subtype(raw: Column, token_count: Column) -> Column:
    """'acknowledgement', 'footnote' or 'text'."""
    bare = strip(raw)
    first = F.lower(F.split(bare, r"\s+")[0])
    note = bare.rlike(r"^\s*[0-9]+\s+[A-Z]") & (F.coalesce(token_count, F.lit(0)) < 60)
    return F.when(raw.isNull() | (raw == ""), "text").when(first.isin(ACKNOWLEDGEMENT), "acknowledgement").when(note, "footnote").otherwise("text")


def treatment(title: Column, raw: Column, token_count: Column) -> Column:
    """'skip', 'metadata_only', or 'process_' with high, medium or low; a null title is medium."""
    t = F.coalesce(normalize_title(title), F.lit(""))
    return (
        F.when(subtype(raw, token_count) == "acknowledgement", "skip")
        .when(t.isin(METADATA_ONLY), "metadata_only")
        .when(_any(t, "startswith", SKIP), "skip")
        .when(_any(t, "startswith", HIGH), "process_high")
        .when(_any(t, "startswith", LOW), "process_low")
        .otherwise("process_medium")
    )


def _mapped(value: Column, pairs: dict, default) -> Column:
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(table[value], F.lit(default))


def importance(treated: Column) -> Column:
    return _mapped(treated, {"process_high": "high", "process_medium": "medium", "process_low": "low", "skip": "low", "metadata_only": "low"}, "medium")


def boost(treated: Column) -> Column:
    return _mapped(treated, {"process_high": 1.10, "process_medium": 1.00, "process_low": 0.95, "skip": 0.0, "metadata_only": 0.0}, 1.00)


def embeds(treated: Column) -> Column:
    return treated.isin("process_high", "process_medium", "process_low")


def affinities(kind: Column, title: Column, treated: Column) -> Column:
    """Query affinity tags, as an array."""
    t = F.coalesce(normalize_title(title), F.lit(""))
    tags = lambda *x: F.array(*map(F.lit, x))
    return (
        F.when(kind == "table", tags("table", "specific"))
        .when(kind == "equation", tags("equation", "specific"))
        .when(kind == "figure", tags("figure"))
        .when((treated == "process_high") & ~_any(t, "contains", BROAD), tags("specific"))
        .otherwise(tags("broad"))
    )


def table_misaligned(kind: Column, header: Column, rows: Column) -> Column:
    """Whether a table's first column holds labels under a header that should hold numbers."""
    first = F.lower(F.trim(F.try_element_at(header, F.lit(1))))
    cell = F.trim(F.coalesce(F.try_element_at(F.try_element_at(rows, F.lit(1)), F.try_element_at(header, F.lit(1))), F.lit("")))
    digits = F.regexp_replace(cell, r"[.\-]", "")
    some = (F.size(header) > 0) & (F.size(rows) > 0)
    return F.coalesce((kind == "table") & some & first.isin(ROW_LABELS) & (cell != "") & ~digits.rlike("^[0-9]+$"), F.lit(False))


def misaligned_text(caption: Column, header: Column) -> Column:
    """Caption and column names in place of the text of a misaligned table."""
    return F.concat(F.coalesce(caption, F.lit("")), F.lit("\n\nColumns: "), F.array_join(header, " | "))
