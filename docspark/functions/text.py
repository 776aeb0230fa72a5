"""Text functions as column expressions (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.strip`` sees it, in a class both Java and RE2 read.
BLANK = r"\s\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def count_tokens(text: Column) -> Column:
    """0 for null and empty, else a quarter of the code points, at least 1."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def hash_text(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as hex."""
    return F.sha2(text, 256)


def clean_text(text: Column) -> Column:
    """Without control characters, runs of blanks as one, at most one empty line, stripped."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def extract_numbers(text: Column) -> Column:
    """The distinct numbers of the text as they are spelt, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\b[0-9]+\.?[0-9]*\b)"), 1))


def split_sentences(text: Column) -> Column:
    """Cut at white space after ``.!?`` and before a capital A-Z; stripped, without empty ones."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentence_boundary(text: Column, target_tokens: int, slack_chars: int = 150, look_chars: int = 300) -> Column:
    """Length of the leading sentences that end within the target (plus slack); the whole length if it fits, -1 if none does."""
    limit = 4 * target_tokens
    sentences = split_sentences(F.substring(text, 1, limit + look_chars))
    state = F.aggregate(
        sentences,
        F.struct(F.lit(0).alias("at"), F.lit(-1).alias("end")),
        lambda acc, s: F.struct(
            (acc["at"] + F.length(s) + 1).alias("at"),
            F.when(acc["at"] + F.length(s) <= limit + slack_chars, acc["at"] + F.length(s)).otherwise(acc["end"]).alias("end"),
        ),
    )
    return F.when(F.length(text) <= limit, F.length(text)).otherwise(state["end"])


def normalize_title(title: Column) -> Column:
    """Without a leading section number, stripped, lower case."""
    return F.lower(strip(F.regexp_replace(title, r"^[0-9]+[.0-9]*\s*", "")))


def chunk_id(paper_id: Column, level: Column, sequence: Column) -> Column:
    short = F.substring(F.replace(paper_id, F.lit(" "), F.lit("_")), 1, 30)
    return F.concat(short, F.lit("_L"), level.cast("string"), F.lit("_"), F.format_string("%04d", sequence))


def chunk_type(modalities: Column) -> Column:
    """The single modality, else 'mixed' (also for none)."""
    kinds = F.array_distinct(F.filter(modalities, lambda m: m.isNotNull()))
    return F.when(F.size(kinds) == 1, kinds[0]).otherwise("mixed")


def position_in_paper(order: Column, n_elements: Column) -> Column:
    return F.round(order / F.greatest(n_elements, F.lit(1)), 4)


def word_limit(amount: Column) -> Column:
    """30 % of the amount, from 100 to 350."""
    return F.greatest(F.lit(100), F.least(F.lit(350), F.floor(amount * 0.30).cast("int")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{BLANK}]+"), lambda w: w != ""))


def pack_paragraphs(text: Column, cap_tokens: int) -> Column:
    """Greedy packing of paragraphs into parts of at most ``cap_tokens``; a longer paragraph is packed by its sentences, a longer sentence stands alone."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(count_tokens(p) > cap_tokens, split_sentences(p)).otherwise(F.array(p))))
    empty = F.array().cast("array<string>")

    def step(acc: Column, u: Column) -> Column:
        fits = count_tokens(F.concat(acc["open"], F.lit("\n\n"), u)) <= cap_tokens
        return F.struct(
            F.when((acc["open"] == "") | fits, acc["parts"]).otherwise(F.concat(acc["parts"], F.array(acc["open"]))).alias("parts"),
            F.when(acc["open"] == "", u).when(fits, F.concat(acc["open"], F.lit("\n\n"), u)).otherwise(u).alias("open"),
        )

    return F.aggregate(
        units,
        F.struct(empty.alias("parts"), F.lit("").alias("open")),
        step,
        lambda acc: F.when(acc["open"] == "", acc["parts"]).otherwise(F.concat(acc["parts"], F.array(acc["open"]))),
    )


def extractive_summary(texts: Column) -> Column:
    """First and last sentence (by full stop) of each text, joined."""
    def ends(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, r"\."), strip), lambda s: s != "")
        return F.when(F.size(parts) > 1, F.array(parts[0], F.element_at(parts, -1))).otherwise(parts)

    sentences = F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), ends))
    return F.when(F.size(sentences) > 0, F.concat(F.array_join(sentences, ". "), F.lit("."))).otherwise("")


def tag_label(label: Column) -> Column:
    """Stripped, lower case, first 50 characters."""
    return F.substring(F.lower(strip(label)), 1, 50)


def encode_cursor(value: Column, row_id: Column) -> Column:
    """Opaque position of a row in a keyset-paged order."""
    return F.base64(F.concat(value.cast("string"), F.lit("|"), row_id.cast("string")).cast("binary"))


def decode_cursor(cursor: Column) -> Column:
    """``struct(value, id)`` of :func:`encode_cursor`; the id is what follows the last bar."""
    text = F.unbase64(cursor).cast("string")
    return F.struct(F.regexp_extract(text, r"(?s)^(.*)\|([^|]*)$", 1).alias("value"), F.regexp_extract(text, r"(?s)^(.*)\|([^|]*)$", 2).alias("id"))


def backoff(attempt: Column, base: float, cap: float) -> Column:
    """Seconds before the next attempt, without jitter."""
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt))


def first_number(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whole seconds named by the first pattern that matches (its group 1), else null."""
    found = [F.when(F.regexp_extract(text, p, 1) != "", F.regexp_extract(text, p, 1).cast("double").cast("int")) for p in patterns]
    return F.coalesce(*found)


# What a model's name contains, in the order of the tests, and the provider it stands for.
PROVIDERS = (("gemini", "gemini"), ("groq", "groq"), ("openrouter", "openrouter"), ("gpt", "openai"), ("openai", "openai"), ("claude", "anthropic"), ("anthropic", "anthropic"), ("ollama", "ollama"))


def provider(model: Column) -> Column:
    """The provider of a model name; 'unknown' for others and null."""
    name, out = F.lower(model), None
    for part, found in PROVIDERS:
        out = F.when(name.contains(part), found) if out is None else out.when(name.contains(part), found)
    return out.otherwise("unknown")


def progress(status: Column, step: Column, steps: tuple[tuple[str, int], ...]) -> Column:
    """Percent done: 0 for 'none', 100 for 'ready' and 'failed', else by the step."""
    by_step = F.coalesce(F.create_map(*[F.lit(x) for pair in steps for x in pair])[step], F.lit(0))
    return F.when(status == "none", 0).when(status.isin("ready", "failed"), 100).otherwise(by_step)


#: Bytes a file may have.
MOST_BYTES = 50 * 1024 * 1024


def file_facts(content: Column, name: Column) -> dict[str, Column]:
    """SHA-256 of the bytes, their number, whether they are within the limit, and a name of safe characters."""
    size = F.octet_length(content)
    safe = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9._-]+", "_"), "^[_.]+|[_.]+$", "")
    return {"file_hash": F.sha2(content, 256), "n_bytes": size.cast("bigint"), "allowed": size <= MOST_BYTES, "file_name": F.concat(F.substring(safe, 1, 100), F.lit(".pdf"))}
