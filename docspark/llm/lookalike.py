"""One consistent form for texts that look the same.

1. Compatibility: letter width, kinds of blank and hyphen, canonical composition;
   characters that show nothing are deleted. Raised and lowered digits, fractions,
   circled and styled letters differ to the eye and stay.
2. Look-alikes: each run of letters becomes a lattice of the letters of all scripts
   that look the same. Viterbi picks the path of highest score: character bigrams of the path's
   script, the probability of a change of script inside a run, and that of the script in this
   document. A run some script can spell whole keeps to one script.
All scores are counted over all documents from letters and runs that only one script can spell. The script of
a document is judged by such letters too. So everything depends on what a text looks like and
nothing on how it is written, and texts that look the same always get the same form.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.pairs import pairs_within

# Letters that look the same, Latin first where there is one, then Cyrillic, Greek, Armenian, Cherokee, Lisu.
CLASSES = (
    "aа", "cсϲ", "dԁ", "eе", "hһ", "iі", "jјϳ", "lӏ", "oоοօ", "pр", "qԛ", "sѕ", "uս", "vѵν", "wԝ", "xх", "yу",
    "AАΑᎪꓮ", "BВΒꓐ", "CСϹᏟꓚ", "DꓓᎠ", "EЕΕᎬꓰ", "FꓝϜ", "GԌᏀꓖ", "HНΗᎻꓧ", "IІΙӀꓲ", "JЈͿᎫꓙ", "KКΚᏦꓗ", "LᏞꓡ", "MМΜᎷꓟ", "NΝꓠ", "OОΟՕꓳ",
    "PРΡᏢꓑ", "RᎡꓣ", "SЅՏᏚꓢ", "TТΤᎢꓔ", "UՍꓴ", "VѴᏙꓦ", "WԜᎳꓪ", "XХΧꓫ", "YҮΥꓬ", "ZΖᏃꓜ", "ГΓ", "ПΠ", "ФΦ",
)
CLASS_OF = {c: group for group in CLASSES for c in group}
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "LISU")
#: Decomposition tags that change nothing a reader sees, apart from letter width and kind of blank.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>")
#: So many letters of a document count as much as the shares in all documents.
KAPPA = 1.0
#: Rows of the counts that hold letters and changes of script, and stand for no bigram.
LETTERS, CHANGES = ("", "letters"), ("", "changes")

_RUN = re.compile(r"(?:[^\W\d_][̀-ͯ]*)+")
_WIDE_RUN = re.compile(r"[^\x00-\x7f]+")
_WIDE = re.compile(r"[^\x00-\x7f]")
_ASCII_LETTERS = "".join(chr(c) for c in range(128) if chr(c).isalpha())
_TWINS = "".join(c for c in _ASCII_LETTERS if c in CLASS_OF)
_SURE = "".join(c for c in _ASCII_LETTERS if c not in CLASS_OF).encode()
#: Runs of an ASCII text that another script could spell too.
_DOUBTFUL = re.compile(f"(?<![A-Za-z])[{_TWINS}]+(?![A-Za-z])")


@lru_cache(maxsize=None)
def script(c: str) -> int:
    """Index in SCRIPTS, or the number after the last for other letters."""
    name = unicodedata.name(c, "")
    return next((k for k, s in enumerate(SCRIPTS) if name.startswith(s)), len(SCRIPTS))


@lru_cache(maxsize=None)
def _options(c: str) -> dict[int, str]:
    """The letters that look like ``c``, the first of each script."""
    out: dict[int, str] = {}
    for x in CLASS_OF.get(c, c):
        out.setdefault(script(x), x)
    return out


class _Compat(dict):
    """A translation table filled as characters turn up; bounded by the characters there are."""

    def __missing__(self, code: int) -> int | str | None:
        self[code] = out = self.look(code)
        return out

    @staticmethod
    def look(code: int) -> int | str | None:
        c = chr(code)
        if c in "\t\n\r" or 0x03D0 <= code <= 0x03FF or code == 0x017F:  # Greek symbols and long s look different
            return code
        kind = unicodedata.category(c)
        if kind == "Zs":
            return " "
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0):
            return None
        if code in (0x2010, 0x2011, 0xFE63):
            return "-"
        d = unicodedata.decomposition(c)
        if d.startswith("<"):
            tag, *parts = d.split()
            out = "".join(chr(int(x, 16)) for x in parts)
            if tag in SAME_LOOK and not out.startswith(" "):
                return out.translate(COMPAT)
        return code


COMPAT = _Compat()


def compat(text: str) -> str:
    """Step 1; the result is decomposed. Line ends become line feeds, tabs blanks."""
    if text.isascii():
        return text.replace("\r\n", "\n").replace("\t", " ") if "\r" in text or "\t" in text else text
    # ASCII characters stay what they are
    out = unicodedata.normalize("NFD", _WIDE_RUN.sub(lambda m: m[0].translate(COMPAT), text))
    return out.replace("\r\n", "\n").replace("\t", " ")


def _letters(run: str) -> list[tuple[str, str]]:
    return [(m[0], m[1:]) for m in re.findall(r".[̀-ͯ]*", run, re.S)]


def _common(letters: list[tuple[str, str]]) -> set[int]:
    """The scripts that can spell all the letters."""
    out = set(_options(letters[0][0]))
    for c, _ in letters[1:]:
        out &= _options(c).keys()
    return out


@lru_cache(maxsize=200_000)
def _evidence(run: str) -> tuple[tuple[tuple[str, str], ...], int]:
    """What a run adds to the counts: its bigrams if only one script can spell it; else the changes of script that are certain."""
    letters = _letters(run)
    common = _common(letters)
    if len(common) == 1:
        k = next(iter(common))
        path = [_options(c)[k] for c, _ in letters]
        return tuple(zip(["^", *path], path)), 0
    return (), 0 if common else sum(not _options(a).keys() & _options(b).keys() for (a, _), (b, _) in zip(letters, letters[1:]))


class Resolver:
    """Step 2 under given counts ``{(first, second): n}`` of bigrams; ``^`` stands before a run."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        self.counts = {k: n for k, n in counts.items() if k[0]}
        self.total: Counter = Counter()
        seen: list[set] = [{c for c in CLASS_OF if script(c) == k} for k in range(len(SCRIPTS) + 1)]
        share = [1.0] * (len(SCRIPTS) + 1)
        for (a, b), n in self.counts.items():
            self.total[a, script(b)] += n
            seen[script(b)].add(b)
            share[script(b)] += n
        self.kinds = [len(x) + 1 for x in seen]
        self.share = [x / sum(share) for x in share]
        self.change = -math.log((counts.get(CHANGES, 0) + 0.5) / (counts.get(LETTERS, 0) + 1000.0))
        self.paths = lru_cache(maxsize=200_000)(self._paths)

    def cost(self, a: str, b: str) -> float:
        k = script(b)
        return -math.log((self.counts.get((a, b), 0) + 0.5) / (self.total[a, k] + 0.5 * self.kinds[k]))

    def _paths(self, run: str) -> tuple[tuple[int, float, str], ...]:
        """The best path of each script a run may begin in, as ``(script, cost, text)``."""
        letters = _letters(run)
        common = _common(letters)
        if common:
            out = []
            for k in sorted(common):
                path = [_options(c)[k] for c, _ in letters]
                cost = sum(self.cost(a, b) for a, b in zip(["^", *path], path)) if len(common) > 1 else 0.0
                out.append((k, cost, "".join(c + marks for c, (_, marks) in zip(path, letters))))
            return tuple(out)
        out = []
        for first, c in _options(letters[0][0]).items():
            paths = {c: (self.cost("^", c), c + letters[0][1])}
            for letter, marks in letters[1:]:
                paths = {
                    b: min((v + (self.cost(a, b) if script(a) == script(b) else self.change + self.cost("^", b)), t + b + marks) for a, (v, t) in paths.items())
                    for b in _options(letter).values()
                }
            out.append((first, *min(paths.values())))
        return tuple(out)

    def prior(self, text: str) -> list[float]:
        """Cost of each script in a text, by the letters that only one script has."""
        own = [0] * (len(SCRIPTS) + 1)
        plain = text.encode("ascii", "ignore")
        own[0] = len(plain) - len(plain.translate(None, _SURE))
        if len(plain) < len(text):
            for c, n in Counter(_WIDE.findall(text)).items():
                if c not in CLASS_OF and c.isalpha():
                    own[script(c)] += n
        total = sum(own) + KAPPA
        return [-math.log((n + KAPPA * s) / total) for n, s in zip(own, self.share)]

    def text(self, text: str) -> str:
        """The canonical form of a whole text."""
        out = compat(text)
        runs = _DOUBTFUL if out.isascii() else _RUN
        prior: list[float] = []
        changed: dict[str, str] = {}
        for run in set(runs.findall(out)):
            paths = self.paths(run)
            if len(paths) > 1 and not prior:
                prior = self.prior(out)
            best = paths[0][2] if len(paths) == 1 else min((cost + prior[k], k, t) for k, cost, t in paths)[2]
            if best != run:
                changed[run] = best
        if changed:
            out = runs.sub(lambda m: changed.get(m[0], m[0]), out)
        return out if out.isascii() else unicodedata.normalize("NFC", out)


def _bigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a partition: bigrams of runs that only one script can spell, letters, and changes of script that are certain."""
    counts: Counter = Counter()
    for pdf in batches:
        words: Counter = Counter()
        for t in pdf["text"]:
            words.update(_RUN.findall(compat(t)))
        for w, n in words.items():
            pairs, changes = _evidence(w)
            counts[LETTERS] += n * len(w)
            counts[CHANGES] += n * changes
            for pair in pairs:
                counts[pair] += n
    yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["a", "b", "n"])


def bigram_counts(documents: DataFrame) -> dict[tuple[str, str], int]:
    """Counts over all documents; pairs of letters of one script reach the driver, at most the squares of six alphabets."""
    parts = documents.select("text").where("text is not null and text <> ''").mapInPandas(_bigrams, "a string, b string, n long")
    total = parts.where(_spelt(F.col("b")) | (F.col("a") == "")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return {(r.a, r.b): r.n for r in total.collect()}


def _spelt(c):
    """Letters of SCRIPTS: bigrams of other scripts decide nothing and are not collected."""
    return c.rlike("^[\\p{IsLatin}\\p{IsCyrillic}\\p{IsGreek}\\p{IsArmenian}\\p{IsCherokee}\\p{IsLisu}]$")


def _canonical(counts: dict) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resolver = Resolver(counts)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": pdf["digest"], "canonical": [resolver.text(t) for t in pdf["text"]]})

    return run


def canonical_texts(documents: DataFrame) -> DataFrame:
    """``documents(doc_id, text)`` -> ``(doc_id, digest, canonical)``, ``digest`` being that of the text as it was.

    Null texts are left out; an empty text stays empty, as does one that shows nothing. Letter
    case, accents, digits, punctuation, line ends and the number of blanks stay. Repeated
    rows come out repeated.
    """
    counts = bigram_counts(documents)
    rows = documents.where("text is not null").select("doc_id", "text", F.md5("text").alias("digest"))
    return rows.mapInPandas(_canonical(counts), "doc_id bigint, digest string, canonical string")


def _forms(canonical: DataFrame) -> DataFrame:
    return canonical.select("doc_id", "digest", F.md5("canonical").alias("form")).distinct()


def equal_looking_pairs(canonical: DataFrame) -> DataFrame:
    """``(doc_id_a, doc_id_b)``: texts with the same canonical form that are not equal as they were."""
    keys = _forms(canonical)
    forms = keys.groupBy("form").agg(F.count("*").alias("n"), F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("form", "n")
    pairs = pairs_within(keys.join(forms, "form"), "form", "doc_id", "digest")
    return pairs.where("digest_a <> digest_b").select("doc_id_a", "doc_id_b").distinct()


def equal_looking_classes(canonical: DataFrame) -> DataFrame:
    """``(doc_id, class_id, n_members, n_texts)``: every document with the smallest id that looks the same, how many do, and how many different texts they are."""
    keys = _forms(canonical)
    sizes = keys.groupBy("form").agg(F.min("doc_id").alias("class_id"), F.count_distinct("doc_id").alias("n_members"), F.count_distinct("digest").alias("n_texts"))
    return keys.join(sizes, "form").select("doc_id", "class_id", "n_members", "n_texts").distinct()
