"""Chunking parsed elements: a state machine over each paper's elements in order.

Rows are partitioned by paper and sorted inside the partition; the machine
runs over the stream of Arrow batches and holds one open buffer, so a paper of any
length needs no more memory than its largest chunk. What one element looks ahead to
(the next action) and the paper's totals are window columns of the same partitioning.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import sections

LEAST, TARGET, MOST = 100, 300, 500
#: Tokens after which a new part begins in a paper without headers.
PART = 400
ATOMIC = ("table", "equation", "figure")
BOUNDARY, ALONE, MERGED = "hard_chunk_boundary", "self_contained_chunk", ("merge_with_adjacent_text", "merge_with_anchor_element")

OUT = "paper_id string, seq int, section_title string, first_order int, last_order int, soft_split boolean, token_count int, modalities string, source_element_ids array<string>, text string"
_NAMES = [c.split()[0] for c in OUT.split(", ")]
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_CUT = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def tokens(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def clean(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", _CONTROL.sub("", text))).strip()


def cut_at(text: str, target: int = TARGET) -> int:
    """Where to cut: the last sentence end up to the target (with slack), else four characters a token."""
    limit = 4 * target
    if len(text) <= limit:
        return len(text)
    end = at = 0
    for m in _CUT.finditer(text, 0, limit + 300):
        at = m.start()
        if at > limit + 150:
            break
        end = at
    return end if end > 0 else limit


class Machine:
    """Chunks of one paper. A trailing buffer below the least size becomes the last chunk; small soft-split pieces wait for the next chunk."""

    def __init__(self, paper: str) -> None:
        self.paper, self.seq, self.out = paper, 0, []
        self.waiting: tuple | None = None
        self.clear()

    def clear(self) -> None:
        self.parts: list[str] = []
        self.elements: list[tuple] = []
        self.size = 0

    def put(self, e: tuple, text: str) -> None:
        if text:
            self.parts.append(text)
        self.elements.append(e)
        self.size += tokens(text)

    def flush(self, soft: bool = False, last: bool = False) -> None:
        text = "\n\n".join(self.parts).strip()
        if not text:
            self.clear()
            return
        n = tokens(text)
        if n < LEAST and not soft and not last:
            return  # kept open: it joins what follows
        first, final = self.elements[0], self.elements[-1]
        row = [first[1], first[2], final[2], soft, [text], {e[3] for e in self.elements}, list(dict.fromkeys(e[0] for e in self.elements))]
        self.clear()
        if self.waiting is not None:
            w, self.waiting = self.waiting, None
            row = [w[0], w[1], row[2], row[3], w[4] + row[4], w[5] | row[5], list(dict.fromkeys(w[6] + row[6]))]
        if soft and n < LEAST and not last:
            self.waiting = tuple(row)
            return
        self.emit(row)

    def emit(self, row) -> None:
        text = "\n\n".join(row[4])
        self.out.append((self.paper, self.seq, row[0], row[1], row[2], row[3], tokens(text), ",".join(sorted(x for x in row[5] if x)), row[6], text))
        self.seq += 1

    def element(self, e: tuple, action: str, text: str, next_action: str | None) -> None:
        """``e``: id, section title, order, type."""
        if action == BOUNDARY:
            self.flush()
            return
        if action == ALONE:
            self.flush()
            self.put(e, clean(text))
            self.flush()
            return
        if action not in MERGED:
            self.put(e, clean(text))
            return
        n = tokens(text)
        if n > MOST and e[3] in ATOMIC:
            self.flush()
            self.put(e, clean(text))
            self.flush()
            return
        if n > MOST:
            self.flush()
            while text:
                if tokens(text) <= MOST:
                    self.put(e, clean(text))
                    break
                k = cut_at(text)
                head, text = text[:k].strip(), text[k:].strip()
                if head:
                    self.put(e, clean(head))
                    self.flush(soft=True)
            return
        if self.parts and self.size + n > MOST:
            whole, held = "\n\n".join(self.parts), self.elements
            k = cut_at(whole)
            self.parts = [whole[:k].strip()]
            self.flush(soft=True)
            if whole[k:].strip():  # the tail keeps its source elements
                self.parts, self.elements = [clean(whole[k:])], held[-1:]
                self.size = tokens(self.parts[0])
        self.put(e, clean(text))
        if self.size >= TARGET and next_action != BOUNDARY:
            self.flush()

    def finish(self) -> None:
        self.flush(last=True)
        if self.waiting is not None:
            row, self.waiting = self.waiting, None
            self.emit(row)

    def take(self) -> list[tuple]:
        rows, self.out = self.out, []
        return rows


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    machine: Machine | None = None
    for pdf in batches:
        rows: list[tuple] = []
        for paper, eid, title, order, kind, action, text, nxt in zip(*(pdf[c] for c in ("paper_id", "element_id", "title", "ord", "type", "action", "text", "next_action"))):
            if machine is None or machine.paper != paper:
                if machine is not None:
                    machine.finish()
                    rows += machine.take()
                machine = Machine(paper)
            machine.element((eid, title, int(order), kind), action, text or "", nxt)
            rows += machine.take()
        yield pd.DataFrame(rows, columns=_NAMES)
    if machine is not None:
        machine.finish()
        yield pd.DataFrame(machine.take(), columns=_NAMES)


def newest_elements(elements: DataFrame) -> DataFrame:
    """One row per element id, the one parsed last."""
    keep = [c for c in elements.columns if c != "element_id"]
    one = elements.where("element_id is not null").groupBy("element_id").agg(F.max_by(F.struct(*keep), F.struct("parsed_at")).alias("e"))
    return one.select("element_id", *[F.col(f"e.{c}").alias(c) for c in keep])


def _parts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The part of every element of one paper: a new one begins after 400 tokens or more, counted from 0 again."""
    pdf = pdf.sort_values(["ord", "element_id"])
    out, held, part = [], 0, 1
    for n in pdf["size"].tolist():
        out.append(f"part_{part}")
        held += n
        if held >= PART:
            held, part = 0, part + 1
    return pd.DataFrame({"element_id": pdf["element_id"].to_numpy(), "part": out})


def prepared(elements: DataFrame) -> DataFrame:
    """Treated elements in order, with the text to chunk; papers without a header get synthetic parts every 400 tokens."""
    bad = sections.table_misaligned(F.col("type"), F.col("content.header_row"), F.col("content.rows"))
    text = F.when(bad, sections.misaligned_text(F.col("content.caption"), F.col("content.header_row"))).otherwise(F.coalesce("phase2_ready.text_for_embedding", "content.raw", F.lit("")))
    rows = elements.select(
        "paper_id",
        "element_id",
        "type",
        F.coalesce("location.order", F.lit(0)).alias("ord"),
        F.col("section.title").alias("given_title"),
        F.coalesce("phase2_ready.action", F.lit("")).alias("action"),
        text.alias("text"),
        sections.treatment(F.col("section.title"), F.col("content.raw"), F.col("content.token_count")).alias("treatment"),
    )
    w = Window.partitionBy("paper_id").orderBy("ord", "element_id")
    rows = rows.withColumn("next_action", F.lead("action").over(w)).withColumn("n_headers", F.count_if(F.col("type") == "section_header").over(Window.partitionBy("paper_id")))
    size = F.when(F.length("text") == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length("text") / 4)))
    bare = rows.where("n_headers = 0").select("paper_id", "element_id", "ord", size.cast("bigint").alias("size"))
    parts = bare.groupBy("paper_id").applyInPandas(_parts, "element_id string, part string")
    rows = rows.join(parts, "element_id", "left")
    return rows.withColumn("title", F.when(F.col("n_headers") == 0, F.col("part")).otherwise(F.col("given_title"))).drop("part")


def chunk_elements(elements: DataFrame) -> DataFrame:
    """Chunks of :data:`OUT` from the newest rows of all elements; skipped and reference sections are left out."""
    rows = prepared(newest_elements(elements)).where(sections.embeds(F.col("treatment")))
    placed = rows.select("paper_id", "element_id", "title", "ord", "type", "action", "text", "next_action").repartition("paper_id").sortWithinPartitions("paper_id", "ord", "element_id")
    return placed.mapInPandas(_run, OUT)


def _folded(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["paper_id", "n_full", "rest", "n_elements"]
        state: list | None = None
        for pdf in batches:
            out = []
            for paper, n in zip(pdf["paper_id"].tolist(), pdf["n"].tolist()):
                if state is None or state[0] != paper:
                    if state is not None:
                        out.append(tuple(state))
                    state = [paper, 0, 0, 0]
                state[2] += n
                state[3] += 1
                if state[2] >= most:
                    state[1], state[2] = state[1] + 1, 0
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([tuple(state)] if state is not None else [], columns=names)

    return run


def simple_fold(rows: DataFrame, most: int = TARGET) -> DataFrame:
    """``rows(paper_id, ord, element_id, n)`` -> ``(paper_id, n_full, rest, n_elements)``: running sums that start anew at ``most``.

    Sorted partitions are streamed, so that a paper of any length needs no more memory than a batch.
    """
    placed = rows.repartition("paper_id").sortWithinPartitions("paper_id", "ord", "element_id")
    return placed.select("paper_id", "n").mapInPandas(_folded(most), "paper_id string, n_full long, rest long, n_elements long")
