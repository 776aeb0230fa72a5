"""References to records that do not exist, by compressed bitmaps.

All keys are dictionary-encoded: a key range (hash bucket) and a position in it.
Each range holds one bitmap of positions per referring field and period, and
bitmaps of the stored, deleted and so-far-stored keys. Orphans are the bits of
``reference AND NOT parent``; only surviving bits are decoded to keys again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.work import Work

#: Expected keys in a range; a range's bitmap has as many bits as it has keys.
RANGE_KEYS = 16384


class Bitmap:
    """A compressed set of positions: a sorted array of 16-bit offsets per block of 65,536, or a packed block where that is smaller."""

    __slots__ = ("blocks",)

    def __init__(self, blocks: dict[int, tuple[bool, np.ndarray]]) -> None:
        self.blocks = blocks

    @classmethod
    def of(cls, positions: np.ndarray) -> Bitmap:
        positions = np.unique(np.asarray(positions, dtype=np.int64))
        blocks: dict[int, tuple[bool, np.ndarray]] = {}
        if len(positions):
            high = positions >> 16
            for part in np.split(positions, np.flatnonzero(np.diff(high)) + 1):
                blocks[int(part[0] >> 16)] = cls._pack((part & 0xFFFF).astype(np.uint16))
        return cls(blocks)

    @staticmethod
    def _pack(offsets: np.ndarray) -> tuple[bool, np.ndarray]:
        top = int(offsets[-1]) + 1
        if len(offsets) * 16 <= top:
            return False, offsets
        bits = np.zeros(top, dtype=np.uint8)
        bits[offsets] = 1
        return True, np.packbits(bits, bitorder="little")

    @staticmethod
    def _offsets(dense: bool, data: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(data, bitorder="little")).astype(np.uint16) if dense else data

    def and_not(self, other: Bitmap) -> Bitmap:
        out: dict[int, tuple[bool, np.ndarray]] = {}
        for k, (dense, data) in self.blocks.items():
            if k in other.blocks:
                theirs, gone = other.blocks[k]
                if dense and theirs:
                    left = data.copy()
                    n = min(len(left), len(gone))
                    left[:n] &= ~gone[:n]
                    offsets = self._offsets(True, left)
                else:
                    offsets = self._offsets(dense, data)
                    if theirs:
                        byte = offsets >> 3
                        inside = byte < len(gone)
                        hit = np.zeros(len(offsets), dtype=bool)
                        hit[inside] = (gone[byte[inside]] >> (offsets[inside] & 7)) & 1 == 1
                        offsets = offsets[~hit]
                    else:
                        offsets = np.setdiff1d(offsets, gone, assume_unique=True)
                if len(offsets):
                    out[k] = self._pack(offsets)
            else:
                out[k] = (dense, data)
        return Bitmap(out)

    def decode(self) -> np.ndarray:
        parts = [(k << 16) + self._offsets(*v).astype(np.int64) for k, v in sorted(self.blocks.items())]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _survivors(key: tuple, refs: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    """The surviving bits of one key range."""
    pos, month = keys["pos"].to_numpy(), keys["first_month"].to_numpy()
    is_stored, is_deleted = keys["is_stored"].to_numpy(dtype=bool), keys["is_deleted"].to_numpy(dtype=bool)
    stored, not_deleted = Bitmap.of(pos[is_stored]), Bitmap.of(pos[~is_deleted])
    missing_or_stored = Bitmap.of(pos[~is_stored | is_deleted])
    by_period: dict[int, Bitmap] = {}
    out = []
    for (field, period), part in refs.groupby(["field", "period"], sort=False):
        bits = Bitmap.of(part["pos"].to_numpy())
        if period not in by_period:
            by_period[period] = Bitmap.of(pos[is_stored & ~(month > period)])
        deleted = bits.and_not(not_deleted)
        live = bits.and_not(deleted)
        missing = live.and_not(stored)
        late = live.and_not(missing_or_stored).and_not(by_period[period])
        for kind, left in (("deleted", deleted), ("missing", missing), ("late", late)):
            at = left.decode()
            if len(at):
                out.append(pd.DataFrame({"bucket": key[0], "pos": at, "field": field, "period": period, "kind": kind}))
    return pd.concat(out) if out else pd.DataFrame({"bucket": [], "pos": [], "field": [], "period": [], "kind": []})


def month_number(ts: Column) -> Column:
    """Months since year 0 of a UTC time."""
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def orphan_references(
    rows: DataFrame,
    tombstones: DataFrame,
    work: Work,
    key: str = "chunk_id",
    fields: tuple[str, ...] = ("children_ids", "summary_of", "sibling_ids"),
    stored_at: str = "ingested_at",
    range_keys: int = RANGE_KEYS,
) -> DataFrame:
    """``(key, ref_field, ref_id, kind, period)``, one row per referring key, field and reference that is deleted, missing or late.

    ``stored_at`` is ISO-8601 text (any offset) or a timestamp; the first one of a key sets its
    UTC month (``period``, months since year 0; null if no row of the key has a readable one). 'deleted': a
    tombstone and no row stored at or after it; 'missing': no row; 'late': first stored in a
    later month than the referring key. Null and empty references, and rows with a null key, are
    ignored; repeated rows and references count once. Unreadable times are as if absent: such a
    key is stored, never late, and its own references are never late.
    """
    ts = F.try_to_timestamp(F.col(stored_at).cast("string"))
    seen = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    gone = tombstones.where(F.col("chunk_id").isNotNull()).groupBy(F.col("chunk_id").alias("id")).agg(F.max("deleted_at").cast("timestamp").alias("deleted_at"))
    refs = None
    for n, field in enumerate(fields):
        part = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.lit(n).alias("field"), F.explode(field).alias("ref_id"))
        refs = part if refs is None else refs.union(part)
    refs = work.table(refs.where("ref_id is not null and ref_id <> ''").distinct(), "refs")

    keys = (
        seen.select("id", "first", "last", F.lit(True).alias("is_stored"), F.lit(None).cast("timestamp").alias("deleted_at"))
        .unionByName(gone.select("id", F.lit(None).cast("timestamp").alias("first"), F.lit(None).cast("timestamp").alias("last"), F.lit(False).alias("is_stored"), "deleted_at"))
        .unionByName(refs.select(F.col("ref_id").alias("id")).distinct().select("id", *[F.lit(None).cast("timestamp").alias(c) for c in ("first", "last")], F.lit(False).alias("is_stored"), F.lit(None).cast("timestamp").alias("deleted_at")))
        .groupBy("id")
        .agg(F.max("first").alias("first"), F.max("last").alias("last"), F.max("is_stored").alias("is_stored"), F.max("deleted_at").alias("deleted_at"))
    )
    keys = work.table(
        keys.select("id", month_number(F.col("first")).alias("first_month"), "is_stored", (F.col("deleted_at").isNotNull() & ~F.coalesce(F.col("last") >= F.col("deleted_at"), F.lit(False))).alias("is_deleted")),
        "keys",
    )
    ranges = max(1, -(-keys.count() // range_keys))
    bucket = F.pmod(F.xxhash64(F.lit("range"), F.col("id")), F.lit(ranges)).cast("int")
    order = Window.partitionBy("bucket").orderBy("id")
    codes = work.table(keys.withColumn("bucket", bucket).withColumn("pos", (F.row_number().over(order) - 1).cast("long")), "codes")
    work.drop(keys)

    own = codes.where("is_stored").select("id", F.col("first_month").alias("period"))
    coded = refs.join(own, "id").join(codes.select(F.col("id").alias("ref_id"), "bucket", "pos"), "ref_id")
    coded = work.table(coded.select("id", "field", F.coalesce("period", F.lit(1 << 30)).alias("period"), "bucket", "pos"), "coded")
    work.drop(refs)

    bits = coded.select("bucket", "pos", "field", "period").distinct()
    side = codes.select("bucket", "pos", F.coalesce("first_month", F.lit(-1)).alias("first_month"), "is_stored", "is_deleted")
    left = bits.groupBy("bucket").cogroup(side.groupBy("bucket")).applyInPandas(_survivors, "bucket int, pos long, field int, period int, kind string")
    names = F.create_map(*[x for n, f in enumerate(fields) for x in (F.lit(n), F.lit(f))])
    named = left.join(codes.select("bucket", "pos", F.col("id").alias("ref_id")), ["bucket", "pos"])
    hits = coded.join(named, ["bucket", "pos", "field", "period"])
    return hits.select(F.col("id").alias(key), names[F.col("field")].alias("ref_field"), "ref_id", "kind", F.when(F.col("period") < (1 << 30), F.col("period")).alias("period"))
