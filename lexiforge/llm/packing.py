"""Filling containers of fixed capacity with items of varying length.

Bounded-space online best fit: every packing task keeps at most ``open_bins`` bins open, in a bitset
keyed by free space. An item goes to the bin with the least free space that holds it, found as the
lowest set bit from its size on; if there is none a new bin is opened, and where that would be one
too many the fullest bin closes first. An item beyond the capacity is cut into whole containers and a rest,
which is packed like any item; no other item is divided.

Items reach the tasks by hash, so that a hot source or length spreads; the number of tasks follows
from the total size (``task_capacity`` units each), so the bins left open at the ends stay a fixed
small share of the whole. Nothing is collected but that total.

Defined results: an item of null, zero or negative size takes no room and gets one row, with
``start = stop = 0``, in a bin that is open; a null id is an id like any other and repeated rows are
packed each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
OPEN_BINS = 128
TASK_CAPACITY = 16 << 20
#: Beyond so many tasks each takes more; it streams, so its size is no matter.
MOST_TASKS = 20_000


class OpenBins:
    """The open bins of one task, in a bitset keyed by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.count, self.made = 0, 0, 0
        self.by_free: dict[int, deque[int]] = {}

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def _put(self, bin_no: int, free: int) -> None:
        self.by_free.setdefault(free, deque()).append(bin_no)
        self.bits |= 1 << free
        self.count += 1

    def _take(self, free: int) -> int:
        same = self.by_free[free]
        bin_no = same.popleft()
        if not same:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_no

    def add(self, size: int) -> tuple[int, int]:
        """The bin an item of this size goes to, and how much of it was used before."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_no = self._take(free)
        else:
            if self.count >= self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_no, free = self.new(), self.capacity
        if free > size:
            self._put(bin_no, free - size)
        return bin_no, self.capacity - free


def place(bins: OpenBins, size: int) -> Iterator[tuple[int, int, int, int]]:
    """The pieces of an item: bin, offset in the bin, start and stop in the item."""
    size, start = max(0, size), 0
    while size - start > bins.capacity:
        yield bins.new(), 0, start, start + bins.capacity
        start += bins.capacity
    bin_no, used = bins.add(size - start)
    yield bin_no, used, start, size


SCHEMA = "part bigint, start bigint, stop bigint, bin string, bin_offset bigint"


def pack(
    items: DataFrame,
    id_col: str = "doc_id",
    size_col: str = "n_tokens",
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    task_capacity: int = TASK_CAPACITY,
) -> DataFrame:
    """``id, part, start, stop, bin, bin_offset``: one row for each piece of each item."""
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins start from 1")
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)).alias("size"))
    total = rows.agg(F.coalesce(F.sum(F.greatest("size", F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    tasks = min(MOST_TASKS, max(1, round(total / max(capacity, task_capacity))))
    spread = rows.repartition(tasks, F.xxhash64("id", "size")).sortWithinPartitions(F.xxhash64("id"), "id", "size")
    spread = spread.select("id", "size", F.spark_partition_id().alias("task"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        names = ["id", "part", "start", "stop", "bin", "bin_offset"]
        for batch in batches:
            if not batch.num_rows:
                continue
            task, out = batch["task"][0].as_py(), []
            for row, size in enumerate(batch["size"].to_pylist()):
                out += [(row, part, start, stop, f"{task}-{bin_no}", at) for part, (bin_no, at, start, stop) in enumerate(place(bins, size))]
            rows, *rest = (list(x) for x in zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            columns = [batch["id"].take(pa.array(rows)), *(pa.array(x, k) for x, k in zip(rest, kinds))]
            yield pa.RecordBatch.from_arrays(columns, names)

    packed = spread.mapInArrow(run, f"id {id_type}, {SCHEMA}")
    return packed.withColumnRenamed("id", id_col)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: number of bins, units packed and the share of the room that is used."""
    bins = packed.groupBy("bin").agg(F.sum(F.col("stop") - F.col("start")).alias("used"))
    whole = bins.agg(F.count("*").alias("bins"), F.coalesce(F.sum("used"), F.lit(0)).alias("units"), F.max("used").alias("fullest"))
    return whole.select("bins", "units", "fullest", (F.col("units") / (F.col("bins") * capacity)).alias("fill"))
