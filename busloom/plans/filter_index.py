"""Row numbers that match a predicate, kept as a table and extended by the frames that came since."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import with_dense_index
from ..operators.decode import decode_frames
from ..operators.trace import page_bounds
from .catalog import Catalog
from .predicate import filter_frames
from .retention import retained
from .session import Session

#: matches from an end of the index up to which a page is found by a top-k
NEAR = 100_000


class FilterIndex:
    """Matches (idx) under root/session=<n>/filter=<digest>/part=<rows scanned>.

    A part holds the matches among the frames between the part before and its own number, so the parts' names tell how far
    the index reaches, also where nothing matched. Another session, predicate or catalogue has another folder: the index
    is rebuilt there and never mixed. A part that failed to be written has no success marker and is written again.
    """

    def __init__(self, spark: SparkSession, root: str, catalog: Catalog, predicate: object, session: Session | None = None):
        known = sorted((b, m.id, m.extended, repr(m)) for b, m, _ in catalog.winners())
        digest = hashlib.sha256(json.dumps([predicate, known], sort_keys=True, default=str).encode()).hexdigest()[:24]
        self.spark, self.catalog, self.predicate = spark, catalog, predicate
        self.folder = f"{(session or Session()).path(root)}/filter={digest}"

    def _parts(self) -> list[tuple[int, str]]:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = fs.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/part=*/_SUCCESS"))
        paths = [str(s.getPath().getParent()) for s in done]
        return sorted((int(p.rpartition("=")[2]), p) for p in paths)

    def matches(self, frames: DataFrame) -> DataFrame:
        """(idx) of every frame that matches; only frames beyond what is stored are tested."""
        parts = self._parts()
        reached = parts[-1][0] if parts else 0
        top = frames.agg(F.max("idx")).first()[0]
        if top is not None and top >= reached:
            path = f"{self.folder}/part={top + 1}"
            new = frames.filter((F.col("idx") >= reached) & (F.col("idx") <= top))
            filter_frames(new, self.predicate, self.catalog).select("idx").write.mode("overwrite").parquet(path)
            parts.append((top + 1, path))
        return self.spark.read.schema("idx long").parquet(*[p for _, p in parts]) if parts else frames.select("idx").limit(0)

    def page(self, frames: DataFrame, offset: int, limit: int, from_end: bool = False, first: int = 0) -> tuple[DataFrame, int, int]:
        """(decoded page of matches, their number, the page's first position), as trace.filtered_page without recounting.
        Matches before the low-water mark `first` are gone. A page far from both ends is found by numbering the matches by
        ranges, so no task keeps all that come before it."""
        found = retained(self.matches(frames), first)
        count = found.count()
        start, end = page_bounds(count, offset, limit, from_end)
        size = end - start
        if start + size <= NEAR:
            wanted = found.orderBy("idx").offset(start).limit(size)
        elif count - start <= NEAR:
            wanted = found.orderBy(F.desc("idx")).limit(count - start).orderBy("idx").limit(size)
        else:
            wanted = with_dense_index(found.withColumn("at", F.col("idx")), "at", name="rn").filter(F.col("rn").between(start, end - 1))
        rows = [r["idx"] for r in wanted.collect()]  # one page
        page = frames.filter(F.col("idx").isin(rows)) if rows else frames.limit(0)
        return decode_frames(page, self.catalog).orderBy("idx"), count, start
