"""Text blocks of web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that hold blocks, and elements whose content is skipped.
BLOCKS = frozenset(("p", "li", "blockquote"))
SKIPPED = frozenset(("nav", "header", "footer", "script", "style"))
SHORTEST, LONGEST, KEPT = 8, 2000, 1000


class _Blocks(HTMLParser):
    """Collects the text of block elements that hold no other block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # [tag, parts, is a leaf]
        self.skip: list[str] = []
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in SKIPPED:
            self.skip.append(tag)
        elif tag in BLOCKS:
            if tag in ("p", "li") and self.open and self.open[-1][0] == tag:
                self._close()  # an element of the same kind ends the one before
            for o in self.open:
                o[2] = False
            self.open.append([tag, [], not self.skip])

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED and tag in self.skip:
            while self.skip and self.skip.pop() != tag:
                pass
        elif tag in BLOCKS and any(o[0] == tag for o in self.open):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        if self.open and not self.skip and data.strip():
            self.open[-1][1].append(data.strip())

    def _close(self) -> None:
        _, parts, leaf = self.open.pop()
        text = " ".join(" ".join(parts).split())
        if leaf and SHORTEST <= len(text) <= LONGEST:
            self.found.append(text[:KEPT])

    def close(self) -> None:
        super().close()
        while self.open:
            self._close()


def blocks(html: str | None) -> list[str]:
    """Distinct blocks in order of appearance; a null or empty page has none."""
    if not html:
        return []
    p = _Blocks()
    p.feed(html)
    p.close()
    return list(dict.fromkeys(p.found))


def page_blocks(df: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, position, block): one row per block of every page."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [blocks(h) for h in b.column(1).to_pylist()]
            rows = pa.array([i for i, g in enumerate(got) for _ in g], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([k for g in got for k in range(len(g))], pa.int32()), pa.array([x for g in got for x in g], pa.string())], names=["id", "position", "block"])

    src = df.select(F.col(id_col).alias("id"), F.col(html).alias("html"))
    return src.mapInArrow(one, f"id {src.schema['id'].dataType.simpleString()}, position int, block string")


def stored_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, position, block): blocks of the latest successful fetch of each page; null and blank blocks are left out."""
    best = pages.where("status = 200 and blocks is not null").groupBy("page_id").agg(F.max(F.struct("fetched_at", "received_at", "blocks")).alias("b"))
    rows = best.select("page_id", F.posexplode(F.array_distinct("b.blocks")).alias("position", "block"))
    return rows.where("trim(block) <> ''")
