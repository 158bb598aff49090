"""Drawing tools as a table function: pointer events of an image in, changed pixels, picks and errors out.

    gestures.register(spark)
    SELECT * FROM gesture(TABLE(SELECT * FROM events), key => 'image_id')

The function says itself that its input is divided by the key and ordered by seq, and its
first output column is the key with the key's own name and type, so one function serves
relations of any owner. An image comes as one `canvas` row before its events; its events
are applied in order, and when the image is done the pixels that differ are given once.

Events (key, seq, phase, tool, x, y, size, r, g, b, a, width, height, data): phase is canvas,
down, move or up. pencil and eraser draw from the last place to this one with a square brush
of `size`; bucket fills what is connected to the place and has its very colour; line and rect
are drawn on `up`, from where the pointer went down; picker gives the colour of the place. An
event that no tool understands gives an error and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, LongType, Row, StringType, StructType

from rasterloom.operators.kernels import reach

TOOLS = ("pencil", "eraser", "bucket", "line", "rect", "picker")


def between(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Points from one place to another, one for each step of the longer side."""
    dx, dy = abs(x1 - x0), abs(y1 - y0)
    n = max(dx, dy)
    along = lambda k, d: (2 * k * d + n) // (2 * n) if n else 0
    return [(x0 + (x1 > x0) * along(k, dx) - (x1 < x0) * along(k, dx), y0 + (y1 > y0) * along(k, dy) - (y1 < y0) * along(k, dy)) for k in range(n + 1)]


class Canvas:
    """An image and the gesture that goes on."""

    def __init__(self, image: np.ndarray):
        self.before, self.image = image, image.copy()
        self.changed_by = np.full(image.shape[:2], -1, np.int64)
        self.tool, self.start, self.last = None, None, None

    def _put(self, seq: int, points: list[tuple[int, int]], size: int, color: list[int]) -> None:
        h, w = self.image.shape[:2]
        for x, y in points:
            x0, y0 = x - (size - 1) // 2, y - (size - 1) // 2
            area = slice(max(0, y0), max(0, min(h, y0 + size))), slice(max(0, x0), max(0, min(w, x0 + size)))
            self.image[area], self.changed_by[area] = color, seq

    def apply(self, e: Row) -> list[int] | None:
        """The colour that a picker finds, else nothing; the image is changed."""
        if e["phase"] == "down":
            if e["tool"] not in TOOLS:
                raise ValueError(f"no tool {e['tool']}")
            self.tool, self.start, self.last = e["tool"], (e["x"], e["y"]), None
        elif e["phase"] not in ("move", "up"):
            raise ValueError(f"no phase {e['phase']}")
        elif self.tool is None:
            raise ValueError(f"{e['phase']} without down")
        x, y, size, color = e["x"], e["y"], max(1, e["size"] or 1), [e[c] or 0 for c in "rgba"]
        h, w = self.image.shape[:2]
        inside, found = 0 <= x < w and 0 <= y < h, None
        if self.tool in ("pencil", "eraser"):
            points = [(x, y)] if self.last is None else between(*self.last, x, y)[1:]
            self._put(e["seq"], points, size, color if self.tool == "pencil" else [0, 0, 0, 0])
        elif self.tool == "bucket" and e["phase"] == "down" and inside:
            if self.image[y, x].tolist() != color:
                them = reach((self.image == self.image[y, x]).all(-1), (y, x))
                self.image[them], self.changed_by[them] = color, e["seq"]
        elif self.tool == "picker" and inside:
            found = self.image[y, x].tolist()
        elif self.tool in ("line", "rect") and e["phase"] == "up":
            (x0, y0), (x1, y1) = self.start, (x, y)
            corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
            sides = [((x0, y0), (x1, y1))] if self.tool == "line" else list(zip(corners, corners[1:]))
            self._put(e["seq"], [p for a, b in sides for p in between(*a, *b)], size, color)
        self.last = x, y
        if e["phase"] == "up":
            self.tool = None
        return found

    def changes(self) -> Iterator[tuple[int, int, int, list[int]]]:
        for y, x in np.argwhere((self.before != self.image).any(-1)).tolist():
            yield int(self.changed_by[y, x]), y, x, self.image[y, x].tolist()


@udtf
class Gesture:
    """One image's events at a time."""

    def __init__(self, analyzed: AnalyzeResult):
        self.key, self.owner, self.canvas = analyzed.schema.fields[0].name, None, None

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or key.value not in rows.dataType.names:
            raise ValueError("gesture() takes a table and the name of its key")
        out = StructType().add(key.value, rows.dataType[key.value].dataType).add("kind", StringType()).add("seq", LongType())
        for c in ("y", "x", *"rgba"):
            out = out.add(c, IntegerType())
        return AnalyzeResult(out.add("message", StringType()), partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn("seq")])

    def eval(self, row: Row, key: str) -> Iterator[tuple]:
        self.owner = row[key]
        try:
            if row["phase"] == "canvas":
                data = np.frombuffer(bytes(row["data"] or b""), np.uint8).astype(np.int64)
                if self.canvas is not None or data.size != 4 * row["width"] * row["height"]:
                    raise ValueError("a canvas comes once, with four bytes a pixel")
                self.canvas = Canvas(data.reshape(row["height"], row["width"], 4))
            elif self.canvas is None:
                raise ValueError("no canvas yet")
            else:
                found = self.canvas.apply(row)
                if found is not None:
                    yield (self.owner, "pick", row["seq"], row["y"], row["x"], *found, None)
        except (ValueError, TypeError) as e:
            yield (self.owner, "error", row["seq"], row["y"], row["x"], None, None, None, None, str(e))

    def terminate(self) -> Iterator[tuple]:
        if self.canvas is not None:
            for seq, y, x, color in self.canvas.changes():
                yield (self.owner, "pixel", seq, y, x, *color, None)


EVENT = "seq long, phase string, tool string, x int, y int, size int, r int, g int, b int, a int, width int, height int, data binary"


def register(spark: SparkSession) -> None:
    spark.udtf.register("gesture", Gesture)
