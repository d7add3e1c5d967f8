"""Fill-in-middle transformation: texts cut in three and put in another order between marks.

Cuts are drawn in units (lines or characters) from a hash of the id, so that a row
has the same cuts in every run. All byte offsets and code-point offsets of a chunk
of texts are converted into each other by a sparse exception index: it records the
place of every multibyte character and the bytes that it has beyond one. Between
two exceptions an offset is plain arithmetic, so ASCII text costs nothing, and a
cut is one binary search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trialframe.llm._arrays import chunks, text_bytes

MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix, middle


@dataclass
class CharIndex:
    """Code-point and byte offsets of one stretch of UTF-8, by its exceptions alone."""

    char: np.ndarray  # code-point offset of each multibyte character, ascending
    byte: np.ndarray  # its byte offset
    excess: np.ndarray  # bytes beyond one of the first 0, 1, 2, ... multibyte characters

    @classmethod
    def of(cls, data: np.ndarray) -> CharIndex:
        byte = np.flatnonzero(data >= 0xC0)
        lead = data[byte]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        excess = np.concatenate([[0], np.cumsum(extra)])
        return cls(byte - excess[:-1], byte, excess)

    def to_byte(self, chars: np.ndarray) -> np.ndarray:
        return chars + self.excess[np.searchsorted(self.char, chars, "left")]

    def to_char(self, at: np.ndarray) -> np.ndarray:
        """Code-point offsets of byte offsets, which stand between characters."""
        return at - self.excess[np.searchsorted(self.byte, at, "left")]


def line_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets behind every line of the rows: behind each newline, and where a row ends without one."""
    behind = np.flatnonzero(data == 0x0A) + 1
    full = np.flatnonzero(np.diff(at))
    last = at[1:][full]
    return np.union1d(behind, last[data[last - 1] != 0x0A])


def unit_cuts(data: np.ndarray, at: np.ndarray, index: CharIndex, unit: str):
    """Units of each row, and a function from (rows, units from the row's start) to byte offsets."""
    start = at[:-1]
    if unit == "char":
        first = index.to_char(at)
        return np.diff(first), lambda rows, k: index.to_byte(first[rows] + k)
    ends = line_ends(data, at)
    first = np.searchsorted(ends, at, "right")
    stops = np.concatenate([ends, [0]])
    return np.diff(first), lambda rows, k: np.where(k == 0, start[rows], stops[first[rows] + k - 1])


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "line",
    rate: int = 100,
    spm_rate: int = 50,
    seed: str = "7",
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every document.

    ``unit`` is ``line`` (a line with its newline) or ``char``; ``n`` is their number.
    The first four groups of eight hexadecimal digits of sha256 of ``seed:id`` are h1
    to h4. The prefix ends behind the smaller, the middle behind the larger of
    h1 % (n + 1) and h2 % (n + 1) units. ``form`` is ``plain`` (output is the text,
    cuts are null) for an empty text, one that contains a mark, and where h3 % 100 is
    not below ``rate``; else ``spm`` where h4 % 100 is below ``spm_rate``, else ``psm``.

    A null text is empty, a null id the empty id. Rows with equal ids each keep
    their row, with cuts at the same hashes. An empty table gives an empty one.
    """
    if unit not in ("line", "char"):
        raise ValueError("unit is line or char")
    if len(set(marks)) < 3 or any(len(m) < 2 or m[0] in m[1:] for m in marks):
        raise ValueError("marks differ, and a mark's first character is nowhere else in it")  # so no two marks overlap
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    group = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(h.alias(f"h{k + 1}") for k, h in enumerate(group)))
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in chunks(batch):
                data, at = text_bytes(column)
                h1, h2, h3, h4 = (part.column(2 + k).to_numpy() for k in range(4))
                index, whole = CharIndex.of(data), data.tobytes()
                n, cut = unit_cuts(data, at, index, unit)
                own = np.arange(len(part))
                a, b = h1 % (n + 1), h2 % (n + 1)
                one, two = cut(own, np.minimum(a, b)), cut(own, np.maximum(a, b))
                chars = np.diff(index.to_char(np.stack([at[:-1], one, two])), axis=0)
                texts = [whole[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                plain = (h3 % 100 >= rate) | np.array([not t or p in t or s in t or m in t for t in texts], bool)
                spm = h4 % 100 < spm_rate
                out = []
                for t, lo, hi, same, turned in zip(texts, (one - at[:-1]).tolist(), (two - at[:-1]).tolist(), plain, spm):
                    if not same:
                        head, tail = p + t[:lo], s + t[hi:]
                        t = (tail + head if turned else head + tail) + m + t[lo:hi]
                    out.append(t)
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(form.tolist(), pa.string())]
                    + [pa.array(c, mask=plain) for c in chars]
                    + [pa.array(out, pa.binary()).cast(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text behind an ``output`` of ``fill_in_middle``, null where either is null.

    A transformed text has no mark of its own, so each mark is found where it was put.
    """
    p, s, m = marks

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + F.lit(len(second) + 1))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + F.lit(len(m) + 1))

    prefix, suffix, middle = between(p, s)
    last, first, inside = between(s, p)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(first, inside, last))
    )
