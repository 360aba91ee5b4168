"""Scanned pages put into reading order, a batch at a time on Arrow columns.

Lines are put into columns by their left edges (a gap of more than COLUMN_GAP
starts the next column); a line that runs over several columns is cut at its wide
blanks and its parts go to one column after the other. Columns are then read from
left to right, each from top to bottom, and words broken at line ends are joined. Nothing here loops over rows in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pixels between the left edges of neighbouring columns, at least; indents and tilt move a line by far less.
COLUMN_GAP = 100
#: What a word broken at a line's end may end with: hyphens as read and as misread.
BREAKS = r"[-=~¬\x{ad}\x{2010}\x{2011}]"


def _array(x) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def reading_order(text, boxes=None) -> pa.Array:
    """The texts with their lines in reading order, as strings; null text gives "".

    A page whose boxes are null or don't match its lines in number keeps the order it came in.
    """
    text = pc.fill_null(_array(text).cast(pa.string()), "")
    if boxes is None:
        return text
    boxes = _array(boxes)
    lines = pc.split_pattern(text, "\n")
    n = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lines)
    m = pc.fill_null(pc.list_value_length(boxes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = pc.list_flatten(boxes)
    row = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    x, y = np.zeros(len(row)), rank.astype(float)
    ok = n == m
    if ok.any() and len(inner):
        bx, by = (pc.fill_null(inner.field(k).cast(pa.float64()), 0).to_numpy(zero_copy_only=False) for k in ("x0", "y0"))
        brow = np.repeat(np.arange(len(m)), m)
        x[ok[row]], y[ok[row]] = bx[ok[brow]], by[ok[brow]]
    by_x = np.lexsort((x, row))
    xs, rs = x[by_x], row[by_x]
    step = np.zeros(len(row), np.int64)
    if len(row) > 1:
        step[1:] = (rs[1:] == rs[:-1]) & (xs[1:] - xs[:-1] > COLUMN_GAP)
    column = np.empty(len(row), np.int64)
    column[by_x] = np.cumsum(step)
    # Numbered over all rows; a line cut into k parts reaches k - 1 columns on, so rows are kept apart by the sort's last key.
    wide = pc.match_substring(flat, "    ").to_numpy(zero_copy_only=False)
    if wide.any():
        at = np.nonzero(wide)[0]
        parts = pc.split_pattern_regex(pc.utf8_trim_whitespace(flat.take(pa.array(at))), " {4,}")
        k = np.ones(len(row), np.int64)
        k[at] = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        line = np.repeat(np.arange(len(row)), k)
        piece = np.arange(len(line)) - np.repeat(np.cumsum(k) - k, k)
        source = np.empty(len(line), np.int64)
        cut = wide[line]
        source[~cut] = line[~cut]
        source[cut] = len(row) + np.arange(int(cut.sum()))
        flat = pa.concat_arrays([flat, pc.list_flatten(parts)]).take(pa.array(source))
        n = np.bincount(row, k, minlength=len(n)).astype(np.int64)
        row, y, rank, column = row[line], y[line], rank[line], column[line] + piece
    order = np.lexsort((rank, y, column, row))
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), flat.take(pa.array(order))), "\n")


def joined(ordered: pa.Array) -> pa.Array:
    """Lines run together: a break at a line's end is closed, other line ends become blanks."""
    s = pc.replace_substring_regex(ordered, rf"(\pL){BREAKS}[ \t]*\n[ \t]*", r"\1")
    return pc.replace_substring(s, "\n", " ")


def words(joined_text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words (blank-separated, letters and digits only), flat, and the offsets of each text's words."""
    s = pc.replace_substring_regex(pc.utf8_lower(joined_text), r"[^\pL\pN\s]+", "")
    s = pc.utf8_trim_whitespace(pc.replace_substring_regex(s, r"\s+", " "))
    parts = pc.split_pattern(s, " ")
    flat, n = pc.list_flatten(parts), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.utf8_length(s), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # an empty text splits into one empty word
        keep = ~np.repeat(empty, n)
        flat, n = flat.filter(pa.array(keep)), np.where(empty, 0, n)
    return flat, np.concatenate([[0], np.cumsum(n)])
