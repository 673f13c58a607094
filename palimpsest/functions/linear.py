"""Matching in time that grows with the text's length, for patterns whose backtracking would not.

RLIKE backtracks: a repeated group takes a stack frame for each turn, so a long line overflows the stack and takes its
executor along, and open-ended repetitions try every place and length that a long text offers. Such patterns are told by
their syntax and handed, a batch of texts at a time, to Arrow's RE2 kernels, which simulate an automaton. What they find
becomes columns again without a loop over rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.regex import repeats, translate


def backtracks(pattern: str) -> bool:
    """Whether RLIKE's time or stack may grow faster than with a text's length."""
    groups, loops = repeats(pattern)
    return groups + loops > 0


def flagged(pattern: str, multiline: bool, ignore_case: bool) -> str:
    flags = "m" * multiline + "i" * ignore_case
    return (f"(?{flags})" if flags else "") + pattern


def search(text: Column, pattern: str, multiline: bool = True, ignore_case: bool = False) -> Column:
    """Whether the text has a match of an RE2 pattern; null of a null text."""
    if not backtracks(pattern):
        return text.rlike(translate(pattern, multiline, ignore_case))
    return _kernel(flagged(pattern, multiline, ignore_case))(text)


def search_each(texts: Column, pattern: str, multiline: bool = True, ignore_case: bool = False) -> Column:
    """search() of each text of an array, for places where the elements themselves are out of a kernel's reach."""
    if not backtracks(pattern):
        regex = translate(pattern, multiline, ignore_case)
        return F.transform(texts, lambda t: t.rlike(regex))
    return _each_kernel(flagged(pattern, multiline, ignore_case))(texts)


def _kernel(pattern: str):
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    def found(texts: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        return pc.match_substring_regex(texts, pattern=pattern)

    found.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_udf(found, "boolean")


def _each_kernel(pattern: str):
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    def found(lists: pa.Array) -> pa.Array:
        import pyarrow as pa
        import pyarrow.compute as pc

        hits = pc.match_substring_regex(lists.flatten(), pattern=pattern)
        sizes = pc.fill_null(pc.list_value_length(lists), 0)
        ends = pc.cumulative_sum(pa.concat_arrays([pa.array([0], pa.int32()), sizes.cast(pa.int32())]))
        return pa.ListArray.from_arrays(ends, hits, mask=lists.is_null() if lists.null_count else None)

    found.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return arrow_udf(found, "array<boolean>")


def spans(text: Column, pattern: str, marks: tuple[str, str, str], multiline: bool = True, ignore_case: bool = False) -> Column:
    """Byte ranges of an RE2 pattern's matches as (start, end), leftmost and not overlapping; null of a null text.

    marks: two characters that the text does not hold, and one that counts as a single byte. Each takes three bytes. The
    kernel puts the first two around every match; where they then stand in the batch's bytes gives all ranges at once.
    """
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    whole, last = flagged(pattern, multiline, ignore_case), [m.encode() for m in marks]

    def ranges(texts: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        marked = pc.replace_substring_regex(pc.fill_null(texts, ""), pattern=whole, replacement=rf"{marks[0]}\0{marks[1]}")
        marked = marked.cast(pa.large_string())
        if isinstance(marked, pa.ChunkedArray):
            marked = marked.combine_chunks()
        buffers = marked.buffers()
        starts = np.frombuffer(buffers[1], dtype=np.int64)[marked.offset:marked.offset + len(marked) + 1]
        data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, dtype=np.uint8)

        def places(mark):
            hit = np.flatnonzero(data[:-2] == mark[0])
            return hit[(data[hit + 1] == mark[1]) & (data[hit + 2] == mark[2])]

        opened, closed, wide = map(places, last)
        row = np.searchsorted(starts, opened, side="right") - 1
        per_row = np.bincount(row, minlength=len(marked))
        ends = np.concatenate([[0], np.cumsum(per_row)])
        before = 6 * (np.arange(len(opened)) - ends[row])  # marks of the row's matches before this one
        narrow = lambda at: 2 * (np.searchsorted(wide, at) - np.searchsorted(wide, starts[row]))
        start = opened - starts[row] - before - narrow(opened)
        end = closed - starts[row] - before - 3 - narrow(closed)
        pairs = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["start", "end"])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs, mask=texts.is_null() if texts.null_count else None)

    ranges.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_udf(ranges, "array<struct<start:int,end:int>>")(text)
