"""Exact search of many values in many texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of the values that are sent to every executor at once, and that a value may have.
MOST_CHARS, LONGEST = 20_000_000, 10_000


def find_values(texts: DataFrame, values: DataFrame, ident: str, text: str, name: str, value: str, any_case: bool = False) -> DataFrame:
    """(ident, name, start, end): the first place of each value in each text that has it.

    All values form one automaton, so a text is read once however many values there are; it is broadcast, after a
    check of its size.  A larger table of values is cut into parts by a hash of the value, and the texts are read once
    for each part.  Of a value above ``LONGEST`` characters the automaton has the first ones, and where these are found
    the rest is compared.  Null and empty values are found nowhere.
    """
    chars = values.agg(F.sum(F.length(value))).first()[0] or 0
    parts = -(-chars * 2 // MOST_CHARS) if chars > MOST_CHARS else 1
    if parts > 1:
        part = F.pmod(F.xxhash64(value), F.lit(parts))
        each = [_find(texts, values.where(part == i), ident, text, name, value, any_case) for i in range(parts)]
        return reduce(DataFrame.unionByName, each)
    return _find(texts, values, ident, text, name, value, any_case)


def _find(texts: DataFrame, values: DataFrame, ident: str, text: str, name: str, value: str, any_case: bool) -> DataFrame:
    spark = texts.sparkSession
    rows = [(r[0], r[1]) for r in values.select(name, value).where(F.length(value) > 0).collect()]
    sent, longest = spark.sparkContext.broadcast(rows), LONGEST
    named = to_arrow_type(values.schema[name].dataType)
    kinds = texts.schema[ident].dataType.simpleString(), values.schema[name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by: dict[str, list] = {}
        for key, x in sent.value:
            same = x.lower() if any_case else x
            by.setdefault(same[:longest], []).append((key, len(same), same[longest:]))
        automaton = ahocorasick.Automaton()
        for x, keys in by.items():
            automaton.add_word(x, (len(x), keys))
        if by:
            automaton.make_automaton()
        for batch in batches:
            found: list[tuple] = []
            for key, x in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                first: dict = {}
                if x and by:
                    same = x.lower() if any_case else x
                    for last, (n, keys) in automaton.iter(same):
                        for k, size, rest in keys:
                            if k not in first and (not rest or same.startswith(rest, last + 1)):
                                first[k] = (last - n + 1, last - n + 1 + size)
                found += [(key, k, a, b) for k, (a, b) in first.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], batch.schema[0].type), pa.array([r[1] for r in found], named), *[pa.array([r[i] for r in found], pa.int64()) for i in (2, 3)]], names=[ident, name, "start", "end"])

    return texts.select(ident, text).mapInArrow(run, f"`{ident}` {kinds[0]}, `{name}` {kinds[1]}, start long, end long")
