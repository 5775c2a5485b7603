"""How often every term or n-gram occurs and in how many records, by suffix sorting.

Every record emits its token suffixes, truncated to ``max_n`` terms. Each task adds up the equal
suffixes that it read; what is left is routed by the first two terms, sorted in reverse
lexicographic order, and one pass with a stack adds each suffix's counts to all its prefixes, the
counts of one suffix from several tasks included: a prefix is complete, and leaves the stack, as
soon as a suffix comes that doesn't begin with it. That is one shuffle, of combined suffixes.

The record sets are carried as numbers that add up: of the suffixes of one record that share a
prefix only the first counts the record for it, so each record counts once for each n-gram, and
partial sums may be formed anywhere.

A first term with a third of all suffixes goes to as many routes as it has second terms, so its
spread grows with the collection. Only the sums of single terms may then come from several routes;
they are added up once more.

Defined results: records with null tokens have none; empty lists and an empty table yield no
rows; repeated tokens count each time for the occurrences and once for the records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.storage import write_table

SEP = " "  # sorts below every character of a term, so joined suffixes sort as lists of terms do
COMBINED = 400_000  # rows that a task adds up at a time


def _sums(max_n: int) -> list[str]:
    return ["cf", *(f"df{k}" for k in range(1, max_n + 1))]


def _suffixes(tokens: pa.ListArray, max_n: int) -> pa.Table | None:
    """The truncated suffixes of a batch of records with their sums.

    A record is counted for each of its prefixes once: by the suffix that has it first.
    """
    terms = tokens.flatten()
    n = len(terms)
    if not n:
        return None
    record = pc.list_parent_indices(tokens).to_numpy()
    gram, codes = terms, []
    for k in range(1, max_n + 1):
        if k > 1:
            later = terms.slice(k - 1)
            inside = np.zeros(n, dtype=bool)
            inside[: n - k + 1] = record[: n - k + 1] == record[k - 1 :]
            longer = pc.binary_join_element_wise(gram, pa.concat_arrays([later, pa.nulls(n - len(later), terms.type)]), SEP)
            gram = pc.if_else(pa.array(inside), longer, gram)
        encoded = gram.dictionary_encode()
        code = encoded.indices.to_numpy().astype(np.int64)
        codes.append(np.unique(record.astype(np.int64) * len(encoded.dictionary) + code, return_index=True)[1])
    kinds = len(encoded.dictionary)
    sums = [np.bincount(code, minlength=kinds), *(np.bincount(code[first], minlength=kinds) for first in codes)]
    return pa.table([encoded.dictionary, *(x.astype(np.int64) for x in sums)], names=["suffix", *_sums(max_n)])


def _combine(max_n: int):
    """The suffixes of a task, equal ones added up."""
    names = _sums(max_n)

    def added(rows: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(rows).group_by("suffix", use_threads=False).aggregate([(c, "sum") for c in names])
        return pa.table([t["suffix"], *(t[f"{c}_sum"] for c in names)], names=["suffix", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            t = _suffixes(b.column(0), max_n)
            if t is not None:
                held.append(t)
            if sum(t.num_rows for t in held) >= COMBINED:
                held = [added(held)]
                if held[0].num_rows > COMBINED // 2:  # mostly different ones: they go as they are
                    yield from held.pop().to_batches(max_chunksize=50_000)
        if held:
            yield from added(held).to_batches(max_chunksize=50_000)

    return run


_OUT = pa.schema([("gram", pa.string()), ("n", pa.int32()), ("cf", pa.int64()), ("df", pa.int64())])


def _stack(max_n: int):
    """Sum up prefixes of suffixes that come in descending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[str] = []  # the suffix on the stack; cf[k] and df[k] belong to its first k + 1 terms
        cf: list[int] = []
        df: list[int] = []
        out: tuple[list, list, list, list] = ([], [], [], [])

        def pop(to: int) -> None:
            while len(path) > to:
                out[0].append(SEP.join(path))
                out[1].append(len(path))
                out[2].append(cf[-1])
                out[3].append(df.pop())
                path.pop()
                c = cf.pop()
                if path:  # occurrences of a longer gram are occurrences of its prefix
                    cf[-1] += c

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _OUT.types)], schema=_OUT)
            for x in out:
                x.clear()
            return b

        for b in batches:
            sums = [b.column(c).to_pylist() for c in _sums(max_n)]
            for suffix, c, *d in zip(b.column("suffix").to_pylist(), *sums):
                terms = suffix.split(SEP)
                same = 0
                for x, y in zip(path, terms):
                    if x != y:
                        break
                    same += 1
                pop(same)
                while len(path) < len(terms):
                    path.append(terms[len(path)])
                    cf.append(0)
                    df.append(0)
                cf[-1] += c
                for k in range(len(terms)):
                    df[k] += d[k]
            if len(out[0]) > 50_000:
                yield batch()
        pop(0)
        yield batch()

    return run


def ngram_counts(records: DataFrame, tokens: str, max_n: int = 1) -> DataFrame:
    """(gram, n, cf, df) of every n-gram of up to ``max_n`` terms: occurrences and records."""
    combined = records.select(tokens).mapInArrow(_combine(max_n), "suffix STRING, " + ", ".join(f"{c} LONG" for c in _sums(max_n)))
    routed = combined.repartition(F.substring_index("suffix", SEP, 2)).sortWithinPartitions(F.desc("suffix"))
    grams = write_table(routed.mapInArrow(_stack(max_n), "gram STRING, n INT, cf LONG, df LONG"), "grams")  # read twice below
    single = grams.where("n = 1").groupBy("gram", "n").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
    return grams.where("n > 1").unionByName(single)


def banded(grams: DataFrame, records: int | Column, rare_below: int = 3, common_over: float = 0.15) -> DataFrame:
    """The counts with a ``band``: ``rare``, ``common`` or null for the useful ones between."""
    n = records if isinstance(records, Column) else F.lit(records)
    return grams.withColumn("band", F.when(F.col("df") < rare_below, "rare").when(F.col("df") > common_over * n, "common"))
