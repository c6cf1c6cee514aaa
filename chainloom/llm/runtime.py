"""What the corpus operators share: columns by name, batches in Python workers, bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, held, let_go, shared_dir, table, workers
from ..session import settle as written

__all__ = ["discard", "held", "let_go", "map_batches", "map_groups", "shared_dir", "smallest", "string_column", "table", "workers", "written"]


def string_column(df: DataFrame, name: str) -> F.Column:
    """The named column as a string; a typed null where the table has no such column."""
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def map_batches(df: DataFrame, function, schema: T.StructType | str, owner: str | None = None) -> DataFrame:
    """mapInArrow for a function from one record batch to one table or batch (None: no rows), or to an
    iterator of them. owner: under which name the function keeps something in its worker (see held)."""
    workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(owner)
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                for part in [out] if isinstance(out, pa.Table | pa.RecordBatch) else out:
                    yield from part.to_batches() if isinstance(part, pa.Table) else [part]
        let_go(owner)

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, key: str, function, schema: T.StructType | str, rows: int = 4096) -> DataFrame:
    """A function from the rows of one key (a record batch without nulls in the key, which is a long) to
    a tuple of lists, one for each column of the schema. Rows come sorted by key, so a worker holds one group and
    one batch at a time, and results leave it about `rows` at a time."""
    workers(df.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        out, group, own = [[] for _ in names], [], None

        def close() -> None:
            whole = group[0] if len(group) == 1 else pa.Table.from_batches(group).combine_chunks().to_batches()[0]
            for column, values in zip(out, function(whole), strict=True):
                column += values
            group.clear()

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)
            for c in out:
                c.clear()
            return done

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if group and keys[a] != own:
                    close()
                own = keys[a]
                group.append(batch.slice(a, b - a))
            if len(out[0]) >= rows:
                yield flush()
        if group:
            close()
        yield flush()
        let_go()

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def smallest(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The n rows with the smallest values of a 64-bit hash column. Of a large table only the hashes
    under a bound that holds about 2n rows are sorted, so what reaches one place is bounded by n and
    not by n rows of every partition."""
    total = df.count()
    if total > 4 * n:
        df = df.where(F.col(by) < int(-(2**63) + 2**64 * (2 * n / total)))
    return df.orderBy(by, *ties).limit(n)
