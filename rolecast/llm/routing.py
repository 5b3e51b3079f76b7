"""Which 64-bit keys of a chunk occur anywhere else: keys travel as packed arrays, by their
high bits, to buckets, and the recurring ones go back to the chunks that asked.

A key reaches a bucket once per block of text and chunk, however often it occurs there, so a
hot key costs as many entries as there are blocks, not occurrences. Bit 0 of a key says that
it occurs more than once in its block.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rolecast.llm.kernels import U, bucket_slices, packed

ROUTED = "bucket int, keys binary, chunks binary"
RETURNED = "chunk int, keys binary"
ROUTED_ARROW = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("chunks", pa.binary())])
_EVEN = U(0xFFFFFFFFFFFFFFFE)


def even(keys: np.ndarray) -> np.ndarray:
    return keys & _EVEN


def route(keys: np.ndarray, chunks: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows for the occurrences (key, chunk) of one block."""
    keys = even(keys)
    order = np.lexsort((chunks, keys))
    keys, chunks = keys[order], chunks[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    often = same[1:] | same[:-1]
    first = np.ones(len(keys), bool)
    first[1:] = ~same[1:-1] | (chunks[1:] != chunks[:-1])
    keys, chunks = (keys | often.astype(U))[first], chunks[first].astype(np.int32)
    rows = [(b, packed(keys[s]), packed(chunks[s])) for b, s in bucket_slices(keys, buckets)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, ROUTED_ARROW.types)],
                                      schema=ROUTED_ARROW)


def arrays(table: pa.Table, column: str, kind) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in table.column(column).to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _recurring(table: pa.Table) -> pa.Table:
    keys, chunks = arrays(table, "keys", U), arrays(table, "chunks", np.int32)
    order = np.argsort(keys, kind="stable")
    keys, chunks = keys[order], chunks[order]
    plain = even(keys)
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = plain[1:] == plain[:-1]
    # A flagged key sorts behind its plain one, so a lone entry recurs only by its flag.
    hit = same[1:] | same[:-1] | ((keys & U(1)) == 1)
    plain, chunks = plain[hit], chunks[hit]
    order = np.lexsort((plain, chunks))
    plain, chunks = plain[order], chunks[order]
    new = np.ones(len(plain), bool)
    new[1:] = (plain[1:] != plain[:-1]) | (chunks[1:] != chunks[:-1])
    plain, chunks = plain[new], chunks[new]
    ids, at = np.unique(chunks, return_index=True)
    cuts = np.append(at, len(chunks))
    return pa.table({"chunk": pa.array(ids, pa.int32()),
                     "keys": pa.array([packed(plain[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def recurring(routed: DataFrame) -> DataFrame:
    """(chunk, keys): the keys of each chunk that occur at least twice overall."""
    return routed.groupBy("bucket").applyInArrow(_recurring, RETURNED)


def returned(table: pa.Table) -> np.ndarray:
    """The sorted keys that came back to a chunk."""
    return np.unique(arrays(table, "keys", U))
