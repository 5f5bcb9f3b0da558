"""Helpers shared by the corpus operators: shared folders, row-wise Arrow passes, packed arrays."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import materialized, shared_dir

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: White space of every contract that takes words `[^\x20\x09-\x0D]+`; bytes.split() cuts at just these.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes to words of digits, letters and all beyond ASCII: A-Z become a-z, and all other ASCII becomes a space.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Rows and bytes that one Arrow batch may hold, so that a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Bytes of a text that are cut into words at once.
PIECE_BYTES = 1 << 20
#: Buckets of a table.
MOST_BUCKETS = 50_000

written = materialized


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, cut at ASCII white space, in lists of about PIECE_BYTES bytes each."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        if cut := _BLANK.search(text, end):
            end = cut.start()
        else:
            break
        yield text[at:end].split()
        at = end
    yield (text[at:] if at else text).split()


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by bytes as well as rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def per_text(
    docs: DataFrame, text: str, carry: Iterable[str] | None, fields: str, start: Callable[[], Callable[[list], dict]]
) -> DataFrame:
    """One narrow pass over the texts: columns `row` (struct of the carried columns) and `fields`.

    start() runs once per task and returns a function of a list of UTF-8 byte strings (None for null)
    that gives a list or Arrow array per field. carry: columns to keep, all of them if None. The carried
    columns travel inside one struct, so none of their names can clash with the new ones.
    """
    small_batches(docs.sparkSession)
    kept = docs.columns if carry is None else list(carry)
    src = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"), docs[text].cast("binary").alias("text"))
    new = T.StructType.fromDDL(fields)
    schema = T.StructType([T.StructField("row", src.schema["row"].dataType), *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        f, seen = start(), 0
        for b in batches:
            out = f(b.column(1).to_pylist())
            seen += b.nbytes
            cols = [b.column(0)] + [
                v if isinstance(v := out[x.name], pa.Array) else pa.array(v, type=to_arrow_type(x.dataType))
                for x in new.fields
            ]
            out = pa.RecordBatch.from_arrays(cols, names=["row", *[x.name for x in new.fields]])
            del b, cols
            yield out
            if seen > 4 * BATCH_BYTES:
                release()
                seen = 0
        del f
        release()

    return src.mapInArrow(run, schema)


def n_buckets(total: int, each: int, least: int = 12) -> int:
    """Number of hash buckets so that one holds about `each` of `total` items; grows with the input."""
    return max(least, -(-int(total) // each))


def release() -> None:
    """Gives freed memory back to the system: a worker lives on after its task, beside others on its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(a: np.ndarray) -> bytes:
    """A numeric array as compressed byte planes."""
    a = np.ascontiguousarray(a)
    head = a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little")
    return head + _zip.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    dtype, n = np.dtype(b[:4].decode().strip()), int.from_bytes(b[4:12], "little")
    if not n:
        return np.empty(0, dtype)
    planes = np.frombuffer(_unzip.decompress(b[12:]), np.uint8).reshape(dtype.itemsize, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """Like pack, for ascending unsigned numbers: stores their steps."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    a = unpack(b)
    return np.cumsum(a, dtype=a.dtype)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """df as files in the shared folder, bucketed by key: later groupings by key read them without a shuffle.

    Spark takes at most 100,000 buckets; a bucket then holds more than was asked for. The catalog entry that
    writing needs is dropped again, which leaves the files.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.bucketBy(min(buckets, MOST_BUCKETS), key).option("path", path).saveAsTable(table)
    found = spark.table(table)
    found.schema  # resolved now, while the entry is there
    spark.sql(f"DROP TABLE {table}")
    return found
