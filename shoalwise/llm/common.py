"""What the operators of this folder share: stages in the shared folder, and words of texts."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwise.session import ship

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach: ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a temporary folder is made for ``local``
    masters; other masters raise.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.applicationId not in _roots:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="shoalwise-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _roots[context.applicationId] = f"file://{folder}"
    return _roots[context.applicationId]


def shipped(f: Callable) -> Callable:
    """``f(spark, ...)`` that first makes the package importable in Python workers."""

    @wraps(f)
    def run(spark: SparkSession, *args, **options):
        return f(ship(spark), *args, **options)

    return run


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared root."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage, survives lost executors, and lets later reads take only
    the columns they need.  The files stay until the shared folder is cleared.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Give memory that is free to the system: Spark uses workers again, and a task's own would come on top of it."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(name: str | Column) -> Column:
    """The UTF-8 bytes of a text column, NULL as empty; Python then needs no decoding of whole texts."""
    column = F.col(name) if isinstance(name, str) else name
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


#: Every ASCII byte that is no letter and no digit becomes a space.
_SPACED = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased."""
    return text.lower().translate(_SPACED).split()


def words_of_texts(texts: list[bytes], size: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """:func:`plain_words` of texts, so many bytes at a time: place of the first text, all words, and how many each text has."""
    ends, low = np.cumsum([len(t) for t in texts]), 0
    while low < len(texts):
        # at least one text
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, side="right")))
        flat = np.frombuffer(b" ".join([b"", *texts[low:high], b""]).lower().translate(_SPACED), np.uint8)
        inside = flat != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat[inside])])
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[low:high])])
        yield low, words, np.diff(np.searchsorted(starts, begins + 1))
        low = high


def spaced_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text whose A-Z are lower-cased."""
    return text.lower().split()


def spaced_word_count(name: str | Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text column as a long; NULL has none."""
    column = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.regexp_count(column.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def crc_remainder(name: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; NULL ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus
