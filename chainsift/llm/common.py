"""Helpers shared by the text operators: the shared scratch folder, written tables, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_OWN: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster names
    it; a temporary folder, made once for a driver, where it is unset (tests on one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if 0 not in _OWN:
        _OWN[0] = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return f"file://{_OWN[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chainsift/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows as Parquet in the shared folder, read again. Survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes what ``write_table`` wrote, once nothing lazy reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string (on the driver)."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def arrow_map(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, object]], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """``mapInArrow`` over column lists: ``rows(columns[, state])`` gives the output columns of a batch.

    ``setup`` makes a state once for each task (or finds it again in its process). A batch is handed on
    in slices of at most 256 rows, so that memory stays in proportion to a few texts."""
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = rows({n: part.column(n).to_pylist() for n in part.schema.names}, state)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in kind], schema=kind)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def text_bytes() -> F.Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")


def words(text: bytes, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, A-Z lower-cased on request (ASCII only, as both bytes methods are)."""
    return (text.lower() if lower else text).split()


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and the len(texts) + 1 places where they begin and end. A null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    first = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[first[0] : first[-1]], first - first[0]


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def find_words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of texts that begin at ``first`` (the last entry: where they end): starts, ends, first eight bytes, last eight bytes (0 for words
    of up to eight) and length (17 for longer than 16), which name a word of up to 16 bytes exactly."""
    space = _SPACE[data]
    before, after = np.append(True, space[:-1]), np.append(space[1:], True)
    inner = first[(first > 0) & (first < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    n = ends - starts
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[8 : 8 + len(data)] = data
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    a = eight[starts + 8] & _FIRST[np.minimum(n, 8)]
    b = np.where(n > 8, eight[ends], np.uint64(0))
    return starts, ends, a, b, np.minimum(n, 17).astype(np.uint8)


class Words:
    """Numbers of words of at most 16 bytes, named exactly by their length, first eight and last eight bytes: open addressing in flat arrays,
    of which at most half is in use."""

    def __init__(self, bits: int = 21):
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.a, self.b = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.n, self.row = np.zeros(1 << bits, np.uint8), np.zeros(1 << bits, np.int32)

    def _spots(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        h = (a ^ (a >> np.uint64(29)) ^ (b * np.uint64(0x7FB5D329728EA185)) ^ n) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The numbers of the words, -1 where there is none."""
        out, left, spot = np.full(len(a), -1, np.int64), np.arange(len(a)), self._spots(a, b, n)
        while len(left):
            held = self.n[spot]
            same = (held == n) & (self.a[spot] == a) & (self.b[spot] == b)
            out[left[same]] = self.row[spot[same]]
            on = np.flatnonzero(~same & (held != 0))
            left, spot, a, b, n = left[on], (spot[on] + 1) & self.mask, a[on], b[on], n[on]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, row: np.ndarray) -> None:
        """Different words that are not here yet."""
        if 2 * (self.used + len(a)) > len(self.n):
            held = np.flatnonzero(self.n)
            a, b, n, row = (np.append(own[held], new) for own, new in ((self.a, a), (self.b, b), (self.n, n), (self.row, row)))
            self._clear(max(self.bits, int(2 * len(a)).bit_length() + 1))
        self.used += len(a)
        spot = self._spots(a, b, n)
        while len(a):
            free = np.flatnonzero(self.n[spot] == 0)
            self.a[spot[free]], self.b[spot[free]], self.n[spot[free]], self.row[spot[free]] = a[free], b[free], n[free], row[free]
            on = np.flatnonzero((self.n[spot] != n) | (self.a[spot] != a) | (self.b[spot] != b))
            a, b, n, row, spot = a[on], b[on], n[on], row[on], (spot[on] + 1) & self.mask


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)], np.uint64)


def window_hashes(h: np.ndarray, offsets: tuple[int, ...], span: int) -> np.ndarray:
    """A 64-bit hash of ``h[i + o] for o in offsets``, for each window start i of ``span`` words."""
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, o in enumerate(offsets):
        out += (h[o : o + n] ^ (h[o : o + n] >> np.uint64(29))) * _FACTORS[k]
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low and high bits depend on all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
