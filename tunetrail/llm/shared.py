"""What several corpus operators need: shared scratch tables, text buffers, rolling hashes."""

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that end a word: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NO_ID = np.iinfo(np.int64).max
BLOCK = 1 << 19
LONG_WORD = 1 << 12


def scratch_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir, else one in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there. Runs a job."""
    path = f"{scratch_folder(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, from one scan."""
    return df.agg(F.sum(F.octet_length(F.coalesce(column, F.lit(""))))).first()[0] or 0


def parts_for(total_bytes: int, least: int = 4 << 20, most: int = 64 << 20) -> int:
    """Number of equal parts for packed exchanges between parts and buckets.

    The part size follows the square root of the input, so that a message from one part to one
    bucket keeps a useful length, within bounds that fit a worker's memory.
    """
    size = min(most, max(least, int((total_bytes * (64 << 10)) ** 0.5)))
    return max(1, -(-total_bytes // size))


def in_parts(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, doc_id, text) with NULL text as empty; a part is a hash of id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part"),
                       F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def id_values(column) -> np.ndarray:
    """Ids of an Arrow column; NULL counts as larger than every id."""
    return pc.fill_null(column, NO_ID).to_numpy() if len(column) else np.empty(0, np.int64)


def binary_values(column) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, a line feed after each, and where each one starts (one more at the end)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array that ends with a space byte."""
    space = SPACE[data]
    if not len(space):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    edges = change if space[0] else np.concatenate([[0], change])
    return edges[0::2], edges[1::2]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values (xor-shift-multiply rounds)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        out = []
        for base in (BASE, pow(BASE, -1, 2**64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps))
        _powers[:] = out
    return _powers[0], _powers[1]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums; hash of [i, j) is (sums[j] - sums[i]) * BASE**-i."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:len(codes)], out=out[1:])
    return out


def window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` codes, in blocks of bounded memory."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for start in range(0, n, BLOCK):
        stop = min(n, start + BLOCK)
        sums = prefix_sums(codes[start:stop + length - 1].astype(np.uint64))
        out[start:stop] = (sums[length:] - sums[:-length]) * powers(stop - start)[1][:stop - start]
    return mix(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; words of LONG_WORD bytes and more are hashed by themselves."""
    import hashlib

    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts >= LONG_WORD)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK)))
        first, last = starts[at], min(ends[to - 1], starts[to - 1] + LONG_WORD)
        sums = prefix_sums(data[first:last].astype(np.uint64) + np.uint64(1))
        a = starts[at:to] - first
        b = np.minimum(ends[at:to] - first, len(sums) - 1)
        out[at:to] = (sums[b] - sums[a]) * powers(len(sums))[1][a]
        at = to
    out = mix(out)
    for k in long:
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k]:ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def planes(values: np.ndarray) -> bytes:
    """Fixed-width values as byte planes: sorted or small values compress well that way."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)


def bucket_cuts(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of `buckets` equal hash ranges begins in sorted 64-bit hashes (one more at the end)."""
    edges = [(b << 64) // buckets for b in range(buckets)]
    return np.append(np.searchsorted(sorted_hashes, np.array(edges, np.uint64)), len(sorted_hashes))


def found(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the sorted array, and where."""
    if not len(among):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values, at


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges[0::2], edges[1::2]


def slices(texts: list[bytes], limit: int = 4 << 20):
    """(first, last) of runs of texts of about `limit` bytes, one text at least."""
    first, weight = 0, 0
    for k, text in enumerate(texts):
        if weight and weight + len(text) > limit:
            yield first, k
            first, weight = k, 0
        weight += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def sums_of(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of a mask between consecutive starts; the last run ends with the array."""
    return np.add.reduceat(mask, starts, dtype=np.int64) if len(starts) else np.empty(0, np.int64)


def labelled(labels: DataFrame, column: str, modulus: int, held_out: int, most: int, seed: int = 7) -> DataFrame:
    """At most `most` training rows (doc_id, label): a sample by hash of all rows outside the held-out fold.

    Rows with a NULL id or label are left out; an id with several labels has the majority, 1 on a tie.
    """
    return (labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
            .where(fold(F.col("doc_id"), modulus) != held_out)
            .groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("label"))
            .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most))


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """Schema of a table with more columns at its end."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def owned(owner: np.ndarray, *columns: np.ndarray):
    """(owner, its values of each column), one owner after the other."""
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else []
    for a, b in zip(starts, np.append(starts[1:], len(owner)) if len(owner) else []):
        yield int(owner[a]), [c[order[a:b]] for c in columns]


def other_columns(df: DataFrame, *added: str) -> list[str]:
    """Names of the columns that keep their place beside the added ones; names go without case."""
    low = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in low]


def quoted(names: list[str]) -> list:
    """Columns by their exact names, dots included."""
    return [F.col(f"`{n}`") for n in names]


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it where the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
