"""Readers for play history, audio library and lyrics files.

Paths may be files, folders or patterns. Files of one pattern may have different headers: those
with the same header are read together, and every column is matched by name.
"""

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F, types as T

from tunetrail.operators.dedupe import number_copies
from tunetrail.schema import LIBRARY, LYRICS, PLAYS

CSV_OPTIONS = {"header": True, "escape": '"', "quote": '"'}


def canonical_name(name):
    """Export column name → the name used here.

    Export files prefix track columns with `master_metadata_`, and the track address with
    the vendor's name.
    """
    name = name.strip()
    if name.endswith("_track_uri"):
        return "track_uri"
    return {
        "master_metadata_track_name": "track_name",
        "master_metadata_album_artist_name": "artist",
    }.get(name, name)


def _paths(paths):
    return [paths] if isinstance(paths, str) else list(paths)


def _files(spark, paths):
    """(path, encoded address, size) of the data files behind paths, folders and patterns, in the order given, then by name.

    Spark lists the files; none is opened, and empty ones are left out.
    """
    found = []
    for path in _paths(paths):
        try:
            listed = spark.read.format("binaryFile").load(path).select("path", "_metadata.file_path", "length").collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(path) from error
            raise
        found += sorted(tuple(row) for row in listed)
    return found


# A split limit over any file's size: one task reads one file, from its start.
WHOLE_FILE = str(1 << 40)
# Files up to this size are read by tasks to their end, which a text scan does in a fraction of a second.
SMALL_FILE = 1 << 24
# Larger files opened at once by the driver.
OPENED = 16
# Rows of a task are numbered in the low 33 bits of monotonically_increasing_id.
ROW_NUMBER = (1 << 33) - 1


def _first_line(spark, conf, file):
    """First line of a text file, compressed or not; the rest is not read."""
    java = spark._jvm
    path = java.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = java.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        source = codec.createInputStream(stream) if codec else stream
        return java.java.io.BufferedReader(java.java.io.InputStreamReader(source, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def _headers(spark, files):
    """{address: first line} of text files (path, address, size), compressed or not.

    Small files are read by tasks, one each; larger ones, of which there are few for their bytes,
    are opened by the driver, several at a time, since no scan stops after a file's first line.
    """
    small = [path for path, _, size in files if size <= SMALL_FILE]
    large = [(path, address) for path, address, size in files if size > SMALL_FILE]
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    with ThreadPoolExecutor(OPENED) as pool:
        lines = pool.map(lambda file: _first_line(spark, conf, file[0]), large)
        found = {_plain(address): line for (_, address), line in zip(large, lines)}
    if small:
        own = spark.newSession()
        for key, value in spark.conf.getAll.items():
            if spark.conf.isModifiable(key):
                own.conf.set(key, value)
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            own.conf.set(key, WHOLE_FILE)
        lines = own.read.text(small).select("_metadata.file_path", "value", F.monotonically_increasing_id().alias("row"))
        first = lines.where(F.col("row").bitwiseAND(ROW_NUMBER) == 0)
        found |= {_plain(r.file_path): r.value for r in first.collect()}
    return found


def _plain(address):
    """File addresses are written with one slash or three."""
    return re.sub("^file:/+", "file:/", address)


def _address(c):
    """`_plain` of a column."""
    return F.regexp_replace(c, "^file:/+", "file:/")


def _scan(spark, paths, fmt, **options):
    """One table per header, with `source_no`: the position of the row's file among all files."""
    files = _files(spark, paths)
    if not files:
        raise FileNotFoundError(f"no data in {paths}")
    headers = _headers(spark, files) if fmt == "csv" else {}
    groups = {}
    for file, address, _ in files:
        groups.setdefault(headers.get(_plain(address), ""), []).append(file)
    numbers = spark.createDataFrame([(address, n) for n, (_, address, _) in enumerate(files)], "_file string, source_no int").select(
        _address(F.col("_file")).alias("_file"), "source_no")
    for group in groups.values():
        reader = spark.read.format(fmt).options(**(CSV_OPTIONS | options if fmt == "csv" else {"mergeSchema": True}))
        rows = reader.load(group)
        yield rows.withColumn("_file", _address(F.col("_metadata.file_path"))).join(numbers, "_file").drop("_file")


def _conform(df, schema, rename=None):
    """Keep the declared columns that exist, under their own names, leniently cast, and `source_no`."""
    rename = rename or {}
    present = {rename.get(c, canonical_name(c)): c for c in df.columns}
    picked = []
    for field in schema:
        if field.name not in present:
            continue
        c = F.col(f"`{present[field.name]}`")
        if isinstance(field.dataType, T.IntegerType) and field.name == "skipped":
            text = F.lower(F.trim(c.cast("string")))
            c = F.when(text.isin("true", "1", "1.0"), 1).when(text.isin("false", "0", "0.0"), 0)
        elif isinstance(field.dataType, T.TimestampNTZType):
            c = F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz") if _is_text(df, present[field.name]) else c.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.IntegerType):
            c = c.try_cast("double").try_cast("int")
        else:
            c = c.try_cast(field.dataType)
        picked.append(c.alias(field.name))
    return df.select(*picked, *(["source_no"] if "source_no" in df.columns else []))


def _is_text(df, name):
    return isinstance(df.schema[name].dataType, T.StringType)


def _content_ids(plays):
    """Set `play_id` to `_natural`, the hash of a row's content, with a number from the second row that has it.

    Hashes alone are shuffled to find those that repeat. Rows whose hash is unique keep their place
    (few repeated hashes are sent to all tasks by Spark's own choice); only repeats are numbered.
    """
    times = plays.groupBy("_natural").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1")
    times = times.select(F.col("_natural").alias("_repeated"))
    match = F.col("_natural") == F.col("_repeated")
    unique = plays.join(times, match, "left_anti").withColumn("play_id", F.col("_natural"))
    numbered = number_copies(plays.join(times, match, "left_semi").drop("play_id"), "_natural", "_repeat")
    suffix = F.when(F.col("_repeat") > 1, F.concat(F.lit("-"), F.col("_repeat").cast("string"))).otherwise("")
    named = numbered.withColumn("play_id", F.concat("_natural", suffix)).drop("_repeat")
    return unique.unionByName(named)


def conform_plays(raw, rename=None):
    """Play rows under the names and types used here. Extra columns are dropped, missing ones are
    NULL, except the four that every play needs. Without a play id, one is made of the row's
    content, and repeats of a row are numbered.
    """
    plays = _conform(raw, PLAYS, rename)
    lost = {"ts", "skipped", "track_name", "artist"} - set(plays.columns)
    if lost:
        raise ValueError(f"play history lacks {sorted(lost)}")
    own_id = "play_id" in plays.columns
    missing = [f for f in PLAYS if f.name not in plays.columns]
    plays = plays.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    natural = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
                                        ["user_id", "ts", "track_uri", "track_id", "track_name", "artist", "ms_played"]]), 256)
    if not own_id:
        plays = _content_ids(plays.withColumn("_natural", natural))
    return (plays.withColumn("play_id", F.coalesce("play_id", natural))
            .withColumn("user_id", F.coalesce("user_id", F.lit("")))
            .select(*[f.name for f in PLAYS]))


def conform_library(raw, rename=None):
    """Audio-feature rows under the names and types used here; without `track_id` an error."""
    library = _conform(raw, LIBRARY, rename)
    if "track_id" not in library.columns:
        raise ValueError("an audio library file has no track_id")
    return library


def read_plays(spark, path, fmt="csv", rename=None):
    """Listening history, see `conform_plays`."""
    return conform_plays(stack([rows.drop("source_no") for rows in _scan(spark, path, fmt)]), rename)


def read_library(spark, paths, fmt="csv", rename=None):
    """Stack audio-feature files that each hold some of the target columns.

    `source_no` is the position of the file among all files: those given first win when
    duplicates are dropped. A file without `track_id` is an error.
    """
    return stack([conform_library(rows, rename) for rows in _scan(spark, paths, fmt)])


def read_lyrics(spark, paths, fmt="csv", rename=None):
    """Stack lyrics files; texts may span lines."""
    return stack([_conform(rows, LYRICS, rename) for rows in _scan(spark, paths, fmt, multiLine=True)])


def stack(parts):
    """UNION ALL by name; columns a part lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def enrichment_worklist(plays, done=None, limit=None, offset=0):
    """Tracks that still need lyrics: one row per address, in address order.

    `done` holds the addresses already fetched; `offset` and `limit` cut one batch.
    """
    from tunetrail.operators.dedupe import first_per_key

    tracks = first_per_key(
        plays.select("artist", "track_name", "track_uri", "ts", "play_id").dropna(subset=["artist", "track_name", "track_uri"]),
        ["track_uri"], ["ts", "play_id"]).drop("ts", "play_id")
    if done is not None:
        tracks = tracks.join(done.select("track_uri"), "track_uri", "left_anti")
    if limit is None and not offset:
        return tracks
    tracks = tracks.orderBy("track_uri").offset(offset)
    return tracks if limit is None else tracks.limit(limit)
