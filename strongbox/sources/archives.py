"""Packing files into tar.gz archives and reading such archives."""

import gzip
import hashlib
import posixpath
import tarfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongbox.filesystem import qualified, resolve, within
from strongbox.functions.keys import archive_id, hash_part
from strongbox.operators.joins import join_on
from strongbox.schemas import MB, MEMBERS
from strongbox.sources.files import list_files

PACK_BYTES = 256 * MB
PACK_FILES = 100_000
STORE_ONLY = 0  # gzip level: data files are compressed already
COPY_BUFFER = 524288
MEMBERS_PER_BATCH = 1000
PACKED = pa.schema([("archive", pa.string()), ("member", pa.string()), ("length", pa.int64()), ("sha256", pa.string())])


def with_packs(files: DataFrame, group: Sequence[str], pack_bytes: int = PACK_BYTES, pack_files: int = PACK_FILES) -> DataFrame:
    """Adds ``pack_no``, which splits each group into packs of about the given size.

    The totals of a group decide how many packs it gets, the hash of the member which one it
    joins, so no group is ever brought together.
    """
    totals = files.groupBy(*group).agg(F.sum("length").alias("_bytes"), F.count(F.lit(1)).alias("_files"))
    packs = F.greatest(F.ceil(F.col("_bytes") / pack_bytes), F.ceil(F.col("_files") / pack_files), F.lit(1))
    counted = join_on(files, totals.select(*group, packs.alias("_packs")), group)
    return counted.withColumn("pack_no", hash_part("member", "_packs")).drop("_packs")


def pack_archives(
    files: DataFrame,
    group: Sequence[str],
    dest: str,
    gzip_level: int = STORE_ONLY,
    pack_bytes: int = PACK_BYTES,
    pack_files: int = PACK_FILES,
) -> DataFrame:
    """Writes the files of each group to tar.gz archives below ``dest``; returns their manifest.

    ``files`` has the group columns, member, length and either ``content`` or a ``path`` to read.
    Rows arrive sorted by archive and are copied straight through, so a task holds one batch.
    An archive gets its final name once it is complete, and the same one when a task is retried.
    The manifest (archive, member, length, sha256) is kept in ``dest/_manifest``.
    """
    spark, dest, base = files.sparkSession, qualified(dest), qualified("/")
    packed = with_packs(files, group, pack_bytes, pack_files)
    named = packed.withColumn(
        "archive", F.concat(F.lit("compressed-"), archive_id(*group, "pack_no"), F.lit(".tar.gz"))
    )
    source = "content" if "content" in files.columns else "path"
    schema = T.StructType([f for f in MEMBERS.fields if f.name in PACKED.names])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, writer = None, None
        try:
            for batch in batches:
                rows = []
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("archive", "member", source)]
                for archive, member, value in zip(*columns, strict=True):  # one row is a Python object at a time
                    archive, member = archive.as_py(), member.as_py()
                    if archive != current:
                        if writer:
                            writer.close()
                        current, writer = archive, _ArchiveWriter(dest, archive, gzip_level)
                    value = within(base, value.as_py()) if source == "path" else value.as_buffer()
                    rows.append((archive, member, *writer.add(member, value, source == "path")))
                yield pa.RecordBatch.from_pylist([dict(zip(PACKED.names, row, strict=True)) for row in rows], schema=PACKED)
            if writer:
                writer.close()
                writer = None
        finally:
            if writer:
                writer.abandon()

    sorted_rows = (
        named.select("archive", "member", source).repartition("archive").sortWithinPartitions("archive", "member")
    )
    sorted_rows.mapInArrow(write, schema).write.mode("overwrite").parquet(f"{dest}/_manifest")
    return spark.read.schema(schema).parquet(f"{dest}/_manifest")


class _ArchiveWriter:
    """One archive, written under a temporary name and renamed when it is complete."""

    def __init__(self, dest: str, archive: str, level: int):
        self.store, folder = resolve(dest)
        self.store.create_dir(folder, recursive=True)
        self.final = posixpath.join(folder, archive)
        self.partial = posixpath.join(folder, f"_{archive}.{uuid.uuid4().hex}")
        self.raw = self.store.open_output_stream(self.partial, compression=None)
        # No name or time in the header: a rewritten archive has the same bytes.
        self.packed = gzip.GzipFile(filename="", mode="wb", compresslevel=level, fileobj=self.raw, mtime=0)
        self.tar = tarfile.open(fileobj=self.packed, mode="w|", format=tarfile.GNU_FORMAT)

    def add(self, member: str, value, is_path: bool) -> tuple[int, str]:
        info = tarfile.TarInfo(member)
        if not is_path:
            info.size = len(value)
            self._add(info, pa.BufferReader(value))
            return info.size, hashlib.sha256(value).hexdigest()
        store, inner = resolve(value)
        info.size = store.get_file_info(inner).size
        with store.open_input_stream(inner, compression=None, buffer_size=COPY_BUFFER) as stream:
            reader = _Digesting(stream)
            self._add(info, reader)
        return info.size, reader.digest.hexdigest()

    def _add(self, info: tarfile.TarInfo, source) -> None:
        self.tar.addfile(info, source)
        self.tar.members.clear()  # a tarfile remembers all its members

    def close(self) -> None:
        self.tar.close()
        self.packed.close()
        self.raw.close()
        self.store.move(self.partial, self.final)

    def abandon(self) -> None:
        self.raw.close()
        self.store.delete_file(self.partial)


class _Digesting:
    def __init__(self, stream):
        self.stream, self.digest = stream, hashlib.sha256()

    def read(self, n: int = -1) -> bytes:
        data = self.stream.read(n)
        self.digest.update(data)
        return data


def accepted_member(name: str) -> bool:
    """Whether a member stays inside the folder it is unpacked to."""
    return not name.startswith("/") and ".." not in name.split("/") and name != ""


def unpack_archives(spark: SparkSession, archives: str, dest: str | None = None) -> DataFrame:
    """The files inside tar.gz archives: archive, member, length, sha256, modified, accepted.

    Archives are streamed, each by one task, whatever their size. Folders show up as the prefix
    of their files. With ``dest`` the members are written to ``dest/<archive name>/<member>``; a
    member that would leave that folder is not ``accepted`` and not written.
    """
    listed = list_files(spark.createDataFrame([(archives,)], "path string"))
    found = listed.where(F.col("path").endswith(".tar.gz")).select("path")
    dest = qualified(dest) if dest else None
    spread = found.repartition(max(spark.sparkContext.defaultParallelism, 1), "path")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield from _frames(_members(path, dest))

    return spread.mapInPandas(members, MEMBERS)


def _members(path: str, dest: str | None) -> Iterator[tuple]:
    store, inner = resolve(path)
    name = posixpath.basename(inner)
    with store.open_input_stream(inner, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
        while entry := tar.next():
            tar.members.clear()  # a tarfile remembers all its members
            if not entry.isfile():
                continue
            accepted = accepted_member(entry.name)
            target = posixpath.join(dest, name, entry.name) if dest and accepted else None
            digest = _copy(tar.extractfile(entry), target)
            yield name, entry.name, entry.size, digest, int(entry.mtime), accepted


def _copy(source, target: str | None) -> str:
    digest, out = hashlib.sha256(), None
    if target:
        store, inner = resolve(target)
        store.create_dir(posixpath.dirname(inner), recursive=True)
        out = store.open_output_stream(inner, compression=None)
    try:
        while data := source.read(COPY_BUFFER):
            digest.update(data)
            if out:
                out.write(data)
    finally:
        if out:
            out.close()
    return digest.hexdigest()


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == MEMBERS_PER_BATCH:
            yield pd.DataFrame(held, columns=MEMBERS.names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=MEMBERS.names)


def overlay_members(members: DataFrame) -> DataFrame:
    """The member that remains when archives are unpacked over one another, later ones last."""
    columns = [c for c in members.columns if c not in ("host_id", "member")]
    last = members.groupBy("host_id", "member").agg(
        F.max_by(F.struct(*columns), F.struct("modified", "archive")).alias("_m")
    )
    return last.select("host_id", "member", *[F.col(f"_m.{c}").alias(c) for c in columns])
