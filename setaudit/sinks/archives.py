"""Archives written by executors, one per set, from a plan of items; checked, converted and unpacked."""

from __future__ import annotations

import io
import os
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.sources.files import located, open_path, wanted_entry, with_content

# What a canonical archive fixes, so equal contents give equal bytes.
FIXED_TIME = (1996, 12, 24, 23, 32, 0)
COMMENT = "TORRENTZIPPED-"
END = 22


def packed(name_content: list[tuple[str, bytes]]) -> bytes:
    """A canonical archive: entries by lower-case name, fixed time, deflated, with the checksum of its directory as comment."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for name, content in sorted(name_content, key=lambda x: x[0].lower()):
            info = zipfile.ZipInfo(name, FIXED_TIME)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    body = out.getvalue()
    comment = f"{COMMENT}{directory_sum(body):08X}".encode()
    return body[:-2] + len(comment).to_bytes(2, "little") + comment


def directory_sum(archive: bytes) -> int:
    """The crc32 of an archive's central directory."""
    end = archive.rfind(b"PK\x05\x06")
    size, start = (int.from_bytes(archive[end + i : end + i + 4], "little") for i in (12, 16))
    return zlib.crc32(archive[start : start + size])


def is_canonical(content: bytes) -> bool:
    """Whether an archive has its entries in order and at the fixed time, and the right checksum as its comment."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [i.filename.lower() for i in z.infolist()]
        right = f"{COMMENT}{directory_sum(content):08X}".encode()
        return names == sorted(names) and all(i.date_time == FIXED_TIME for i in z.infolist()) and z.comment == right


def build(plan: DataFrame) -> DataFrame:
    """(archive, content) from (archive, name, content): one archive per set; a set's items are bounded by the set."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"archive": [pdf["archive"].iloc[0]], "content": [packed(list(zip(pdf["name"], pdf["content"])))]})

    return plan.groupBy("archive").applyInPandas(one, "archive string, content binary")


def read_contents(sources: DataFrame) -> DataFrame:
    """(archive, name, content, error) of (archive, name, location_type, location_path, location_entry): each item's bytes, from a
    file or an archive's entry; `build` takes the rows without an error."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    with open_path(r.location_path) as f:
                        if r.location_type == "archive":
                            with zipfile.ZipFile(f) as z:
                                rows.append((r.archive, r.name, z.read(r.location_entry or r.name), None))
                        else:
                            rows.append((r.archive, r.name, f.read(), None))
                except (OSError, KeyError, zipfile.BadZipFile, zlib.error) as e:
                    rows.append((r.archive, r.name, None, str(e)))
            yield pd.DataFrame(rows, columns=["archive", "name", "content", "error"])

    return sources.select("archive", "name", "location_type", "location_path", "location_entry").mapInPandas(each, "archive string, name string, content binary, error string")


def write_files(rows: DataFrame, name: str, folder: str, suffix: str = "") -> DataFrame:
    """(path, action, error): each row's `content` written by its executor to folder/name+suffix. A file that exists is left
    (skipped); one is written beside its place and then renamed, so a lost executor leaves no half file under the name."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in frames:
            out = []
            for key, content in zip(pdf[name], pdf["content"]):
                path = f"{folder.rstrip('/')}/{key}{suffix}"
                system, inner = located(path)
                try:
                    if ".." in str(key).split("/"):
                        raise OSError("leaves the folder")
                    if system.get_file_info(inner).type != fs.FileType.NotFound:
                        out.append((path, "skipped", None))
                        continue
                    system.create_dir(os.path.dirname(inner), recursive=True)
                    draft = f"{inner}.{os.getpid()}.part"
                    with system.open_output_stream(draft) as f:
                        f.write(content)
                    system.move(draft, inner)
                    out.append((path, "written", None))
                except OSError as e:
                    out.append((path, "failed", str(e)))
            yield pd.DataFrame(out, columns=["path", "action", "error"])

    return rows.select(F.col(name).alias(name), "content").mapInPandas(each, "path string, action string, error string")


def check(archives: DataFrame) -> DataFrame:
    """(path, canonical, error) of a listing; `canonical` is null where an archive cannot be read."""

    def read(path: str) -> list[tuple]:
        try:
            with open_path(path) as f:
                return [(is_canonical(f.read()), None)]
        except (zipfile.BadZipFile, OSError) as e:
            return [(None, str(e))]

    return with_content(archives, "canonical boolean, error string", read)


def check_counts(checked: DataFrame) -> DataFrame:
    """(compliant, other, errors) of `check`."""
    return checked.agg(F.count_if("canonical").alias("compliant"), F.count_if(~F.col("canonical")).alias("other"), F.count_if(F.col("canonical").isNull()).alias("errors"))


def convert(archives: DataFrame) -> DataFrame:
    """(path, content, error): each archive of a listing as a canonical one; `write_files` puts them in place."""

    def read(path: str) -> list[tuple]:
        try:
            with open_path(path) as f, zipfile.ZipFile(f) as z:
                return [(packed([(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]), None)]
        except (zipfile.BadZipFile, OSError, zlib.error) as e:
            return [(None, str(e))]

    return with_content(archives, "content binary, error string", read)


def extract_all(archives: DataFrame, folder: str) -> DataFrame:
    """(path, action, error): every entry of each archive of a listing written to folder/archive/entry, entry by entry."""

    def read(path: str) -> list[tuple]:
        stem = os.path.splitext(path.rsplit("/", 1)[-1])[0]
        with open_path(path) as f, zipfile.ZipFile(f) as z:
            return [(f"{stem}/{i.filename}", z.read(i)) for i in z.infolist() if not i.is_dir() and wanted_entry(i.filename)]

    return write_files(with_content(archives, "target string, content binary", read), "target", folder)
