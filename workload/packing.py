"""Zip archives made of the derived lines, for the queries that read them back."""

from __future__ import annotations

import shutil
import tempfile
import zipfile
from typing import IO

from pyspark.sql import functions as F

from logvane.session import work_path
from logvane.sources.archives import file_system
from workload.raw_events import raw_lines

ARCHIVES, MEMBERS = 4, 16
_PACKED: dict[tuple[str, str], str] = {}


def dealt_lines(spark, sf_dir):
    """``archive, member, line``, an archive's lines in one task."""
    event = F.col("event_key")
    return raw_lines(spark, sf_dir).select(
        (event % ARCHIVES).alias("archive"), F.floor(event / ARCHIVES % MEMBERS).cast("long").alias("member"), "line").repartition("archive")


def packed_lines(spark, sf_dir):
    """The folder of archives that hold all lines, written once per session by one task an archive."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _PACKED:
        return _PACKED[key]
    root = work_path(spark, "archives")

    def pack(batches):
        """Lines wait in a file for each member, so nothing is sorted and no member is held."""
        system, folder = file_system(root)
        system.create_dir(folder, recursive=True)
        waiting: dict[int, dict[int, IO[bytes]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                members = waiting.setdefault(row["archive"], {})
                if row["member"] not in members:
                    members[row["member"]] = tempfile.TemporaryFile()
                members[row["member"]].write(row["line"].encode() + b"\n")
        for name, members in waiting.items():
            with system.open_output_stream(f"{folder}/day-{name}.zip") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("README.txt", "not a log\n")
                for member in sorted(members):
                    with members[member] as lines, archive.open(f"logs/{member}.json", "w", force_zip64=True) as out:
                        lines.seek(0)
                        shutil.copyfileobj(lines, out, 1 << 20)
        yield from ()

    dealt_lines(spark, sf_dir).mapInArrow(pack, "nothing long").count()
    _PACKED[key] = root
    return root
