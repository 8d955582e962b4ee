"""A Python data source ``fasta`` for sequence files that hold whole records per file (plain, gz, bz2 or xz)."""

from __future__ import annotations

import bz2
import glob
import gzip
import lzma
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_OPENERS = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}


def records(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(id, sequence) of FASTA lines; ids end at the first blank, records without a sequence are skipped."""
    name, parts = None, []
    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if name is not None and parts:
                yield name, "".join(parts)
            name, parts = (line[1:].split(maxsplit=1) or [""])[0], []
        elif line:
            parts.append(line)
    if name is not None and parts:
        yield name, "".join(parts)


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(glob.glob(options["path"]))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        opener = next((f for suffix, f in _OPENERS.items() if partition.value.endswith(suffix)), open)
        with opener(partition.value, "rt") as lines:
            yield from records(lines)


class FastaDataSource(DataSource):
    """``spark.dataSource.register(FastaDataSource)``, then ``spark.read.format("fasta").load(path)``.

    For files on a file system that all executors mount; :func:`readers.read_fasta` reads any store that Spark knows.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "id string, seq string"

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)
