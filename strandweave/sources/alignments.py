"""Sources for alignments and reference sequences: BAM, SAM and FASTA."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandweave.session import ship
from strandweave.sources.bam import BAM_SCHEMA, BamSource, is_sorted, read_header
from strandweave.sources.bam import open_file as _open

__all__ = ["BAM_SCHEMA", "CALL_COLUMNS", "contigs", "is_sorted", "read_bam", "read_header", "read_sam", "register"]

#: What evidence is made of: bases, and of the tags only whether a read has other alignments.
CALL_COLUMNS = ("ordinal", "rid", "begin_pos", "map_q", "flag", "next_rid", "tlen", "cigar", "qname", "seq", "tag_SA")


def read_bam(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, **options: str) -> DataFrame:
    """Alignments of one or more files; only ``columns`` (of BAM_SCHEMA, or ``tag_XX``) are decoded."""
    register(spark)
    types = dict(f.strip().split(" ", 1) for f in BAM_SCHEMA.replace("map<string,string>", "map").split(","))
    types["tags"] = "map<string,string>"
    reader = spark.read.format("bam").options(**options)
    if columns:
        reader = reader.schema(", ".join(f"{c} {types.get(c, 'string')}" for c in columns))
    return reader.load(path)


FASTA_SCHEMA = "template_id int, name string, chunk_no long, seq string"


def fasta_index(path: str) -> list[tuple[str, int, int, int, int]]:
    """(name, length, offset, bases in a line, bytes in a line) from the index beside the file, or by one scan."""
    try:
        lines = _open(path + ".fai").read().decode().splitlines()
        return [(p[0], *map(int, p[1:5])) for p in (x.split("\t") for x in lines if x)]
    except OSError:
        pass
    out: list[list] = []
    offset = 0
    with _open(path) as f:
        rest = b""
        while block := f.read(1 << 20):
            lines = (rest + block).split(b"\n")
            rest = lines.pop()
            for line in lines:
                offset = _indexed(out, line, len(line) + 1, offset)
        if rest:
            _indexed(out, rest, len(rest), offset)
    return [tuple(x) for x in out]


def _indexed(out: list[list], line: bytes, size: int, offset: int) -> int:
    if line.startswith(b">"):
        out.append([line[1:].split()[0].decode(), 0, offset + size, 0, 0])
    elif out:
        bases = len(line.rstrip(b"\r"))
        out[-1][1] += bases
        if not out[-1][3]:
            out[-1][3:] = [bases, size]
    return offset + size


class _Piece(InputPartition):
    def __init__(self, begin: int, end: int, number: int, what: tuple):
        super().__init__(None)
        self.begin, self.end, self.number, self.what = begin, end, number, what


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunk", 65536))
        self.per = int(options.get("chunks_per_task", 256))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for tid, entry in enumerate(fasta_index(self.path)):
            length = entry[1]
            last = (length + self.chunk - 1) // self.chunk
            out += [_Piece(a, min(last, a + self.per), tid, entry) for a in range(0, last, self.per)]
        return out

    def read(self, part: _Piece) -> Iterator[tuple]:
        name, length, offset, bases, width = part.what
        with _open(self.path) as f:
            for no in range(part.begin, part.end):
                a, b = no * self.chunk, min(length, (no + 1) * self.chunk)
                start = offset + a // bases * width + a % bases
                stop = offset + (b - 1) // bases * width + (b - 1) % bases + 1
                f.seek(start)
                yield part.number, name, no, f.read(stop - start).replace(b"\n", b"").replace(b"\r", b"").decode()


class FastaSource(DataSource):
    """``spark.read.format("fasta").option("chunk", 65536).load(path)``: the reference in equal pieces."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return FASTA_SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the sources known, and let filters reach those that ask for them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    spark.dataSource.register(FastaSource)


def contigs(spark: SparkSession, bam: str) -> DataFrame:
    """(template_id, name, length) from a BAM header."""
    return spark.createDataFrame([(i, n, length) for i, (n, length) in enumerate(read_header(bam).contigs)], "template_id int, name string, length long")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Text alignments; contigs stay names, and positions count from 0."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@"))
    at = lambda i: F.get(f, F.lit(i))
    tags = F.map_from_entries(F.transform(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), F.regexp_extract(t, "^..:.:(.*)$", 1))))
    return rows.select(
        at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("rname"), (at(3).cast("int") - 1).alias("begin_pos"), at(4).cast("int").alias("map_q"), at(5).alias("cigar"),
        at(6).alias("rnext"), (at(7).cast("int") - 1).alias("next_pos"), at(8).cast("int").alias("tlen"), at(9).alias("seq"), at(10).alias("qual"), tags.alias("tags"),
    )
