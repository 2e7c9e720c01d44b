"""Parser and chunker together, and the command line."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunker import MarkdownChunker
from ..sources import parsers, sinks


class Pipeline:
    """chunk_strings takes (doc_id, raw); chunk_files takes paths."""

    def __init__(self, kind: str, chunker: MarkdownChunker | None = None, **options):
        if kind not in parsers.PARSERS:
            raise ValueError(f"no parser named {kind}")
        self.kind, self.chunker, self.options = kind, chunker or MarkdownChunker(), options

    def chunk_strings(self, docs: DataFrame) -> DataFrame:
        return self.chunker.chunk(parsers.parsed_lines(docs, self.kind, **self.options))

    __call__ = chunk_strings

    def chunk_files(self, spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
        return self.chunk_strings(parsers.read(spark, path, self.kind, recursive).select("doc_id", "raw"))


class EnvelopePipeline(Pipeline):
    """JSON envelopes in, envelopes with chunked parts out."""

    def __init__(self, chunker: MarkdownChunker | None = None, **options):
        super().__init__("json", chunker, **options)

    def chunk_directory(self, spark: SparkSession, folder: str, out: str | None = None) -> str:
        """Every envelope below folder; by default to the folder's name with -chunked."""
        out = out or folder.rstrip("/") + "-chunked"
        docs = parsers.read(spark, folder, "json", recursive=True)
        parts = sinks.envelope_parts(self.chunk_strings(docs.select("doc_id", "raw")))
        rows = docs.join(parts, "doc_id", "left").withColumn("e", F.from_json("raw", parsers.ENVELOPE))
        rows.select(sinks.envelope_json(F.col("e"), F.coalesce("has_part", F.array().cast(parts.schema["has_part"].dataType))).alias("value")).write.mode("overwrite").text(out)
        return out


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description="Chunk a file, or a folder of JSON envelopes.")
    a.add_argument("--filepath", required=True)
    a.add_argument("--output")
    a.add_argument("--max-headers-to-use", default="h4")
    a.add_argument("--max-chunk-word-count", type=int, default=250)
    a.add_argument("--hard-max-chunk-word-count", type=int, default=400)
    a.add_argument("--min-chunk-word-count", type=int, default=15)
    a.add_argument("--remove-links", action="store_true")
    o = a.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    chunker = MarkdownChunker(o.max_headers_to_use, o.max_chunk_word_count, o.hard_max_chunk_word_count, o.min_chunk_word_count)
    if os.path.isdir(o.filepath):
        print(EnvelopePipeline(chunker).chunk_directory(spark, o.filepath, o.output))
        return
    kind = parsers.format_of(o.filepath)
    if kind not in parsers.PARSERS:
        raise ValueError(f"{kind} files are read from spans; see quillon.operators.layout")
    out = o.output or o.filepath.rsplit(".", 1)[0] + "-chunks.json"
    sinks.save_one(Pipeline(kind, chunker).chunk_files(spark, o.filepath), out, o.remove_links)
    print(out)


if __name__ == "__main__":
    main()
