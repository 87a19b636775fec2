"""Chunkers and block readers as table functions of SQL: SELECT d.doc_id, c.* FROM docs d, LATERAL chunk_text(d.text, 'fixed') c."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import chunking as C


class _Chunks:
    def eval(self, text: str, chunker: str):
        """pos and chunk of a text by the chunker of this name, with its own parameters; a null text has none."""
        if text is not None:
            yield from enumerate(C.CHUNKERS[chunker](text))


class _ProfileChunks:
    def eval(self, text: str, profile: str):
        """pos and chunk by the chunker and parameters of a profile."""
        if text is not None:
            name, parameters = C.PROFILES[profile]
            yield from enumerate(C.CHUNKERS[name](text, **parameters))


class _MarkdownBlocks:
    def eval(self, text: str):
        """Blocks of a Markdown text."""
        if text is not None:
            for pos, block in enumerate(C.parsed_markdown(text)):
                yield (pos, *block)


def register(spark: SparkSession) -> None:
    """chunk_text(text, chunker), chunk_profile(text, profile) and markdown_blocks(text) for the session's SQL."""
    made = {
        "chunk_text": (_Chunks, "pos int, chunk string"),
        "chunk_profile": (_ProfileChunks, "pos int, chunk string"),
        "markdown_blocks": (_MarkdownBlocks, "block_pos int, content_type string, text string, heading string"),
    }
    for name, (handler, schema) in made.items():
        spark.udtf.register(name, F.udtf(handler, returnType=schema))
