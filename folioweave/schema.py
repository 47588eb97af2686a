"""Vocabularies and types of the citation model."""

from __future__ import annotations

from pyspark.sql import types as T

#: What a cited place may be counted in.
LOCATION_TYPES = (
    "page", "chapter", "book", "volume", "question", "article", "lecture", "position", "verse", "part", "bekker number",
    "line", "stephanus number", "objection", "sed contra", "respondeo", "ad", "distinction", "prose", "metre",
)
#: Labels of page blocks.
BLOCK_LABELS = ("SectionHeader", "Text", "PageHeader", "PageFooter", "Footnote")
#: States of an import, in the order it goes through them.
QUEUE_STATUSES = ("pending", "queued", "inProgress", "processingContents", "imported", "importedAndCrawled", "complete")
#: Verdicts of copyright checks, most open first.
COPYRIGHT_STATUSES = ("likely_public_domain", "probably_public_domain", "doubtful_public_domain", "likely_copyrighted")
#: Fixed value: verdicts that withhold a book.
HIDDEN_STATUSES = ("likely_copyrighted",)
MAX_PARTS = 8

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.IntegerType())])
PARTS = T.ArrayType(PART)
PARTS_SQL = "array<struct<type: string, value: int>>"
