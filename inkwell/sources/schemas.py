"""Schemas of stored tables and of requests."""

from __future__ import annotations

#: Version of the metadata file.
META_VERSION = 3

CONTENT = "struct<content:string,title:string,links:array<string>,images:array<string>>"

#: What is indexed: attributes are in `index`, whatever their names.
INPUT = f"mbox string, id string, author string, tsec long, content {CONTENT}, index map<string,string>, seq long"

#: batch and seq order the writes of a document; the last one counts.
DOCUMENTS = f"indexed_id long, id string, author string, is_comment boolean, tsec long, content {CONTENT}, batch long, seq long, shard long"

#: As they lie in files: the batch is that of the piece, which a commit numbers.
STORED_DOCUMENTS = DOCUMENTS.replace("batch long, ", "")

#: One row for each document that has the token; rows may repeat until they are compacted.
POSTINGS = "mbox string, attr string, token string, shard long, indexed_id long"

#: Search replies, a row per document.
REPLY = f"id string, indexed_id string, author string, content {CONTENT}, relevance float, timestamp struct<tsec:bigint,tnsec:bigint>"
