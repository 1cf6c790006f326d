"""Document identifiers: the day of a document in the high 32 bits, a hash of its external id in the low ones."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
LOW = 0xFFFFFFFF


def pack_id(tsec: Column, aux: Column) -> Column:
    """Day of `tsec` (seconds, not negative) and the low 32 bits of `aux`."""
    day = F.call_function("div", tsec.cast("long"), F.lit(DAY).cast("long"))
    return F.shiftleft(day, 32).bitwiseOR(aux.cast("long").bitwiseAND(F.lit(LOW)))


def shard_number(indexed_id: Column) -> Column:
    """The day number, which is the shard of all postings of a document."""
    return F.shiftright(indexed_id, 32)


def id_seconds(indexed_id: Column) -> Column:
    """Midnight UTC of the document's day."""
    return shard_number(indexed_id) * F.lit(DAY)


def id_aux(indexed_id: Column) -> Column:
    return indexed_id.bitwiseAND(F.lit(LOW))


def external_hash(external_id: Column) -> Column:
    """32 bits of the external id's MD5."""
    return F.conv(F.substring(F.md5(external_id.cast("binary")), 1, 8), 16, 10).cast("long")


def document_id(tsec: Column, external_id: Column) -> Column:
    return pack_id(tsec, external_hash(external_id))


def id_hex(indexed_id: Column) -> Column:
    """16 lower-case hex digits, which sort like the number."""
    return F.lower(F.lpad(F.hex(indexed_id), 16, "0"))


def parse_id(text: Column) -> Column:
    """The leading hex digits (at most 16) as a number; null and text without any are 0."""
    digits = F.regexp_extract(text, r"^\s*(?:0[xX])?([0-9a-fA-F]{1,16})", 1)
    return F.coalesce(F.conv(F.when(digits != "", digits), 16, 10).try_cast("long"), F.lit(0).cast("long"))


def index_base(mbox: Column, attr: Column, token: Column) -> Column:
    """The display name of a posting list over all shards."""
    return F.concat_ws(".", mbox, attr, token)


def index_key(shard: Column, mbox: Column, attr: Column, token: Column) -> Column:
    """The display name of a posting list in one shard."""
    return F.concat(id_hex(shard), F.lit("."), index_base(mbox, attr, token))


def id_time(indexed_id: Column) -> Column:
    """The day as text; the session's time zone is UTC."""
    return F.date_format(F.timestamp_seconds(id_seconds(indexed_id)), "yyyy-MM-dd HH:mm:ss")


def day_floor(seconds: int) -> int:
    """The smallest id of the day that holds `seconds`: bounds of time ranges have no low bits."""
    if seconds < 0:
        raise ValueError("times before 1970 are not supported")
    return (seconds // DAY) << 32


def to_hex(value: int) -> str:
    return f"{value:016x}"


def from_hex(text: str | None) -> int:
    """The leading hex digits of a cursor; 0 where there are none."""
    m = re.match(r"\s*(?:0[xX])?([0-9a-fA-F]{1,16})", text or "")
    return int(m[1], 16) if m else 0


def split_index_name(name: str) -> tuple[str, str, str]:
    """mailbox.attribute.token: the first two dots divide, the token may hold more."""
    parts = name.split(".", 2)
    if len(parts) != 3:
        raise ValueError(f"not an index name: {name!r}")
    return parts[0], parts[1], parts[2]
