"""Text functions as Column expressions: hosts, sanitising, ANSI, ids, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts that are never reported: loopback, link-local, private ranges (fixed values).
PRIVATE_HOST = r"^(?:localhost$|127\.|0\.0\.0\.0$|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|\[?::1\]?$)|\.local$|\.localhost$|\.internal$"
_URL = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/@\s]*@)?([^/:?#\s]+)"
_SCP = r"^[A-Za-z0-9._-]+@([A-Za-z0-9.-]+):"


def host_of(token: Column) -> Column:
    """Lower-case host of a URL or of user@host:path; null if there is none (204)."""
    url, scp = F.regexp_extract(token, _URL, 1), F.regexp_extract(token, _SCP, 1)
    host = F.when(url != "", url).when(scp != "", scp)
    return F.lower(host)


def is_private_host(host: Column) -> Column:
    """Whether a host is dropped from network facts (393)."""
    return F.coalesce(F.rlike(host, F.lit(PRIVATE_HOST)), F.lit(True))


def strip_ansi(text: Column) -> Column:
    """Without terminal escapes (295)."""
    return F.regexp_replace(text, r"\x1B(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1B]*(?:\x07|\x1B\\)|[@-Z\\-_])", "")


def sanitize(text: Column) -> Column:
    """Without control and bidirectional characters; line ends stay (281)."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F‎‏‪-‮⁦-⁩]", "")


def sanitize_cell(text: Column) -> Column:
    """One line for a table cell: white space collapsed (281)."""
    return F.trim(F.regexp_replace(sanitize(F.regexp_replace(text, r"[\t\r\n]+", " ")), r" {2,}", " "))


def head_tail(text: Column, most: int, gap: str = "…") -> Column:
    """The first and last halves of a text that exceeds `most` characters (34, 321)."""
    half = most // 2
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, half), F.lit(gap), F.right(text, F.lit(half)))).otherwise(text)


def truncate_utf8(text: Column, most_bytes: int) -> Column:
    """The longest prefix of whole characters within a number of bytes (67).

    UTF-8 marks the bytes that continue a character, so the cut moves back over at most three of them.
    """
    raw = F.encode(text, "UTF-8")

    def starts(at: int) -> Column:  # whether a character starts at this byte, counted from 0
        return F.conv(F.hex(F.substring(raw, at + 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) != 0x80

    cut = F.lit(max(0, most_bytes - 3))
    for back in (2, 1, 0):
        at = most_bytes - back
        if at >= 0:
            cut = F.when(starts(at), F.lit(at)).otherwise(cut)
    return F.when(F.octet_length(text) <= most_bytes, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


def uuid_version(uid: Column) -> Column:
    """4, 7 or null (273)."""
    v = F.regexp_extract(F.lower(uid), r"^[0-9a-f]{8}-[0-9a-f]{4}-([47])[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", 1)
    return F.when(v != "", v.cast("int"))


def short_id(harness: Column, uid: Column, width: int = 8) -> Column:
    """First characters of a random UUID, last of a time-ordered one, else a hash's (274, 275)."""
    bare = F.regexp_replace(F.lower(uid), "-", "")
    v = uuid_version(uid)
    return F.when(v == 4, F.substring(bare, 1, width)).when(v == 7, F.right(bare, F.lit(width))).otherwise(F.substring(F.sha2(F.concat(harness, F.lit(":"), uid), 256), 1, width))


def safe_sid(sid: Column) -> Column:
    """A session id that may name a file, else a hash of it (276)."""
    return F.when(F.rlike(sid, F.lit(r"^[A-Za-z0-9._-]{1,128}$")) & ~F.rlike(sid, F.lit(r"^\.+$")), sid).otherwise(F.substring(F.sha2(sid, 256), 1, 16))


def short_hash(value: Column, n: int) -> Column:
    return F.substring(F.sha2(value, 256), 1, n)


def canonical_json(json: Column) -> Column:
    """A JSON text with sorted keys and no spaces, null if it does not parse (77): a variant keeps its keys sorted."""
    return F.to_json(F.try_parse_json(json))
