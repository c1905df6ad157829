"""Canonical bytes of records that differ only in writing.

A text's canonical form holds its letters and digits only, case folded, compatibility forms replaced by the plain
character; null is the empty text. A record's canonical bytes are its parts in order, each with its length, so that no
two different records share them. Sets are sorted and joined the same way, so order and repetition do not count.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

_PLAIN = re.compile(r"[0-9a-z]*", re.A)
_NOT_WORD = re.compile(r"[\W_]+")


def letters_digits(text: str | None) -> str:
    """Letters and digits of a text, folded."""
    if not text:
        return ""
    if text.isascii():
        s = text.lower()
        return s if s.isalnum() else "".join(c for c in s if c.isalnum())
    s = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in s if c.isalnum())


def pack(parts: Iterable[str]) -> bytes:
    """Parts joined so that each can be told from the next."""
    out = bytearray()
    for p in parts:
        b = p.encode("utf-8", "surrogatepass")
        out += b
        out += b"\x00%d\x01" % len(b)
    return bytes(out)


def pack_set(items: Iterable[str]) -> str:
    return pack(sorted(set(items))).decode("utf-8", "surrogatepass")


def attrs_items(text: str | None) -> list[str]:
    """The items of ``key=value;key=value`` or ``|``-split text: key without case, value as canonical text."""
    out = []
    for item in re.split(r"[;|]", text or ""):
        key, _, value = item.partition("=")
        key = key.strip().casefold()
        if key or value.strip():
            out.append(f"{key}={letters_digits(value)}")
    return out


def plain_items(items: Iterable[str | None] | None) -> list[str]:
    """Items trimmed and without case; null items do not count."""
    return [i.strip().casefold() for i in items or () if i is not None]
