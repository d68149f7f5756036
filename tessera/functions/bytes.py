"""Bytes as characters: a bijection between the 256 byte values and printable pseudo-characters, on string columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import CharMapper, Marker


def pseudo_table() -> list[str]:
    """Bytes that print as one visible sign stand for themselves; the others get the characters from U+0100 on, in order."""
    out, n = [], 0
    for b in range(256):
        visible = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out.append(chr(b) if visible else chr(256 + n))
        n += not visible
    return out


def latin_table() -> list[str]:
    """As pseudo_table, but every byte beyond ASCII stands as a Latin letter, so that letters stay together."""
    table, taken = pseudo_table(), set(pseudo_table())
    letters = (chr(c) for c in range(0x100, 0x250) if unicodedata.category(chr(c)) in ("Ll", "Lu") and chr(c) not in taken)
    return [c if b < 128 or (unicodedata.category(c) in ("Ll", "Lu") and c != "µ") else next(letters) for b, c in enumerate(table)]


class ByteMapper(CharMapper):
    """UTF-8 bytes as the table's characters. Bytes are read as the first 256 characters, so that one `translate` maps them all."""

    def __init__(self, table: list[str]):
        super().__init__(lambda c: self._signs(c, ""), lambda c: _bytes(c, table))
        object.__setattr__(self, "table", table)

    def _signs(self, c: Column, spare: str) -> Column:
        moved = [(chr(b), sign) for b, sign in enumerate(self.table) if chr(b) != sign and chr(b) not in spare]
        return F.translate(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), "".join(a for a, _ in moved), "".join(b for _, b in moved))

    def marked(self, c: Column) -> Column:
        return self._signs(c, "\x01")


def _bytes(c: Column, table: list[str]) -> Column:
    """Backwards; bytes that aren't UTF-8 decode to U+FFFD, characters outside of the table go."""
    back = F.create_map(*(F.lit(x) for b, sign in enumerate(table) for x in (sign, f"{b:02X}")))
    signs = F.filter(F.split(F.replace(c, F.lit(" "), F.lit(table[32])), ""), lambda x: x != "")
    raw = F.unhex(F.array_join(F.transform(signs, lambda x: F.element_at(back, x)), ""))
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.make_valid_utf8(raw.cast("string")))


def pseudo_bytes() -> CharMapper:
    return ByteMapper(pseudo_table())


def latin_bytes() -> CharMapper:
    return ByteMapper(latin_table())


def token_to_bytes(c: Column, table: list[str], marker: Marker) -> Column:
    """A token of pseudo-characters as binary; its boundary mark becomes the byte of a blank."""
    parts = marker.isolate(c)
    blank = F.when(parts["mark"] != "", F.lit(table[32])).otherwise(F.lit(""))
    back = F.create_map(*(F.lit(x) for b, sign in enumerate(table) for x in (sign, f"{b:02X}")))
    signs = F.filter(F.split(marker.concatenate(parts["root"], blank), ""), lambda x: x != "")
    return F.unhex(F.array_join(F.transform(signs, lambda x: F.element_at(back, x)), ""))


def bytes_to_token(c: Column, table: list[str], marker: Marker) -> Column:
    """Binary as pseudo-characters; a blank at the mark's place becomes the mark."""
    moved = [(chr(b), sign) for b, sign in enumerate(table) if chr(b) != sign]
    signs = F.translate(F.decode(c, "ISO-8859-1"), "".join(a for a, _ in moved), "".join(b for _, b in moved))
    parts = Marker(table[32], marker.detached, marker.side).isolate(signs)
    return F.when(parts["mark"] != "", marker.concatenate(parts["root"], F.lit(marker.substitute))).otherwise(signs)
