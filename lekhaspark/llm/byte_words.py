"""Words of a text by a table of 256 bytes: A-Z become lower case, what separates words becomes a space, all else of UTF-8 stays."""

from __future__ import annotations

# Digits, letters and the bytes above 127 are in words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []
