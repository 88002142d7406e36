"""Words of UTF-8 bytes by one table of 256 bytes and ``split``."""

from __future__ import annotations

from collections.abc import Iterator

# A-Z become a-z; every other ASCII byte that is no letter or digit becomes a blank. Bytes of
# characters beyond ASCII stay, so such characters are parts of words.
TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

# Bytes of a text whose words are held as objects at once.
SLICE_BYTES = 1 << 20


def words_of_bytes(data: bytes, limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists; a longer text is cut between words."""
    if len(data) <= limit:
        yield data.translate(TABLE).split()
        return
    plain = data.translate(TABLE)
    start = 0
    while start < len(plain):
        end = start + limit
        if end < len(plain):
            cut = plain.rfind(b" ", start + 1, end)
            if cut < 0:  # a word longer than a slice stays whole
                cut = plain.find(b" ", end)
            end = cut if cut >= 0 else len(plain)
        yield plain[start:end].split()
        start = end
