"""Apple Data Compression: literals and two lengths of back references."""

from __future__ import annotations


def unpack(raw: bytes, most: int) -> bytes:
    """Up to ``most`` bytes. Damaged data end before the first step that doesn't fit: what came until then is kept."""
    out, k = bytearray(), 0
    while k < len(raw) and len(out) < most:
        c = raw[k]
        if c & 0x80:
            n = (c & 0x7F) + 1
            if k + 1 + n > len(raw) or len(out) + n > most:
                break
            out += raw[k + 1 : k + 1 + n]
            k += 1 + n
            continue
        far = bool(c & 0x40)
        if k + 2 + far > len(raw):
            break
        if far:
            n, back = (c & 0x3F) + 4, (raw[k + 1] << 8 | raw[k + 2]) + 1
        else:
            n, back = (c >> 2 & 0xF) + 3, ((c & 3) << 8 | raw[k + 1]) + 1
        k += 2 + far
        if back > len(out) or len(out) + n > most:
            break
        for _ in range(n):
            out.append(out[-back])
    return bytes(out)
