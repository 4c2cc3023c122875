"""Legacy text encodings with ordered fallback, for worker code and the driver."""

from __future__ import annotations

import codecs

#: Language-driver bytes and their Python codecs, from the public table-format description.
LANGUAGE_DRIVERS = {
    0x01: "cp437", 0x02: "cp850", 0x03: "cp1252", 0x04: "mac_roman", 0x08: "cp865", 0x09: "cp437", 0x0A: "cp850", 0x0B: "cp437", 0x0D: "cp437",
    0x0E: "cp850", 0x0F: "cp437", 0x10: "cp850", 0x11: "cp437", 0x12: "cp850", 0x13: "cp932", 0x14: "cp850", 0x15: "cp437", 0x16: "cp850",
    0x17: "cp865", 0x18: "cp437", 0x19: "cp437", 0x1A: "cp850", 0x1B: "cp437", 0x1C: "cp863", 0x1D: "cp850", 0x1F: "cp852", 0x22: "cp852",
    0x23: "cp852", 0x24: "cp860", 0x25: "cp850", 0x26: "cp866", 0x37: "cp850", 0x40: "cp852", 0x4D: "cp936", 0x4E: "cp949", 0x4F: "cp950",
    0x50: "cp874", 0x57: "cp1252", 0x58: "cp1252", 0x59: "cp1252", 0x64: "cp852", 0x65: "cp866", 0x66: "cp865", 0x67: "cp861", 0x6A: "cp737",
    0x6B: "cp857", 0x78: "cp950", 0x79: "cp949", 0x7A: "cp936", 0x7B: "cp932", 0x7C: "cp874", 0x7D: "cp1255", 0x7E: "cp1256", 0x96: "mac_cyrillic",
    0x97: "mac_latin2", 0x98: "mac_greek", 0xC8: "cp1250", 0xC9: "cp1251", 0xCA: "cp1254", 0xCB: "cp1253", 0xCC: "cp1257",
}
#: What is tried after a table's own encoding.
FALLBACKS = ("cp1250", "cp852", "mazovia", "piast")
#: Letters of the Mazovia table at 0x80-0x9F, and where it differs from windows-1250 above.
_MAZOVIA_LETTERS = "ąąćęłńóśźżŻŹćńóŚÓąęłńóśźżŻŹćńóŚÓ"
_MAZOVIA_ABOVE = {0xA1: "Ą", 0xA5: "Ľ", 0xA6: "Ś", 0xAE: "Ž", 0xB1: "ą", 0xB5: "ľ", 0xB6: "ś", 0xB7: "ˇ", 0xB9: "š", 0xBE: "ž"}


def _mazovia_table() -> str:
    low = "".join(map(chr, range(0x80)))
    high = "".join(_MAZOVIA_ABOVE.get(n, bytes([n]).decode("cp1250")) for n in range(0xA0, 0x100))
    return low + _MAZOVIA_LETTERS + high


def register() -> None:
    """Makes mazovia, piast and pki known to Python's codecs, once in a process."""
    try:
        codecs.lookup("mazovia")
        return
    except LookupError:
        pass
    table = _mazovia_table()
    places = {ord(c): n for n, c in enumerate(table)}

    def encode(text: str, errors: str = "strict") -> tuple[bytes, int]:
        return codecs.charmap_encode(text, errors, places)

    def decode(data: bytes, errors: str = "strict") -> tuple[str, int]:
        return codecs.charmap_decode(bytes(data), errors, table)

    def find(name: str) -> codecs.CodecInfo | None:
        return codecs.CodecInfo(encode, decode, name=name) if name in ("mazovia", "piast", "pki") else None

    codecs.register(find)


register()


def of_driver(byte: int) -> str:
    """Encoding of a language-driver byte; ascii if unknown."""
    return LANGUAGE_DRIVERS.get(byte, "ascii")


def attempts(primary: str) -> list[str]:
    return list(dict.fromkeys([primary, *FALLBACKS]))


def decode(data: bytes, primary: str, errors: str = "strict") -> tuple[str, bool]:
    """Text, and whether the primary encoding couldn't read it (its bytes should then be kept).

    Only strict decoding falls back; ignore and replace read by the primary alone.
    """
    register()
    if errors != "strict":
        return data.decode(primary, errors), False
    for place, name in enumerate(attempts(primary)):
        try:
            return data.decode(name), place > 0
        except UnicodeDecodeError:
            continue
    return data.decode(primary, "replace"), True


def encode(text: str, encodings: list[str]) -> bytes:
    """Bytes by the first encoding that has all the letters; raises if none has."""
    register()
    for name in encodings:
        try:
            return text.encode(name)
        except UnicodeEncodeError:
            continue
    raise ValueError(f"text fits none of {', '.join(encodings)}")
