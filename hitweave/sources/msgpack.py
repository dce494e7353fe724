"""A small MessagePack reader and writer for recorded blocks."""

from __future__ import annotations

import struct


def unpack(data: bytes, at: int = 0) -> tuple[object, int]:
    """The value at ``at`` and the position after it."""
    tag = data[at]
    at += 1
    if tag < 0x80:
        return tag, at
    if tag < 0x90:
        return _map(data, at, tag & 15)
    if tag < 0xA0:
        return _array(data, at, tag & 15)
    if tag < 0xC0:
        return data[at : at + (tag & 31)].decode(), at + (tag & 31)
    if tag >= 0xE0:
        return tag - 256, at
    if tag in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[tag], at
    sized = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I", 0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I"}
    numbers = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    if tag in numbers:
        return struct.unpack_from(numbers[tag], data, at)[0], at + struct.calcsize(numbers[tag])
    if tag not in sized:
        raise ValueError(f"unknown tag {tag:#x}")
    n = struct.unpack_from(sized[tag], data, at)[0]
    at += struct.calcsize(sized[tag])
    if tag in (0xDC, 0xDD):
        return _array(data, at, n)
    if tag in (0xDE, 0xDF):
        return _map(data, at, n)
    if at + n > len(data):
        raise ValueError("value runs past the end")
    return (data[at : at + n] if tag <= 0xC6 else data[at : at + n].decode()), at + n


def _array(data: bytes, at: int, n: int) -> tuple[list, int]:
    out = []
    for _ in range(n):
        value, at = unpack(data, at)
        out.append(value)
    return out, at


def _map(data: bytes, at: int, n: int) -> tuple[dict, int]:
    out = {}
    for _ in range(n):
        key, at = unpack(data, at)
        out[key], at = unpack(data, at)
    return out, at


def pack(value: object) -> bytes:
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if 0 <= value < 128:
            return bytes([value])
        return b"\xcf" + struct.pack(">Q", value) if value >= 0 else b"\xd3" + struct.pack(">q", value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        return b"\xdb" + struct.pack(">I", len(value.encode())) + value.encode()
    if isinstance(value, bytes):
        return b"\xc6" + struct.pack(">I", len(value)) + value
    if isinstance(value, dict):
        return b"\xdf" + struct.pack(">I", len(value)) + b"".join(pack(k) + pack(v) for k, v in value.items())
    return b"\xdd" + struct.pack(">I", len(value)) + b"".join(map(pack, value))
