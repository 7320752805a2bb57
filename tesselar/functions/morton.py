"""Bit-level column functions on BIGINT: Morton codes, radix digits, voxel keys and their hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shifts and masks that spread 10 bits over 30.
SPREAD = ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249))
MASK32 = 0xFFFFFFFF
#: Fixed value: the multiplier of the voxel hash.
HASH_FACTOR = 0x45D9F3B


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def spread(v: Column) -> Column:
    for shift, mask in SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(_long(mask))
    return v


def compact(v: Column) -> Column:
    v = v.bitwiseAND(_long(SPREAD[-1][1]))
    for (shift, _), mask in zip(SPREAD[::-1], (0x030C30C3, 0x0300F00F, 0x030000FF, 0x3FF)):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(_long(mask))
    return v


def quantise(v: Column) -> Column:
    """[0, 1] to 0..1023 by truncation, clamped."""
    return F.floor(F.least(F.greatest(v * 1024.0, F.lit(0.0)), F.lit(1023.0))).cast("long")


def interleave(x: Column, y: Column, z: Column) -> Column:
    """30-bit code; x is most significant."""
    return F.shiftleft(spread(x), 2).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(spread(z))


def digit(code: Column, at: int) -> Column:
    """The 4-bit digit number ``at``."""
    return F.shiftright(code, 4 * at).bitwiseAND(_long(15))


def voxel_coord(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def pack_key(kx: Column, ky: Column, kz: Column) -> Column:
    """Ten bits an axis, offset by 512: coordinates 1024 apart share a key."""
    a, b, c = ((k + 512).bitwiseAND(_long(1023)) for k in (kx, ky, kz))
    return F.shiftleft(a, 20).bitwiseOR(F.shiftleft(b, 10)).bitwiseOR(c)


def unpack_key(key: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(key, s).bitwiseAND(_long(1023)) - 512 for s in (20, 10, 0))


def integer_hash(key: Column) -> Column:
    """Unsigned 32-bit mixing hash of a key of at most 30 bits, in BIGINT."""
    k = key.bitwiseXOR(F.shiftright(key, 16))
    k = (k * _long(HASH_FACTOR)).bitwiseAND(_long(MASK32))
    return k.bitwiseXOR(F.shiftright(k, 16))


#: Masks that leave two zero bits between the bits of a number of up to 21 bits.
_WIDE = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def interleave20(*cells: Column) -> Column:
    """The 60-bit code of three cells of 20 bits."""
    out = []
    for c in cells:
        x = c.cast("long")
        for step, mask in _WIDE:
            x = x.bitwiseOR(F.shiftleft(x, step)).bitwiseAND(F.lit(mask).cast("long"))
        out.append(x)
    return F.shiftleft(out[0], 2).bitwiseOR(F.shiftleft(out[1], 1)).bitwiseOR(out[2])
