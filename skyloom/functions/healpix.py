"""HEALPix centres in the nested scheme as Spark columns (Gorski et al. 2005): bit arithmetic inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of the finest pixels that 64-bit numbers hold.
FINEST = 29
#: Fixed by the scheme: ring and longitude of the twelve base pixels, in halves of their size.
RING = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
LONGITUDE = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)
#: Every second bit, and the masks that close the gaps between them.
MASKS = (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF, 0x0000FFFF0000FFFF, 0x00000000FFFFFFFF)


def even_bits(v: Column) -> Column:
    """The number that the even bits of ``v`` make."""
    v = v.bitwiseAND(F.lit(MASKS[0]))
    for k, mask in enumerate(MASKS[1:]):
        v = v.bitwiseOR(F.shiftrightunsigned(v, 1 << k)).bitwiseAND(F.lit(mask))
    return v


def center(pixel: Column, order: int) -> tuple[Column, Column]:
    """(ra, dec) in radians of the centre of a nested pixel."""
    if not 0 <= order <= FINEST:
        raise ValueError(f"order out of range [0, {FINEST}]")
    side = 1 << order
    pixel = pixel.cast("long")
    face = F.shiftright(pixel, 2 * order).cast("int")
    inside = pixel.bitwiseAND(F.lit(side * side - 1).cast("long"))
    x, y = even_bits(inside), even_bits(F.shiftrightunsigned(inside, 1))
    row = F.get(F.array(*map(F.lit, RING)), face).cast("long") * side - x - y - 1
    n = F.when(row < side, row).when(row > 3 * side, 4 * side - row).otherwise(F.lit(side).cast("long"))
    cap = n.cast("double") * n / (3.0 * side * side)  # 1 - |z| in the caps
    polar = F.asin(F.sqrt(cap * (2.0 - cap)))  # angle from the pole, exact where z is nearly 1
    polar = F.when(cap > 0.5, F.acos(1.0 - cap)).otherwise(polar)
    dec = (F.when(row < side, math.pi / 2 - polar).when(row > 3 * side, polar - math.pi / 2)
           .otherwise(F.asin((2 * side - row).cast("double") * (2.0 / (3.0 * side)))))
    step = F.get(F.array(*map(F.lit, LONGITUDE)), face).cast("long") * n + x - y
    step = F.when(step < 0, step + 8 * n).otherwise(step)
    return step.cast("double") * (math.pi / 4) / n, dec
