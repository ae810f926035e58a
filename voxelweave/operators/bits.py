"""Packed fields of point records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bits(c: Column, at: int, n: int) -> Column:
    return F.shiftright(c, at).bitwiseAND((1 << n) - 1)


def unpack_legacy(flags: Column) -> dict[str, Column]:
    """One byte: return 3 bits, returns 3, scan direction 1, edge of flight line 1."""
    return {"return_number": _bits(flags, 0, 3), "number_of_returns": _bits(flags, 3, 3), "scan_direction": _bits(flags, 6, 1), "edge_of_flight": _bits(flags, 7, 1)}


def pack_legacy(return_number: Column, number_of_returns: Column, scan_direction: Column, edge: Column) -> Column:
    return return_number.bitwiseAND(7).bitwiseOR(F.shiftleft(number_of_returns.bitwiseAND(7), 3)).bitwiseOR(F.shiftleft(scan_direction.bitwiseAND(1), 6)).bitwiseOR(F.shiftleft(edge.bitwiseAND(1), 7))


def unpack_extended(returns: Column, flags: Column) -> dict[str, Column]:
    """Two bytes: returns 4 + 4 bits; class flags 4, scanner channel 2, scan direction 1, edge of flight line 1."""
    return {
        "return_number": _bits(returns, 0, 4), "number_of_returns": _bits(returns, 4, 4), "class_flags": _bits(flags, 0, 4), "scanner_channel": _bits(flags, 4, 2),
        "scan_direction": _bits(flags, 6, 1), "edge_of_flight": _bits(flags, 7, 1),
    }
