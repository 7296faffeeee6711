"""IP addresses as 128 bits, and lists of networks as an index of disjoint intervals; all in built-in expressions.

An IPv4 address is its IPv4-mapped IPv6 address, so both kinds share one order. The bits are two longs with the sign bit
turned, so that the signed order of (hi, lo) is the order of addresses.
"""

from __future__ import annotations

import ipaddress
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Intervals that an index holds at most: it travels inside the plan.
MOST = 65_536
_TURN = 1 << 63
_BYTE = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_QUAD = rf"{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}"
_BITS = "array<struct<hi:bigint,lo:bigint>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def plain_address(text: Column) -> Column:
    """Trimmed, lower case, without zone and brackets."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, r"^[\s\u0085 ]+|[\s\u0085 ]+$", "")), "%.*$", "")
    return F.regexp_replace(bare, r"^\[(.*)\]$", "$1")


def _folded(numbers: Column) -> Column:
    """Four 16-bit numbers as one long, the sign bit turned."""
    whole = F.aggregate(numbers, F.lit(0).cast("long"), lambda n, x: F.shiftleft(n, 16).bitwiseOR(x))
    return whole.bitwiseXOR(F.lit(-_TURN))


def address_bits(text: Column) -> Column:
    """struct(hi, lo) of an IPv4 or IPv6 address in text form, IPv4 as mapped; null for anything else. Zones and brackets are passed over."""

    def parsed(ip: Column) -> Column:
        quad = F.regexp_extract(ip, rf"(?:^|:)({_QUAD})$", 1)
        byte = lambda i: F.get(F.split(quad, r"\."), F.lit(i)).cast("int")
        two = F.concat(F.lower(F.hex(byte(0) * 256 + byte(1))), F.lit(":"), F.lower(F.hex(byte(2) * 256 + byte(3))))
        head = F.substring(ip, F.lit(1), F.length(ip) - F.length(quad))
        mapped = F.when(quad == "", ip).when(head == "", F.concat(F.lit("::ffff:"), two)).otherwise(F.concat(head, two))
        return _let(mapped, groups)

    def groups(v6: Column) -> Column:
        halves = F.split(v6, "::")
        side = lambda i: F.when(F.get(halves, F.lit(i)) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(halves, F.lit(i)), ":"))
        gap = F.lit(8) - F.size(side(0)) - F.size(side(1))
        filled = F.concat(side(0), F.array_repeat(F.lit("0"), gap), side(1))
        every = F.when((F.size(halves) == 2) & (gap >= 1), filled).when(F.size(halves) == 1, F.split(v6, ":"))
        return _let(every, numbers)

    def numbers(parts: Column) -> Column:
        good = (F.size(parts) == 8) & F.forall(parts, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        values = F.transform(parts, lambda g: F.conv(g, 16, 10).cast("long"))
        return F.when(good, F.struct(_folded(F.slice(values, 1, 4)).alias("hi"), _folded(F.slice(values, 5, 4)).alias("lo")))

    return _let(plain_address(text), parsed)


@dataclass(frozen=True)
class NetworkIndex:
    """Disjoint intervals of 128-bit numbers in ascending order."""

    intervals: tuple[tuple[int, int], ...]

    @staticmethod
    def of(networks: Iterable[str]) -> NetworkIndex:
        """The union of networks (address/length, host bits ignored; a bare address is a network of its own); touching ones are one interval."""
        spans = []
        for text in networks:
            n = ipaddress.ip_network(text.strip(), strict=False)
            base = 0xFFFF << 32 if n.version == 4 else 0
            spans.append((base + int(n.network_address), base + int(n.broadcast_address)))
        merged: list[tuple[int, int]] = []
        for low, high in sorted(spans):
            if merged and low <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        return NetworkIndex(tuple(merged))

    @staticmethod
    def of_table(networks: DataFrame, column: str, most: int = MOST) -> NetworkIndex:
        """The index of a table's networks; more than ``most`` different ones are an error, as the index travels in the plan."""
        rows = networks.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} networks")
        return NetworkIndex.of(r[0] for r in rows)

    def _ends(self, which: int) -> Column:
        pairs = [{"hi": (x[which] >> 64) - _TURN, "lo": (x[which] & (1 << 64) - 1) - _TURN} for x in self.intervals]
        return F.from_json(F.lit(json.dumps(pairs)), _BITS)

    def holds(self, bits: Column) -> Column:
        """Whether an address (``address_bits``) lies in one of the networks: a binary search for the last interval that starts at or before it. False for null."""
        if not self.intervals:
            return F.lit(False)
        steps = F.lit([1 << i for i in range(len(self.intervals).bit_length() - 1, -1, -1)])
        starts, ends = self._ends(0), self._ends(1)

        def search(x: Column) -> Column:
            further = lambda at, step: F.when((at + step <= len(self.intervals)) & (F.get(starts, at + step - 1) <= x), at + step).otherwise(at)
            return F.get(ends, F.aggregate(steps, F.lit(0), further) - 1) >= x

        return F.coalesce(_let(bits, search), F.lit(False))
