"""The draws and keys of generation as SQL for another engine: xxHash64 over wide unsigned numbers, written out."""

from __future__ import annotations

from itertools import count

import xxhash

# The primes of xxHash64, and the seed that Spark's function starts from.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
START = 42
WIDE, MOD = "::UHUGEINT", 1 << 64
_names = count()


def times(a: str, c: int) -> str:
    return f"(({a}) * {c}{WIDE} % {MOD}{WIDE})"


def plus(a: str, c: int) -> str:
    return f"(({a} + {c % MOD}{WIDE}) % {MOD}{WIDE})"


def named(x: str, body) -> str:
    """body of a name for x, so that x is written once."""
    v = f"v{next(_names)}"
    return f"list_transform([{x}], lambda {v}: {body(v)})[1]"


def turned(x: str, k: int) -> str:
    return named(x, lambda v: f"(({v} * {1 << k}{WIDE} % {MOD}{WIDE}) + ({v} // {1 << (64 - k)}{WIDE}))")


def folded(x: str, k: int) -> str:
    return named(x, lambda v: f"xor({v}, {v} // {1 << k}{WIDE})")


def finished(x: str) -> str:
    return folded(times(folded(times(folded(x, 33), P2), 29), P3), 32)


def of_long(value: str, seed: str) -> str:
    """The hash of a bigint that isn't negative, from the hash before it."""
    own = times(turned(times(f"({value}){WIDE}", P2), 31), P1)
    return finished(plus(times(turned(f"xor({plus(seed, P5 + 8)}, {own})", 27), P1), P4))


def of_int(value: int, seed: str) -> str:
    return finished(plus(times(turned(f"xor({plus(seed, P5 + 4)}, {value * P1 % MOD}{WIDE})", 23), P2), P3))


def of_constants(*parts: str | int, start: int = START) -> int:
    for p in parts:
        start = xxhash.xxh64_intdigest(p.to_bytes(4, "little") if isinstance(p, int) else p.encode(), start)
    return start


def uniform(seed, table: str, field: str, index: str, draw: int = 0, *more: str) -> str:
    """hashing.uniform() of a row's index (and further indices)."""
    out = f"{of_constants(str(seed), table, field)}{WIDE}"
    for x in (index, *more):
        out = of_long(x, out)
    return f"(({of_int(draw, out)} % {1 << 53}{WIDE})::DOUBLE / {float(1 << 53)!r}::DOUBLE)"


def digits(seed, table: str, field: str, index: str) -> str:
    """hashing.hash_digits(): 32 hexadecimal digits."""
    own = [of_long(index, f"{of_constants(k, str(seed), table, field)}{WIDE}") for k in (1, 2)]
    return " || ".join(f"lpad(lower(to_hex(({x})::UBIGINT)), 16, '0')" for x in own)


def uuid(seed, table: str, field: str, index: str) -> str:
    return named(f"({digits(seed, table, field, index)})", lambda d: f"{d}[1:8] || '-' || {d}[9:12] || '-' || {d}[13:16] || '-' || {d}[17:20] || '-' || {d}[21:32]")


def pick(u: str, values: list) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + f"][floor({u} * {float(len(values))!r})::INT + 1]"
