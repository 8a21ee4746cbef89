"""The seeded 64-bit xxHash of short decimal texts as plain SQL, for checking filters bit by bit."""

from __future__ import annotations

from .functions.hashing import P1, P2, P3, P5

TWO64 = "18446744073709551616::UHUGEINT"


def _n(x: int) -> str:
    return f"{x}::UHUGEINT"


def _mul(a: str, b: int) -> str:
    return f"((({a}) * {_n(b)}) % {TWO64})"


def _rot(a: str, by: int) -> str:
    return f"((({a}) * {_n(1 << by)}) % {TWO64} + ({a}) // {_n(1 << (64 - by))})"


def _byte(t: str, i: int) -> str:
    return f"ascii(substr({t}, {i}, 1))::UHUGEINT"


def hashes(name: str, source: str, seeds: list[int]) -> str:
    """CTEs that end in ``name``(t, s0, s1, ...): the hashes of each distinct ``t`` of ``source`` (at most 7 digits)."""
    four = " + ".join(f"{_byte('t', i + 1)} * {_n(256**i)}" for i in range(4))
    out = [
        f"{name}_a AS (SELECT t, seed, (seed::UHUGEINT + {_n(P5)} + length(t)::UHUGEINT) % {TWO64} AS h "
        f"FROM (SELECT DISTINCT t FROM {source}) CROSS JOIN (SELECT unnest([{', '.join(map(str, seeds))}]) AS seed))",
        f"{name}_b AS (SELECT t, seed, CASE WHEN length(t) >= 4 THEN xor(h, {_mul(four, P1)}) ELSE h END AS h, "
        f"CASE WHEN length(t) >= 4 THEN substr(t, 5) ELSE t END AS r FROM {name}_a)",
        f"{name}_c0 AS (SELECT t, seed, r, CASE WHEN length(t) >= 4 THEN ({_mul(_rot('h', 23), P2)} + {_n(P3)}) % {TWO64} ELSE h END AS h FROM {name}_b)",
    ]
    for i in range(3):
        mixed = f"xor(h, {_mul(_byte('r', i + 1), P5)})"
        out.append(f"{name}_x{i} AS (SELECT t, seed, r, h, CASE WHEN length(r) > {i} THEN {mixed} ELSE h END AS x FROM {name}_c{i})")
        out.append(f"{name}_c{i + 1} AS (SELECT t, seed, r, CASE WHEN length(r) > {i} THEN {_mul(_rot('x', 11), P1)} ELSE h END AS h FROM {name}_x{i})")
    out += [
        f"{name}_d AS (SELECT t, seed, {_mul(f'xor(h, h // {_n(1 << 33)})', P2)} AS h FROM {name}_c3)",
        f"{name}_e AS (SELECT t, seed, {_mul(f'xor(h, h // {_n(1 << 29)})', P3)} AS h FROM {name}_d)",
        f"{name}_f AS (SELECT t, seed, xor(h, h // {_n(1 << 32)}) AS h FROM {name}_e)",
    ]
    cols = ", ".join(f"max(h) FILTER (WHERE seed = {s}) AS s{i}" for i, s in enumerate(seeds))
    out.append(f"{name} AS (SELECT t, {cols} FROM {name}_f GROUP BY t)")
    return ",\n".join(out)
