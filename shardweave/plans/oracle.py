"""SQL fragments shared by the oracle statements."""

from __future__ import annotations


def _word(text: str, pos: str) -> str:
    at = [f"coalesce(nullif(ascii(substr({text}, {pos} + {j}, 1)), 0), 0)::BIGINT" for j in range(1, 5)]
    return f"({at[0]} + {at[1]} * 256 + {at[2]} * 65536 + {at[3]} * 16777216)"


def _rotl(x: str, bits: int) -> str:
    return f"((({x}) * {1 << bits}) % 4294967296 + ({x}) // {1 << (32 - bits)})"


def murmur3_sql(text: str) -> str:
    """MurmurHash3 x86-32, seed 0, of an ASCII text expression."""
    mul1 = "(w * -862048943) & 4294967295"
    words = (
        f"list_transform(list_transform(list_transform(range(0, length({text}) // 4 + 1), "
        f"lambda i: {_word(text, 'i * 4')}), "
        f"lambda w: {mul1}), "
        f"lambda w: ({_rotl('w', 15)} * 461845907) & 4294967295)"
    )
    body = (
        f"list_reduce(list_prepend(0::BIGINT, list_slice(w, 1, length({text}) // 4)), "
        f"lambda h, k: ({_rotl('xor(h, k)', 13)} * 5 + 3864292196) & 4294967295)"
    )
    steps = [
        f"SELECT xor(xor({body}, w[length({text}) // 4 + 1]), length({text})) AS h FROM (SELECT {words} AS w)",
        "SELECT (xor(h, h // 65536) * -2048144789) & 4294967295 AS h",
        "SELECT (xor(h, h // 8192) * -1028477387) & 4294967295 AS h",
        "SELECT xor(h, h // 65536)::BIGINT AS h",
    ]
    sql = steps[0]
    for step in steps[1:]:
        sql = f"{step} FROM ({sql})"
    return f"({sql})"


def fnv1a_sql(text: str) -> str:
    """32-bit FNV-1a of an ASCII text expression."""
    return (
        f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length({text}) + 1), "
        f"lambda i: ascii(substr({text}, i, 1))::BIGINT)), "
        f"lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
    )


def crc32_sql(text: str) -> str:
    """IEEE CRC-32 of an ASCII text expression, bit by bit."""
    bit = "lambda c, z: xor(c // 2, (c % 2) * 3988292384)"
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), "
        f"lambda i: ascii(substr({text}, i, 1))::BIGINT)), "
        f"lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), {bit})), 4294967295)"
    )


def quarter_shard_sql(h: str) -> str:
    """Shard under four equal hash ranges."""
    return f"('shard-' || ({h} // 1073741824))"


def round_sql(x: str, digits: int) -> str:
    return f"round({x}, {digits})"
