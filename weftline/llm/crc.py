"""CRC-32 as DuckDB SQL, for the SQL forms of operators that use it."""

#: A common table expression with the 256 remainders of single bytes.
CRC_TABLE = "tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t)"


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of the UTF-8 bytes of a text expression that is not empty; CRC_TABLE's row must be in scope."""
    digits = f"hex(encode({text}))"
    some = f"list_transform(range(1, length({digits}) + 1, 2), lambda i: ('0x' || substr({digits}, i::INT, 2))::BIGINT)"
    return f"xor(list_reduce({some}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)"
