"""Unsigned crc32 in DuckDB SQL, for the oracles."""

#: A common table expression with the table of one byte's steps.
CRC = """crc_steps AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS steps FROM range(256) t(i))"""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of ``text``'s UTF-8 bytes; ``steps`` of crc_steps must be at hand."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    return f"xor(list_reduce(list_transform(range(octet_length(encode({text}))), lambda i: {byte}), lambda c, b: xor(steps[xor(c, b) % 256 + 1], c // 256), 4294967295), 4294967295)"
