"""CRC-32 in SQL, for the control queries."""

from __future__ import annotations


def crc32_sql(ids: str) -> str:
    """Common table expressions that end in ``crcs`` (id, h): the unsigned CRC-32 of the decimal form of each ``id`` of ``ids``."""
    # 3988292384: the reversed polynomial of CRC-32, a fixed value
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END"
    start = "list_concat([4294967295::UBIGINT], list_transform(range(1, length(id::VARCHAR) + 1), lambda k: ascii(substr(id::VARCHAR, k, 1))::UBIGINT))"
    return f"""crc_table AS (SELECT list(list_reduce(list_concat([i::UBIGINT], range(8)::UBIGINT[]), lambda c, k: {step}) ORDER BY i) AS t FROM range(256) r(i)),
crcs AS (SELECT id, xor(list_reduce({start}, lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS h FROM {ids}, crc_table)"""
