"""Pieces of SQL for the engine that the training-data queries are checked with."""


def _nibble_table():
    """Remainders of CRC-32 for the 16 values of half a byte."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


def crc32_sql(digits):
    """Unsigned CRC-32 of bytes, given by a column with their hexadecimal digits."""
    table = f"({_nibble_table()}::bigint[])"
    half = f"xor(c >> 4, {table}[(xor(c, x) & 15) + 1])"
    whole = f"xor({half} >> 4, {table}[(xor({half}, x >> 4) & 15) + 1])"
    values = f"list_transform(regexp_extract_all({digits}, '..'), lambda p: ('0x' || p)::bigint)"
    return (
        "xor(4294967295::bigint,"
        f" list_reduce(list_concat([4294967295::bigint], {values}), lambda c, x: {whole}))"
    )
