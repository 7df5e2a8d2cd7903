"""Phone numbers of the North American plan, and keys of reporters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Area codes that are toll-free, and that cost extra.
TOLL_FREE = ["800", "833", "844", "855", "866", "877", "888"]
PREMIUM = ["900"]


def phone(raw: Column) -> Column:
    """struct(e164, national, kind, valid) of a number of the North American plan: ten digits, or eleven after a 1, in any writing; nulls and false for others.

    Area and exchange codes begin with 2 to 9 and don't end in 11. kind: toll_free, premium or fixed_or_mobile.
    """
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\D", "")
    ten = F.when(F.length(digits) == 10, digits).when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10))
    written = ~F.coalesce(raw, F.lit("")).rlike(r"^\s*\+(?!1)") & ~F.coalesce(raw, F.lit("")).rlike("[A-Za-z]")
    valid = F.coalesce(written & ten.rlike(r"^[2-9](?!11)\d{2}[2-9](?!11)\d{6}$"), F.lit(False))
    area = F.substring(ten, 1, 3)
    kind = F.when(area.isin(TOLL_FREE), "toll_free").when(area.isin(PREMIUM), "premium").otherwise("fixed_or_mobile")
    national = F.concat(F.lit("("), area, F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4))
    return F.struct(F.when(valid, F.concat(F.lit("+1"), ten)).alias("e164"), F.when(valid, national).alias("national"), F.when(valid, kind).alias("kind"), valid.alias("valid"))


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """The keyed hash of a text, 64 hexadecimal digits, in built-in functions alone."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def reporter_key(owner: Column, secret: bytes, purpose: str) -> Column:
    """48 digits that stand for a reporter: the same for one owner, of no use without the secret."""
    return F.substring(hmac_sha256(F.concat_ws("|", owner, F.lit(purpose)), secret), 1, 48)
