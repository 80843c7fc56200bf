"""Scalar functions over strings: entropy, lines, paths, digests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import let


def entropy_of(v: Column) -> Column:
    """Entropy of a value that costs nothing to refer to, such as a lambda variable."""
    def total(n: Column) -> Column:
        def add(acc: Column, ch: Column) -> Column:
            # How often the character occurs, from lengths in bytes: those are known without counting.
            times = (F.octet_length(v) - F.octet_length(F.replace(v, ch, F.lit("")))) / F.octet_length(ch)
            return let(times / n, lambda p: acc - p * F.log2(p))
        return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(F.array_distinct(F.split(v, "")), F.lit(0.0), add))
    return let(F.length(v), total)


def shannon_entropy(s: Column) -> Column:
    """Bits per character, 0 for the empty string; characters are summed in order of appearance."""
    return let(s, entropy_of)


def is_hex(s: Column) -> Column:
    return F.rlike(s, F.lit(r"\A[0-9a-fA-F]+\z"))


def entropy_threshold(s: Column, threshold: float) -> Column:
    return F.when(is_hex(s), F.lit(min(3.0, float(threshold)))).otherwise(F.lit(float(threshold)))


def line_number(text: Column, start: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.regexp_count(F.substring(text, F.lit(1), start), F.lit("\n")) + 1


def line_before(text: Column, start: Column) -> Column:
    return F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)


def line_after(text: Column, start: Column) -> Column:
    return F.substring_index(F.substring(text, start + 1, F.length(text)), "\n", 1)


def line_of(text: Column, start: Column) -> Column:
    return F.concat(line_before(text, start), line_after(text, start))


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(forward_slashes(path), "/", -1)


def fingerprint(value: Column, salt: Column | str) -> Column:
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.substring(F.sha2(F.concat(salt, F.lit(" "), value), 256), 1, 32)


def path_key(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def hmac_sha256_hex(message: Column, inner_pad: Column, outer_pad: Column) -> Column:
    """Upper-case hex HMAC-SHA256; the pads are the 64-byte key blocks, see ``key_pads``."""
    inner = F.unhex(F.sha2(F.concat(inner_pad, F.encode(message, "UTF-8")), 256))
    return F.upper(F.sha2(F.concat(outer_pad, inner), 256))


def key_pads(key: bytes) -> tuple[bytes, bytes]:
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def base64url_text(part: Column) -> Column:
    """Decoded text of a base64url part; NULL when it does not decode."""
    usable = F.length(part) - F.when(F.length(part) % 4 == 1, 1).otherwise(0)
    standard = F.substring(F.translate(part, "-_", "+/"), F.lit(1), usable)
    padding = F.repeat(F.lit("="), F.pmod(-usable, F.lit(4)).cast("int"))
    return F.make_valid_utf8(F.try_to_binary(F.concat(standard, padding), F.lit("base64")).cast("string"))


def strict_json(text: Column) -> Column:
    """Parsed value of a text that is one JSON value; NULL otherwise.

    The parser stops after the first value, so the text is parsed inside an array and inside an
    object: nothing but a single value is right in both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(member.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull(),
                  F.try_variant_get(listed, "$[0]", "variant"))


def is_real_jwt(token: Column) -> Column:
    """Header and payload decode to JSON objects and the header names a string ``alg``."""
    header = strict_json(base64url_text(F.split_part(token, F.lit("."), F.lit(1))))
    payload = strict_json(base64url_text(F.split_part(token, F.lit("."), F.lit(2))))
    return F.coalesce(
        F.rlike(token, F.lit(r"\A[^.]+\.[^.]+\.[^.]*\z"))
        & F.schema_of_variant(header).startswith("OBJECT")
        & F.schema_of_variant(payload).startswith("OBJECT")
        & (F.schema_of_variant(F.try_variant_get(header, "$.alg", "variant")) == "STRING"), F.lit(False))


def human_age(at: Column, now: Column) -> Column:
    """"42s ago" and so on, each unit rounded half up from the one before."""
    elapsed = F.unix_millis(now.cast("timestamp")) - F.unix_millis(at.cast("timestamp"))
    seconds = F.greatest(F.lit(0), F.floor(elapsed / 1000 + 0.5))
    minutes = F.floor(seconds / 60 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    return (F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago")))
            .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
            .when(hours < 48, F.concat(hours.cast("string"), F.lit("h ago")))
            .otherwise(F.concat(days.cast("string"), F.lit("d ago"))))
