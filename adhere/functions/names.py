"""Names, addresses, share codes and cleaned form input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import CODE_ALPHABET, CODE_LENGTH, UNKNOWN_PERSON

CODE_SPACE = len(CODE_ALPHABET) ** CODE_LENGTH


# What a form strips from both ends of its text.
PAGE_BLANKS = (" \t\n\u000b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
               "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")


def page_trim(text: Column) -> Column:
    return F.trim(text, F.lit(PAGE_BLANKS))


def owner_name(display_name: Column, username: Column) -> Column:
    return F.coalesce(display_name, username)


def person_label(display_name: Column, username: Column) -> Column:
    """Page form: an empty name counts as missing."""
    return F.coalesce(F.nullif(display_name, F.lit("")), F.nullif(username, F.lit("")),
                      F.lit(UNKNOWN_PERSON))


def email_for(username: Column, domain: str) -> Column:
    return F.concat(F.lower(page_trim(username)), F.lit(f"@{domain}"))


def username_of(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def json_field(document: Column, name: str) -> Column:
    return F.get_json_object(document, f"$.{name}")


def clean_code(code: Column) -> Column:
    return F.upper(page_trim(code))


def code_of_number(number: Column) -> Column:
    """Six characters of the code alphabet, most significant first."""
    base, alphabet = len(CODE_ALPHABET), F.lit(CODE_ALPHABET)
    digits = [F.floor(number / F.lit(base ** k)).cast("long") % base
              for k in reversed(range(CODE_LENGTH))]
    return F.concat(*[F.substr(alphabet, (d + 1).cast("int"), F.lit(1)) for d in digits])


def code_candidate(key: Column, attempt: int) -> Column:
    """The ``attempt``-th code for a key: 48 bits of a digest, folded."""
    text = F.concat(key.cast("string"), F.lit(f"#{attempt}"))
    number = F.conv(F.substr(F.md5(text.cast("binary")), F.lit(1), F.lit(12)), 16, 10)
    return code_of_number(number.cast("long") % CODE_SPACE)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
