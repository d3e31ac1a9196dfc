"""Python's text of values: ``repr`` of numbers and strings, and what ``json.dumps`` and ``json.loads`` write and read.

All are expressions over one value. Texts are cut into tokens by patterns whose repeats never go back, so time and
stack stay linear in the text, however deep it nests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from venuematch.functions.once import bound

# A JSON string, its closing quote missing at the end of a broken text.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+'

# What stands for the numbers that JSON has no text for: an object with one field.
NO_NUMBER = "no JSON number"
_MARKED = rf'\{{"{NO_NUMBER}":"(-?[a-z]+)"\}}'


def float_text(number: Column) -> Column:
    """``repr`` of a double: plain from 0.0001 to below 1e16, otherwise with an exponent of two digits or more.

    The digits are the fewest, up to 17, that read back as the same number; those of the least numbers, below 1e-307, are
    the JVM's and may be one more.
    """
    return bound(number, lambda n: F.when(_is_plain(n), n.cast("string")).otherwise(_any_float_text(n)))


def _is_plain(number: Column) -> Column:
    """Whether the JVM's text is Python's: no exponent in either, and at most 15 digits, of which no two texts are the same
    number, so that none is shorter. A digit more is allowed for where the text has its sign, zero and dot."""
    size = F.abs(number)
    return ((size >= 0.001) & (size < 1e7) | (size == 0.0)) & (F.length(number.cast("string")) <= 16)


def _any_float_text(number: Column) -> Column:
    size = F.abs(number)
    written = [F.format_string(f"%.{n}e", size) for n in (14, 15, 16)]
    chosen = F.coalesce(*[F.when(text.try_cast("double") == size, text) for text in written[:-1]], written[-1])
    return bound(chosen, lambda scientific: _decimal_text(number, scientific))


def _decimal_text(number: Column, scientific: Column) -> Column:
    """The number from its digits and power as Java writes them with an exponent."""
    power = F.substring_index(scientific, "e", -1).try_cast("int")
    digits = F.regexp_replace(F.replace(F.substring_index(scientific, "e", 1), F.lit(".")), r"(?<=[0-9])0+$", "")
    padded = F.rpad(digits, F.greatest(power + 1, F.length(digits)), "0")
    fraction = F.substring(padded, power + 2, F.length(padded))
    whole = F.concat(F.substring(padded, F.lit(1), power + 1), F.lit("."), F.when(fraction == "", "0").otherwise(fraction))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    rest = F.substring(digits, F.lit(2), F.length(digits))
    shown = F.concat(
        F.substring(digits, 1, 1),
        F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)),
        F.lit("e"),
        F.substring_index(scientific, "e", -1),
    )
    text = F.when((power >= 0) & (power < 16), whole).when((power < 0) & (power >= -4), small).otherwise(shown)
    signed = F.concat(F.when(number.cast("string").startswith("-"), "-").otherwise(""), text)
    return (
        F.when(F.isnan(number), "nan")
        .when(number == float("inf"), "inf")
        .when(number == -float("inf"), "-inf")
        .when(number.isNotNull(), signed)
    )


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def _each_sign(text: Column, pattern: str, shown) -> Column:
    """The text with each sign that fits a pattern shown by its number; the text itself where there is none."""
    signs = F.regexp_extract_all(text, F.lit(r"(?s)."), F.lit(0))
    told = F.transform(signs, lambda c: F.when(c.rlike(f"^{pattern}$"), shown(F.ascii(c))).otherwise(c))
    return F.when(text.rlike(pattern), F.array_join(told, "")).otherwise(text)


def _hex(number: Column, length: int) -> Column:
    return F.lpad(F.lower(F.hex(number)), length, "0")


def json_string(text: Column) -> Column:
    """A JSON string as ``json.dumps(..., ensure_ascii=False)`` writes it; null for a null."""
    return bound(text, lambda t: F.when(t.rlike(r'[\x00-\x1f"\\]'), _escaped(t)).otherwise(F.concat(F.lit('"'), t, F.lit('"'))))


def _escaped(text: Column) -> Column:
    named = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
    body = _each_sign(_replaced(text, named), r"[\x00-\x1f]", lambda n: F.concat(F.lit("\\u"), _hex(n, 4)))
    return F.concat(F.lit('"'), body, F.lit('"'))


def string_repr(text: Column) -> Column:
    """``repr`` of a string: single quotes unless it has some and no double ones, and signs that can't be shown escaped."""
    quote = F.when(text.contains("'") & ~text.contains('"'), '"').otherwise("'")
    escaped = _replaced(text, [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")])
    quoted = F.when(quote == "'", F.replace(escaped, F.lit("'"), F.lit("\\'"))).otherwise(escaped)

    def told(n: Column) -> Column:
        return (
            F.when(n < 256, F.concat(F.lit("\\x"), _hex(n, 2)))
            .when(n < 65536, F.concat(F.lit("\\u"), _hex(n, 4)))
            .otherwise(F.concat(F.lit("\\U"), _hex(n, 8)))
        )

    body = _each_sign(quoted, r"[\p{C}\p{Z}&&[^ ]]", told)
    return F.concat(quote, body, quote)


def value_text(json_text: Column) -> Column:
    """``str()`` of what Python reads from the JSON text of a list or an object, token by token, to any depth.

    A key that is repeated in one object is shown each time.
    """
    tokens = F.regexp_extract_all(json_text, F.lit(rf'(?s){_MARKED}|{_STRING}"|[\[\]{{}}:,]|[^\s"\[\]{{}}:,]+'), F.lit(0))

    def shown(token: Column) -> Column:
        return (
            F.when(token.startswith("{") & (token != "{"), F.regexp_extract(token, _MARKED, 1))
            .when(token.startswith('"'), string_repr(F.try_variant_get(F.try_parse_json(token), "$", "string")))
            .when(token.isin(",", ":"), F.concat(token, F.lit(" ")))
            .when(token.isin("true", "false"), F.initcap(token))
            .when(token == "null", "None")
            .when(token == "-0", "0")
            .when(token.rlike(r"^-?[0-9]*[.eE]|^-?[0-9]+[eE]"), float_text(token.try_cast("double")))
            .otherwise(token)
        )

    return F.array_join(F.transform(tokens, shown), "")


def marker(text: str) -> str:
    return f'{{"{NO_NUMBER}":"{text}"}}'


def readable_json(text: Column) -> Column:
    """The text with markers for bare ``NaN``, ``Infinity`` and ``-Infinity`` outside strings, which Python's reader
    takes too. Strings and what is between them are told apart from the start of the text on."""
    parts = F.regexp_extract_all(text, F.lit(rf'(?s){_STRING}"?|[^"]+'), F.lit(0))

    def rewritten(part: Column) -> Column:
        for name, number in [("NaN", "nan"), ("-Infinity", "-inf"), ("Infinity", "inf")]:
            part = F.regexp_replace(part, rf"(?<![\w.+-]){name}\b", marker(number))
        return part

    told = F.transform(parts, lambda part: F.when(part.startswith('"'), part).otherwise(rewritten(part)))
    return F.when(text.rlike("NaN|Infinity"), F.array_join(told, "")).otherwise(text)


MARKERS = [marker(number) for number in ("nan", "inf", "-inf")]
