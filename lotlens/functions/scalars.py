"""Scalar functions as Columns over built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(text: Column) -> Column:
    """Digits of a text as bigint; none: null."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("bigint")


def trim_all(text: Column) -> Column:
    """Without any white space at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_handle(text: Column) -> Column:
    """Without leading at signs and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(text, "^@+", ""), "/+$", "")


def local_part(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def zero_padded(n: Column, width: int = 6) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def thousands(n: Column, separator: str = ",") -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(separator))


def uk_number(n: Column, unit: str = "") -> Column:
    """Thousands set apart by no-break spaces, and a unit after a plain one."""
    text = thousands(n, "\u00a0")
    return F.concat(text, F.lit(f" {unit}")) if unit else text


def without_prefix(text: Column, prefix: str) -> Column:
    """Without the prefix where the text starts with it; only once."""
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def in_ukrainian_order(text: Column) -> Column:
    """The text with Ukrainian collation: sorts and comparisons follow its alphabet, upper and lower case together."""
    return F.collate(text, "uk")


def initials(name: Column) -> Column:
    """No words: a question mark; one: its first two letters; else first letters of the first and last; upper case."""
    words = F.filter(F.split(trim_all(name), r"\s+"), lambda w: w != "")
    first, last = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(-1))
    return F.when(F.size(words) < 1, "?").when(F.size(words) == 1, F.upper(F.substring(first, 1, 2))).otherwise(F.upper(F.concat(F.substring(first, 1, 1), F.substring(last, 1, 1))))


def colour_bucket(name: Column, colours: int = 8) -> Column:
    """Rolling sum of characters' first UTF-16 units, modulo the number of colours."""
    unit = lambda c: F.when(F.ascii(c) > 0xFFFF, 0xD800 + F.shiftright(F.ascii(c) - 0x10000, 10)).otherwise(F.ascii(c))
    return F.aggregate(F.filter(F.split(trim_all(name), ""), lambda c: c != ""), F.lit(0), lambda h, c: (h + unit(c)) % colours)


def relative_age(then: Column, now: Column) -> Column:
    """minutes, hours or days gone by, floored: ``59 m``, ``23 h``, ``2 d``."""
    m = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 60_000_000)
    h = F.floor(m / 60)
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(" m"))).when(h < 24, F.concat(h.cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(h / 24).cast("string"), F.lit(" d")))


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5)


def percent(part: Column, whole: Column) -> Column:
    """Rounded share; 0 of nothing."""
    return F.when(whole != 0, half_up(part / whole * 100)).otherwise(F.lit(0)).cast("bigint")


def round_exact(x: Column, digits: int = 0) -> Column:
    """A double rounded on its exact binary value, exact halves to the even digit: 2.675 is below the half and gives 2.67, 0.125 gives 0.12.

    The double is a whole number m of steps of 2 ** -k; m * 10 ** digits is divided by 2 ** k in whole decimals, so nothing is lost on the
    way. Null, NaN, infinities and doubles without a fraction stay as they are. digits: 0 to 10.
    """
    if not 0 <= digits <= 10:
        raise ValueError("digits must be 0 to 10")
    whole = "decimal(38,0)"
    size = F.abs(x)
    k = F.lit(53) - F.floor(F.log2(size)).cast("int")
    m = (size * F.pow(F.lit(2.0), k)).cast("bigint").cast(whole)
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n).cast("decimal(19,0)")
    half = F.floor(k / 2).cast("int")
    steps = (power(half) * power(k - half)).cast(whole)
    parts = (m * F.lit(10**digits).cast("decimal(11,0)")).cast(whole)
    rest = (parts % steps).cast(whole)
    down = ((parts - rest) / steps).cast(whole)
    twice = (rest * F.lit(2).cast("decimal(1,0)")).cast(whole)
    up = (twice > steps) | ((twice == steps) & (down % 2 == 1))
    value = F.concat((down + F.when(up, 1).otherwise(0)).cast(whole).cast("string"), F.lit(f"E-{digits}")).cast("double")
    tiny = size < F.lit(10.0 ** -(digits + 1))
    return F.when(F.isnan(x) | (size >= F.lit(2.0**52)) | (size == 0), x).when(tiny, F.lit(0.0) * F.signum(x)).otherwise(value * F.signum(x))


def guarded_ratio(part: Column, count: Column, digits: int = 2) -> Column:
    """part / count, a count of 0 standing for 1, rounded on its exact value."""
    return round_exact((part / F.greatest(count, F.lit(1))).cast("double"), digits)


def pages(total: Column, per_page: int) -> Column:
    return F.ceil(total / per_page).cast("bigint")


def label(code: Column, labels: dict[str, str]) -> Column:
    """A code's label, or the code itself."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(pairs, code), code)


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def toggled(values: Column, value: Column) -> Column:
    """Without the value if it was there, else with it at the end."""
    return F.when(F.array_contains(values, value), F.array_remove(values, value)).otherwise(F.array_append(values, value))


def csv_cell(text: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line break; null is empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def xml_text(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def safe_filename(text: Column) -> Column:
    """Runs of other characters than letters, digits, _ and - become _; at most 80; ``export`` for nothing."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(text, r"[^A-Za-z0-9_Ѐ-ӿ\-]+", "_"), 1, 80), F.lit("")), F.lit("export"))


def _kept(encoded: Column, chars: str) -> Column:
    for c in chars:
        encoded = F.replace(encoded, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return encoded


def uri_component(text: Column) -> Column:
    """Percent-encoded as browsers encode a component: spaces as %20; letters, digits and -_.!~*'() stay."""
    return _kept(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), "!~'()")


def uri_quoted(text: Column) -> Column:
    """Percent-encoded as servers quote a value: letters, digits and -_.~ stay."""
    return F.replace(_kept(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), "~"), F.lit("*"), F.lit("%2A"))


def media_type(path: Column, types: dict[str, str], other: str = "image/jpeg") -> Column:
    out = F.lit(other)
    for ending, kind in types.items():
        out = F.when(F.endswith(F.lower(path), F.lit("." + ending)), kind).otherwise(out)
    return out


def card_price(price: Column, currency: Column | str = "UAH") -> Column:
    """A price as a message card shows it: thousands set apart by spaces, then the currency."""
    return F.concat(thousands(price, " "), F.lit(" "), F.lit(currency) if isinstance(currency, str) else currency)


def listing_line(year: Column, *more: Column) -> Column:
    """The parts of a listing's short line that are there, year first."""
    return F.concat_ws(" · ", year.cast("string"), *more)


def six_cells(code: Column) -> Column:
    """The digits of a typed code in six cells, filled up with spaces."""
    return F.rpad(F.substring(F.regexp_replace(code, "[^0-9]", ""), 1, 6), 6, " ")


def masked_email(email: Column, placeholder: str) -> Column:
    return F.when(F.endswith(email, F.lit(placeholder)), "").otherwise(email)


def avatar_path(connected: Column, picture: Column, path: str = "/auth/me/avatar") -> Column:
    """Where a user's picture is served: null unless the account is connected and has one."""
    return F.when(F.coalesce(connected, F.lit(False)) & (F.coalesce(picture, F.lit("")) != ""), path)


def json_get(text: Column, path: list[str | int], kind: str, default: Column | None = None) -> Column:
    """A nested value of a JSON text by names and positions, as ``kind``; ``default`` where a step is missing or null, or text or type don't fit. A name has one kind of quotes at most."""
    quote = lambda p: f'["{p}"]' if "'" in p else f"['{p}']"
    where = "$" + "".join(f"[{p}]" if isinstance(p, int) else quote(p) for p in path)
    found = F.try_variant_get(F.try_parse_json(text), where, kind)
    return found if default is None else F.coalesce(found, default)
