"""Text expressions: pure column functions, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters outside printable ASCII that chemical text may hold.
ALLOWED = "·°±→↔≡′″ÅåΔδαβγμωΩ–—…‹›⋯×−⁻⁺⁰¹²³⁴⁵⁶⁷⁸⁹"
#: What stands for a character that was lost.
LOST = "[?]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def paragraphs(c: Column) -> Column:
    """Blank-line separated paragraphs, line breaks and runs of blanks made one blank."""
    parts = F.split(c, r"\n\s*\n")
    return F.transform(parts, lambda p: F.regexp_replace(F.replace(strip(p), F.lit("\n"), F.lit(" ")), r"\s{2,}", " "))


def unit_kind(c: Column) -> Column:
    """figure_caption, heading or paragraph, from the text alone; outer blanks don't count."""
    c = strip(c)
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(c, r"[^\p{Lu}]", ""))
    heading = (F.length(c) < 70) & ~c.rlike(r"[.,;]$") & (letters > 0) & (upper / F.nullif(letters, F.lit(0)) > 0.5)
    return F.when(c.rlike(r"^(Figure|Fig\.|FIGURE)\s*[0-9]"), "figure_caption").when(heading, "heading").otherwise("paragraph")


def ascii_tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; accents part tokens."""
    return F.transform(F.regexp_extract_all(c, F.lit("([a-zA-Z0-9]+)"), 1), F.lower)


def odd_characters(c: Column) -> Column:
    """Distinct characters that are neither printable ASCII, line feed, tab nor allowed, as first seen."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"([^\x20-\x7E\n\t{ALLOWED}])"), 1))


def repaired_controls(c: Column) -> Column:
    """Control characters that stand for a printed one are restored, all others become [?]."""
    c = F.replace(F.replace(c, F.lit("\x03bc"), F.lit("μ")), F.lit("\x7f"), F.lit("·"))
    return F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F]", "[?]")


def sanity_flags(label: Column, value: Column) -> Column:
    """Messages on a text: a lost character, and the first five odd characters with their code points."""
    odd = odd_characters(value)
    shown = F.array_join(F.transform(F.slice(odd, 1, 5), lambda x: F.format_string("U+%04X '%s'", F.ascii(x), x)), ", ")
    lost = F.when(value.contains(LOST), F.concat(label, F.lit(f": contains '{LOST}': a character was lost and masked")))
    strange = F.when(F.size(odd) > 0, F.concat(label, F.lit(": unexpected character(s) "), shown))
    return F.filter(F.array(lost, strange), lambda x: x.isNotNull())


def quoted_list(c: Column) -> Column:
    """An array of texts as ['a', 'b']."""
    return F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))


def joined_row(cells: Column) -> Column:
    """Cells of a table row, stripped, between bars; a null cell is empty."""
    return F.array_join(F.transform(cells, lambda x: F.coalesce(strip(x), F.lit(""))), " | ")


def joined_labels(c: Column) -> Column:
    """Labels in one string; null if there is none."""
    return F.nullif(F.array_join(c, ", "), F.lit(""))


def signed(c: Column) -> Column:
    """With a plus before it unless it has one."""
    return F.when(c.startswith("+"), c).otherwise(F.concat(F.lit("+"), c))


def shortest_number(c: Column) -> Column:
    """A number in at most six significant digits without trailing zeros, as %g gives it
    for magnitudes from 0.0001 up to a million."""
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.abs(F.nullif(c, F.lit(0.0)))))).cast("int")
    shown = F.concat_ws("", *[F.when(F.coalesce(digits, F.lit(0)) == k, F.format_string(f"%.{k}f", c)) for k in range(10)])
    return F.when(shown.contains("."), F.regexp_replace(shown, r"\.?0+$", "")).otherwise(shown)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys and nulls kept, of texts and numbers."""
    parts = [F.concat(F.lit(f'"{k}":'), F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")) for k, c in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def before_last(c: Column, marker: str) -> Column:
    """What stands before the last ``marker``; the whole text if it has none."""
    c = F.col(c) if isinstance(c, str) else c
    at = F.length(c) - F.length(F.substring_index(c, marker, -1))
    return F.when(c.contains(marker), F.substring(c, F.lit(1), (at - len(marker)).cast("int"))).otherwise(c)


def joined(c: Column, sep: str = "; ") -> Column:
    """Non-null elements of a list in one string."""
    return F.array_join(c, sep)


def formatted_pairs(symbols: Column, definitions: Column) -> Column:
    """'symbol = definition' entries; undefined ones say so; nothing gives null."""
    pair = F.arrays_zip(symbols.alias("s"), definitions.alias("d"))
    shown = F.transform(F.filter(pair, lambda p: p["s"].isNotNull()), lambda p: F.concat(p["s"], F.lit(" = "), F.coalesce(p["d"], F.lit("[NOT DEFINED IN EVIDENCE]"))))
    return F.nullif(F.array_join(shown, "; "), F.lit(""))


def content_hash(*cols: Column) -> Column:
    """First 16 hex digits of SHA-256 over the fields, nulls apart from texts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]), 256), 1, 16)


def sanitized(c: Column, kind: T.DataType) -> Column:
    """``c`` with repaired_controls applied to every text in it: strings, elements of
    arrays, values of maps and fields of structs, however deep."""
    if isinstance(kind, T.StringType):
        return repaired_controls(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: sanitized(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: sanitized(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[sanitized(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c
