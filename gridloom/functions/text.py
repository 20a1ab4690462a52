"""Text functions as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All code points that Python takes for white space.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
#: Letters and digits with apostrophes inside; an underscore separates.
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
_PIECE = WORD + r"[^\p{L}\p{N}]*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: the optimiser copies a
    column into each place of a lambda that uses it, and there it would be
    computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}|{SPACE}$", "")


def clean(c: Column) -> Column:
    """One space for each run of white space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), SPACE, " "))



def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD))


def pieces(c: Column) -> Column:
    """Each word with what follows it up to the next one."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_PIECE), F.lit(0))


def clean_path(path: Column) -> Column:
    """Cleaned headings without blank ones; null is an empty path."""
    return F.filter(F.transform(F.coalesce(path, F.array().cast("array<string>")), clean), lambda x: x != "")


def starts_with_path(path: Column, prefix: Column) -> Column:
    return F.slice(path, 1, F.size(prefix)) == prefix


def render_row(headers: Column, row: Column) -> Column:
    """``header = value`` for each value that isn't blank, then a full stop; blank rows are empty."""
    pairs = F.zip_with(headers, row, lambda h, v: F.when(h.isNotNull() & (clean(v) != ""), F.concat(h, F.lit(" = "), clean(v))))
    text = F.array_join(F.filter(pairs, lambda x: x.isNotNull()), "; ")
    return F.when(text != "", F.concat(text, F.lit("."))).otherwise(F.lit(""))


def render_prefix(path: Column) -> Column:
    return F.array_join(clean_path(path), " > ")


def render_block(type_: Column, text: Column, path: Column, caption: Column, headers: Column, rows: Column) -> Column:
    """A block as text: heading path, then text; or caption and rows."""
    prefix = render_prefix(path)
    shown = clean(caption)
    shown = F.when((shown != prefix) & ~F.array_contains(F.transform(F.coalesce(path, F.array().cast("array<string>")), clean), shown), shown).otherwise(F.lit(""))
    lines = F.concat(F.array(prefix, shown), F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: render_row(headers, r)))
    table = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    plain = F.concat_ws("\n", F.nullif(prefix, F.lit("")), F.nullif(clean(text), F.lit("")))
    return F.when(type_ == "table", table).otherwise(plain)



def join_wrapped(c: Column) -> Column:
    """The lines of a text with a space between them, or nothing after a hyphen,
    which goes; blank lines at the start are left out.  As ``layout.join_wrapped``:
    where a blank line follows, the hyphen before the one that went may go too."""
    c = F.coalesce(c, F.lit(""))
    count = lambda x, y: F.length(x) - F.length(F.replace(x, F.lit(y), F.lit("")))
    times = F.transform(F.regexp_extract_all(c, F.lit(r"-[-\n]*\n"), F.lit(0)), lambda x: F.least(count(x, "-"), count(x, "\n")))
    joined = F.aggregate(F.sequence(F.lit(1), F.coalesce(F.array_max(times), F.lit(1))), c, lambda x, _: F.replace(x, F.lit("-\n"), F.lit("")))
    return F.translate(F.regexp_replace(joined, r"^\n+", ""), "\n", " ")


def fold(c: Column) -> Column:
    """Lower-case ASCII words: Latin letters lose their marks, other letters go."""
    marked = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿŐőŰűĀāĂăĄąĆćČčĎďĒēĘęĚěĞğĪīŁłŃńŇňŌōŔŕŘřŚśŞşŠšŤťŪūŮůŹźŻżŽž"
    plain = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyOoUuAaAaAaCcCcDdEeEeEeGgIi\0\0NnNnOoRrRrSsSsSsTtUuUuZzZzZz"
    ascii_ = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), marked, plain), r"[^\x01-\x7f]|\x00", "")
    return F.array_join(F.regexp_extract_all(F.lower(ascii_), F.lit("[a-z0-9]+"), F.lit(0)), " ")
