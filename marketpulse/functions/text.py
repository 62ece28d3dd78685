"""String normalisation on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SOURCE = "Yahoo Finance"
#: The characters with Unicode's White_Space property.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def clean_headline(text: Column) -> Column:
    """Stripped, without the literal two-character sequence backslash + n."""
    return F.replace(strip(text), F.lit("\\n"), F.lit(""))


def footer_parts(footer: Column, default_source: str = DEFAULT_SOURCE) -> tuple[Column, Column]:
    """(source, relative time) of a 'source • time' footer.

    Without a footer the source is the default and the time is empty.
    """
    parts = F.split(strip(footer), "•")
    source = F.when(footer.isNull(), F.lit(default_source)).otherwise(strip(parts[0]))
    second = F.try_element_at(parts, F.lit(2))
    return source, F.coalesce(strip(second), F.lit(""))


def absolute_link(link: Column, root: str) -> Column:
    """Links that do not start with http get the site root in front."""
    return F.when(link.startswith("http"), link).otherwise(F.concat(F.lit(root), link))


def dot_link(link: Column, root: str) -> Column:
    """Links that start with a dot: drop the first character and put the root in front."""
    return F.concat(F.lit(root), F.substring(link, F.lit(2), F.length(link)))


def search_query(text: Column) -> Column:
    """Blanks become plus signs."""
    return F.replace(text, F.lit(" "), F.lit("+"))
