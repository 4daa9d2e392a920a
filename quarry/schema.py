"""The constants that extraction, splitting and re-assembly share, and how operators name columns.

Operators add columns to those of their input.  An input column named like one that an
operator makes is replaced by it; names used inside an operator never meet the input's.
"""

from pyspark.sql import DataFrame

#: Stands between a chunk's titles and its content. Fixed value.
TITLE_SEPARATOR = "---###---"
NO_TITLE = "[no-title]"
NO_AUTHOR = "[no-author]"


def others(df: DataFrame, *made: str) -> list[str]:
    """The columns that stay as they are beside those that an operator makes, whatever their case."""
    taken = {c.lower() for c in made}
    return [f"`{c}`" for c in df.columns if c.lower() not in taken]


def free(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has, also in another case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
