"""Tables written to the folder that the driver and all executors share, and column names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from barline.sources.scratch import discard, shared_dir, written

__all__ = ["discard", "fresh", "named", "shared_dir", "written"]


def named(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], *names: str) -> list[str]:
    """The given names, each with as many signs behind it as makes it none of ``taken``, in upper or lower case."""
    held, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
