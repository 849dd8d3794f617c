"""Parsing expressions: lenient numbers, range lists, sensor lists, paths, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_double(c: Column) -> Column:
    """A number, or NULL; the text "nan" counts as missing."""
    return F.nanvl(F.trim(c).try_cast("double"), F.lit(None).cast("double"))


def lenient_int(c: Column) -> Column:
    """Whole part of a number written any way ("12", "12.0", "1.2e1"), or NULL."""
    return lenient_double(c).try_cast("bigint")


def parse_int(c: Column, default: int = -1) -> Column:
    return F.coalesce(lenient_int(c), F.lit(default))


def parse_float(c: Column, default: float | None = None) -> Column:
    return F.coalesce(lenient_double(c), F.lit(default).cast("double"))


def range_list(c: Column) -> Column:
    """``"1,2,5-8"`` as sorted distinct integers; a reversed range is turned round."""
    items = F.filter(F.transform(F.split(c, ","), lambda s: F.trim(s)), lambda s: s != "")

    def spread(s):
        ends = F.transform(F.split(s, "-"), lambda e: F.trim(e).cast("int"))
        a, b = F.get(ends, F.lit(0)), F.element_at(ends, -1)
        return F.sequence(F.least(a, b), F.greatest(a, b))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(items, spread))))


@F.udtf(returnType="k int, v int")
class RangeValues:
    """A table function of range lists: the numbers of ``range_list`` and their places, one row each.

    Null and empty texts give no rows, an entry that is no number or range fails; an entry with an empty end, such as
    ``-3``, is none either and is passed over.
    """

    def eval(self, spec: str):
        values = set()
        for item in filter(None, map(str.strip, (spec or "").split(","))):
            ends = [e.strip() for e in item.split("-")]
            if all(ends):
                low, high = sorted((int(ends[0]), int(ends[-1])))
                values.update(range(low, high + 1))
        yield from enumerate(sorted(values))


def sensor_list(c: Column) -> Column:
    """``"x,y;x,y"`` as points; an entry without two parts raises."""
    items = F.filter(F.transform(F.split(c, ";"), lambda s: F.trim(s)), lambda s: s != "")

    def point(s):
        parts = F.split(s, ",")
        bad = F.raise_error(F.concat(F.lit("invalid sensor entry "), s)).cast("double")
        part = lambda i: F.when(F.size(parts) == 2, F.trim(F.get(parts, F.lit(i))).cast("double")).otherwise(bad)
        return F.struct(part(0).alias("x"), part(1).alias("y"))

    return F.transform(items, point)


def path_part(path: Column, from_end: int) -> Column:
    """Path part counted from the end, "unknown" when the path is too short."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-from_end)), F.lit("unknown"))


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """Map lookup with a default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def sequence_name(prefix: str, n: Column, suffix: str, width: int = 4) -> Column:
    """Zero-padded file name; numbers too long for the width stay whole."""
    text = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text), F.lit(suffix))


def json_points(text: Column) -> Column:
    """Polygon points of an annotation JSON text, first shape first."""
    schema = "shapes ARRAY<STRUCT<label STRING, points ARRAY<ARRAY<DOUBLE>>>>"
    return F.from_json(text, schema)["shapes"]
