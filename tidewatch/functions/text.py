"""Column functions over text: stripping, districts, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BOROUGH_CODES, DISTRICTS


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends (Spark's trim takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def title(c: Column) -> Column:
    """A capital after every character that is no letter, small letters otherwise."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, F.initcap), "")


def parse_district(board: Column | str) -> Column:
    """A board such as `05 BROOKLYN` as struct(district `Brooklyn 05`, borough `Brooklyn`)."""
    board = F.col(board) if isinstance(board, str) else board
    normal = F.upper(strip(board))
    number = F.regexp_extract(normal, r"^(\d+)\s+\S", 1)
    borough = title(F.regexp_extract(normal, r"^\d+\s+(.*)$", 1))
    bare = F.regexp_replace(number, r"^0+(?=\d)", "")
    known = F.concat(borough, F.lit(" "), F.when(F.length(bare) > 2, bare).otherwise(F.lpad(bare, 2, "0")))
    unknown = F.lit("Unspecified")
    return (
        F.when(normal.contains("UNSPECIFIED"), F.struct(unknown.alias("district"), unknown.alias("borough")))
        .when(number != "", F.struct(known.alias("district"), borough.alias("borough")))
        .otherwise(F.struct(title(board).alias("district"), unknown.alias("borough")))
    )


def borough_of(district: Column) -> Column:
    """`Staten Island 03` -> `Staten Island`; itself where there is no number."""
    return F.regexp_replace(district, r" [^ ]*$", "")


def is_official(district: Column) -> Column:
    """Whether a district is one of the community districts."""
    number = F.regexp_extract(district, r" (\d{1,9})$", 1)
    most = F.create_map(*[x for name, n in DISTRICTS.items() for x in (F.lit(name), F.lit(n))])
    return F.coalesce((number != "") & (F.try_to_number(number, F.lit("999999999")).cast("int").between(F.lit(1), F.try_element_at(most, borough_of(district)))), F.lit(False))


def district_of_code(code: Column) -> Column:
    """A boundary code such as 305 as `Brooklyn 05`."""
    names = F.create_map(*[x for k, name in BOROUGH_CODES.items() for x in (F.lit(k), F.lit(name))])
    return F.concat(F.try_element_at(names, F.floor(code / 100).cast("int")), F.lit(" "), F.lpad((code % 100).cast("string"), 2, "0"))


def signal_id(kind: Column, district: Column, problem: Column, day: Column) -> Column:
    """A stable identifier of a signal."""
    identity = F.lower(F.concat_ws("|", kind, district, problem, day.cast("string")))
    return F.concat(F.lit("SIG-"), F.upper(F.substring(F.sha2(identity, 256), 1, 10)))


def canonical_json(row: dict[str, Column]) -> Column:
    """The columns as a JSON object with sorted keys and no blanks; nulls stay as keys."""
    return F.to_json(F.struct(*[row[k].alias(k) for k in sorted(row)]), {"ignoreNullFields": "false"})


def canonical_hash(row: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(row), 256)


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Minute boundaries between two times."""

    def minute(c: Column | str) -> Column:
        return F.unix_seconds(F.date_trunc("minute", F.col(c) if isinstance(c, str) else c).cast("timestamp"))

    return (minute(end) - minute(start)) / F.lit(60)
