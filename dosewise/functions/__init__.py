from dosewise.functions.dates import date_to_int, day_number, parse_date_int, parse_stamp_text
from dosewise.functions.missing import (
    at_most,
    below,
    blank_to_null,
    filled,
    flag,
    known,
    one_of,
    parse_number,
)

__all__ = [
    "at_most",
    "below",
    "blank_to_null",
    "date_to_int",
    "day_number",
    "filled",
    "flag",
    "known",
    "one_of",
    "parse_date_int",
    "parse_number",
    "parse_stamp_text",
]
