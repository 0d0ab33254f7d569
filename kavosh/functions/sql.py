"""The column builders that SQL can state, as temporary SQL functions: Catalyst inlines them, so they cost what the builders do."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kavosh.functions.dicts import AREA_CODES, MOBILE
from kavosh.functions.phones import ARABIC_DIGITS, ASCII_DIGITS, PERSIAN_DIGITS

_FUNCTIONS = {
    "kavosh_digits(x STRING)": f"regexp_replace(translate(coalesce(x, ''), '{PERSIAN_DIGITS + ARABIC_DIGITS}', '{ASCII_DIGITS * 2}'), '[^0-9]', '')",
    "kavosh_national(x STRING)": "regexp_replace(kavosh_digits(x), '^(?:0098|98)', '')",
    "kavosh_phone(x STRING)": "CASE WHEN kavosh_national(x) RLIKE '^9[0-9]{9}$' THEN concat('0', kavosh_national(x)) WHEN kavosh_national(x) RLIKE '^0[0-9]{10}$' THEN kavosh_national(x) ELSE trim(coalesce(x, '')) END",
    "kavosh_phone_kind(x STRING)": f"CASE WHEN regexp_replace(kavosh_national(x), '^([0-9]{{10}})$', '0$1') RLIKE '^{MOBILE}$' THEN 'mobile' WHEN regexp_replace(kavosh_national(x), '^([0-9]{{10}})$', '0$1') RLIKE '^0(?:{'|'.join(AREA_CODES)})[0-9]{{8}}$' THEN 'landline' ELSE '' END",
    "kavosh_site_key(x STRING)": r"regexp_replace(regexp_replace(lower(regexp_extract(x, r'^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#\s]*)', 1)), r':\d*$', ''), r'^www\.', '')",
    "kavosh_plain(x STRING)": "lower(translate(coalesce(x, ''), 'يك\u200c', 'یک '))",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; their names."""
    for head, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS STRING RETURN {body}")
    return [head.split("(")[0] for head in _FUNCTIONS]
