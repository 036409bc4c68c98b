"""What functions take and give, as far as paths in their arguments need a type that is not their own."""

from __future__ import annotations


def _each(kind, names: str) -> dict:
    return dict.fromkeys(names.split(), kind)


#: Function -> types of its arguments, the last one for all further ones; "" is string for what has no type of its own.
SIGNATURES: dict[str, tuple[str, ...]] = {
    **_each(("double",), "SUM AVG MEAN STD STDDEV STDDEV_POP STDDEV_SAMP VARIANCE VAR_POP VAR_SAMP CORR COVAR_POP COVAR_SAMP MEDIAN ABS CEIL CEILING FLOOR SQRT CBRT EXP LN LOG LOG10 LOG2 POW POWER SIN COS TAN ASIN ACOS ATAN ATAN2 DEGREES RADIANS SIGN SIGNUM PERCENTILE SKEWNESS KURTOSIS REGR_SLOPE REGR_INTERCEPT REGR_R2 PMOD MOD"),
    **_each(("double", "int"), "ROUND BROUND"),
    **_each(("double", "double", "int"), "PERCENTILE_APPROX APPROX_PERCENTILE"),
    **_each(("date", "int"), "DATE_ADD DATE_SUB DATEADD ADD_MONTHS"),
    **_each(("date",), "DATEDIFF DATE_DIFF LAST_DAY"),
    **_each(("timestamp",), "YEAR QUARTER MONTH DAY DAYOFMONTH DAYOFWEEK DAYOFYEAR WEEKDAY WEEKOFYEAR HOUR MINUTE SECOND MONTHS_BETWEEN UNIX_MILLIS UNIX_MICROS UNIX_SECONDS"),
    **_each(("", "timestamp"), "DATE_TRUNC DATE_PART DATEPART EXTRACT"),
    **_each(("timestamp", ""), "DATE_FORMAT"),
    **_each(("date", ""), "TRUNC NEXT_DAY"),
    **_each(("", "int"), "LEFT RIGHT REPEAT LPAD RPAD SUBSTRING SUBSTR NTH_VALUE LAG LEAD CONV"),
    **_each(("", "", "int"), "SPLIT_PART SPLIT SUBSTRING_INDEX LOCATE REGEXP_EXTRACT REGEXP_EXTRACT_ALL"),
    **_each(("int",), "CHR CHAR SPACE FACTORIAL MAKE_DATE MAKE_TIMESTAMP NTILE SEQUENCE"),
}
SIGNATURES["LPAD"] = SIGNATURES["RPAD"] = ("", "int", "")
SIGNATURES["LAG"] = SIGNATURES["LEAD"] = ("", "int", "")
SIGNATURES["CONV"] = ("", "int", "int")

#: Functions whose arguments have one type.
TOGETHER = set("COALESCE NVL IFNULL NULLIF GREATEST LEAST ARRAY IF IFF NVL2 EQUAL_NULL".split())

#: Functions that give one of the values they get.
PASSING = set("MAX MIN FIRST FIRST_VALUE LAST LAST_VALUE ANY_VALUE MODE LAG LEAD NTH_VALUE MAX_BY MIN_BY".split())

#: Array functions by their arguments: a array, e element, i index, s string, l anything else.
ARRAYS: dict[str, str] = {
    **_each("ae", "ARRAY_CONTAINS ARRAY_POSITION ARRAY_REMOVE ARRAY_APPEND ARRAY_PREPEND"),
    **_each("aa", "ARRAY_UNION ARRAY_INTERSECT ARRAY_EXCEPT ARRAYS_OVERLAP"),
    **_each("al", "ARRAY_DISTINCT ARRAY_MAX ARRAY_MIN ARRAY_SORT SORT_ARRAY ARRAY_SIZE SIZE CARDINALITY EXPLODE EXPLODE_OUTER POSEXPLODE POSEXPLODE_OUTER ARRAY_COMPACT SHUFFLE TRANSFORM FILTER EXISTS FORALL ANY_MATCH AGGREGATE REDUCE"),
    **_each("aal", "ZIP_WITH"),
    **_each("as", "ARRAY_JOIN"),
    **_each("ai", "SLICE ELEMENT_AT TRY_ELEMENT_AT GET"),
    "ARRAY_INSERT": "aie",
}

AGGREGATES = set("COUNT SUM AVG MEAN MIN MAX FIRST FIRST_VALUE LAST LAST_VALUE ANY_VALUE COLLECT_LIST COLLECT_SET ARRAY_AGG LISTAGG STRING_AGG STD STDDEV STDDEV_POP STDDEV_SAMP VARIANCE VAR_POP VAR_SAMP CORR COVAR_POP COVAR_SAMP MEDIAN MODE PERCENTILE PERCENTILE_APPROX APPROX_PERCENTILE APPROX_COUNT_DISTINCT COUNT_IF MAX_BY MIN_BY BOOL_AND BOOL_OR EVERY SOME ANY BIT_AND BIT_OR BIT_XOR SKEWNESS KURTOSIS REGR_SLOPE REGR_INTERCEPT REGR_R2 GROUPING GROUPING_ID".split())

#: The type that a function gives, whatever it gets.
RESULTS: dict[str, str] = {
    **_each("string", "UPPER LOWER UCASE LCASE INITCAP TRIM LTRIM RTRIM LPAD RPAD REPLACE SUBSTRING SUBSTR LEFT RIGHT SPLIT_PART CONCAT_WS TRANSLATE REPEAT REGEXP_REPLACE REGEXP_EXTRACT MD5 SHA1 SHA2 HEX BASE64 DATE_FORMAT CHR SPACE FORMAT_STRING LISTAGG STRING_AGG ARRAY_JOIN GET_JSON_OBJECT TO_JSON JSON_DISPLAY"),
    **_each("bigint", "COUNT LENGTH CHAR_LENGTH OCTET_LENGTH BIT_LENGTH ASCII INSTR LOCATE POSITION SIZE CARDINALITY ROW_NUMBER RANK DENSE_RANK NTILE YEAR QUARTER MONTH DAY HOUR MINUTE DATEDIFF COUNT_IF APPROX_COUNT_DISTINCT CRC32 XXHASH64 HASH LEVENSHTEIN"),
    **_each("double", "SQRT CBRT EXP LN LOG LOG10 LOG2 SIN COS TAN ASIN ACOS ATAN ATAN2 STDDEV VARIANCE CORR RAND PERCENT_RANK CUME_DIST MEDIAN"),
    **_each("boolean", "ISNULL ISNOTNULL STARTSWITH ENDSWITH CONTAINS ARRAY_CONTAINS REGEXP_LIKE BOOL_AND BOOL_OR"),
    **_each("date", "DATE_ADD DATE_SUB ADD_MONTHS TO_DATE CURRENT_DATE LAST_DAY MAKE_DATE NEXT_DAY"),
    **_each("timestamp", "TO_TIMESTAMP CURRENT_TIMESTAMP NOW DATE_TRUNC MAKE_TIMESTAMP"),
}
