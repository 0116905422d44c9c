"""Functions that a query may call although the catalogue has no example of them: engines differ in their names, and parsers take any name."""

from __future__ import annotations

# By category, the name of each entry and the spellings of its call.
SPELLINGS: dict[str, dict[str, tuple[str, ...]]] = {
    "scalar.string": {
        "Pad": ("lpad", "rpad", "pad"),
        "Space": ("space",),
        "Length": ("len", "char_length", "character_length"),
        "StrPosition": ("strpos", "locate", "position", "charindex"),
        "Stuff": ("stuff",),
        "IsAscii": ("is_ascii",),
        "Format": ("format", "printf"),
        "ToBase64": ("to_base64",),
        "FromBase64": ("from_base64",),
        "UNBASE64": ("unbase64",),
        "JARO_WINKLER_SIMILARITY": ("jaro_winkler_similarity",),
    },
    "scalar.datetime": {
        "Week": ("week",),
        "CurrentTime": ("current_time",),
        "StrToDate": ("str_to_date", "to_date"),
        "StrToTime": ("str_to_time", "to_timestamp"),
        "DateBin": ("date_bin", "time_bucket"),
        "TimestampAdd": ("timestampadd", "timestamp_add"),
        "TimestampDiff": ("timestampdiff", "timestamp_diff"),
        "TimestampSub": ("timestamp_sub",),
        "TimestampTrunc": ("timestamp_trunc",),
        "TimeAdd": ("time_add",),
        "TimeDiff": ("time_diff",),
        "TimeSub": ("time_sub",),
        "TimeTrunc": ("time_trunc",),
        "DatetimeAdd": ("datetime_add",),
        "DatetimeDiff": ("datetime_diff",),
        "DatetimeSub": ("datetime_sub",),
        "DatetimeTrunc": ("datetime_trunc",),
        "UnixSeconds": ("unix_seconds",),
        "UnixMillis": ("unix_millis",),
        "TimeToStr": ("time_to_str",),
        "TimeToUnix": ("time_to_unix",),
        "DateFromParts": ("date_from_parts", "datefromparts"),
        "TsOrDsAdd": ("ts_or_ds_add",),
        "TsOrDsToDate": ("ts_or_ds_to_date",),
        "UnixToStr": ("unix_to_str",),
        "STRPTIME": ("strptime",),
        "STRFTIME": ("strftime",),
        "EPOCH": ("epoch",),
    },
    "scalar.null_handling": {"EqualNull": ("equal_null",), "IsNullValue": ("is_null_value", "isnull")},
    "scalar.type_conversion": {
        "Convert": ("convert",),
        "Typeof": ("typeof",),
    },
    "scalar.regex": {
        "RegexpExtractAll": ("regexp_substr_all",),
        "RegexpSplit": ("regexp_split", "regexp_split_to_array"),
        "RegexpFullMatch": ("regexp_full_match",),
        "RegexpILike": ("regexp_ilike",),
        "REGEXP_MATCHES": ("regexp_matches",),
        "STRING_SPLIT_REGEX": ("string_split_regex",),
        "REGEXP_EXTRACT_ALL": ("regexp_extract_all",),
    },
    "scalar.json": {
        "JSONExtract": ("get_json_object", "json_extract"),
        "JSONExtractScalar": ("json_extract_scalar", "json_value"),
        "JSONObject": ("json_object", "json_build_object"),
        "JSONArray": ("json_build_array",),
        "JSONExists": ("json_path_exists",),
        "JSONKeys": ("json_keys", "json_object_keys"),
        "JSONType": ("json_type", "json_typeof"),
        "JSONFormat": ("json_format",),
        "JSONBExtract": ("jsonb_extract", "jsonb_extract_path"),
        "JSONBExtractScalar": ("jsonb_extract_scalar", "jsonb_extract_path_text"),
        "JSONBContains": ("jsonb_contains",),
        "JSONBContainsAllTopKeys": ("jsonb_exists_all",),
        "JSONBContainsAnyTopKeys": ("jsonb_exists_any",),
        "JSONBDeleteAtPath": ("jsonb_delete_path",),
        "JSON_ARRAY": ("json_array",),
        "JSON_EXISTS": ("json_exists",),
        "JSON_EXTRACT_STRING": ("json_extract_string",),
        "JSON": ("json",),
    },
    "scalar.array": {
        "ArraySize": ("size", "array_size", "array_length", "cardinality"),
        "ArrayReverse": ("array_reverse", "list_reverse"),
        "ArraySlice": ("slice", "array_slice", "list_slice"),
        "ArrayFilter": ("filter", "array_filter", "list_filter"),
        "ArrayToString": ("array_join", "array_to_string"),
        "ArrayFirst": ("array_first", "list_first"),
        "ArrayLast": ("array_last", "list_last"),
        "ArrayConcat": ("array_concat", "array_cat", "list_concat"),
        "GenerateSeries": ("generate_array",),
        "ArrayContainsAll": ("array_contains_all", "array_has_all"),
        "ArrayAll": ("array_all", "forall"),
        "ArrayAny": ("array_any",),
        "SORT_ARRAY": ("sort_array",),
        "ARRAY_DISTINCT": ("array_distinct",),
        "ARRAY_INTERSECT": ("array_intersect",),
        "ARRAY_UNION": ("array_union",),
        "ARRAY_EXCEPT": ("array_except",),
        "ARRAY_REPEAT": ("array_repeat",),
        "ARRAY_COMPACT": ("array_compact",),
        "ARRAYS_ZIP": ("arrays_zip",),
        "SEQUENCE": ("sequence",),
        "LIST_DISTINCT": ("list_distinct",),
        "LIST_INTERSECT": ("list_intersect",),
        "GENERATE_SERIES": ("generate_series",),
    },
    "scalar.map_struct": {
        "MapSize": ("map_size",),
        "StructExtract": ("struct_extract",),
        "Struct": ("named_struct", "struct", "struct_pack"),
        "Map": ("map",),
        "VarMap": ("var_map",),
        "MAP_VALUES": ("map_values",),
        "MAP_ENTRIES": ("map_entries",),
        "MAP_CONCAT": ("map_concat",),
    },
    "scalar.hash_crypto": {"FarmFingerprint": ("farm_fingerprint", "farmhash64"), "SHA256": ("sha256",)},
    "scalar.session_system": {"CURRENT_SETTING": ("current_setting",)},
    "scalar.numeric": {
        "EVEN": ("even",), "TRUNC": ("trunc",),
        "Pow": ("pow", "power"),
        "IsInf": ("isinf", "is_inf"),
    },
    "scalar.pattern_matching": {"Match": ("match",)},
    "agg.collection": {
        "GroupConcat": ("listagg", "string_agg"),
        "ArrayConcatAgg": ("array_concat_agg",),
        "ArrayUniqueAgg": ("array_unique_agg",),
        "JSONArrayAgg": ("json_array_agg",),
        "JSONObjectAgg": ("json_object_agg", "json_objectagg"),
        "JSON_ARRAYAGG": ("json_arrayagg",),
        "ObjectAgg": ("object_agg",),
        "COLLECT_LIST": ("collect_list",),
        "COLLECT_SET": ("collect_set",),
        "GROUP_CONCAT": ("group_concat",),
    },
    "agg.approximate": {
        "Hll": ("hll", "hll_sketch_agg"), "APPROX_QUANTILE": ("approx_quantile",),
        "ApproxDistinct": ("approx_count_distinct", "approx_distinct"),
        "ApproxQuantile": ("approx_percentile",),
    },
    "agg.statistical": {
        "VariancePop": ("var_pop", "variance_pop"),
    },
    "agg.ordered_set": {
        "Quantile": ("quantile", "quantile_cont", "quantile_disc"),
    },
    "scalar.arithmetic": {
        "Add": ("try_add",),
        "Sub": ("try_subtract",),
        "Mul": ("try_multiply",),
        "Div": ("try_divide", "divide"),
        "Mod": ("mod", "try_mod"),
        "Neg": ("negative",),
    },
    "scalar.bitwise": {
        "BitwiseLeftShift": ("shiftleft",),
        "BitwiseRightShift": ("shiftright",),
    },
    "table_valued": {"POSEXPLODE": ("posexplode",)},
}
#: Words that are calls without brackets.
BARE = ("current_date", "current_timestamp", "current_time", "current_user", "localtimestamp")


def by_spelling() -> dict[str, tuple[str, str, str]]:
    """(category, subcategory, name) of each spelling."""
    out = {}
    for group, entries in SPELLINGS.items():
        category, _, sub = group.partition(".")
        for name, spellings in entries.items():
            for spelling in spellings:
                out[spelling] = (category, sub or category, name)
    return out
