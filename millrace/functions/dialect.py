"""The engine's SQL function dialect, as rewrites to Spark SQL.

Three kinds of name: those Spark has under the same name and meaning (``SAME``),
those it has under another name (``ALIASES``), and those whose meaning differs
and is composed (``COMPOSED``: one template per number of arguments, with ``{0}``,
``{1}`` ... for the arguments' SQL).  ``sql`` rewrites one call, ``call`` builds a
Column from one, and ``translate`` rewrites a whole statement.

All rewrites stay JVM-side but the five in ``udfs``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names with Spark's own meaning (fixed values: the dialect's function names).
SAME = frozenset(
    """
    abs acos any_value approx_count_distinct arrays_overlap array_agg array_append array_compact array_contains array_distinct
    array_max array_min array_remove array_size ascii asin atan atan2 avg base64 binary bit_and bit_length bit_or bool_and bool_or
    bround btrim cardinality cbrt ceiling character_length char_length coalesce concat_ws contains convert_timezone corr cos cosh cot
    count covar_pop covar_samp crc32 cume_dist current_catalog current_date current_schema current_time current_timestamp current_user
    date_part degrees dense_rank e exp factorial find_in_set first_value floor format_number greatest grouping grouping_id hex initcap
    instr isnotnull isnull lag last_day last_value lcase lead least length levenshtein ln locate log log10 log2 lower lpad map map_keys
    map_values max md5 median min months_between next_day now ntile nullif octet_length overlay percent_rank pi pmod position pow power
    quote radians rank regexp_extract regexp_replace regr_sxx regr_syy repeat replace reverse right round row_number rpad session_user
    sha sha1 shiftleft shiftright shiftrightunsigned sign sin sinh size soundex space split_part sqrt stddev stddev_pop stddev_samp
    substring_index sum tan tanh translate ucase unbase64 unhex unix_timestamp upper user var_pop var_samp
    """.split()
)

ALIASES = {
    "array_cat": "concat", "array_concat": "concat", "array_intersection": "array_intersect", "set_union": "array_union", "array_length": "cardinality",
    "collect": "collect_list", "ends_with": "endswith", "starts_with": "startswith", "from_hex": "unhex", "hll": "hll_sketch_agg", "is_substr": "contains",
    "strpos": "instr", "lshift": "shiftleft", "rshift": "shiftright", "rshiftunsigned": "shiftrightunsigned", "localtime": "current_time",
    "localtimestamp": "localtimestamp", "map_construct": "map", "mappify": "map_entries", "kvgen": "map_entries",
    "query_user": "session_user", "regexp_like": "regexp_like", "regexp_col_like": "regexp_like", "regexp_col_matches": "regexp_like",
    "regexp_matches": "regexp_like", "repeatstr": "repeat", "system_user": "current_user", "to_hex": "hex", "transaction_timestamp": "current_timestamp",
    "translate3": "translate", "udfdegrees": "degrees", "variance": "var_samp", "random": "rand", "covariance": "covar_samp", "correlation": "corr",
    "timestamptype": "make_timestamp", "datetype": "make_date", "timetype": "make_time", "to_time": "try_to_time", "hll_merge": "hll_union_agg",
    "hll_decode": "hll_sketch_estimate", "every": "bit_and", "tdigest_merge": "kll_merge_agg_double", "mod": "mod", "isnan": "isnan",
}

_GREAT_CIRCLE = (
    "(2 * 6371000 * asin(sqrt(pow(sin(radians(CAST({2} AS DOUBLE) - CAST({0} AS DOUBLE)) / 2), 2) + cos(radians(CAST({0} AS DOUBLE))) * "
    "cos(radians(CAST({2} AS DOUBLE))) * pow(sin(radians(CAST({3} AS DOUBLE) - CAST({1} AS DOUBLE)) / 2), 2))))"
)
_FROM_END = "IF({1} < 0, size({0}) + {1}, {1})"
_NUMERIC = "({0} rlike '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$')"

COMPOSED: dict[str, dict[int, str]] = {
    # arrays: 0-based, NULL and negative indices as the dialect has them
    "array_position": {2: "get(filter(transform({1}, (x, j) -> IF(x <=> {0}, CAST(j AS BIGINT), NULL)), z -> z IS NOT NULL), 0)"},
    "array_prepend": {2: "array_prepend({1}, {0})"},
    "array_insert": {3: "array_insert({0}, IF({1} >= 0, {1} + 1, {1} - 1), {2})"},
    "array_remove_at": {2: f"filter({{0}}, (x, j) -> j <> {_FROM_END})"},
    "array_slice": {
        2: f"filter({{0}}, (x, j) -> j >= {_FROM_END})",
        3: f"filter({{0}}, (x, j) -> j >= {_FROM_END} AND j < IF({{2}} < 0, size({{0}}) + {{2}}, {{2}}))",
    },
    "sublist": {3: "slice({0}, CASE WHEN {1} = 0 THEN 1 ELSE {1} END, {2})"},
    "array_avg": {1: "(aggregate(filter({0}, x -> x IS NOT NULL), 0D, (acc, x) -> acc + x) / nullif(cardinality({0}), 0))"},
    "array_sum": {1: "aggregate(array_compact({0}), 0L, (acc, x) -> acc + x)"},
    "array_frequency": {1: "map_from_entries(transform(array_distinct(array_compact({0})), k -> struct(CAST(k AS STRING), size(filter({0}, x -> x = k)))))"},
    "array_generate_range": {
        2: "IF({0} < {1}, filter(sequence({0}, {1}), x -> x <> {1}), CAST(array() AS ARRAY<INT>))",
        3: "IF(({2} > 0 AND {0} < {1}) OR ({2} < 0 AND {0} > {1}), filter(sequence({0}, {1}, {2}), x -> x <> {1}), CAST(array() AS ARRAY<INT>))",
    },
    "array_to_string": {2: "array_join({0}, {1}, '')"},
    "array_sort": {1: "sort_array({0})"},
    "element": {1: "IF(size({0}) <= 1, get({0}, 0), raise_error('multiset has more than one element'))"},
    "fusion": {1: "flatten(collect_list({0}))"},
    # strings
    "concat": {n: "concat_ws('', " + ", ".join(f"{{{i}}}" for i in range(n)) + ")" for n in range(1, 11)},
    "left": {2: "IF({1} < 0, substring({0}, 1, greatest(length({0}) + {1}, 0)), left({0}, greatest({1}, 0)))"},
    "ltrim": {1: "ltrim({0})", 2: "trim(LEADING {1} FROM {0})"},
    "rtrim": {1: "rtrim({0})", 2: "trim(TRAILING {1} FROM {0})"},
    "trim": {1: "trim({0})", 2: "trim(BOTH {1} FROM {0})"},
    "substring": {2: "substring({0}, {1})", 3: "substring({0}, {1}, {2})"},
    "substr": {2: "substring({0}, {1})", 3: "substring({0}, {1}, {2})"},
    "bin": {1: "IF(CAST({0} AS BIGINT) < 0 AND typeof({0}) = 'int', right(bin({0}), 32), bin({0}))"},
    "chr": {1: "CAST(unhex(CASE WHEN {0} < 128 THEN lpad(hex({0}), 2, '0') WHEN {0} < 2048 THEN hex((192 + {0} div 64) * 256 + 128 + {0} % 64) "
               "WHEN {0} < 65536 THEN hex((224 + {0} div 4096) * 65536 + (128 + {0} div 64 % 64) * 256 + 128 + {0} % 64) "
               "ELSE hex((240 + {0} div 262144) * 16777216L + (128 + {0} div 4096 % 64) * 65536 + (128 + {0} div 64 % 64) * 256 + 128 + {0} % 64) END) AS STRING)"},
    "listagg": {1: "listagg({0}, ',')", 2: "listagg({0}, {1})"},
    "col_like": {2: "({0} LIKE {1})"},
    "parse_url": {2: "try_parse_url({0}, {1})", 3: "try_parse_url({0}, {1}, {2})"},
    "toascii": {1: "decode(encode({0}, 'US-ASCII'), 'UTF-8')"},
    "to_utf8": {1: "decode(encode({0}, 'UTF-8'), 'UTF-8')"},
    "is_utf8": {1: "is_valid_utf8(CAST({0} AS STRING))"},
    "byte_substr": {2: "substring({0}, {1})", 3: "substring({0}, {1}, {2})"}, "bytesubstring": {3: "substring({0}, {1}, {2})"},
    "binary_string": {1: "to_binary({0}, 'utf-8')"},
    "similar_to": {2: "rlike({0}, concat('^(?s:', replace(replace({1}, '%', '.*'), '_', '.'), ')$'))"},
    "regexp_split": {4: "CASE upper({2}) WHEN 'FIRST' THEN split({0}, {1}, 2) WHEN 'ALL' THEN slice(split({0}, {1}), 1, {3}) ELSE split({0}, {1}) END"},
    "sha256": {1: "sha2({0}, 256)"}, "sha512": {1: "sha2({0}, 512)"},
    "aes_encrypt": {2: "aes_encrypt({0}, {1}, 'ECB')"}, "aes_decrypt": {2: "CAST(try_aes_decrypt({0}, {1}, 'ECB') AS STRING)"},
    # masking: upper to X, lower to x, digit to n
    "mask": {1: "mask({0}, 'X', 'x', 'n', NULL)"},
    "mask_first_n": {1: "concat(mask(left({0}, 4), 'X', 'x', 'n', NULL), substring({0}, 5))", 2: "concat(mask(left({0}, {1}), 'X', 'x', 'n', NULL), substring({0}, {1} + 1))"},
    "mask_last_n": {2: "concat(left({0}, greatest(length({0}) - {1}, 0)), mask(right({0}, {1}), 'X', 'x', 'n', NULL))"},
    "mask_show_first_n": {2: "concat(left({0}, {1}), mask(substring({0}, {1} + 1), 'X', 'x', 'n', NULL))"},
    "mask_show_last_n": {2: "concat(mask(left({0}, greatest(length({0}) - {1}, 0)), 'X', 'x', 'n', NULL), right({0}, {1}))"},
    # numbers
    "truncate": {
        1: "(sign({0}) * floor(abs({0})) + 0D)",
        # through decimals, in which 1.15 * 100 is 115; beyond their range a double has no such digits
        2: "CAST(sign({0}) * coalesce(CAST(floor(try_cast(abs({0}) AS DECIMAL(28,10)) * CAST(pow(10, greatest({1}, 0)) AS DECIMAL(10,0)) / CAST(pow(10, greatest(-({1}), 0)) AS DECIMAL(10,0))) AS DOUBLE), "
           "abs({0}) * pow(10, {1})) / pow(10, {1}) + 0D AS DOUBLE)",
    },
    "divide": {2: "CASE WHEN {1} = 0 THEN CASE WHEN {0} > 0 THEN double('Infinity') WHEN {0} < 0 THEN double('-Infinity') WHEN {0} = 0 THEN double('NaN') END ELSE {0} / {1} END"},
    "bitwise_and": {2: "({0} & {1})"}, "bitwise_or": {2: "({0} | {1})"}, "bitwise_xor": {2: "({0} ^ {1})"}, "bitwise_not": {1: "(~{0})"},
    "xor": {2: "({0} ^ {1})"},
    "rand_integer": {1: "CAST(floor(rand() * {0}) AS INT)"}, "sample": {1: "(rand() < {0} / 100)"}, "alternate": {0: "(monotonically_increasing_id() % 2)"},
    "isnumeric": {1: _NUMERIC}, "is_numeric": {1: _NUMERIC},
    "to_number": {1: "CAST({0} AS DOUBLE)", 2: "round(CAST({0} AS DOUBLE), IF(instr({1}, '.') = 0, 0, length({1}) - instr({1}, '.')))"},
    "sum0": {1: "coalesce(sum({0}), 0)"},
    "approx_percentile": {2: "percentile_approx({0}, {1}, 10000)"},
    "tdigest": {1: "kll_sketch_agg_double(CAST({0} AS DOUBLE))"}, "tdigest_quantile": {2: "kll_sketch_get_quantile_double({1}, {0})"},
    # hashing
    "hash64": {1: "IF({0} IS NULL, 0L, xxhash64({0}))", 2: "IF({0} IS NULL, {1}, xxhash64({0}, {1}))"}, "hash": {1: "hash({0})", 2: "hash({0}, {1})"},
    # truth and types
    "istrue": {1: "({0} IS TRUE)"}, "isfalse": {1: "({0} IS FALSE)"}, "isnottrue": {1: "({0} IS NOT TRUE)"}, "isnotfalse": {1: "({0} IS NOT FALSE)"},
    "isdate": {1: "(try_cast({0} AS DATE) IS NOT NULL)"}, "is_date": {1: "(try_cast({0} AS DATE) IS NOT NULL)"},
    "is_time": {1: "(try_to_time({0}) IS NOT NULL)"}, "is_timestamp": {1: "(try_to_timestamp({0}) IS NOT NULL)"},
    **{f"is_{k}": {1: f"(typeof({{0}}) LIKE '{t}')"} for k, t in {
        "bigint": "bigint", "bit": "boolean", "decimal": "decimal%", "fixedsizebinary": "binary", "float4": "float", "float8": "double", "int": "int",
        "intervalday": "interval day%", "intervalyear": "interval year%", "list": "array%", "struct": "struct%", "varbinary": "binary", "varchar": "string", "map": "map%"}.items()},
    "typeof": {1: "CASE typeof({0}) WHEN 'boolean' THEN 'BOOLEAN' WHEN 'string' THEN 'CHARACTER VARYING' WHEN 'int' THEN 'INTEGER' WHEN 'binary' THEN 'BINARY VARYING' "
                  "WHEN 'void' THEN 'NULL' ELSE upper(typeof({0})) END"},
    # dates: parts are BIGINT
    **{k: {1: f"CAST({s}({{0}}) AS BIGINT)"} for k, s in {
        "day": "day", "dayofmonth": "dayofmonth", "dayofweek": "dayofweek", "dayofyear": "dayofyear", "hour": "hour", "minute": "minute", "month": "month",
        "quarter": "quarter", "second": "second", "week": "weekofyear", "weekofyear": "weekofyear", "year": "year", "yearweek": "weekofyear"}.items()},
    "datediff": {2: "datediff({0}, {1})"}, "date_sub": {2: "date_sub(CAST({0} AS DATE), {1})"}, "date_add": {2: "date_add(CAST({0} AS DATE), {1})"},
    "timestampadd": {3: "timestampadd({0}, {1}, {2})"}, "timestampdiff": {3: "timestampdiff({0}, {1}, {2})"},
    "current_date_utc": {0: "to_date(to_utc_timestamp(current_timestamp(), current_timezone()))"},
    "current_role": {0: "current_user()"}, "is_member": {1: "({0} = current_user())"},
    "current_path": {0: "concat_ws('.', current_catalog(), current_schema())"},
    "date_trunc": {2: "date_trunc({0}, {1})"},
    # conversion
    "convert_to": {2: "CASE upper({1}) WHEN 'UTF8' THEN to_binary(CAST({0} AS STRING), 'utf-8') END"},
    "convert_from": {2: "CASE upper({1}) WHEN 'UTF8' THEN CAST({0} AS STRING) END"},
    "convert_replaceutf8": {2: "replace(make_valid_utf8(CAST({0} AS STRING)), '\\uFFFD', {1})"},
    "to_json_text": {1: "to_json({0})"},
    # geometry
    "geo_distance": {4: _GREAT_CIRCLE}, "geo_beyond": {5: f"({_GREAT_CIRCLE} > {{4}})"}, "geo_nearby": {5: f"({_GREAT_CIRCLE} <= {{4}})"},
    # windows over time
    "tumble": {2: "window({0}, {1})"}, "hop": {3: "window({0}, {1}, {2})"}, "session": {2: "session_window({0}, {1})"},
    "tumble_start": {2: "window({0}, {1}).start"}, "tumble_end": {2: "window({0}, {1}).end"},
    "hop_start": {3: "window({0}, {1}, {2}).start"}, "hop_end": {3: "window({0}, {1}, {2}).end"},
    "session_start": {2: "session_window({0}, {1}).start"}, "session_end": {2: "session_window({0}, {1}).end"},
    "flatten": {1: "explode({0})"},
    "maxdir": {1: "max({0})"}, "mindir": {1: "min({0})"}, "imaxdir": {1: "max_by({0}, lower({0}))"}, "imindir": {1: "min_by({0}, lower({0}))"},
    # as HLL_DECODE(HLL(x)), of the hashes: any type, no blank left out, and small while it holds few values
    "ndv": {1: "hll_sketch_estimate(hll_sketch_agg(IF({0} IS NULL, NULL, xxhash64({0}))))"},
    "single_value": {1: "IF(count(1) <= 1, any_value({0}), raise_error('more than one row'))"},
}

#: Tokens of the dialect's date formats, longest first, and Java's.
FORMAT_TOKENS = {
    "YYYY": "yyyy", "YYY": "yyy", "YY": "yy", "MONTH": "MMMM", "MON": "MMM", "MM": "MM", "DDD": "DDD", "DD": "dd", "DAY": "EEEE", "DY": "EEE", "HH24": "HH",
    "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "FFF": "SSS", "FF": "SS", "F": "S", "AM": "a", "PM": "a", "TZD": "z", "TZO": "XXX", "WW": "ww", "Q": "q",
}
_TOKEN = re.compile("|".join(sorted(FORMAT_TOKENS, key=len, reverse=True)) + "|\"[^\"]*\"|.", re.S)


def java_format(text: str) -> str:
    """A date format of the dialect (YYYY-MM-DD HH24:MI:SS) in Java's letters."""
    out = []
    for token in _TOKEN.findall(text.upper() if '"' not in text else text):
        if token.startswith('"'):
            out.append("'" + token[1:-1] + "'")
        else:
            out.append(FORMAT_TOKENS.get(token.upper(), f"'{token}'" if token.isalpha() else token))
    return "".join(out)


def _dated(name: str, args: list[str]) -> str | None:
    """TO_CHAR, TO_DATE, TO_TIMESTAMP with a literal format."""
    literal = len(args) > 1 and re.fullmatch(r"'((?:[^']|'')*)'", args[1].strip())
    if name == "to_char" and literal:
        if "#" in literal[1]:
            return f"format_number({args[0]}, '{literal[1]}')"
        return f"date_format({args[0]}, '{java_format(literal[1])}')"
    if name in ("to_date", "to_timestamp"):
        if len(args) == 1:
            made = f"timestamp_seconds({args[0]})"
            return f"CAST({made} AS DATE)" if name == "to_date" else made
        if literal:
            lenient = "try_" if len(args) == 3 and args[2].strip() == "1" else ""
            if name == "to_date" and lenient:
                return f"CAST(try_to_timestamp({args[0]}, '{java_format(literal[1])}') AS DATE)"
            return f"{lenient}{name}({args[0]}, '{java_format(literal[1])}')"
    return None


def sql(name: str, *args: str) -> str:
    """Spark SQL of one call; arguments are SQL text."""
    key = name.lower()
    if key == "convert" and len(args) == 2:  # CONVERT(value, TYPE)
        return f"CAST({args[0]} AS {re.sub('(?i)^(varchar|character varying)( *[(][0-9 ]+[)])?$', 'STRING', args[1].strip())})"
    done = _dated(key, list(args))
    if done is not None:
        return done
    if key in COMPOSED:
        template = COMPOSED[key].get(len(args))
        if template is None:
            raise ValueError(f"{name} does not take {len(args)} arguments")
        safe = [a if re.fullmatch(r"[\w.`']+|'[^']*'", a.strip()) else f"({a})" for a in args]
        return re.sub(r"\{(\d+)\}", lambda m: safe[int(m[1])], template)
    return f"{ALIASES.get(key, key)}({', '.join(args)})"


def call(name: str, *args: str) -> Column:
    return F.expr(sql(name, *args))


def known() -> frozenset[str]:
    """All names of the dialect."""
    return SAME | frozenset(ALIASES) | frozenset(COMPOSED) | {"convert", "to_char", "to_date", "to_timestamp"}


_LEX = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|[A-Za-z_]\w*|\s+|.", re.S)
#: Calls whose arguments hold keywords and are left to Spark's own parser.
_OWN_SYNTAX = frozenset("cast try_cast extract position overlay trim substring count over in exists values row".split())


_KEYWORD = re.compile(r"\b(FROM|DISTINCT|ORDER|AS|PLACING|IN|SELECT)\b", re.I)


def _outer(text: str) -> str:
    """An argument's text without literals and without what stands in parentheses."""
    text = re.sub(r"'(?:[^']|'')*'", "", text)
    while (shorter := re.sub(r"\([^()]*\)", "", text)) != text:
        text = shorter
    return text


_GROUP_ID = re.compile(r"\bGROUP_ID\s*\(\s*\)", re.I)
_SETS = re.compile(r"\bGROUPING\s+SETS\s*\(", re.I)


def numbered_sets(statement: str) -> str:
    """GROUP_ID() spelt out: a statement per repetition of a grouping set, with its number, united.

    The statement is one SELECT; without GROUPING SETS no set is repeated and the number is 0.
    """
    m = _SETS.search(statement)
    if not m:
        return _GROUP_ID.sub("0", statement)
    depth, at = 1, m.end()
    while depth:
        depth += {"(": 1, ")": -1}.get(statement[at], 0)
        at += 1
    listed, sets, depth, held = statement[m.end() : at - 1], [], 0, ""
    for c in listed + ",":
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and not depth:
            sets.append(held.strip())
            held = ""
        else:
            held += c
    names = [[x.strip() for x in one.strip("()").split(",") if x.strip()] for one in sets]
    columns = list(dict.fromkeys(x.lower() for own in names for x in own))
    # a set's number as GROUPING_ID gives it: 1 for each column it leaves out
    ids = [sum((c not in {x.lower() for x in own}) << (len(columns) - 1 - i) for i, c in enumerate(columns)) for own in names]
    once = [one for i, one in enumerate(sets) if ids[i] not in ids[:i]]
    parts = []
    for turn in range(max(map(ids.count, ids))):
        again = sorted({i for i in ids if ids.count(i) > turn})
        rest = _GROUP_ID.sub(str(turn), statement[at:])
        if turn:
            only = f" HAVING grouping_id({', '.join(columns)}) IN ({', '.join(map(str, again))})"
            having = re.match(r"\s*HAVING\s+", rest, re.I)
            rest = f"{only} AND {rest[having.end() :]}" if having else only + rest
        parts.append(_GROUP_ID.sub(str(turn), statement[: m.end()]) + ", ".join(once) + ")" + rest)
    return parts[0] if len(parts) == 1 else " UNION ALL ".join(f"({p})" for p in parts)


def translate(statement: str) -> str:
    """A statement of the dialect as Spark SQL: calls rewritten, "quoted" names in backticks."""
    if _GROUP_ID.search(statement):
        statement = numbered_sets(statement)
    tokens = _LEX.findall(statement)

    def run(at: int, closing: str | None) -> tuple[list[list[str]], int]:
        """Arguments (token lists, rewritten) up to the closing parenthesis."""
        args: list[list[str]] = [[]]
        while at < len(tokens):
            t = tokens[at]
            if closing and t == ")":
                return args, at + 1
            if closing and t == ",":
                args.append([])
                at += 1
                continue
            if t == "(":
                inner, at = run(at + 1, ")")
                args[-1].append("(" + ",".join("".join(a) for a in inner) + ")")
                continue
            nxt = at + 1
            if re.match(r"[A-Za-z_]", t) and nxt < len(tokens) and tokens[nxt] == "(":
                inner, at = run(nxt + 1, ")")
                texts = ["".join(a) for a in inner]
                bare = [x.strip() for x in texts]
                bare = [] if bare == [""] else bare
                plain = not any(_KEYWORD.search(_outer(x)) for x in bare)
                key = t.lower()
                if key in known() and plain and not (key in _OWN_SYNTAX and len(bare) < 2):
                    try:
                        if key == "ndv" and "".join(tokens[at:]).lstrip()[:6].upper().startswith(("FILTER", "OVER")):
                            t, bare = "approx_count_distinct", [*bare, "0.01D"]  # one call, which takes the clause
                        args[-1].append(sql(t, *bare))
                        continue
                    except ValueError:
                        pass
                args[-1].append(f"{t}({','.join(texts)})")
                continue
            args[-1].append("`" + t[1:-1].replace('""', '"') + "`" if t.startswith('"') else t)
            at += 1
        return args, at

    return "".join(run(0, None)[0][0])
