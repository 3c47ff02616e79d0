"""The registered queries in DuckDB SQL, written from the definitions of the metrics.

Column metrics are spelled out column by column: every value is a scalar subquery over
the table, so the SQL shares no structure with the Spark plans it checks.
"""

from __future__ import annotations

# Fixed values, written out here so that the SQL does not lean on what it checks.
PATTERNS = {
    'email': r'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b',
    'phone': r'\b(\+\d{1,3}[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}\b',
    'credit_card': r'\b(?:\d{4}[- ]?){3}\d{4}\b',
    'singapore_nric': r'\b[STFG]\d{7}[A-Z]\b',
    'address': r'\b\d+\s+[A-Za-z]+\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd)\b',
    'date_of_birth': r'\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b',
    'ip_address': r'\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b',
}
RISK_LEVELS = {
    "High Risk": (
        "Your data contains sensitive information that needs protection.",
        "Apply masking or anonymization to high-risk fields before sharing.",
    ),
    "Medium Risk": (
        "Your data has some privacy concerns to address.",
        "Review medium-risk fields and consider privacy-enhancing techniques.",
    ),
    "Low Risk": (
        "Your data appears to have good privacy protection.",
        "Continue with your current anonymization approach.",
    ),
}
ADVICE = {
    "High Risk": [
        "Apply data masking or tokenization to personally identifiable information",
        "Consider aggregating or generalizing sensitive fields",
        "Remove unique identifiers or replace with category values",
        "Implement k-anonymity to prevent re-identification",
        "Obtain explicit consent before sharing this dataset",
    ],
    "Medium Risk": [
        "Review and transform high-risk fields to reduce identifiability",
        "Consider data generalization techniques (e.g., age ranges instead of exact ages)",
        "Document privacy measures taken for data sharing compliance",
        "Implement access controls when sharing this dataset",
    ],
    "Low Risk": [
        "Document the privacy-preserving measures already in place",
        "Maintain current anonymization levels in future updates",
        "Consider periodic re-assessment if data structure changes",
    ],
}
RISKY_AND_POOR = (
    "This dataset presents significant privacy risks and poor data quality. Consider substantial revisions before sharing."
)
RISKY_BUT_GOOD = (
    "While the data quality is good, the high privacy risk requires mitigation measures before sharing."
)
SAFE_BUT_POOR = (
    "The data has low privacy risk but poor quality. Focus on improving data quality before sharing."
)
SAFE_AND_GOOD = (
    "This dataset has both low privacy risk and good quality, making it suitable for sharing with minimal changes."
)
IN_BETWEEN = (
    "Consider addressing both privacy and quality aspects before sharing this dataset."
)

N, S, T = "numeric", "string", "datetime"

TABLES: dict[str, dict[str, tuple[str, str]]] = {
    "orders": {
        "o_orderkey": (N, "bigint"),
        "o_custkey": (N, "bigint"),
        "o_orderstatus": (S, "string"),
        "o_totalprice": (N, "double"),
        "o_orderdate": (T, "timestamp_ntz"),
        "o_orderpriority": (S, "string"),
    },
    "customer": {
        "c_custkey": (N, "bigint"),
        "c_name": (S, "string"),
        "c_nationkey": (N, "int"),
        "c_acctbal": (N, "double"),
        "c_mktsegment": (S, "string"),
    },
    "supplier": {
        "s_suppkey": (N, "bigint"),
        "s_name": (S, "string"),
        "s_nationkey": (N, "int"),
        "s_acctbal": (N, "double"),
    },
    "part": {
        "p_partkey": (N, "bigint"),
        "p_name": (S, "string"),
        "p_brand": (S, "string"),
        "p_type": (S, "string"),
        "p_size": (N, "int"),
        "p_retailprice": (N, "double"),
    },
    "lineitem": {
        "l_orderkey": (N, "bigint"),
        "l_partkey": (N, "bigint"),
        "l_suppkey": (N, "bigint"),
        "l_linenumber": (N, "int"),
        "l_quantity": (N, "double"),
        "l_extendedprice": (N, "double"),
        "l_discount": (N, "double"),
        "l_tax": (N, "double"),
        "l_returnflag": (S, "string"),
        "l_linestatus": (S, "string"),
        "l_shipdate": (T, "timestamp_ntz"),
    },
    "documents": {
        "doc_id": (N, "bigint"),
        "text": (S, "string"),
        "lang": (S, "string"),
        "source": (S, "string"),
        "n_chars": (N, "bigint"),
    },
    "events": {
        "event_id": (N, "bigint"),
        "ts": (T, "timestamp_ntz"),
        "user_id": (N, "bigint"),
        "event_type": (S, "string"),
        "value": (N, "double"),
        "props": (S, "string"),
    },
}
TABLES["orders_nulls"] = TABLES["orders"]
TABLES["part_odd"] = {c: t for c, t in TABLES["part"].items() if c != "p_type"}
TABLES["customer_personal"] = {
    "c_custkey": (N, "bigint"),
    "c_name": (S, "string"),
    "c_nric": (S, "string"),
    "c_address": (S, "string"),
    "c_birth": (S, "string"),
    "c_mktsegment": (S, "string"),
}

DERIVED = {
    "orders_nulls": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_totalprice >= 300000 THEN o_totalprice END AS o_totalprice,
               o_orderdate, nullif(o_orderpriority, '3-MEDIUM') AS o_orderpriority
        FROM orders""",
    "customer_personal": """
        SELECT c_custkey, c_name,
               'S' || lpad(c_custkey::VARCHAR, 7, '0') || 'A' AS c_nric,
               (c_custkey + 1)::VARCHAR || ' Orchard Road' AS c_address,
               (c_nationkey + 1)::VARCHAR || '/6/' || (1950 + c_nationkey)::VARCHAR AS c_birth,
               c_mktsegment
        FROM customer""",
    "orders_dates": """
        SELECT o_orderkey,
               CASE WHEN o_orderpriority = '1-URGENT' THEN '2024-02-30'
                    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_date
        FROM orders""",
    "part_odd": """
        SELECT p_partkey,
               CASE WHEN p_size < 15 THEN upper(p_name) WHEN p_size < 30 THEN lower(p_name)
                    ELSE upper(substr(p_name, 1, 1)) || substr(p_name, 2) END AS p_name,
               CASE WHEN p_size = 1 THEN '' ELSE p_brand END AS p_brand,
               p_size,
               CASE WHEN p_size >= 49 THEN 'infinity'::DOUBLE ELSE p_retailprice END
                   AS p_retailprice
        FROM part""",
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_source(source: str, body: str) -> str:
    return f"WITH {source} AS ({DERIVED[source]}) {body}" if source in DERIVED else body


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# --- one column at a time -----------------------------------------------------------


def rows_of(source: str) -> str:
    return f"(SELECT count(*) FROM {source})"


def values_of(source: str, c: str) -> str:
    return f"(SELECT count({c}) FROM {source})"


def missing_of(source: str, c: str) -> str:
    return f"({rows_of(source)} - {values_of(source, c)})"


def distinct_of(source: str, c: str) -> str:
    return f"(SELECT count(DISTINCT {c}) FROM {source})"


def ratio(a: str, b: str, empty: str = "0.0::DOUBLE") -> str:
    return f"(CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE {empty} END)"


def missing_share(source: str, c: str) -> str:
    return ratio(missing_of(source, c), rows_of(source))


def skip(source: str, c: str, value: str, neutral: str) -> str:
    return f"(CASE WHEN {missing_share(source, c)} > 0.5 THEN {neutral}::DOUBLE ELSE {value} END)"


def groups_of(source: str, c: str) -> str:
    keep = "" if TABLES[source][c][0] in (N, T) else f"WHERE {c} IS NOT NULL"
    return f"(SELECT count(*)::DOUBLE AS f FROM {source} {keep} GROUP BY {c})"


def factor_of(source: str, c: str) -> str:
    return f"(SELECT coalesce(avg(1.0::DOUBLE - 1.0::DOUBLE / f), 1.0::DOUBLE) FROM {groups_of(source, c)})"


def entropy_of(source: str, c: str) -> str:
    n = rows_of(source)
    return f"(SELECT abs(coalesce(sum(f / {n} * log2(f / {n})), 0.0::DOUBLE)) FROM {groups_of(source, c)})"


def hartley_of(source: str, c: str) -> str:
    d = distinct_of(source, c)
    return f"(CASE WHEN {d} > 1 THEN log10({d}) ELSE 0.0::DOUBLE END)"


def unique_of(source: str, c: str) -> str:
    return f"least(1.0::DOUBLE, {ratio(distinct_of(source, c), rows_of(source))})"


def hits_of(source: str, c: str, pattern: str) -> str:
    return (
        f"(SELECT count(*) FROM {source} WHERE regexp_matches({c}, {quoted(PATTERNS[pattern])}))"
    )


def sensitive_of(source: str, c: str) -> str:
    if TABLES[source][c][0] != S:
        return "0.0::DOUBLE"
    total = " + ".join(hits_of(source, c, p) for p in PATTERNS)
    return f"least(1.0::DOUBLE, {ratio(total, rows_of(source))})"


def sensitive_names(source: str, c: str) -> str:
    if TABLES[source][c][0] != S:
        return "'None'"
    names = ", ".join(f"CASE WHEN {hits_of(source, c, p)} > 0 THEN '{p}' END" for p in PATTERNS)
    return f"coalesce(nullif(concat_ws(', ', {names}), ''), 'None')"


def risk_of(source: str, c: str) -> str:
    return f"(0.7::DOUBLE * {unique_of(source, c)} + 0.3::DOUBLE * {sensitive_of(source, c)})"


METRICS = {
    "privacy_risk_score": lambda s, c: skip(s, c, risk_of(s, c), "0.0"),
    "uniqueness_score": lambda s, c: skip(s, c, unique_of(s, c), "0.0"),
    "sensitive_data_score": lambda s, c: skip(s, c, sensitive_of(s, c), "0.0"),
    "sensitivity_type": sensitive_names,
    "privacy_factor": lambda s, c: skip(s, c, factor_of(s, c), "1.0"),
    "shannon_entropy": lambda s, c: skip(s, c, entropy_of(s, c), "0.0"),
    "hartley_measure": lambda s, c: skip(s, c, hartley_of(s, c), "0.0"),
}
TEXT_METRICS = ("sensitivity_type",)


def column_rows(source: str, metrics: list[str]) -> str:
    """SELECTs of ``ix``, ``column_name`` and metrics, one per column, unrounded."""
    return union(
        [
            f"SELECT {ix} AS ix, '{c}' AS column_name, "
            + ", ".join(f"{METRICS[m](source, c)} AS {m}" for m in metrics)
            for ix, c in enumerate(TABLES[source])
        ]
    )


def rounded(metric: str) -> str:
    return metric if metric in TEXT_METRICS else f"round({metric}, 6) AS {metric}"


def column_metrics(source: str, *metrics: str) -> str:
    shown = ", ".join(map(rounded, metrics))
    body = f"SELECT column_name, {shown} FROM ({column_rows(source, list(metrics))})"
    return with_source(source, body)


def names(condition: str) -> str:
    return f"coalesce(string_agg(column_name, ', ' ORDER BY ix) FILTER ({condition}), '')"


def summary(source: str) -> str:
    rows = column_rows(
        source, ["privacy_risk_score", "privacy_factor", "shannon_entropy", "hartley_measure"]
    )
    risk = "privacy_risk_score"
    high, medium, low = f"{risk} > 0.7::DOUBLE", f"{risk} > 0.3::DOUBLE AND {risk} <= 0.7::DOUBLE", f"{risk} <= 0.3::DOUBLE"
    return f"""
        SELECT avg({risk}) AS overall_privacy_score,
               product(privacy_factor) AS overall_privacy_factor,
               avg(shannon_entropy) AS avg_shannon_entropy,
               avg(hartley_measure) AS avg_hartley_measure,
               {names(high)} AS high_risk_columns,
               {names(medium)} AS medium_risk_columns,
               {names(low)} AS low_risk_columns,
               count(*) AS total_columns,
               count(*) FILTER ({high}) AS high_risk_count,
               count(*) FILTER ({medium}) AS medium_risk_count,
               count(*) FILTER ({low}) AS low_risk_count
        FROM ({rows})"""


def category(score: str) -> str:
    return (
        f"CASE WHEN {score} > 0.7::DOUBLE THEN 'High Risk' "
        f"WHEN {score} > 0.3::DOUBLE THEN 'Medium Risk' ELSE 'Low Risk' END"
    )


def level_text(position: int) -> str:
    whens = " ".join(
        f"WHEN '{level}' THEN {quoted(texts[position])}" for level, texts in RISK_LEVELS.items()
    )
    return f"CASE risk_level {whens} END"


def ranked(source: str) -> str:
    metrics = ["privacy_risk_score", "privacy_factor", "shannon_entropy", "hartley_measure"]
    rows = column_rows(source, metrics)
    return union(
        [
            f"SELECT '{m}' AS metric, (row_number() OVER (ORDER BY round({m}, 9) DESC, ix))::INTEGER AS rank, "
            f"column_name, round({m}, 6) AS score FROM ({rows})"
            for m in metrics
        ]
    )


def pii(source: str, columns: list[str]) -> str:
    return union(
        [
            f"SELECT '{c}' AS column_name, {rows_of(source)} AS total_count, "
            + ", ".join(f"{hits_of(source, c, p)} AS {p}" for p in PATTERNS)
            for c in columns
        ]
    )


# --- quality -----------------------------------------------------------------------------


def bad_values(source: str, c: str) -> str:
    kind, dtype = TABLES[source][c]
    if kind == N and dtype == "double":
        return f"(SELECT count(*) FROM {source} WHERE isinf({c}))"
    if kind == S:
        return f"(SELECT count(*) FROM {source} WHERE coalesce({c}, '') = '')"
    return "0::BIGINT"


def validity_of(source: str, c: str) -> str:
    kind, _ = TABLES[source][c]
    if kind == T:
        return "1.0::DOUBLE"
    whole = values_of(source, c) if kind == N else rows_of(source)
    return f"(1.0::DOUBLE - {ratio(bad_values(source, c), whole)})"


def dup_of(source: str, c: str) -> str:
    return f"({values_of(source, c)} - {distinct_of(source, c)})"


def unique_share(source: str, c: str) -> str:
    return ratio(distinct_of(source, c), values_of(source, c), "1.0::DOUBLE")


def is_id(c: str) -> str:
    return str(any(mark in c for mark in ("id", "key", "code", "num", "uuid"))).upper()


def case_counts(source: str, c: str) -> tuple[str, str, str]:
    lower = f"(SELECT count(*) FROM {source} WHERE {c} = lower({c}) AND {c} <> upper({c}))"
    upper = f"(SELECT count(*) FROM {source} WHERE {c} = upper({c}) AND {c} <> lower({c}))"
    return lower, upper, f"({values_of(source, c)} - {lower} - {upper})"


def whole_numbers(source: str, c: str) -> str:
    if TABLES[source][c][1] == "double":
        return f"(SELECT count(*) FROM {source} WHERE isfinite({c}) AND {c} = floor({c}))"
    return values_of(source, c)


def case_score(source: str, c: str) -> str:
    if TABLES[source][c][0] != S:
        return "1.0::DOUBLE"
    most = "greatest({}, {}, {})".format(*case_counts(source, c))
    return ratio(most, values_of(source, c), "1.0::DOUBLE")


def format_score(source: str, c: str) -> str:
    if TABLES[source][c][0] != N:
        return "1.0::DOUBLE"
    whole = whole_numbers(source, c)
    most = f"greatest({whole}, {values_of(source, c)} - {whole})"
    return ratio(most, values_of(source, c), "1.0::DOUBLE")


def consistency_rows(source: str) -> str:
    parts = []
    for c, (kind, _) in TABLES[source].items():
        counts = case_counts(source, c) if kind == S else ("0::BIGINT",) * 3
        whole = whole_numbers(source, c) if kind == N else "0::BIGINT"
        fraction = f"({values_of(source, c)} - {whole})" if kind == N else "0::BIGINT"
        parts.append(
            f"SELECT '{c}' AS column_name, round({case_score(source, c)}, 6) AS case_consistency_score, "
            f"round({format_score(source, c)}, 6) AS format_consistency_score, "
            f"{counts[0]} AS lowercase_count, {counts[1]} AS uppercase_count, "
            f"{counts[2]} AS mixed_case_count, {whole} AS integer_count, {fraction} AS float_count"
        )
    return union(parts)


def legacy_rows(source: str) -> str:
    parts = []
    for c, (kind, _) in TABLES[source].items():
        lower, upper, mixed = case_counts(source, c) if kind == S else ("0::BIGINT",) * 3
        score = (
            ratio(f"greatest({lower}, {upper})", values_of(source, c), "1.0::DOUBLE")
            if kind == S
            else "1.0::DOUBLE"
        )
        parts.append(
            f"SELECT '{c}' AS column_name, round({score}, 6) AS case_consistency_score, "
            f"{lower} AS lowercase_count, {upper} AS uppercase_count, {mixed} AS mixed_case_count"
        )
    return union(parts)


def inferred(source: str, c: str) -> str:
    kind, _ = TABLES[source][c]
    if kind == N:
        whole = f"{whole_numbers(source, c)} = {values_of(source, c)}"
        return f"(CASE WHEN {whole} THEN 'integer' ELSE 'float' END)"
    return "'datetime'" if kind == T else "'string'"


def quality_rows(source: str) -> str:
    return union(
        [
            f"SELECT {ix} AS ix, '{c}' AS column_name, {inferred(source, c)} AS data_type, "
            f"{rows_of(source)} AS n, {values_of(source, c)} AS v, "
            f"{missing_share(source, c)} AS missing, "
            f"{validity_of(source, c)} AS validity, "
            f"1.0::DOUBLE - {ratio(dup_of(source, c), values_of(source, c))} AS uniqueness, "
            f"{unique_share(source, c)} AS unique_share, "
            f"{is_id(c)} AS named, "
            f"{ratio(distinct_of(source, c), values_of(source, c))} AS unique_ratio, "
            f"{case_score(source, c)} AS case_score, {format_score(source, c)} AS format_score"
            for ix, c in enumerate(TABLES[source])
        ]
    )


def duplicates_of(source: str) -> str:
    return f"(SELECT count(*) FROM {source}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source}))"


INTEGRITY = """coalesce(
    avg(1.0::DOUBLE - missing) FILTER (named OR unique_ratio > 0.9::DOUBLE) * 0.7::DOUBLE
      + avg(1.0::DOUBLE - missing) FILTER (NOT (named OR unique_ratio > 0.9::DOUBLE)) * 0.3::DOUBLE,
    avg(1.0::DOUBLE - missing))"""


def quality_scores(source: str) -> str:
    row_score = f"(1.0::DOUBLE - ({duplicates_of(source)})::DOUBLE / {rows_of(source)})"
    return f"""
        SELECT *, 0.25::DOUBLE * completeness + 0.2::DOUBLE * accuracy + 0.15::DOUBLE * validity
                  + 0.15::DOUBLE * uniqueness + 0.1::DOUBLE * integrity
                  + 0.15::DOUBLE * consistency AS overall_quality_score
        FROM (SELECT sum(v)::DOUBLE / sum(n)::DOUBLE AS completeness,
                     1.0::DOUBLE AS accuracy,
                     avg(validity) AS validity,
                     (sum(uniqueness) + {row_score}) / (count(*) + 1) AS uniqueness,
                     {INTEGRITY} AS integrity,
                     (sum(case_score) + sum(format_score)) / (2 * count(*)) AS consistency
              FROM ({quality_rows(source)}))"""


SCORES = (
    "completeness",
    "accuracy",
    "validity",
    "uniqueness",
    "integrity",
    "consistency",
    "overall_quality_score",
)


def quality_table(source: str) -> str:
    def two(x: str) -> str:
        return f"printf('%.2f', {x})"

    def percent(x: str) -> str:
        return f"printf('%.1f%%', ({x}) * 100)"

    return with_source(
        source,
        f"""SELECT column_name, data_type, {two('1.0::DOUBLE - missing')} AS completeness,
               {percent('missing')} AS missing_percent, '1.00' AS accuracy,
               {two('validity')} AS validity, {two('uniqueness')} AS uniqueness,
               {percent('unique_share')} AS unique_percent,
               {two('1.0::DOUBLE - missing')} || CASE WHEN named THEN ' (ID)' ELSE '' END
                   AS integrity,
               {two('case_score')} AS consistency
            FROM ({quality_rows(source)})""",
    )


# --- constraints -----------------------------------------------------------------------------


def constraint(
    ix: int, source: str, column: str, kind: str, value: str, test: str, complaint: str
) -> str:
    """A constraint checked cell by cell with a boolean SQL test."""
    whole = rows_of(source) if kind == "not_null" else values_of(source, column)
    good = f"(SELECT count(*) FROM {source} WHERE {test})"
    if kind == "unique":
        good = distinct_of(source, column)
    rate = ratio(good, whole, "1.0::DOUBLE")
    if kind == "unique":
        rate = f"(CASE WHEN {good} = {whole} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    return (
        f"SELECT {ix} AS constraint_ix, '{column}' AS \"column\", '{kind}' AS type, "
        f"{quoted(value)} AS value, {rate} = 1.0 AS passed, "
        f"CASE WHEN {rate} = 1.0 THEN '' ELSE ({whole} - {good})::VARCHAR || {quoted(' ' + complaint)} END "
        f"AS error, round({rate}, 6) AS pass_rate"
    )


def settled(ix: int, column: str, kind: str, value: str, passed: bool, error: str) -> str:
    return (
        f"SELECT {ix} AS constraint_ix, '{column}' AS \"column\", '{kind}' AS type, "
        f"{quoted(value)} AS value, {str(passed).upper()} AS passed, {quoted(error)} AS error, "
        f"{1.0 if passed else 0.0}::DOUBLE AS pass_rate"
    )


LINEITEM_RESULTS = union(
    [
        constraint(0, "lineitem", "l_orderkey", "not_null", "", "l_orderkey IS NOT NULL", "null values found"),
        constraint(1, "lineitem", "l_orderkey", "unique", "", "", "duplicate values found"),
        constraint(2, "lineitem", "l_quantity", "min_value", "10", "l_quantity >= 10", "values below minimum"),
        constraint(3, "lineitem", "l_discount", "max_value", "0.05", "l_discount <= 0.05::DOUBLE", "values above maximum"),
        constraint(4, "lineitem", "l_returnflag", "regex", "[AN]", "regexp_matches(l_returnflag, '^[AN]')", "values don't match pattern"),
        constraint(5, "lineitem", "l_linestatus", "value_in_list", "F", "l_linestatus IN ('F')", "values not in allowed list"),
        settled(6, "l_shipdate", "date_format", "%Y-%m-%d", True, ""),
        settled(7, "l_returnflag", "min_value", "1", False, "Column is not numeric"),
        settled(8, "l_tax", "max_value", "x", False, "Invalid maximum value"),
        settled(9, "missing_col", "not_null", "", False, "Column not found in dataset"),
        settled(10, "l_tax", "foo", "", False, "Unknown constraint type"),
    ]
)


# --- assessment ------------------------------------------------------------------------------


def assessed(source: str) -> str:
    p, q = "overall_privacy_score", "overall_quality_score"
    return f"""
        SELECT '{source}' AS dataset, round({p}, 6) AS {p}, round({q}, 6) AS {q},
               CASE WHEN {p} < 0.4 THEN 'low' WHEN {p} < 0.7 THEN 'medium' ELSE 'high' END
                   AS privacy_level,
               CASE WHEN {q} < 0.4 THEN 'poor' WHEN {q} < 0.7 THEN 'moderate' ELSE 'good' END
                   AS quality_level,
               CASE WHEN {p} > 0.7 AND {q} < 0.4 THEN {quoted(RISKY_AND_POOR)}
                    WHEN {p} > 0.7 AND {q} > 0.7 THEN {quoted(RISKY_BUT_GOOD)}
                    WHEN {p} < 0.4 AND {q} < 0.4 THEN {quoted(SAFE_BUT_POOR)}
                    WHEN {p} < 0.4 AND {q} > 0.7 THEN {quoted(SAFE_AND_GOOD)}
                    ELSE {quoted(IN_BETWEEN)} END AS recommendation
        FROM ({summary(source)}), ({quality_scores(source)})"""


# --- corpus --------------------------------------------------------------------------------

CHUNKS = """
    SELECT doc_id, (start // 800)::INTEGER AS chunk_index, start::INTEGER AS start,
           substring(text, start::INTEGER + 1, 1000) AS chunk_text
    FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 200, 1), 800)) AS start
          FROM documents WHERE length(text) > 0)"""


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def section(text: str) -> str:
    lines = (
        f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {stripped('x')}), "
        "lambda x: x <> '')"
    )
    return (
        f"CASE WHEN len({lines}) = 0 THEN 'Unknown section' "
        f"WHEN length({lines}[1]) > 100 THEN left({lines}[1], 100) || '...' ELSE {lines}[1] END"
    )


def phrases(text: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex({text}, '[.!?]\\s+'), "
        f"lambda x: {stripped('x')}), lambda x: length(x) >= 10)[1:3]"
    )


NEIGHBOURS = """
    parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
                     generate_subscripts(embedding, 1) AS pos FROM embeddings),
    means AS (SELECT label, pos, avg(x) AS m FROM parts GROUP BY label, pos),
    pairs AS (SELECT means.label::BIGINT AS query_id, vec_id AS id, sum((x - m) * (x - m)) AS distance
              FROM parts JOIN means USING (pos) GROUP BY ALL),
    nearest AS (SELECT query_id, id, distance,
                       row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
                FROM pairs),
    results AS (SELECT * FROM nearest WHERE rank <= 5)"""

CITED = f"""{NEIGHBOURS},
    cited AS (SELECT query_id, rank::INTEGER AS rank, 'citation-' || rank AS citation_id, source,
                     string_split(source, '/')[-1] AS source_filename, '0' AS page,
                     text AS content, distance AS score, {section('text')} AS section
              FROM results JOIN documents ON id = doc_id)"""

# The benchmark items as citations, five to a query, numbered by their place in the list.
CITED_ITEMS = f"""
    SELECT item_id // 5 AS query_id, row_number() OVER (PARTITION BY item_id // 5 ORDER BY item_id) AS n,
           {section('text')} AS section, {phrases('text')} AS phrases FROM benchmark"""

RESPONSES = """
    SELECT doc_id AS response_id, doc_id % (SELECT max(item_id) // 5 + 1 FROM benchmark) AS query_id,
           text FROM documents"""

ATTRIBUTION = f"""
    WITH hits AS (SELECT response_id, n, section,
                         section <> 'Unknown section' AND contains(text, section) AS titled,
                         list_filter(phrases, lambda p: length(p) > 15 AND contains(text, p)) AS found
                  FROM ({RESPONSES}) JOIN ({CITED_ITEMS}) USING (query_id))
    SELECT response_id, n::INTEGER AS n, CASE WHEN titled THEN 'section' ELSE 'phrase' END AS kind,
           CASE WHEN titled THEN section ELSE found[1] END AS hit
    FROM hits WHERE titled OR len(found) > 0"""


def marked(responses: str, cited: str) -> str:
    """CTEs up to ``finished`` (response_id, query_id, citation_count, marked).

    Existing markers are numbered by first appearance as far as the list of citations
    goes. Otherwise markers go in one citation after the other, each looking at the text
    so far.
    """
    place = "list_position(seen, ms[i])"
    return f"""
    RECURSIVE cited_items AS ({cited}),
    lists AS (SELECT query_id, count(*) AS k FROM cited_items GROUP BY query_id),
    responses AS (SELECT r.*, coalesce(k, 0) AS k, regexp_extract_all(text, '\\[([0-9]+)\\]', 1) AS ms
                  FROM ({responses}) r LEFT JOIN lists USING (query_id)),
    old AS (SELECT response_id, k, ms, string_split_regex(text, '\\[[0-9]+\\]') AS pieces,
                   list_filter(ms, lambda m, i: list_position(ms, m) = i) AS seen
            FROM responses WHERE k > 0 AND len(ms) > 0),
    renumbered AS (SELECT response_id, array_to_string(list_transform(pieces, lambda piece, i:
                       piece || CASE WHEN i > len(ms) THEN ''
                                     WHEN {place} <= k THEN '[' || {place} || ']'
                                     ELSE '[' || ms[i] || ']' END), '') AS text FROM old),
    fold AS (
        SELECT response_id, query_id, 0::BIGINT AS n, k, text AS marked FROM responses
        WHERE k > 0 AND len(ms) = 0
        UNION ALL
        SELECT response_id, query_id, n, k,
               CASE WHEN words IS NULL THEN marked
                    ELSE replace(marked, words, words || ' [' || n || ']') END
        FROM (SELECT f.response_id, f.query_id, c.n, f.k, f.marked,
                     CASE WHEN section <> 'Unknown section' AND contains(f.marked, section)
                          THEN section
                          ELSE list_filter(phrases, lambda p: length(p) > 15
                                                              AND contains(f.marked, p))[1]
                     END AS words
              FROM fold f JOIN cited_items c ON c.query_id = f.query_id AND c.n = f.n + 1)),
    finished AS (
        SELECT r.response_id, r.query_id, r.k::INTEGER AS citation_count,
               coalesce(o.text, f.marked, r.text) AS marked
        FROM responses r LEFT JOIN renumbered o ON o.response_id = r.response_id
        LEFT JOIN fold f ON f.response_id = r.response_id AND f.n = f.k)"""


MARKUP = f"""WITH {marked(RESPONSES, CITED_ITEMS)}
    SELECT response_id, citation_count, marked AS marked_text FROM finished"""

ANSWERS = f"""
    SELECT conv_id || '/' || turn AS response_id, conv_id % 12 AS query_id,
           CASE turn % 4 WHEN 0 THEN text || ' ' || coalesce(title, '') || ' again ' || coalesce(title, '')
                         WHEN 1 THEN text || ' [7] and [3], [7]'
                         WHEN 2 THEN coalesce(phrase, '') || '. ' || text
                         ELSE text END AS text
    FROM (SELECT *, conv_id % 12 AS q FROM conversations WHERE role = 'assistant')
    LEFT JOIN (SELECT query_id AS q, section AS title FROM cited WHERE rank = 1) USING (q)
    LEFT JOIN (SELECT query_id AS q, {phrases('content')}[1] AS phrase FROM cited WHERE rank = 2) USING (q)"""

FINISHED = f"""
    WITH {marked(
        f"WITH {CITED} {ANSWERS}",
        f"WITH {CITED} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, "
        f"section, {phrases('content')} AS phrases FROM cited",
    )},
    listed AS (
        WITH {CITED}
        SELECT query_id, '**References:**' || chr(10) || string_agg('[' || n || '] ' || source_filename ||
                   CASE WHEN section <> 'Unknown section' THEN ': ' || section ELSE '' END,
                   chr(10) ORDER BY n) AS lines
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM cited)
        GROUP BY query_id)
    SELECT response_id, citation_count,
           marked || CASE WHEN lines IS NULL THEN '' ELSE chr(10) || chr(10) || lines END AS content
    FROM finished LEFT JOIN listed USING (query_id)"""


# The messages of the prompts, with the figures of the customer table.
PROMPTS = f"""
    WITH {CITED},
    contexts AS (SELECT query_id AS label, string_agg('Document ' || rank || ' [#' || citation_id || '] (Source: ' ||
                        source_filename || ', Page: ' || page || '):' || chr(10) || content || chr(10),
                        chr(10) ORDER BY rank) AS context FROM cited GROUP BY query_id),
    private AS (SELECT '{{"overall_privacy_score":' || round(overall_privacy_score, 6) ||
                       ',"high_risk_columns":"' || high_risk_columns ||
                       '","high_risk_count":' || high_risk_count || '}}' AS told FROM ({summary('customer')})),
    sound AS (SELECT '{{"completeness":' || round(completeness, 6) || ',"validity":' || round(validity, 6) ||
                     ',"overall_quality_score":' || round(overall_quality_score, 6) || '}}' AS told
              FROM ({quality_scores('customer')})),
    asked AS (SELECT conv_id || '/' || turn AS query_id, conv_id % 12 AS label, text FROM conversations
              WHERE role = 'user')
    SELECT query_id, 0 AS position, 'system' AS role,
           'You advise owners of a dataset on its privacy risks and its quality before they share '
           || 'it. Tie every recommendation to the figures below, name the trade-offs, and decline '
           || 'questions that are not about data sharing.' || chr(10) || chr(10)
           || 'Current dataset context:' || chr(10) || private.told || chr(10) || sound.told || chr(10) AS content
    FROM asked, private, sound
    UNION ALL
    SELECT query_id, 1, 'system', 'Relevant Singapore policy information: '
           || coalesce(context, 'No specific Singapore policy information found for this query.')
    FROM asked LEFT JOIN contexts USING (label)
    UNION ALL
    SELECT query_id, 2, 'system', 'When referencing policies, use citation markers like [1], [2], etc. '
           || 'and provide a list of references at the end.' FROM asked
    UNION ALL
    SELECT query_id, 3, 'human', text FROM asked"""


def report(source: str) -> str:
    """The report row of a table, every column taken to be accurate."""
    levels = assessed(source)
    return f"""
        SELECT {rows_of(source)} AS num_rows, {len(TABLES[source])} AS num_columns,
               {quoted(', '.join(TABLES[source]))} AS column_names,
               a.overall_privacy_score, a.overall_quality_score,
               high_risk_count, medium_risk_count, low_risk_count,
               round(completeness, 6) AS completeness_score, round(accuracy, 6) AS accuracy_score,
               round(consistency, 6) AS consistency_score, round(uniqueness, 6) AS uniqueness_score,
               round(validity, 6) AS validity_score, privacy_level, quality_level, recommendation
        FROM ({levels}) a, ({summary(source)}), ({quality_scores(source)})"""


def frequencies(source: str) -> str:
    return union(
        [
            f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS freq "
            f"FROM {source} GROUP BY {c}"
            for c in TABLES[source]
        ]
    )


FEEDBACK = """
    SELECT user_id AS message_id, event_type AS feedback, CAST(ts AS VARCHAR) AS ts
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
          FROM events) WHERE r = 1"""


def orders_factors(having: str = "") -> str:
    return (
        "SELECT round(product(privacy_factor), 6) AS overall_privacy_factor FROM "
        f"({column_rows('orders', ['privacy_factor'])}) {having}"
    )


WINDOW_MEASURES = """count(*) AS rows, count(value) AS present, round(sum(value), 6) AS total,
    round(min(value), 6) AS least, round(max(value), 6) AS most"""

HOURLY = f"""
    SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS from_time,
        CAST(date_trunc('hour', ts) + INTERVAL 1 HOUR AS VARCHAR) AS until_time,
        event_type, {WINDOW_MEASURES}
    FROM events WHERE ts IS NOT NULL GROUP BY date_trunc('hour', ts), event_type"""

SESSIONS = f"""
    SELECT CAST(min(ts) AS VARCHAR) AS from_time,
        CAST(max(ts) + INTERVAL 30 MINUTE AS VARCHAR) AS until_time, user_id, {WINDOW_MEASURES}
    FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
            SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
            FROM events WHERE ts IS NOT NULL))
    GROUP BY user_id, session"""


def identifying(source: str, columns: list[str], k: int, largest: int) -> str:
    """Every set of columns is counted; a set is a number with one bit per column."""
    sets = []
    for mask in range(1, 2 ** len(columns)):
        chosen = [c for i, c in enumerate(columns) if mask >> i & 1]
        if len(chosen) <= largest:
            sets.append(
                f"SELECT {mask} AS mask, '{', '.join(chosen)}' AS columns, {len(chosen)} AS size, "
                f"min(n) AS smallest_group, sum(CASE WHEN n < {k} THEN n ELSE 0 END) AS rows_below "
                f"FROM (SELECT count(*) AS n FROM {source} GROUP BY {', '.join(chosen)})"
            )
    return (
        f"WITH sets AS ({union(sets)}), bad AS (SELECT * FROM sets WHERE smallest_group < {k}) "
        "SELECT columns, CAST(size AS INTEGER) AS size, smallest_group, "
        "CAST(rows_below AS BIGINT) AS rows_below FROM bad AS b WHERE NOT EXISTS "
        "(SELECT 1 FROM bad AS s WHERE s.mask <> b.mask AND (s.mask & b.mask) = s.mask)"
    )


ORACLES: dict[str, str] = {
    # sources
    "load_normalized": "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer",
    "dataset_overview": "SELECT count(*) AS num_rows, 6 AS num_columns, "
    f"{quoted(', '.join(TABLES['orders']))} AS column_names FROM orders",
    "corpus_load": "SELECT doc_id, source, 0 AS page, text FROM documents",
    "chunk_store": f"SELECT c.doc_id, chunk_index, chunk_text, coalesce(len(embedding), 0)::INTEGER AS dimensions, "
    "round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last "
    f"FROM ({CHUNKS}) c LEFT JOIN embeddings ON vec_id = c.doc_id",
    "corpus_stats": "SELECT count(*) AS document_chunks, count(DISTINCT doc_id) AS documents, "
    f"CASE WHEN count(*) = 0 THEN 'No documents ingested' ELSE 'Ready' END AS status FROM ({CHUNKS})",
    # column primitives
    "missing_values": with_source(
        "orders_nulls",
        union(
            [
                f"SELECT '{c}' AS column_name, {missing_of('orders_nulls', c)} AS missing_count, "
                f"round({missing_share('orders_nulls', c)}, 6) AS missing_percentage"
                for c in TABLES["orders_nulls"]
            ]
        ),
    ),
    "data_types": union(
        [
            f"SELECT '{c}' AS column_name, '{dtype}' AS dtype, {inferred('lineitem', c)} AS inferred_type, "
            f"{distinct_of('lineitem', c)} AS unique_values, "
            f"round({ratio(distinct_of('lineitem', c), rows_of('lineitem'))}, 6) AS unique_percentage"
            for c, (_, dtype) in TABLES["lineitem"].items()
        ]
    ),
    "value_frequencies": frequencies("orders"),
    "distinct_counts": union(
        [
            f"SELECT '{c}' AS column_name, {distinct_of('lineitem', c)} AS distinct_count"
            for c in TABLES["lineitem"]
        ]
    ),
    "column_samples": "SELECT column_name, rank::INTEGER AS rank, value FROM (SELECT column_name, value, "
    "row_number() OVER (PARTITION BY column_name ORDER BY md5(value)) AS rank FROM ("
    + union(
        [f"SELECT DISTINCT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM customer" for c in TABLES["customer"]]
    )
    + ")) WHERE rank <= 5",
    "duplicate_rows": "SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_type, user_id FROM events)) AS duplicate_rows FROM events",
    # privacy
    "uniqueness_risk": column_metrics("customer", "uniqueness_score"),
    "pii_counts": union([pii("documents", ["text"]), pii("pages", ["html", "url"])]),
    "pii_counts_injected": with_source(
        "customer_personal",
        pii("customer_personal", ["c_name", "c_nric", "c_address", "c_birth", "c_mktsegment"]),
    ),
    "pattern_match_count": f"SELECT {hits_of('documents', 'text', 'email')} AS match_count",
    "sensitivity": column_metrics("documents", "sensitive_data_score", "sensitivity_type"),
    "privacy_risk": column_metrics(
        "documents",
        "privacy_risk_score",
        "uniqueness_score",
        "sensitive_data_score",
        "sensitivity_type",
    ),
    "privacy_factor": column_metrics("orders", "privacy_factor"),
    "shannon_entropy": column_metrics("orders", "shannon_entropy"),
    "hartley_measure": column_metrics("orders", "hartley_measure"),
    "entropy_profile": column_metrics(
        "lineitem", "privacy_factor", "shannon_entropy", "hartley_measure"
    ),
    "entropy_profile_nulls": column_metrics(
        "orders_nulls", "privacy_factor", "shannon_entropy", "hartley_measure"
    ),
    "risk_advice": f"SELECT s.risk_level, ord, advice FROM (SELECT {category('overall_privacy_score')} AS risk_level FROM ({summary('customer')})) s "
    "JOIN ("
    + union(
        [
            f"SELECT '{level}' AS risk_level, {i} AS ord, {quoted(text)} AS advice"
            for level, items in ADVICE.items()
            for i, text in enumerate(items, 1)
        ]
    )
    + ") a ON a.risk_level = s.risk_level",
    "cumulative_factor": orders_factors(),
    "cumulative_factor_subset": orders_factors(
        "WHERE column_name IN ('o_custkey', 'o_totalprice', 'o_orderdate', 'no_such_column')"
    ),
    "entropy_summary": "SELECT round(product(privacy_factor), 6) AS overall_privacy_factor, "
    "round(avg(privacy_factor), 6) AS avg_privacy_factor, round(avg(shannon_entropy), 6) AS avg_shannon_entropy, "
    "round(avg(hartley_measure), 6) AS avg_hartley_measure FROM "
    f"({column_rows('orders', ['privacy_factor', 'shannon_entropy', 'hartley_measure'])})",
    "factor_buckets": f"SELECT {names('privacy_factor < 0.3')} AS high_risk_columns, "
    f"{names('privacy_factor >= 0.3 AND privacy_factor < 0.7')} AS medium_risk_columns, "
    f"{names('privacy_factor >= 0.7')} AS low_risk_columns FROM ({column_rows('orders', ['privacy_factor'])})",
    "privacy_profile": column_metrics("documents", *METRICS),
    "privacy_summary": "SELECT round(overall_privacy_score, 6) AS overall_privacy_score, "
    "round(overall_privacy_factor, 6) AS overall_privacy_factor, round(avg_shannon_entropy, 6) AS avg_shannon_entropy, "
    "round(avg_hartley_measure, 6) AS avg_hartley_measure, high_risk_columns, medium_risk_columns, low_risk_columns, "
    f"total_columns, high_risk_count, medium_risk_count, low_risk_count FROM ({summary('documents')})",
    "risk_category": f"SELECT column_name, {category('privacy_risk_score')} AS risk_category FROM "
    f"({column_rows('documents', ['privacy_risk_score'])})",
    "dataset_risk_level": f"SELECT round(overall_privacy_score, 6) AS overall_privacy_score, risk_level, "
    f"{level_text(0)} AS risk_description, {level_text(1)} AS risk_action FROM "
    f"(SELECT *, {category('overall_privacy_score')} AS risk_level FROM ({summary('documents')}))",
    "risk_distribution": union(
        [
            f"SELECT '{level} Risk' AS risk_category, {level.lower()}_risk_count AS column_count, "
            f"round({level.lower()}_risk_count::DOUBLE / total_columns * 100, 6) AS column_percent "
            f"FROM ({summary('documents')})"
            for level in ("High", "Medium", "Low")
        ]
    ),
    "ranked_columns": ranked("orders"),
    "high_risk_columns": with_source(
        "customer_personal",
        "SELECT column_name, round(privacy_risk_score, 6) AS privacy_risk_score, sensitivity_type FROM "
        f"({column_rows('customer_personal', ['privacy_risk_score', 'sensitivity_type'])}) "
        "WHERE privacy_risk_score > 0.7::DOUBLE",
    ),
    # quality
    "completeness": with_source(
        "orders_nulls",
        union(
            [
                f"SELECT '{c}' AS column_name, {missing_of('orders_nulls', c)} AS missing_count, "
                f"round({missing_share('orders_nulls', c)}, 6) AS missing_percentage, "
                f"round(1.0::DOUBLE - {missing_share('orders_nulls', c)}, 6) AS completeness_score"
                for c in TABLES["orders_nulls"]
            ]
        ),
    ),
    "completeness_overall": with_source(
        "orders_nulls",
        "SELECT sum(n)::BIGINT AS total_cells, sum(v)::BIGINT AS non_missing_cells, "
        "(sum(n) - sum(v))::BIGINT AS missing_cells, round(sum(v)::DOUBLE / sum(n)::DOUBLE, 6) AS overall_score "
        f"FROM ({quality_rows('orders_nulls')})",
    ),
    "validity": with_source(
        "part_odd",
        union(
            [
                f"SELECT '{c}' AS column_name, {bad_values('part_odd', c)} AS invalid_count, "
                f"round({validity_of('part_odd', c)}, 6) AS validity_score"
                for c in TABLES["part_odd"]
            ]
        ),
    ),
    "validity_overall": with_source(
        "part_odd",
        f"SELECT round(avg(validity), 6) AS overall_score FROM ({quality_rows('part_odd')})",
    ),
    "uniqueness": union(
        [
            f"SELECT '{c}' AS column_name, {dup_of('orders', c)} AS duplicate_count, "
            f"round({unique_share('orders', c)}, 6) AS unique_percentage, "
            f"round(1.0::DOUBLE - {ratio(dup_of('orders', c), values_of('orders', c))}, 6) AS uniqueness_score"
            for c in TABLES["orders"]
        ]
    ),
    "uniqueness_overall": f"SELECT ({duplicates_of('orders')})::BIGINT AS duplicate_rows, "
    f"round(1.0::DOUBLE - ({duplicates_of('orders')})::DOUBLE / {rows_of('orders')}, 6) AS row_uniqueness_score, "
    f"round(uniqueness, 6) AS overall_score FROM ({quality_scores('orders')})",
    "integrity": union(
        [
            f"SELECT '{c}' AS column_name, {is_id(c)} AS is_potential_id, "
            f"round({ratio(distinct_of('lineitem', c), values_of('lineitem', c))}, 6) AS unique_ratio, "
            f"{missing_of('lineitem', c)} AS null_count, "
            f"round(1.0::DOUBLE - {missing_share('lineitem', c)}, 6) AS integrity_score"
            for c in TABLES["lineitem"]
        ]
    ),
    "consistency": with_source(
        "part_odd", union([consistency_rows("part_odd"), consistency_rows("orders")])
    ),
    "consistency_overall": f"SELECT round(consistency, 6) AS overall_score FROM ({quality_scores('orders')})",
    "consistency_legacy": with_source("part_odd", legacy_rows("part_odd")),
    "quality_summary_noacc": f"SELECT {', '.join(map(rounded, SCORES))} FROM ({quality_scores('orders')})",
    "quality_legacy_noacc": with_source(
        "orders_nulls",
        "SELECT round(missing_score, 6) AS missing_score, 1.0::DOUBLE AS outlier_score, "
        "round(consistency_score, 6) AS consistency_score, round(0.5::DOUBLE * missing_score "
        "+ 0.3::DOUBLE + 0.2::DOUBLE * consistency_score, 6) AS overall_quality_score "
        "FROM (SELECT 1.0::DOUBLE - avg(missing) AS missing_score, "
        "(sum(case_score) + sum(format_score)) / (2 * count(*)) AS consistency_score "
        f"FROM ({quality_rows('orders_nulls')}))",
    ),
    "column_quality_table_noacc": quality_table("orders_nulls"),
    "dimension_scores": union(
        [
            f"SELECT '{name.title()}' AS dimension, round({name}, 6) AS score FROM ({quality_scores('orders')})"
            for name in SCORES[:-1]
        ]
    ),
    # constraints
    "constraints_all": LINEITEM_RESULTS,
    "constraint_not_null": with_source(
        "orders_nulls",
        union(
            [
                constraint(0, "orders_nulls", "o_orderpriority", "not_null", "", "o_orderpriority IS NOT NULL", "null values found"),
                constraint(1, "orders_nulls", "o_orderkey", "not_null", "", "o_orderkey IS NOT NULL", "null values found"),
            ]
        ),
    ),
    "constraint_unique": union(
        [
            constraint(0, "orders", "o_orderkey", "unique", "", "", "duplicate values found"),
            constraint(1, "orders", "o_custkey", "unique", "", "", "duplicate values found"),
        ]
    ),
    "constraint_min": union(
        [
            constraint(0, "lineitem", "l_quantity", "min_value", "10", "l_quantity >= 10", "values below minimum"),
            constraint(1, "lineitem", "l_tax", "min_value", "", "l_tax >= 0", "values below minimum"),
        ]
    ),
    "constraint_max": union(
        [
            constraint(0, "lineitem", "l_discount", "max_value", "0.05", "l_discount <= 0.05::DOUBLE", "values above maximum"),
            constraint(1, "lineitem", "l_quantity", "max_value", "50", "l_quantity <= 50", "values above maximum"),
        ]
    ),
    "constraint_regex": union(
        [
            constraint(0, "customer", "c_name", "regex", "Customer#[0-9]{9}", "regexp_matches(c_name, '^Customer#[0-9]{9}')", "values don't match pattern"),
            constraint(1, "customer", "c_mktsegment", "regex", "(?P<first>[A-H])", "regexp_matches(c_mktsegment, '^[A-H]')", "values don't match pattern"),
            settled(2, "c_name", "regex", "[", False, "Invalid regex pattern"),
        ]
    ),
    "constraint_in_list": union(
        [
            constraint(0, "orders", "o_orderstatus", "value_in_list", "O, F", "o_orderstatus IN ('O', 'F')", "values not in allowed list"),
            constraint(1, "orders", "o_custkey", "value_in_list", "1, 2, 3.0", "o_custkey IN (1, 2, 3)", "values not in allowed list"),
        ]
    ),
    "constraint_date": with_source(
        "orders_dates",
        union(
            [
                constraint(0, "orders_dates", "o_date", "date_format", "%Y-%m-%d", "try_strptime(o_date, '%Y-%m-%d') IS NOT NULL", "values don't match date format"),
                constraint(1, "orders_dates", "o_date", "date_format", "%d/%m/%Y", "try_strptime(o_date, '%d/%m/%Y') IS NOT NULL", "values don't match date format"),
            ]
        ),
    ),
    "constraint_summary": "SELECT count(*) FILTER (passed) AS pass_count, count(*) FILTER (NOT passed) AS fail_count, "
    "count(*) AS total_count, round(count(*) FILTER (passed) / count(*)::DOUBLE, 6) AS overall_score "
    f"FROM ({LINEITEM_RESULTS})",
    "constraint_table": "SELECT \"column\", list_aggregate(list_transform(string_split(type, '_'), "
    "lambda w: upper(left(w, 1)) || substring(w, 2)), 'string_agg', ' ') AS constraint_type, value, "
    "CASE WHEN passed THEN '✓ Passed' ELSE '✗ Failed' END AS status, "
    "printf('%.1f%%', pass_rate * 100) AS pass_rate, error "
    f"FROM ({LINEITEM_RESULTS})",
    # assessment
    "assessment": union([assessed(t) for t in ("customer", "orders", "part", "supplier")]),
    "report_row_noacc": report("customer"),
    # corpus and retrieval
    "chunk_fixed": CHUNKS,
    "knn_topk": f"WITH {NEIGHBOURS} SELECT query_id, rank::INTEGER AS rank, id, round(distance, 6) AS distance FROM results",
    "knn_recall": "SELECT count(*) AS queries, 5::BIGINT AS least_rows, true AS recall_reached FROM embeddings",
    "knn_pruned": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS id,
                         list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
                  FROM v q, v c)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank, id,
               round(distance, 6) AS distance
        FROM pairs QUALIFY rank <= 5""",
    "knn_compressed_recall": "SELECT count(*) AS queries, 5::BIGINT AS least_rows, true AS recall_reached, "
    "true AS few_compared FROM embeddings",
    "section_title": f"SELECT doc_id, {section('text')} AS section FROM documents",
    "key_phrases": "SELECT doc_id, (pos - 1)::INTEGER AS position, phrase FROM (SELECT doc_id, unnest(p) AS phrase, "
    f"generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, {phrases('text')} AS p FROM documents))",
    "citations": f"WITH {CITED} SELECT query_id, rank, citation_id, source, source_filename, page, content, "
    "round(score, 6) AS score, section FROM cited",
    "context_text": f"WITH {CITED} SELECT query_id, string_agg('Document ' || rank || ' [#' || citation_id || '] (Source: ' || "
    "source_filename || ', Page: ' || page || '):' || chr(10) || content || chr(10), chr(10) ORDER BY rank) AS context "
    "FROM cited GROUP BY query_id",
    "reference_section": f"WITH {CITED} SELECT query_id, '**References:**' || chr(10) || string_agg('[' || rank || '] ' || "
    "source_filename || CASE WHEN section <> 'Unknown section' THEN ': ' || section ELSE '' END, "
    "chr(10) ORDER BY rank) AS reference_section FROM cited GROUP BY query_id",
    "citation_attribution": ATTRIBUTION,
    "citation_markup": MARKUP,
    "answer_finish": FINISHED,
    "citation_renumber": "SELECT conv_id, turn, text || ' [1] and [2] and [1]' AS text FROM conversations WHERE role = 'assistant'",
    "citation_resolve": f"""
        WITH users AS (SELECT conv_id, turn + 1 AS n, turn, text FROM conversations WHERE role = 'user'),
        answers AS (SELECT conv_id, turn, unnest([turn, 1]) AS n, unnest([0, 1]) AS position
                    FROM conversations WHERE role = 'assistant')
        SELECT a.conv_id || '/' || a.turn AS response_id, a.position::INTEGER AS position, a.n::BIGINT AS n,
               {section('u.text')} AS section, 'conversations' AS source, u.turn::VARCHAR AS page,
               CASE WHEN length(u.text) > 200 THEN left(u.text, 200) || '...' ELSE u.text END AS preview
        FROM answers a JOIN users u ON a.conv_id = u.conv_id AND a.n = u.n""",
    "prompt_frames": PROMPTS,
    "chunk_checks": "SELECT doc_id, true AS all_short, true AS all_inside, true AS all_unit, true AS all_words "
    "FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0",
    "report_fields": f"""
        SELECT 'Data Privacy and Quality Analysis' AS report_type, '2024-01-01T00:00:00' AS timestamp,
               'customer' AS name, {rows_of('customer')} AS num_rows, {len(TABLES['customer'])} AS num_columns,
               round(overall_privacy_score, 6) AS overall_privacy_score,
               round(avg_shannon_entropy, 6) AS avg_shannon_entropy,
               round(avg_hartley_measure, 6) AS avg_hartley_measure,
               round(completeness, 6) AS completeness, round(validity, 6) AS validity,
               round(uniqueness, 6) AS uniqueness, round(integrity, 6) AS integrity,
               round(consistency, 6) AS consistency, ({duplicates_of('customer')})::BIGINT AS duplicate_rows
        FROM ({summary('customer')}), ({quality_scores('customer')})""",
    "accuracy_checks": union(
        [
            f"SELECT '{c}' AS column_name, count(*) AS num_rows, true AS only_numeric, "
            "true AS at_most_a_tenth, true AS adds_up FROM orders"
            for c in TABLES["orders"]
        ]
    ),
    # interactions and streams
    "chat_append": """
        WITH first AS (SELECT conv_id, arg_min(text, turn) AS asked FROM conversations
                       WHERE role = 'user' GROUP BY conv_id),
        ends AS (SELECT conv_id, max(turn) + 1 AS next FROM conversations GROUP BY conv_id)
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL
        SELECT conv_id, next, 'user', 'Again: ' || asked FROM first JOIN ends USING (conv_id)
        UNION ALL
        SELECT conv_id, next + 1, 'assistant', 'As said: ' || left(asked, 20)
        FROM first JOIN ends USING (conv_id)""",
    "feedback_latest": FEEDBACK,
    "chat_history": "SELECT conv_id, turn, role, text AS content FROM conversations",
    "stream_value_frequencies": frequencies("events"),
    "stream_entropy_profile": column_metrics(
        "events", "privacy_factor", "shannon_entropy", "hartley_measure"
    ),
    "stream_feedback": FEEDBACK,
    "stream_hourly_windows": HOURLY,
    "stream_user_sessions": SESSIONS,
    "user_sessions": SESSIONS,
    "distinct_sketches": union(
        [
            f"SELECT '{c}' AS column_name, count(*) AS total_count, "
            f"count(DISTINCT {c}) AS distinct_count, true AS within_bound FROM lineitem"
            for c in TABLES["lineitem"]
        ]
    ),
    "identifying_sets": identifying(
        "lineitem",
        [
            "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
            "l_shipdate",
        ],
        5,
        4,
    ),
    "identifying_sets_customer": identifying("customer", list(TABLES["customer"]), 5, 3),
}


def integrity_overall(source: str) -> str:
    ids = "named OR unique_ratio > 0.9::DOUBLE"
    return with_source(
        source,
        f"SELECT {names(ids)} AS potential_id_columns, round({INTEGRITY}, 6) AS overall_score "
        f"FROM ({quality_rows(source)})",
    )


ORACLES["corpus_page_files"] = (
    "SELECT doc_id, sha256(replace(text, chr(12), ' ')) AS text_sha256, true AS in_order FROM documents"
)
ORACLES["ingest_refresh"] = (
    "SELECT doc_id, CASE WHEN doc_id % 6 IN (3, 4) THEN 2 ELSE 1 END::INTEGER AS run, true AS embedded "
    "FROM documents WHERE doc_id % 6 <> 5 AND "
    "length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0"
)
ORACLES["constraint_unique_keys"] = ORACLES["constraint_unique"]
ORACLES["duplicate_rows_whole"] = (
    "SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) "
    "AS duplicate_rows FROM lineitem"
)
ORACLES["distinct_counts_keys"] = union(
    [
        f"SELECT '{c}' AS column_name, count(*) AS total_count, count(*) - count({c}) AS missing_count, "
        f"count({c}) AS value_count, count(DISTINCT {c}) AS distinct_count, "
        f"count({c}) - count(DISTINCT {c}) AS duplicate_count FROM orders"
        for c in TABLES["orders"]
    ]
)
ORACLES["integrity_overall"] = integrity_overall("customer")
ORACLES["integrity_overall_nulls"] = integrity_overall("orders_nulls")
