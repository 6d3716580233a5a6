"""SQL errors with their SQLSTATE."""

from __future__ import annotations

# The SQLSTATE codes of the dialect and what each stands for.
STATES = {
    "0A000": "unsupported operation",
    "0AF00": "unsupported query",
    "21000": "a scalar subquery gave more than one row",
    "22000": "data exception",
    "22003": "numeric value out of range",
    "22012": "division by zero",
    "22023": "invalid parameter value",
    "22F03": "invalid binary representation",
    "22F3H": "invalid cast",
    "23502": "not-null constraint violated",
    "23505": "unique constraint violated",
    "42601": "syntax error",
    "42701": "duplicate column",
    "42702": "ambiguous column",
    "42703": "undefined column",
    "42803": "grouping error",
    "42804": "datatype mismatch",
    "42809": "wrong object type",
    "42883": "undefined function",
    "42F01": "undefined table",
    "42F04": "database already exists",
    "42F06": "schema already exists",
    "42F07": "table already exists",
    "42712": "duplicate alias",
    "42F10": "a column list of the wrong length",
    "42F64": "union branches have different numbers of columns",
    "42F65": "union branches have incompatible types",
    "54F01": "recursion limit exceeded",
}

# Spark error classes and the dialect's codes for them.
SPARK_STATES = {
    "ARITHMETIC_OVERFLOW": "22003",
    "BINARY_ARITHMETIC_OVERFLOW": "22003",
    "CAST_OVERFLOW": "22F3H",
    "NUMERIC_VALUE_OUT_OF_RANGE": "22003",
    "DIVIDE_BY_ZERO": "22012",
    "REMAINDER_BY_ZERO": "22012",
    "CAST_INVALID_INPUT": "22F3H",
    "SCALAR_SUBQUERY_TOO_MANY_ROWS": "21000",
    "DATATYPE_MISMATCH": "42804",
    "UNRESOLVED_COLUMN": "42703",
    "AMBIGUOUS_REFERENCE": "42702",
    "TABLE_OR_VIEW_NOT_FOUND": "42F01",
    "UNRESOLVED_ROUTINE": "42883",
    "MISSING_AGGREGATION": "42803",
    "MISSING_GROUP_BY": "42803",
    "NUM_COLUMNS_MISMATCH": "42F64",
    "INCOMPATIBLE_COLUMN_TYPE": "42F65",
    "RECURSION_LEVEL_LIMIT_EXCEEDED": "54F01",
    "RECURSION_ROW_LIMIT_EXCEEDED": "54F01",
    "PARSE_SYNTAX_ERROR": "42601",
}


class SQLError(Exception):
    """An error with a five-character SQLSTATE."""

    def __init__(self, state: str, message: str = ""):
        self.state = state
        super().__init__(f"{state}: {message or STATES.get(state, 'error')}")


def of_spark(error: Exception) -> SQLError | None:
    """What a Spark exception means in the dialect: a raised SQLSTATE, or that of its error class."""
    text = str(error)
    at = text.find("[SQLSTATE=")
    if at >= 0:
        return SQLError(text[at + 10 : at + 15], text[at + 16 : at + 200].split("\n")[0])
    get = getattr(error, "getCondition", None) or getattr(error, "getErrorClass", None)
    name = (get() if get else None) or ""
    for k, state in SPARK_STATES.items():
        if name.split(".")[0] == k or f"[{k}" in text:
            return SQLError(state, text.split("\n")[0][:300])
    return None
