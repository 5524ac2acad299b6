"""DuckDB SQL of what `functions.results` reads and makes, for oracles: written from the rules, not from the functions."""

from __future__ import annotations


def _json(x: str) -> str:
    return f"(case when json_valid({x}) then {x} end)"


def member(x: str, path: str) -> str:
    return f"nullif(cast(json_extract({_json(x)}, '{path}') as varchar), 'null')"


def _err(x: str) -> str:
    code, data, message = (f"coalesce({member(x, '$.err.' + m)}, 'null')" for m in ("error_code", "data", "message"))
    return f"concat('{{\"__task_error__\":true,\"error_code\":', {code}, ',\"data\":', {data}, ',\"message\":', {message}, '}}')"


def error_of(x: str) -> str:
    """A result's error."""
    return f"case when json_type({_json(x)}) = 'OBJECT' and json_type({_json(x)}, '$.err') = 'OBJECT' then {_err(x)} end"


def failed(err: str) -> str:
    return f"concat('{{\"__task_result__\":true,\"ok\":null,\"err\":', {err}, '}}')"


def canonical(x: str) -> str:
    kind = f"coalesce(json_type({_json(x)}, '$.err'), 'NULL')"
    known = f"json_type({_json(x)}) = 'OBJECT' and (json_type({_json(x)}, '$.ok') is not null or json_type({_json(x)}, '$.err') is not null or json_type({_json(x)}, '$.__task_result__') is not null)"
    fine = f"concat('{{\"__task_result__\":true,\"ok\":', coalesce({member(x, '$.ok')}, 'null'), ',\"err\":null}}')"
    return f"case when {known} then case when {kind} = 'NULL' then {fine} when {kind} = 'OBJECT' then {failed(_err(x))} end end"


def error(code: str, message: str, data: str = "'null'") -> str:
    """An error of the system; code, message and data are SQL."""
    return f"concat('{{\"__task_error__\":true,\"error_code\":{{\"__builtin_task_code__\":\"', {code}, '\"}},\"data\":', {data}, ',\"message\":', to_json({message}), '}}')"


def seen(status: str, result: str, index: str, flow: str) -> str:
    """What an ended node's result is to others."""
    skipped = failed(error("'UPSTREAM_SKIPPED'", "'Upstream dependency was SKIPPED'", f"concat('{{\"dependency_index\":', {index}, '}}')"))

    def broken(message: str, stage: str) -> str:
        return failed(error("'RESULT_DESERIALIZATION_ERROR'", message, f"concat('{{\"workflow_id\":', to_json({flow}), ',\"task_index\":', {index}, ',\"stage\":\"{stage}\",\"status\":\"', {status}, '\"}}')"))

    no_json = broken(f"concat('Dependency result JSON corrupt (task_index=', {index}, ')')", "json_parse")
    no_result = broken(f"concat('Dependency result deser failed (task_index=', {index}, '): not a result')", "task_result_parse")
    return f"case when {status} = 'SKIPPED' then {skipped} when coalesce({result}, '') = '' then null when not json_valid({result}) or {result} = 'null' then {no_json} else coalesce({canonical(result)}, {no_result}) end"


#: A workflow's value of all its sinks, from `entries`, the members' text.
def value(entries: str) -> str:
    return f"concat('{{\"__task_result__\":true,\"ok\":{{', {entries}, '}},\"err\":null}}')"


CASE_NOT_MET = error("'WORKFLOW_SUCCESS_CASE_NOT_MET'", "'No success case was satisfied'")
