"""Results of tasks and workflows as JSON text: what can be read of them, and the ones that the engine makes.

A result is an object with a value (`ok`) or an error (`err`); tagged or not.
An error is an object. All texts that are written have one canonical form: no
blanks, the tag first, members in fixed order. Members keep their own text.

Every function takes and gives the text of a Spark SQL expression (a column's
name is one), as such expressions nest deeply; `F.expr` makes a column of it.
"""

from __future__ import annotations

from queuelens.functions.tagged import RESULT

# Tags of an encoded error and of a code that the system gave it.
ERROR, BUILT_IN = "__task_error__", "__builtin_task_code__"
# Codes of errors that the system makes.
SKIPPED, UNREADABLE = "UPSTREAM_SKIPPED", "RESULT_DESERIALIZATION_ERROR"
ENQUEUE_FAILED, NOT_SERIAL, NOT_LOADED = "WORKFLOW_ENQUEUE_FAILED", "WORKER_SERIALIZATION_ERROR", "SUBWORKFLOW_LOAD_FAILED"
CHILD_FAILED, NO_CASE = "SUBWORKFLOW_FAILED", "WORKFLOW_SUCCESS_CASE_NOT_MET"
CRASHED, EXPIRED = "WORKER_CRASHED", "TASK_EXPIRED"


def literal(value: str) -> str:
    """A string as a literal; it may hold neither quotes of SQL nor backslashes."""
    if "'" in value or "\\" in value:
        raise ValueError("not a plain text")
    return f"'{value}'"


def member(text: str, path: str) -> str:
    """A member of a JSON object as JSON text; null if it is absent or null. The text must be JSON."""
    # Behind a wildcard strings keep their quotes.
    return f"get_json_object(concat('[', {text}, ']'), '$[*]{path}')"


def is_json(text: str) -> str:
    return f"(try_parse_json({text}) is not null)"


def is_value(text: str) -> str:
    """Whether a text is JSON other than null; JSON's null counts as damaged, as readers can't tell the two."""
    return f"coalesce({is_json(text)} and trim({text}) <> 'null', false)"


def is_object(text: str) -> str:
    return f"coalesce({is_json(text)} and startswith(ltrim({text}), '{{'), false)"


def obj(**members: str) -> str:
    """JSON text of an object whose members are JSON texts; null members are JSON nulls."""
    parts = [f"""'{"," if i else "{"}"{name}":', coalesce({value}, 'null')""" for i, (name, value) in enumerate(members.items())]
    return f"concat({', '.join(parts)}, '}}')"


def text(value: str) -> str:
    """JSON text of a string; characters outside ASCII stay. Null is `null`."""
    return f"regexp_extract(to_json(array({value})), '(?s)^.(.*).$', 1)"


def error(code: str, message: str, data: str = "null") -> str:
    """Canonical text of an error of the system."""
    return obj(**{ERROR: "'true'", "error_code": obj(**{BUILT_IN: text(code)}), "data": data, "message": text(message)})


def failed(err: str) -> str:
    """The result that consists of an error's text."""
    return obj(**{RESULT: "'true'", "ok": "'null'", "err": err})


def _canonical_error(err: str) -> str:
    exception = member(err, ".exception")
    body = obj(**{ERROR: "'true'", "error_code": member(err, ".error_code"), "data": member(err, ".data"), "message": member(err, ".message")})
    return f"concat(regexp_extract({body}, '(?s)^(.*).$', 1), coalesce(concat(',\"exception\":', {exception}), ''), '}}')"


def _readable(value: str) -> str:
    return f"({is_object(value)} and arrays_overlap(json_object_keys({value}), array('{RESULT}', 'ok', 'err')))"


def error_of(value: str) -> str:
    """The error of a result, in canonical form; null if it has none or can't be read."""
    err = member(value, ".err")
    return f"case when {_readable(value)} and startswith({err}, '{{') then {_canonical_error(err)} end"


def canonical(value: str) -> str:
    """A result in canonical form; null if it can't be read."""
    err = member(value, ".err")
    fine = obj(**{RESULT: "'true'", "ok": member(value, ".ok"), "err": "'null'"})
    return f"case when {_readable(value)} then case when {err} is null then {fine} when startswith({err}, '{{') then {failed(_canonical_error(err))} end end"


def case_not_met() -> str:
    """The error of a workflow none of whose success cases is met."""
    return error(f"'{NO_CASE}'", "'No success case was satisfied'")


def seen_by_others(status: str = "status", result: str = "result", task_index: str = "task_index", workflow_id: str = "workflow_id") -> str:
    """What an ended node's result is to others: errors of the system for skipped nodes and unreadable results, null if there is none."""
    index = f"cast({task_index} as string)"

    def broken(message: str, stage: str) -> str:
        data = obj(workflow_id=text(workflow_id), task_index=index, stage=f"'\"{stage}\"'", status=text(status))
        return failed(error(f"'{UNREADABLE}'", message, data))

    skipped = failed(error(f"'{SKIPPED}'", "'Upstream dependency was SKIPPED'", obj(dependency_index=index)))
    no_json = broken(f"concat('Dependency result JSON corrupt (task_index=', {index}, ')')", "json_parse")
    no_result = broken(f"concat('Dependency result deser failed (task_index=', {index}, '): not a result')", "task_result_parse")
    return f"case when {status} = 'SKIPPED' then {skipped} when coalesce({result}, '') = '' then null when not {is_value(result)} then {no_json} else coalesce({canonical(result)}, {no_result}) end"
