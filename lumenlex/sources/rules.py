"""Files of plain data that have to follow rules: a rule is a name and a test; what fails is listed by name."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable

Rule = tuple[str, Callable[[dict], bool]]


def broken(value: dict, rules: Iterable[Rule]) -> list[str]:
    """The names of the rules that ``value`` does not follow. A test that cannot even be made has failed."""
    out = []
    for name, test in rules:
        try:
            good = test(value)
        except (TypeError, ValueError, KeyError, IndexError, AttributeError):
            good = False
        if not good:
            out.append(name)
    return out


def demand(what: str, value: object, rules: Iterable[Rule]) -> None:
    """ValueError that names all rules which ``value`` breaks."""
    if wrong := ["an object"] if not isinstance(value, dict) else broken(value, rules):
        raise ValueError(f"{what}: not met: {'; '.join(wrong)}")


def is_count(x: object) -> bool:
    return type(x) is int and x >= 0


def shape(matrix: list) -> tuple[int, int]:
    """Rows and columns; ValueError where there are none or the rows differ."""
    (columns,) = {len(row) for row in matrix}
    if not columns:
        raise ValueError("no columns")
    return len(matrix), columns


def as_json(value: object, **how) -> str:
    """JSON as it is stored: text as it is, and no number that JSON lacks."""
    return json.dumps(value, ensure_ascii=False, allow_nan=False, **how)


def put(path: str, text: str, durable: bool = False) -> str:
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
        if durable:
            out.flush()
            os.fsync(out.fileno())
    return path


def parsed(path: str) -> object:
    """The JSON value of a file. FileNotFoundError without one, ValueError for anything else than JSON in UTF-8."""
    with open(path, "rb") as source:
        content = source.read()
    try:
        return json.loads(content.decode("utf-8"))
    except ValueError as error:
        raise ValueError(f"{path}: {error}") from error
