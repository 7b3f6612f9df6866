"""JSON as lines of path and value."""

from __future__ import annotations

import json


def flatten(text: str, most: int | None = None) -> str | None:
    """A line ``path: value`` for each leaf in order, a blank line before each element of an array that isn't a leaf; null for no JSON.

    Of more than ``most`` lines the rest is left out, which the last line tells.
    """
    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        return None
    out: list[str] = []
    todo = [("", root, False)]
    while todo:
        if most is not None and len(out) >= most:
            out.append(CUT)
            break
        path, value, parted = todo.pop()
        if parted and out:
            out.append("")
        if isinstance(value, dict) and value:
            todo += [(f"{path}.{k}" if path else k, v, False) for k, v in reversed(value.items())]
        elif isinstance(value, list) and value:
            todo += [(f"{path}[{i}]", v, isinstance(v, (dict, list))) for i, v in reversed(list(enumerate(value)))]
        else:
            out.append(f"{path}: {json.dumps(value, ensure_ascii=False)}")
    return "\n".join(out)


#: The line behind what was left out.
CUT = "..."
