"""Whether two runs may be compared, judged from their records alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from enum import IntEnum
from typing import Any

from .manifest import Record


class Trust(IntEnum):
    """In order of severity."""

    IDENTICAL = 0
    COMPARABLE = 1
    SUSPECT = 2
    INCOMPARABLE = 3


@dataclass(frozen=True)
class Verdict:
    level: Trust
    reasons: tuple[str, ...] = ()


Part = Mapping[str, Any]
#: What must be equal in both records: part (None: that of each compared step), field, level if it isn't, message.
EQUAL: tuple[tuple[str | None, str, Trust, str], ...] = (
    ("run", "schema", Trust.INCOMPARABLE, "the records follow different schemas"),
    ("data", "labels", Trust.INCOMPARABLE, "the runs answer different queries or were scored with different labels"),
    ("data", "corpus", Trust.INCOMPARABLE, "the runs searched different corpora"),
    (None, "version", Trust.SUSPECT, "{step} declares another meaning"),
    (None, "python", Trust.SUSPECT, "{step} ran under another Python"),
    (None, "platform", Trust.SUSPECT, "{step} ran on another platform"),
)
#: What must hold of each compared step of either record: condition of the fault, level, message.
SOUND: tuple[tuple[Callable[[Part], bool], Trust, str], ...] = (
    (lambda p: p["commit"] is None, Trust.SUSPECT, "{step} of the {side} run was made outside any git repository"),
    (lambda p: p["commit"] is not None and p["dirty"], Trust.SUSPECT, "{step} of the {side} run was made from a working tree with changes"),
)
#: Steps of different commits: level and message by whether sources that the step depends on changed.
COMMITS: dict[bool | None, tuple[Trust, str]] = {
    False: (Trust.COMPARABLE, "{step} was made at different commits, but no source that it depends on changed"),
    True: (Trust.SUSPECT, "{step} was made at different commits, and sources that it depends on changed"),
    None: (Trust.SUSPECT, "{step} was made at different commits, which can't be compared"),
}


def assess(left: Record, right: Record, stages: Iterable[str], code_changed: Mapping[str, bool | None] | None = None) -> Verdict:
    """The worst finding decides; what can't be told counts as changed."""
    found: list[tuple[Trust, str]] = []

    def equal(part: str | None, a: Part, b: Part, **words: str) -> None:
        for _, key, level, says in (rule for rule in EQUAL if rule[0] == part):
            if a[key] != b[key]:
                found.append((level, f"{says.format(**words)}: {a[key]} and {b[key]}"))

    for part in ("run", "data"):
        equal(part, left[part], right[part])
    for stage in sorted(set(stages)):
        step, sides = f"'{stage}'", {"left": left.step(stage), "right": right.step(stage)}
        for side, p in sides.items():
            if p is None:
                found.append((Trust.INCOMPARABLE, f"the {side} run has no step {step}"))
            else:
                found += [(level, says.format(step=step, side=side)) for fault, level, says in SOUND if fault(p)]
        a, b = sides.values()
        if a is None or b is None:
            continue
        equal(None, a, b, step=step)
        for package in sorted({*a["uses"], *b["uses"]}):
            x, y = (p["packages"].get(package, "none") for p in (a, b))
            if x != y:
                found.append((Trust.SUSPECT, f"{step} ran with {package} {x} and {y}"))
        if a["commit"] != b["commit"]:
            level, says = COMMITS[(code_changed or {}).get(stage)]
            found.append((level, says.format(step=step)))
    return Verdict(max((level for level, _ in found), default=Trust.IDENTICAL), tuple(reason for _, reason in found))
