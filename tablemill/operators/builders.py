"""Commands from what a form holds."""

from __future__ import annotations

from tablemill.frame import FrameError, PreparedFrame
from tablemill.operators.schema import SLOTS, Form, filled


def build(frame: PreparedFrame, kind: str, column: str, value: object = "", extra: object = "", second: str | None = None, operator: str = "==", when: dict | None = None) -> dict:
    """The command of that kind. value and extra are what its two fields hold, second the other
    column; new columns are numbered on from the frame's."""
    if kind not in SLOTS:
        raise FrameError(f"Comando desconhecido: {kind}")
    form = Form(frame, {"column": column, "second": second, "value": value, "extra": extra, "operator": operator, "when": when})
    return {"type": kind} | filled(SLOTS[kind], form)
