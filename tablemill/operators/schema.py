"""What the commands hold, said once: for each command its slots, and for each kind of slot how a form
fills it and how a command is checked.

A form has fields: `column` and `second` (columns of the frame), `value` and `extra` (what was typed),
`operator` and `when`. A slot names the field that it takes and what stands there if that is empty.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from tablemill.frame import FrameError, PreparedFrame, make_column_id

#: What forms fill in where nothing was typed.
DEFAULTS = {
    "newColumn": "Nova coluna", "header": "Sem título", "newColumns": ("Parte 1", "Parte 2"), "delimiter": " ", "locale": "pt-BR", "currency": "BRL",
    "direction": "asc", "keep": "first", "inputFormat": "auto", "outputFormat": "yyyy-MM-dd", "decimalSeparator": ".",
}


@dataclass(frozen=True)
class Slot:
    name: str
    kind: str
    #: Field of the form, or fields.
    of: str = "value"
    choices: tuple[str, ...] = ()
    #: Of records: their own slots.
    parts: tuple[Slot, ...] = ()
    needed: bool = True

    @property
    def default(self) -> object:
        return DEFAULTS.get(self.name, "")


@dataclass(frozen=True)
class Form:
    frame: PreparedFrame
    fields: dict = field(default_factory=dict)

    def __getitem__(self, name: str) -> object:
        return self.fields.get(name)


def column(name: str = "columnId", of: str = "column") -> Slot:
    return Slot(name, "column", of)


def columns(of: str = "column", needed: bool = True) -> Slot:
    return Slot("columnIds", "columns", of, needed=needed)


def text(name: str = "value", of: str = "value") -> Slot:
    return Slot(name, "text", of)


def cell(name: str = "value", of: str = "value", needed: bool = True) -> Slot:
    return Slot(name, "cell", of, needed=needed)


def choice(name: str, *choices: str) -> Slot:
    return Slot(name, "choice", choices=choices)


def record(name: str, *parts: Slot, many: bool = False) -> Slot:
    return Slot(name, "records" if many else "record", parts=parts)


def constant(name: str, x: object) -> Slot:
    return Slot(name, "constant", choices=(x,), needed=False)


WHEN = Slot("when", "condition", "when", needed=False)
PREDICATE = record("condition", constant("type", "predicate"), column(), constant("operator", "equals"), record("operand", constant("type", "literal"), cell()))

#: The slots of each command.
SLOTS: dict[str, tuple[Slot, ...]] = {
    # cells
    "prefix": (column(), text(), WHEN),
    "suffix": (column(), text(), WHEN),
    "fixedValue": (column(), cell(), WHEN),
    "findReplace": (columns(), cell("find"), cell("replace", "extra"), constant("caseSensitive", False), WHEN),
    "conditionalRule": (Slot("condition", "condition or", "when", parts=(PREDICATE,)), record("updates", column(of="second"), cell(of="extra"), many=True)),
    "dateConversion": (column(), choice("inputFormat"), choice("outputFormat", "dd/MM/yyyy", "yyyy-MM-dd"), WHEN),
    "numberConversion": (column(), choice("decimalSeparator", ",", "."), WHEN),
    "currencyConversion": (column(), text("locale"), text("currency", "extra"), WHEN),
    # rows
    "sort": (record("sorts", column(), choice("direction", "asc", "desc"), many=True),),
    "filter": (column(), Slot("operator", "text", "operator"), cell(needed=False)),
    "deduplicate": (columns(), choice("keep", "first", "last")),
    "removeEmptyRows": (columns(needed=False),),
    # columns
    "renameHeader": (column(), text("header")),
    "reorderColumns": (Slot("columnIds", "columns first", "column"),),
    "splitColumn": (column(), text("delimiter"), Slot("newColumns", "new columns", "extra"), WHEN),
    "combineColumns": (columns("column second"), text("separator"), Slot("newColumn", "new column", "extra"), WHEN),
    "calculatedColumn": (
        Slot("newColumn", "new column"),
        record("expression", constant("type", "binary"), Slot("operator", "text", "operator"), record("left", constant("type", "column"), column()), Slot("right", "operand", "extra second")),
        WHEN,
    ),
}


def literal_of(typed: str) -> object:
    """A number if the text is one (nothing but spaces is 0), else the text."""
    bare = typed.strip()
    if not bare:
        return 0.0
    return float(bare) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", bare) and math.isfinite(float(bare)) else typed


def new_column(form: Form, header: object, ahead: int = 0) -> dict:
    return {"id": make_column_id(str(header), len(form.frame.ids) + ahead), "header": header}


def operand(slot: Slot, form: Form) -> dict:
    typed, other = (form[f] for f in slot.of.split())
    return {"type": "column", "columnId": other} if typed == "" else {"type": "literal", "value": literal_of(str(typed))}


def headers(slot: Slot, form: Form) -> list[dict]:
    typed = [h for h in map(str.strip, str(form[slot.of]).split(",")) if h]
    return [new_column(form, h, k) for k, h in enumerate(typed or slot.default)]


#: How a form fills a slot, by kind.
FILLED: dict[str, Callable[[Slot, Form], object]] = {
    "column": lambda slot, form: form[slot.of],
    "columns": lambda slot, form: [form[f] for f in slot.of.split()],
    "columns first": lambda slot, form: [form[slot.of], *[c for c in form.frame.ids if c != form[slot.of]]],
    "cell": lambda slot, form: form[slot.of],
    "text": lambda slot, form: form[slot.of] or slot.default,
    "choice": lambda slot, form: form[slot.of] if form[slot.of] in slot.choices else slot.default,
    "constant": lambda slot, form: slot.choices[0],
    "condition": lambda slot, form: form[slot.of],
    "condition or": lambda slot, form: form[slot.of] or filled(slot.parts[0].parts, form),
    "record": lambda slot, form: filled(slot.parts, form),
    "records": lambda slot, form: [filled(slot.parts, form)],
    "new column": lambda slot, form: new_column(form, form[slot.of] or slot.default),
    "new columns": headers,
    "operand": operand,
}


def filled(slots: tuple[Slot, ...], form: Form) -> dict:
    """What a form's fields make of slots; a condition that was not given is left out."""
    made = {s.name: FILLED[s.kind](s, form) for s in slots}
    return {s.name: made[s.name] for s in slots if s.kind != "condition" or made[s.name]}


def check_slots(frame: PreparedFrame, slots: tuple[Slot, ...], held: dict, what: str) -> None:
    """Raises for slots that are missing, columns that the frame lacks and choices that are none."""
    for s in slots:
        if s.name not in held:
            if s.needed:
                raise FrameError(f"O comando {what} precisa de {s.name}.")
            continue
        x = held[s.name]
        if s.kind in ("column", "columns", "columns first"):
            for c in [x] if s.kind == "column" else x or []:
                frame.info(c)
        elif s.kind == "choice" and s.choices and x not in s.choices:
            raise FrameError(f"Opção desconhecida de {what}: {x}")
        elif s.kind == "records":
            for each in x:
                check_slots(frame, s.parts, each, what)


def check_command(frame: PreparedFrame, cmd: dict) -> None:
    check_slots(frame, SLOTS.get(cmd["type"], ()), cmd, cmd["type"])
