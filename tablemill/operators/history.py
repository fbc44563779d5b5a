"""A list of commands over a base frame, with undo and redo: the frame is always the base with
all commands applied, so nothing needs an inverse."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from tablemill.frame import PreparedFrame
from tablemill.operators.commands import apply


@dataclass
class PrepPipeline:
    base: PreparedFrame
    commands: list[dict] = field(default_factory=list)
    undone: list[dict] = field(default_factory=list)

    def execute(self, command: dict) -> PreparedFrame:
        """Adds a command if it fits the frame; what was undone is forgotten."""
        out = apply(self.frame(), command)
        self.commands.append(command)
        self.undone.clear()
        return out

    def undo(self) -> PreparedFrame:
        if self.commands:
            self.undone.append(self.commands.pop())
        return self.frame()

    def redo(self) -> PreparedFrame:
        if self.undone:
            self.commands.append(self.undone.pop())
        return self.frame()

    def frame(self) -> PreparedFrame:
        return apply(self.base, *self.commands)


def fingerprint(mode: str, keys: list[str], mappings: list, revision: int, rules: list[dict] = ()) -> str:
    """Equal for equal settings of a write plan; a plan made under another one is stale."""
    said = [[m.source, m.destination, m.status, m.value] for m in mappings]
    text = json.dumps([mode, list(keys), said, revision, list(rules)], sort_keys=True, ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


def columns_changed(before: PreparedFrame, after: PreparedFrame) -> bool:
    shape = lambda f: [(c.id, c.header, c.detected_type) for c in f.columns]
    return shape(before) != shape(after)


def rules_still_valid(rules: list[dict], frame: PreparedFrame) -> list[dict]:
    """Rules whose columns the frame still has."""
    from tablemill.operators.rules import referenced_columns

    return [r for r in rules if all(c in frame.ids for c in referenced_columns(r))]
