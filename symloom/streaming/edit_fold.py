"""The fold of one document's events: each edit needs the text the edits before it left."""

from __future__ import annotations


class EditError(Exception):
    pass


class Buffer:
    """A text with the lengths of its lines, so that a place becomes an offset and an edit one splice.

    An edit inside one line may leave newlines in it: its length then spans them until the batch is over.
    """

    def __init__(self, text: str):
        self.text = text
        self.lengths = [len(line) for line in text.split("\n")]

    def _start(self, line: int) -> int:
        return sum(self.lengths[:line]) + line

    def _replace(self, start: int, end: int, first: int, last: int, new: str, split: bool) -> None:
        """Put ``new`` in place of the offsets, which lie in the lines ``first`` and ``last``."""
        opening, closing = self._start(first), self._start(last) + self.lengths[last]
        head, rest = self.text[opening:start] + new, closing - end
        sizes = [len(piece) for piece in head.split("\n")] if split else [len(head)]
        sizes[-1] += rest
        self.text = self.text[:start] + new + self.text[end:]
        self.lengths = [*self.lengths[:first], *sizes, *self.lengths[last + 1 :]]

    def edit(self, edit: dict, corrected: bool) -> None:
        """One edit; raises before anything is changed."""
        new = edit["text"] or ""
        if corrected and edit["sl"] is None:
            self.__init__(new)
            return
        first, column, last, until = (edit[key] or 0 for key in ("sl", "sc", "el", "ec"))
        if max(first, last) >= len(self.lengths):
            raise EditError("line out of bounds")
        if corrected:
            until = min(until, self.lengths[last])
        if until > self.lengths[last]:
            raise EditError("column out of bounds")
        start = self._start(first) + min(column, self.lengths[first])
        self._replace(start, self._start(last) + until, first, last, new, corrected or first != last)

    def edited(self, edits: list[dict], corrected: bool) -> Buffer:
        """The text after an ordered batch of edits; raises and leaves this one as it is on an error."""
        work = Buffer.__new__(Buffer)
        work.text, work.lengths = self.text, self.lengths
        for edit in edits:
            work.edit(edit, corrected)
        spanning = any("\n" in (edit["text"] or "") for edit in edits)
        return Buffer(work.text) if spanning else work


class Document:
    """A document's state and the events applied to it. ``held`` is a state that it goes on from."""

    def __init__(self, held: dict | None = None):
        blank = dict.fromkeys(("language_id", "version", "text", "last_edit", "last_edited_line", "last_seq"))
        self.row = {"is_open": False, **blank} if held is None else dict(held)
        self.buffer = Buffer(self.row["text"] or "")

    @property
    def last_seq(self) -> int | None:
        return self.row["last_seq"]

    def apply(self, event: dict, corrected: bool) -> str | None:
        """Take one event in; the reason when it fails."""
        self.row["last_seq"] = event["seq"]
        kind = event["event"]
        if kind == "close":
            self.row["is_open"], self.buffer = False, Buffer("")
        elif kind == "open":
            self.row.update(
                is_open=True,
                language_id=event["language_id"],
                version=event["version"],
                last_edit=event["ts"],
                last_edited_line=0,
            )
            self.buffer = Buffer(event["text"] or "")
        elif not self.row["is_open"]:
            return "document not open"
        else:
            return self._change(event, corrected)
        return None

    def _change(self, event: dict, corrected: bool) -> str | None:
        edits = event["changes"] or []
        try:
            self.buffer = self.buffer.edited(edits, corrected)
        except EditError as failure:
            return str(failure)
        if corrected and edits:
            last = edits[-1]
            self.row.update(
                version=event["version"],
                last_edit=event["ts"],
                last_edited_line=(last["sl"] or 0) + (last["text"] or "").count("\n"),
            )
        return None

    def state(self) -> dict:
        if not self.row["is_open"]:
            blank = dict.fromkeys(("language_id", "version", "text", "last_edit", "last_edited_line"))
            return {**self.row, **blank}
        return {**self.row, "text": self.buffer.text}
