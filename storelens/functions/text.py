"""Recursive text splitting: the per-value helper of the chunk operator."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def _cut(text: str, mark: str) -> list[str]:
    """Cut in front of every `mark`, which stays with the text that follows it."""
    if mark == "":
        return list(text)
    head, *tail = text.split(mark)
    return [part for part in [head, *(mark + t for t in tail)] if part]


def _pack(parts: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring parts into windows of at most `size` characters.

    The next window starts again with as many of the last parts as fit both into
    `overlap` and, together with the part that follows, into `size`.
    """
    left, length = 0, 0
    for right, part in enumerate(parts):
        if length + len(part) > size and right > left:
            yield "".join(parts[left:right]).strip()
            while length > 0 and (length > overlap or length + len(part) > size):
                length -= len(parts[left])
                left += 1
        length += len(part)
    if left < len(parts):
        yield "".join(parts[left:]).strip()


def split_recursively(text: str, size: int, overlap: int, marks: Sequence[str]) -> list[str]:
    """Split at the coarsest mark that occurs; go finer only where a part is too long."""
    at = next((i for i, m in enumerate(marks) if m == "" or m in text), len(marks) - 1)
    mark, finer = marks[at], marks[at + 1:]
    pieces: list[str] = []
    fitting: list[str] = []
    for part in _cut(text, mark):
        if len(part) < size:
            fitting.append(part)
            continue
        pieces.extend(_pack(fitting, size, overlap))
        fitting = []
        pieces.extend(split_recursively(part, size, overlap, finer) if finer else [part])
    pieces.extend(_pack(fitting, size, overlap))
    return [p for p in pieces if p]
