"""JSON as language models write it: cleaned of reasoning and fences, repaired, and read."""

from __future__ import annotations

import ast
import json
import re

_THOUGHT = re.compile(r"<think>(.*?)</think>", re.S)
_FENCE = re.compile(r"\A```[^\n]*\n?(.*?)(?:\n[ \t]*```[ \t]*)?\Z", re.S)
_PIECE = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}\[\],]|[^"{}\[\],]+', re.S)
_CLOSER = {"{": "}", "[": "]"}


def cleaned(text: str) -> tuple[str, str]:
    """(reasoning, JSON text) of a model's answer.

    Reasoning may stand in closed tags, lack the opening tag, or never end (then there is no JSON).
    """
    text = text.strip()
    if found := _THOUGHT.search(text):
        thought, text = found[1].strip(), _THOUGHT.sub("", text).strip()
    elif text.startswith("<think>"):
        return text[len("<think>") :].strip(), "{}"
    else:
        head, tag, tail = text.partition("</think>")
        thought, text = (head.strip(), tail.strip()) if tag else ("", text)
    if text.startswith("```"):
        text = _FENCE.match(text)[1].strip()
    first, last = text.find("{"), text.rfind("}")
    return thought, text[first : last + 1] if 0 <= first < last else text


def repaired(text: str) -> str:
    """JSON with raw line ends in strings escaped, trailing commas dropped, and what is open closed."""
    out: list[str] = []
    open_: list[str] = []

    def drop_comma() -> None:
        while out and not out[-1].strip():
            out.pop()
        if out and out[-1] == ",":
            out.pop()
        elif out and out[-1].rstrip() != out[-1] and out[-1][0] != '"':
            out[-1] = out[-1].rstrip()

    for piece in _PIECE.findall(text.strip()):
        if piece[0] == '"':
            piece = piece.replace("\n", "\\n").replace("\r", "\\r")
            if len(piece) == 1 or not re.fullmatch(r'"(?:[^"\\]|\\.)*"', piece, re.S):
                piece = (piece[:-1] if piece.endswith("\\") else piece) + '"'
        elif piece in _CLOSER:
            open_.append(_CLOSER[piece])
        elif piece in ("}", "]"):
            drop_comma()
            if open_ and open_[-1] == piece:
                open_.pop()
        out.append(piece)
    drop_comma()
    return "".join(out) + "".join(reversed(open_)) or "{}"


def parsed(text: str) -> dict | None:
    """The object in a model's answer: as JSON, as repaired JSON, as a Python literal; None if none reads."""
    _, body = cleaned(text)
    for read in (json.loads, lambda b: json.loads(repaired(b)), ast.literal_eval):
        try:
            value = read(body)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
        if isinstance(value, dict):
            return value
    return None
